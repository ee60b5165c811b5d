"""What the physical plans must look like, whatever the data size."""

import pytest

from bindings import analyses as bound
from bindings import panel
from surveyspark import fixed_values as V
from surveyspark.functions.measures import Weight, flag_rate
from surveyspark.operators import filters as FI
from surveyspark.operators import weighted as W
from surveyspark.operators.filters import Selection
from surveyspark.operators.joins import panel_join
from surveyspark.plans import analyses as A
from surveyspark.plans import questions as Q
from surveyspark.plans import specs
from surveyspark.plans.star import Survey, load_star, publish_star
from surveyspark.sinks.tables import publish_table
from tests.conftest import rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def star(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("plan_star"))
    d = panel.dictionary()
    from surveyspark.operators.recode import recode

    publish_star(recode(panel.raw_microdata(spark, SF), d), d, base, regions=panel.regions())
    return load_star(spark, base, weight=Weight(digits=2), regions=panel.regions())


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def analyses(star):
    return [
        A.symptom_prevalence(star), A.comorbidities_by_age(star), A.isolation_by_labour_status(star),
        A.care_places(star), A.regional_risk(star), A.headline_kpis(star), A.income_summary(star),
        A.benefit_overlap(star), A.away_reasons(star), specs.clinical_spec(star),
        specs.behaviour_spec(star), specs.economic_spec(star),
    ]


def test_no_python_and_no_cartesian_product(star):
    for df in analyses(star):
        plan = physical(df)
        for bad in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in plan, plan


def test_partition_and_column_pruning(star):
    plan = physical(A.symptom_prevalence(star.where(months=["1998"])))
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "PartitionFilters: [isnotnull(MES_REF" in scan or "PartitionFilters: [(" in scan
    read = scan.split("ReadSchema:")[1]
    assert "peso_amostral" in read and "sintoma_febre" in read
    assert "medico_deu_diagnostico" not in read and "id_domicilio" not in read


def test_answers_are_pushed_to_parquet(star):
    plan = physical(A.home_office_by_region(star))
    assert "EqualTo(trabalhou_na_semana,Sim)" in plan


def test_forty_kpis_are_one_pass_over_the_fact(star):
    plan = physical(specs.clinical_spec(star))
    assert plan.count("FileScan") == 1
    # months, then the few month rows once more for the total row
    assert plan.count("Exchange") == 2


def test_one_exchange_per_group_by(star):
    rate = flag_rate("pct", V.HAS_SYMPTOM, star.weight)
    table = W.ratio_table(star.tables["base_saude"], [rate], [V.PERIOD])
    assert physical(table).count("Exchange") == 1


def shuffles(df):
    """Lines of the plan that exchange rows by the panel key."""
    return [l for l in physical(df).splitlines() if "Exchange hashpartitioning" in l and "id_morador" in l]


def test_facts_meet_dimensions_already_summed(star, no_broadcast):
    repeating = star.where(keys=V.PANEL_KEY_WITH_PERIOD)
    plan = repeating.by_profile(
        "base_saude", {"w": star.weight.per_row()}, ["faixa_etaria"]
    )._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert plan[join:].count("Aggregate [") == 2


@pytest.mark.parametrize("keys", [V.FULL_KEY, V.PANEL_KEY_WITH_PERIOD])
def test_one_exchange_a_side_by_the_panel_key(spark, star, no_broadcast, keys):
    # The README's setting for panel joins; a pruning filter would show one side once more.
    spark.conf.set("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")
    s = star.where(keys=keys)
    for df in (
        A.comorbidities_by_age(s), A.isolation_by_labour_status(s), A.symptom_evolution_by_age(s),
        s.by_profile("base_saude", {"w": star.weight.per_row()}, ["faixa_etaria"], ["regiao", V.PERIOD]),
    ):
        assert len(shuffles(df)) == 2, physical(df)
    spark.conf.unset("spark.sql.optimizer.dynamicPartitionPruning.enabled")


def test_known_levels_do_not_change_the_tables(star):
    known = star.where(keys=V.PANEL_KEY_WITH_PERIOD)
    other = _Unlisted(**{f: getattr(known, f) for f in known.__dataclass_fields__})
    for table in (A.comorbidities_by_age, A.isolation_by_labour_status, A.symptom_evolution_by_age):
        # Shares of a group add doubles, in any order.
        a, b = (
            sorted(tuple(round(v, 9) if isinstance(v, float) else str(v) for v in r) for r in table(s).collect())
            for s in (known, other)
        )
        assert a == b and a


class _Unlisted(Survey):
    """A survey that does not know the values of its columns."""

    def sums(self, *args, **options):
        return super().sums(*args, **{k: v for k, v in options.items() if k != "levels"})

    def levels(self):
        return {}

    def _determined(self):
        return []


def test_bucketed_tables_join_without_a_shuffle(spark, star, no_broadcast, tmp_path):
    names = [
        publish_table(
            star.tables[t], "plandb", t, str(tmp_path / t), buckets=4, bucket_keys=V.PANEL_KEY)
        for t in ("base_saude", "dim_perfil")
    ]
    left, right = (spark.table(n) for n in names)
    joined = panel_join(left, right, V.PANEL_KEY, ["faixa_etaria"])
    plan = physical(joined)
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_running_weight_orders_slices_not_groups(star, no_broadcast):
    run = W.running_weight(star.tables["base_economico"], V.INCOME, star.weight)
    windows = [l for l in physical(run).splitlines() if "Window [" in l and V.INCOME in l]
    assert windows and all("__slice" in l for l in windows)


def test_median_reads_its_values_once(spark, star):
    df = W.weighted_median(star.tables["base_economico"], V.INCOME, star.weight)
    df.collect()
    plan = physical(df)
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 or "ReusedExchange" in final


@pytest.mark.parametrize("table", [A.regional_risk, A.headline_kpis, Q.regional_risk, A.isolation_by_labour_status])
@pytest.mark.parametrize("selection", [Selection(), Selection(("18-29",), ("Mulher",), panel.REGION_NAMES[:2])])
def test_tables_of_one_frame_are_read_once(spark, star, no_broadcast, table, selection):
    """Not once for each fact, and exchanged once by the panel key, not once a side; as if the facts were stored."""
    lazy = panel.survey(spark, SF).where(selection=selection)
    stored = star.where(selection=selection, keys=lazy.keys, options=lazy.options, month_labels=lazy.month_labels)
    assert rows(panel.rounded(table(lazy))) == rows(panel.rounded(table(stored)))
    passes = 2 if table is A.headline_kpis else 1  # the cases have a pass of their own
    assert len(_lines(table(lazy))) <= passes and len(shuffles(table(lazy))) <= passes


def _lines(df):
    return [l for l in physical(df).splitlines() if "FileScan" in l and "lineitem" in l]


def test_lines_are_exchanged_once(spark, no_broadcast):
    """Orders meet the customers before the lines meet the orders."""
    plan = panel.raw_microdata(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    top = plan[plan.index("Join Inner"):]
    assert "l_orderkey" in top.splitlines()[0]


def test_regions_are_chosen_before_hot_keys_are_counted(spark, star, monkeypatch):
    seen = []
    monkeypatch.setattr(FI, "semi_filter", lambda fact, *rest: seen.append(fact) or fact)
    FI.demographic_filter(
        star.tables["base_saude"], star.tables["dim_perfil"], Selection(("18-29",), (), ("ASIA",)),
        panel.survey(spark, SF).options, regions=panel.regions(), hot_keys=8,
    )
    states = {r["uf"] for r in seen[0].select("uf").distinct().collect()}
    assert states <= set(panel.regions()["ASIA"])


def test_lines_kept_by_year_are_read_by_year(spark):
    s = panel.survey_by_year(spark, SF).where(months=["1998"])
    plan = physical(s.period_rows("base_saude"))
    assert "Join" not in plan and "PartitionFilters: [isnotnull(MES_REF" in plan and "1998" in plan
    assert s.period_rows("base_saude").count() == panel.survey(spark, SF).where(months=["1998"]).period_rows("base_saude").count() > 0


def test_years_are_written_in_one_pass(spark, tmp_path, monkeypatch):
    """No copy of the raw lines that is read once for each year, and no sort of wide rows by year."""
    monkeypatch.setattr(bound, "scratch", lambda _: str(tmp_path))
    assert bound.QUESTIONS["end_to_end_symptom_rate_by_region"][0](spark, SF).count() > 0
    assert sorted(p.name for p in tmp_path.iterdir()) == ["files", "star"]
    folders = {p.name for p in (tmp_path / "files").iterdir() if p.is_dir()}
    assert len(folders) > 1 and folders <= {f"file=survey_12{y}.csv" for y in panel.YEARS}
