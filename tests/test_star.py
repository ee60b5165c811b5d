import pytest
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.functions.measures import Weight
from surveyspark.operators.filters import Options, Selection, is_partial
from surveyspark.plans import analyses as A
from surveyspark.plans import questions as Q
from surveyspark.plans import star as S
from surveyspark.sinks import reports, tables
from surveyspark.sources.dictionary import read_dictionary_csv
from surveyspark.sources.tables import read_spec_csv, read_star_table
from tests.conftest import rows


@pytest.fixture(scope="module")
def published(spark, labelled, dictionary, survey_files, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("star") / "trusted")
    table = read_dictionary_csv(spark, str(survey_files / "variaveis.csv_dict"))
    names = S.publish_star(labelled, dictionary, base, table)
    assert names == ["dim_tempo", "dim_perfil", "dim_localizacao", "base_saude",
                     "base_comportamento", "base_economico", "base_trabalho", "dim_dicionario"]
    return base


def test_tables_have_all_rows_and_indicators(spark, published):
    counts = tables.validate_counts({
        n: read_star_table(spark, published, n) for n in ("base_saude", "dim_perfil", "dim_tempo")
    })
    assert rows(counts, "table") == [("base_saude", 15), ("dim_perfil", 15), ("dim_tempo", 3)]
    health = read_star_table(spark, published, "base_saude").where(
        (F.col(V.PERIOD) == "2020-09") & (F.col("upa") == 100)
    )
    assert rows(health.select("id_morador", V.HAS_SYMPTOM, V.SYMPTOM_COUNT), "id_morador") == [
        ("01", 1, 1), ("02", 0, 0), ("03", 1, 2), ("04", 0, 0)]
    work = read_star_table(spark, published, "base_comportamento").where(F.col(V.PERIOD) == "2020-10")
    assert sorted(r[0] for r in rows(work.select(V.LABOUR_STATUS))) == [
        "Desocupado", "Fora da forca de trabalho", "Nao se aplica", "Ocupado - afastado",
        "Ocupado - trabalhou"]
    assert dict(health.dtypes)[V.PERIOD] == "string"


def test_declared_schema_equals_what_is_written(spark, published, dictionary):
    schemas = S.star_schemas(spark, dictionary)
    for name, schema in schemas.items():
        written = read_star_table(spark, published, name)
        declared = read_star_table(spark, published, name, schema)
        assert sorted(written.dtypes) == sorted(declared.dtypes)
        assert sorted(map(str, rows(written.select(sorted(written.columns))))) == sorted(
            map(str, rows(declared.select(sorted(written.columns)))))


def test_a_new_month_leaves_the_others_alone(spark, labelled, dictionary, tmp_path):
    base = str(tmp_path / "trusted")
    S.publish_star(labelled.where(F.col(V.PERIOD) != "2020-11"), dictionary, base)
    S.publish_star(labelled.where(F.col(V.PERIOD) == "2020-11"), dictionary, base)
    S.publish_star(labelled.where((F.col(V.PERIOD) == "2020-11") & (F.col("upa") == 100)), dictionary, base)
    got = read_star_table(spark, base, "base_saude").groupBy(V.PERIOD).count()
    assert rows(got, V.PERIOD) == [("2020-09", 5), ("2020-10", 5), ("2020-11", 4)]


def test_staging_goes_to_the_shared_folder(spark, labelled, dictionary, tmp_path, monkeypatch):
    class Conf:
        def get(self, name, otherwise):
            assert name == "spark.checkpoint.dir"
            return str(tmp_path / "shared")

    class Session:
        conf = Conf()

    assert S.shared_folder(Session(), "other") == str(tmp_path / "shared")
    shared = tmp_path / "shared"
    monkeypatch.setattr(S, "shared_folder", lambda *_: str(shared))
    S.publish_star(labelled, dictionary, str(tmp_path / "out"), keep_stage=True)
    assert [p.name.startswith("_decoded_") for p in shared.iterdir()] == [True]
    S.publish_star(labelled, dictionary, str(tmp_path / "out"))
    assert len(list(shared.iterdir())) == 1  # its own stage is gone again


def test_questions_on_the_published_star(spark, published):
    s = S.load_star(spark, published, weight=Weight(digits=2))
    # weights 100.5, 100.5, 50, 100.5 and one unreadable; 01 and 03 are symptomatic
    rate = round((100.5 + 50) / 351.5 * 100, 2)
    assert rows(Q.symptom_rate(s)) == [(m, rate) for m in ("2020-09", "2020-10", "2020-11")]
    by_region = rows(Q.symptom_rate_by_region(s).where(F.col(V.PERIOD) == "2020-10"))
    assert by_region == [("2020-10", "Sudeste", round(150.5 / 251 * 100, 2)), ("2020-10", "Norte", 0.0)]


def test_the_documented_key_multiplies_and_the_full_key_does_not(spark, published):
    full = S.load_star(spark, published).where(months=["2020-09"])
    narrow = full.where(keys=V.PANEL_KEY_WITH_PERIOD)
    by_full = dict(rows(A.symptom_rate_by(full, "faixa_etaria")))
    by_narrow = dict(rows(A.symptom_rate_by(narrow, "faixa_etaria")))
    # Person 01 exists in two units: on the narrow key the elder's band inherits the younger's symptom.
    assert by_full["75+"] == pytest.approx(100.0)
    assert by_narrow["75+"] == pytest.approx(100.0 * 150.5 / 150.5)
    narrow_pop = narrow.by_profile("base_saude", {"n": F.lit(1)}, ["faixa_etaria"])
    assert narrow_pop.agg(F.sum("n")).first()[0] == 7  # 2x2 + 3
    full_pop = full.by_profile("base_saude", {"n": F.lit(1)}, ["faixa_etaria"])
    assert full_pop.agg(F.sum("n")).first()[0] == 5


def test_an_inactive_selection_plans_no_join(spark, published):
    s = S.load_star(spark, published)
    options = Options(V.AGE_BANDS, ("Homem", "Mulher"), tuple(V.REGIONS))

    def plan(selection):
        df = Q.symptom_rate(s.where(selection=selection, options=options))
        return df._jdf.queryExecution().optimizedPlan().toString()

    for idle in (Selection(), Selection(V.AGE_BANDS, ["Homem", "Mulher"]), Selection([], [], [])):
        assert "Join" not in plan(idle)
    assert "Join" not in plan(Selection(regions=["Sul"]))  # the region follows from the state
    assert "Join LeftSemi" in plan(Selection(sexes=["Homem"]))


def test_selection_keeps_matching_people_once(spark, published):
    s = S.load_star(spark, published).where(
        keys=V.PANEL_KEY_WITH_PERIOD, months=["2020-09"],
        selection=Selection(age_bands=["30-44", "75+"]), options=Options(),
    )
    assert s.fact("base_saude").count() == 3  # both 01 rows and 03, nobody twice
    assert s.sums("base_saude", {"n": F.lit(1)}).first()["n"] == 3


def test_run_index_survives_a_failing_question(spark, published, tmp_path):
    s = S.load_star(spark, published)
    questions = [
        *[q for q in Q.question_set(s) if q.slug[:2] in ("01", "10")],
        reports.Question("08", "Máscara", lambda: s.tables["base_saude"].select("usa_mascara")),
    ]
    index = {r["slug"]: r for r in reports.run_index(spark, questions, str(tmp_path)).collect()}
    assert [(r["status"], r["linhas"], r["colunas"]) for r in index.values()] == [
        ("OK", 3, 2), ("OK", 15, 3), ("ERRO", 0, 0)]
    assert "usa_mascara" in index["08"]["erro"] and index["08"]["arquivo_csv"] is None
    back = read_spec_csv(spark, index["01_evolucao_geral_sintomas_gripais"]["arquivo_csv"])
    assert back.columns == ["MES_REF", "pct_populacao_com_sintoma_gripal"]
    assert [r[0] for r in back.collect()] == ["2020-09", "2020-10", "2020-11"]  # order kept


def test_report_csv_has_mark_and_one_file(spark, tmp_path):
    df = spark.createDataFrame([("á;b", 'q"q', "l1\nl2")], "x string, y string, z string")
    reports.write_spec_csv(df, str(tmp_path / "r"), sep=";", bom=True)
    files = list((tmp_path / "r").glob("*.csv"))
    assert len(files) == 1 and files[0].read_bytes().startswith(b"\xef\xbb\xbfx;y;z")
    assert rows(read_spec_csv(spark, str(tmp_path / "r"))) == [("á;b", 'q"q', "l1\nl2")]


def test_profile(spark, published):
    s = S.load_star(spark, published)
    got = tables.profile_tables(
        {"base_saude": s.tables["base_saude"], "dim_tempo": s.tables["dim_tempo"]}, w=V.WEIGHT)
    table = {(r["table"], r[V.PERIOD]): r for r in got.collect()}
    assert table[("base_saude", "TOTAL")]["rows"] == 15
    assert table[("base_saude", "2020-09")]["population"] == 351.5
    assert table[("dim_tempo", "TOTAL")]["population"] is None


def test_catalog_publication(spark, labelled, tmp_path):
    name = tables.publish_table(
        labelled.where(F.col(V.PERIOD) != "2020-11"), "tdb", "saude", str(tmp_path / "t"))
    tables.overwrite_period(labelled.where(F.col(V.PERIOD) == "2020-11"), str(tmp_path / "t"))
    tables.register_partitions(spark, name)
    assert rows(spark.table(name).groupBy(V.PERIOD).count(), V.PERIOD) == [
        ("2020-09", 5), ("2020-10", 5), ("2020-11", 5)]
    # publishing again replaces the table
    tables.publish_table(labelled.limit(1), "tdb", "saude", str(tmp_path / "t2"))
    assert spark.table(name).count() == 1


def test_rows_are_counted_while_they_are_written(spark, tmp_path):
    df = spark.range(40).select(F.col("id").alias("n"), F.concat(F.lit("a\nb"), "id").alias("text"))
    for k, part in enumerate((df, df.where("n < 0"), df.orderBy(F.desc("n")).limit(7), df.where("false").limit(3), df.groupBy().count())):
        assert reports.write_counted(part, str(tmp_path / str(k))) == part.count()
        assert read_spec_csv(spark, str(tmp_path / str(k)), ";").count() == part.count()


def test_run_index_survives_any_error(spark, tmp_path):
    def fails():
        raise KeyError("no_table")

    index = reports.run_index(spark, [reports.Question("x", "X", fails)], str(tmp_path)).collect()
    assert [(r["status"], r["erro"]) for r in index] == [("ERRO", "KeyError: 'no_table'")]


def test_the_stage_goes_when_a_table_fails(spark, labelled, dictionary, tmp_path, monkeypatch):
    def fails(df, path):
        raise RuntimeError("disk full")

    monkeypatch.setattr(S, "overwrite_period", fails)
    with pytest.raises(RuntimeError):
        S.publish_star(labelled, dictionary, str(tmp_path / "star"), stage=str(tmp_path / "stage"))
    assert not (tmp_path / "stage").exists()


def test_a_bucket_of_a_period_is_one_file(spark, labelled, tmp_path):
    name = tables.publish_table(labelled.repartition(6), "surveyspark_tests", "buckets", str(tmp_path / "t"), buckets=4, bucket_keys=["id_domicilio"])
    try:
        periods = labelled.select("MES_REF").distinct().count()
        assert 0 < len(list((tmp_path / "t").rglob("*.parquet"))) <= 4 * periods
        assert spark.table(name).count() == labelled.count()
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_a_selection_needs_no_known_options(spark, published):
    s = S.load_star(spark, published).where(selection=Selection(sexes=["Mulher"]))
    assert s.people() is not None and {r["sexo"] for r in s.people().select("sexo").distinct().collect()} == {"Mulher"}
    assert not is_partial(["a", "b", "b"], ["a", "b"]) and is_partial(["a", "a"], ["a", "b"]) and not is_partial([], [])
