"""Long KPI tables: one row per indicator and month, and per indicator over all months.

Each fact is aggregated once per month; the all-months rows are rolled up from the months.  The
``*_sums`` functions give these monthly sums, which ``plans.stored_sums`` can keep, so that an
added month reads only its own rows; the tables take them as ``sums``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.functions import measures as M
from surveyspark.functions.columns import overlap_groups, round_population, safe_ratio
from surveyspark.functions.measures import Ratio
from surveyspark.operators import weighted as W
from surveyspark.operators.reshape import stack
from surveyspark.plans import analyses as A
from surveyspark.plans.star import Survey


@dataclass(frozen=True)
class Kpi:
    """A ratio with the texts that describe it in a long table."""

    ratio: Ratio
    variable: str
    description: str
    group: str
    category: str | None = None
    amount: bool = False  # a mean in currency rather than a percentage


def row_structs(rows: Sequence[Sequence[Column]], names: Sequence[str]) -> Column:
    """An array of output rows."""
    return F.array(
        *[F.struct(*[value.alias(name) for name, value in zip(names, row)]) for row in rows]
    )


def long_table(sums: DataFrame, rows: Sequence[Sequence[Column]], names: Sequence[str]) -> DataFrame:
    """One output row per entry of ``rows`` for every input row."""
    return sums.select(F.inline(row_structs(rows, names)))


def by_grouping(
    sums: DataFrame, rows: Mapping[int, Sequence[Sequence[Column]]], names: Sequence[str]
) -> DataFrame:
    """Different output rows for each set of a :func:`~surveyspark.operators.weighted.regroup`."""
    chosen = None
    for index, entries in rows.items():
        condition, structs = F.col("grouping") == index, row_structs(entries, names)
        chosen = F.when(condition, structs) if chosen is None else chosen.when(condition, structs)
    return sums.select(F.inline(chosen))


def kpi_sums(s: Survey, table: str, kpis: Sequence[Kpi], **options) -> DataFrame:
    """Sums of the KPIs per month."""
    return s.sums(table, M.sums_of([k.ratio for k in kpis]), [V.PERIOD], **options)


#: Monthly sums by name.
Sums = Mapping[str, DataFrame]


def _text(value: str | None) -> Column:
    return F.lit(value).cast("string")


# ---- clinical ------------------------------------------------------------------------------


def _clinical_kpis(s: Survey) -> list[Kpi]:
    def kpi(column: str, label: str, group: str, value: str = V.YES) -> Kpi:
        ratio = M.share(column, A.has(column, value), s.weight, empty="zero")
        return Kpi(ratio, column, label, group, value)

    return [
        *[kpi(c, label, "sintoma") for c, label in V.SPEC_SYMPTOMS.items()],
        *[kpi(c, label, "comorbidade") for c, label in V.SPEC_COMORBIDITIES.items()],
        kpi(V.TEST_TAKEN, *V.KPI_TEXTS["test_taken"]),
        kpi(V.TEST_RESULT, *V.KPI_TEXTS["test_result"], V.POSITIVE),
    ]


def clinical_sums(s: Survey) -> dict[str, DataFrame]:
    return {"clinico": kpi_sums(s, "base_saude", _clinical_kpis(s))}


def clinical_spec(s: Survey, sums: Sums | None = None) -> DataFrame:
    """Symptoms, comorbidities and testing: population and percentage."""
    kpis, sums = _clinical_kpis(s), sums or clinical_sums(s)
    people = [
        s.weight.population(F.coalesce(F.col(k.ratio.num_sum), F.lit(0))) for k in kpis
    ]
    rows = [
        (F.col(V.PERIOD), _text(k.variable), _text(k.description), _text(k.category),
         round_population(p), k.ratio.result(), _text(k.group))
        for k, p in zip(kpis, people)
    ]
    names = ["mes_ref", "variavel", "descricao", "categoria", "pop_ponderada", "pct_ponderado",
             "grupo"]
    return long_table(W.roll_up(sums["clinico"], [V.PERIOD]), rows, names)


# ---- behaviour -----------------------------------------------------------------------------

BEHAVIOUR_COLUMNS = ["mes_ref", "variavel", "descricao", "pct_ponderado", "grupo"]


def _behaviour_kpis(s: Survey) -> tuple[Kpi, Kpi, Kpi, Kpi]:
    """Strict isolation, care seeking of all and of people with symptoms, home office."""
    strict = M.share("strict", A.has(V.ISOLATION, V.STRICT_ISOLATION), s.weight, empty="zero")
    care = M.share("care", A.has(V.CARE_SOUGHT), s.weight, empty="zero")
    remote = M.share("remote", A.has(V.HOME_OFFICE), s.weight, within=A.has(V.WORKED), empty="zero")
    return (
        Kpi(strict, V.ISOLATION, *V.KPI_TEXTS["strict"]),
        Kpi(care, "buscou_atendimento_saude_geral", *V.KPI_TEXTS["care_all"]),
        Kpi(care, "buscou_atendimento_saude_sintomaticos", *V.KPI_TEXTS["care_cases"]),
        Kpi(remote, V.HOME_OFFICE, *V.KPI_TEXTS["remote"]),
    )


def behaviour_sums(s: Survey) -> dict[str, DataFrame]:
    strict, care_all, care_cases, remote = _behaviour_kpis(s)
    # One pass by month and labour status serves the monthly indicators and the composition.
    return {
        "isolamento": kpi_sums(s, "base_saude", [strict]),
        "sintomaticos": kpi_sums(s, "base_comportamento", [care_cases], match="base_saude", match_where=A.symptomatic()),
        "situacao": s.sums(
            "base_comportamento", M.sums_of([care_all.ratio, remote.ratio]),
            [V.PERIOD, V.LABOUR_STATUS],
        ),
    }


def behaviour_spec(s: Survey, sums: Sums | None = None) -> DataFrame:
    """Isolation, care seeking and home office; labour-market shares over all months."""
    strict, care_all, care_cases, remote = _behaviour_kpis(s)
    sums = sums or behaviour_sums(s)

    def rows(kpis: Sequence[Kpi]) -> list[tuple[Column, ...]]:
        return [
            (F.col(V.PERIOD), _text(k.variable), _text(k.description), k.ratio.result(),
             _text(k.group))
            for k in kpis
        ]

    def monthly_table(name: str, kpi: Kpi) -> DataFrame:
        return long_table(W.roll_up(sums[name], [V.PERIOD]), rows([kpi]), BEHAVIOUR_COLUMNS)

    monthly, total, by_status = range(3)
    groups = W.regroup(
        sums["situacao"], [V.PERIOD, V.LABOUR_STATUS], [[V.PERIOD], [], [V.LABOUR_STATUS]]
    )
    groups = groups.withColumn(V.PERIOD, F.coalesce(V.PERIOD, F.lit(V.TOTAL)))
    classified = (F.col("grouping") == by_status) & (F.col(V.LABOUR_STATUS) != V.NOT_APPLICABLE)
    people = F.when(classified, F.col(s.weight.everyone))
    share = safe_ratio(people, F.sum(people).over(Window.partitionBy("grouping")), 100.0)
    groups = groups.withColumn("share", share)  # a row per month and status at most
    kpis = rows([care_all, remote])
    composition = [
        (_text(V.TOTAL), _text(V.LABOUR_STATUS), F.col(V.LABOUR_STATUS), F.col("share"),
         _text("mercado_trabalho"))
    ]
    behaviour = by_grouping(
        groups.where((F.col("grouping") != by_status) | F.col("share").isNotNull()),
        {monthly: kpis, total: kpis, by_status: composition}, BEHAVIOUR_COLUMNS,
    )
    return stack(
        [monthly_table("isolamento", strict), behaviour, monthly_table("sintomaticos", care_cases)]
    )


# ---- economy -------------------------------------------------------------------------------

ECONOMY_COLUMNS = [
    "mes_ref", "variavel", "descricao", "pct_ponderado", "valor_medio_ponderado", "grupo",
]


def _economic_kpis(s: Survey) -> tuple[list[Kpi], Ratio]:
    """Benefits and people without income; the mean income of those who have one."""
    benefits = [
        (V.AID, V.KPI_TEXTS["aid"]),
        (V.FAMILY_AID, V.KPI_TEXTS["family_aid"]),
        ("recebeu_seguro_desemprego", V.KPI_TEXTS["unemployment"]),
    ]
    kpis = [
        *[
            Kpi(M.share(c, A.has(c), s.weight, empty="zero"), c, *texts) for c, texts in benefits
        ],
        Kpi(A.aid_mean(s, "aid_mean", empty="zero"), V.AID_AMOUNT,
            *V.KPI_TEXTS["aid_mean"], amount=True),
        Kpi(M.share("no_income", F.col(V.HAS_INCOME) == 0, s.weight, empty="zero"),
            V.HAS_INCOME, *V.KPI_TEXTS["no_income"]),
    ]
    return kpis, M.mean("income_mean", V.INCOME, s.weight, where=F.col(V.INCOME) > 0)


def economic_sums(s: Survey) -> dict[str, DataFrame]:
    kpis, income_mean = _economic_kpis(s)
    overlap = overlap_groups(V.AID, V.FAMILY_AID, V.SPEC_OVERLAP_LABELS, V.YES, "unknown")
    # One pass by month, region and overlap group serves every block but the median.
    return {
        "economico": s.sums(
            "base_economico", M.sums_of([*[k.ratio for k in kpis], income_mean]),
            [V.PERIOD, "regiao", "grupo"], derive={"grupo": overlap},
        ),
        "rendas": A.earners(s, [V.PERIOD]),
    }


def economic_spec(s: Survey, sums: Sums | None = None) -> DataFrame:
    """Benefits and income by month; income, overlap and regional aid over all months."""
    kpis, income_mean = _economic_kpis(s)
    sums = sums or economic_sums(s) | {"rendas": A.earners(s)}
    nothing = F.lit(None).cast("double")

    def amount(variable: str, label: Column, value: Column, group: str) -> tuple[Column, ...]:
        return (_text(V.TOTAL), _text(variable), label, nothing, value, _text(group))

    monthly, total, by_region, by_overlap = range(4)
    groups = W.regroup(
        sums["economico"], [V.PERIOD, "regiao", "grupo"], [[V.PERIOD], [], ["regiao"], ["grupo"]]
    )
    groups = groups.withColumn(V.PERIOD, F.coalesce(V.PERIOD, F.lit(V.TOTAL)))
    everyone = F.col(s.weight.everyone)
    share = safe_ratio(everyone, F.sum(everyone).over(Window.partitionBy("grouping")), 100.0)
    groups = groups.withColumn("share", share)  # a few dozen rows
    kpi_rows = [
        (F.col(V.PERIOD), _text(k.variable), _text(k.description),
         nothing if k.amount else k.ratio.result(),
         k.ratio.result() if k.amount else nothing, _text(k.group))
        for k in kpis
    ]
    aid = A.aid_mean(s, "aid_mean")  # the monthly one's sums, null where nobody is paid
    mean_row = amount(V.INCOME, _text(V.KPI_TEXTS["income_mean"][0]), income_mean.result(), V.KPI_TEXTS["income_mean"][1])
    region_row = amount(
        "valor_auxilio_regiao", F.concat(F.lit(V.KPI_TEXTS["aid_by_region"][0]), "regiao"), aid.result(),
        V.KPI_TEXTS["aid_by_region"][1],
    )
    overlap_row = (
        _text(V.TOTAL), _text("sobreposicao_bf_ae"), F.col("grupo"), F.col("share"), nothing,
        _text("sobreposicao"),
    )
    blocks = by_grouping(
        groups.where((F.col("grouping") != by_region) | aid.result().isNotNull()),
        {monthly: kpi_rows, total: [*kpi_rows, mean_row], by_region: [region_row],
         by_overlap: [overlap_row]},
        ECONOMY_COLUMNS,
    )
    median = long_table(
        W.weighted_median(sums["rendas"], V.INCOME, A.earners_weight(s)),
        [amount(V.INCOME, _text(V.KPI_TEXTS["income_median"][0]), F.col("median").cast("double"), V.KPI_TEXTS["income_median"][1])],
        ECONOMY_COLUMNS,
    )
    return stack([blocks, median])
