"""The report questions: small tables with two-decimal values, ready to be written as CSV."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.functions import measures as M
from surveyspark.functions.columns import round_population
from surveyspark.operators import weighted as W
from surveyspark.operators.reshape import round_columns
from surveyspark.plans import analyses as A
from surveyspark.plans.star import Survey
from surveyspark.sinks.reports import Question

MONTH, REGION = [V.PERIOD], [V.PERIOD, "regiao"]


def _monthly(s: Survey, table: str, *ratios: M.Ratio) -> DataFrame:
    result = A.table_of(s, table, ratios, MONTH)
    return round_columns(result, [r.name for r in ratios]).orderBy(V.PERIOD)


def _regional(s: Survey, table: str, ratio: M.Ratio, descending: bool = True) -> DataFrame:
    result = round_columns(A.table_of(s, table, [ratio], REGION, skip=["regions"]), [ratio.name])
    value = F.desc(ratio.name) if descending else F.asc(ratio.name)
    return result.orderBy(V.PERIOD, value, "regiao")


def symptom_rate(s: Survey) -> DataFrame:
    return _monthly(
        s, "base_saude", M.flag_rate("pct_populacao_com_sintoma_gripal", V.HAS_SYMPTOM, s.weight)
    )


def symptom_rate_by_region(s: Survey) -> DataFrame:
    return _regional(s, "base_saude", M.flag_rate("pct_sintoma_gripal", V.HAS_SYMPTOM, s.weight))


def symptom_rate_by_age(s: Survey) -> DataFrame:
    ratio = M.flag_rate("pct_sintoma_gripal", V.HAS_SYMPTOM, s.weight)
    sums = s.by_profile(
        "base_saude", ratio.sums(), ["faixa_etaria"], MONTH, skip=["age_bands"]
    )
    table = W.finish(sums, [ratio], [V.PERIOD, "faixa_etaria"])
    return round_columns(table, [ratio.name]).orderBy(V.PERIOD, "faixa_etaria")


def breathing_difficulty(s: Survey) -> DataFrame:
    return _monthly(
        s, "base_saude", M.share("pct_dificuldade_respirar", A.has(V.BREATHING), s.weight)
    )


def symptomatic_with_comorbidity(s: Survey) -> DataFrame:
    """Share of the whole population."""
    both = A.symptomatic() & A.any_comorbidity()
    return _monthly(
        s, "base_saude", M.share("pct_sintomaticos_com_comorbidade", both, s.weight)
    )


def care_seeking(s: Survey) -> DataFrame:
    return _monthly(
        s, "base_comportamento", M.share("pct_buscou_atendimento", A.has(V.CARE_SOUGHT), s.weight)
    )


def care_places(s: Survey) -> DataFrame:
    return round_columns(A.care_places(s), ["pct"])


def strict_isolation(s: Survey) -> DataFrame:
    """Asked in place of mask use, which the survey does not cover."""
    strict = A.has(V.ISOLATION, V.STRICT_ISOLATION)
    return _monthly(s, "base_saude", M.share("pct_rigorosamente_em_casa", strict, s.weight))


def home_office_by_region(s: Survey) -> DataFrame:
    """Share of the whole population, not of people who worked."""
    return _regional(
        s, "base_comportamento", M.share("pct_home_office", A.has(V.HOME_OFFICE), s.weight)
    )


def labour_status(s: Survey) -> DataFrame:
    table = A.population_of(s, "base_comportamento", [V.PERIOD, V.LABOUR_STATUS])
    return table.select(
        V.PERIOD, V.LABOUR_STATUS, round_population("pop").alias("populacao_estimada")
    ).orderBy(V.PERIOD, F.desc("populacao_estimada"), V.LABOUR_STATUS)


def emergency_aid(s: Survey) -> DataFrame:
    return _monthly(
        s, "base_economico",
        M.share("pct_recebeu_auxilio", A.has(V.AID), s.weight),
        A.aid_mean(s, "valor_medio_auxilio"),
    )


def income_by_region(s: Survey) -> DataFrame:
    return _regional(
        s, "base_economico", M.mean("renda_efetiva_media", V.INCOME, s.weight), descending=False
    )


def regional_risk(s: Survey) -> DataFrame:
    """Four indicators by month and region, each over the whole population."""
    columns = ["pct_sintomas", "pct_dificuldade_respirar", "pct_home_office",
               "pct_auxilio_emergencial"]
    parts = {
        "base_saude": [
            M.flag_rate(columns[0], V.HAS_SYMPTOM, s.weight),
            M.share(columns[1], A.has(V.BREATHING), s.weight)],
        "base_comportamento": [M.share(columns[2], A.has(V.HOME_OFFICE), s.weight)],
        "base_economico": [M.share(columns[3], A.has(V.AID), s.weight)],
    }
    panel = round_columns(A.tables_of(s, parts, REGION, skip=["regions"]), columns)
    return panel.orderBy(V.PERIOD, F.desc(columns[0]), "regiao")


# The reports of fixed_values.REPORTS in order.
REPORT_FUNCTIONS: tuple[Callable[[Survey], DataFrame], ...] = (
    symptom_rate,
    symptom_rate_by_region,
    symptom_rate_by_age,
    breathing_difficulty,
    symptomatic_with_comorbidity,
    care_seeking,
    care_places,
    strict_isolation,
    home_office_by_region,
    labour_status,
    emergency_aid,
    income_by_region,
    regional_risk,
)


def question_set(s: Survey) -> list[Question]:
    """The catalogue bound to a survey, for ``sinks.reports.run_index``."""
    reports = zip(V.REPORTS.items(), REPORT_FUNCTIONS, strict=True)
    return [Question(slug, title, partial(f, s)) for (slug, title), f in reports]
