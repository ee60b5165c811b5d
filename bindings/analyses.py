"""Analyses, report questions and KPI tables on the derived panel, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.panel import (
    JOIN_KEY,
    PANEL_SQL,
    REGION_NAMES,
    YEARS,
    avg_sql,
    dictionary,
    pct,
    pop,
    ratio_sql,
    raw_microdata,
    regions,
    rounded,
    scratch,
    survey,
    survey_by_year,
)
from surveyspark import fixed_values as V
from surveyspark.operators.filters import Options, Selection
from surveyspark.plans import analyses as A
from surveyspark.plans import questions as Q
from surveyspark.plans import specs as S
from surveyspark.functions.measures import Weight
from surveyspark.operators.recode import recode
from surveyspark.plans.star import Survey, load_star, publish_star, star_schemas
from surveyspark.plans.stored_sums import Definition, StoredSums
from surveyspark.sinks.tables import unsorted_writes
from surveyspark.sources import microdata as MD

Query = Callable[[SparkSession, str], DataFrame]

SICK = f"{V.HAS_SYMPTOM} = 1"
COMORBID = "(" + " OR ".join(f"{c} = 'Sim'" for c in V.COMORBIDITIES) + ")"
POSITIVE = f"{V.TEST_RESULT} = 'Positivo'"
STATUS = V.LABOUR_STATUS
APPLIES = f"{STATUS} <> 'Nao se aplica'"
LEVELS = ", ".join(f"'{level}'" for level in V.ISOLATION_LEVELS)
SHORT_LEVEL = (
    f"CASE {V.ISOLATION} "
    + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in V.ISOLATION_LEVELS.items())
    + " END"
)
LEVEL_ORDER = (
    f"CASE {V.ISOLATION} "
    + " ".join(f"WHEN '{a}' THEN {i}" for i, a in enumerate(V.ISOLATION_LEVELS, 1))
    + " END"
)
YEAR = "MES_REF AS mes_ref, 'Ano ' || MES_REF AS mes"


def yes(c: str) -> str:
    return f"{c} = 'Sim'"


def on(analysis: Callable[[Survey], DataFrame], **changes) -> Query:
    """An analysis over the panel, doubles rounded."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = survey(spark, sf_dir)
        return rounded(analysis(s.where(**changes) if changes else s))

    return run


def sql(body: str) -> str:
    return PANEL_SQL + body


def union(*parts: str) -> str:
    return sql(" UNION ALL ".join(parts))


def long(
    labels: Mapping[str, str], key: str, by: str = "", group: str = "", source: str = "m"
) -> str:
    """One SELECT per answer column."""
    tail = f" GROUP BY {group}" if group else ""
    return union(
        *[
            f"SELECT {by}{',' if by else ''} '{label}' AS {key}, {pct(yes(c))} AS pct "
            f"FROM {source}{tail}"
            for c, label in labels.items()
        ]
    )


# Joins of the panel with itself on the documented (non-unique) key.
def joined(columns: str, condition: str = "true") -> str:
    """Fact ``a`` joined with other rows ``b``; ``columns`` of b, all of a."""
    return f"(SELECT a.*, {columns} FROM m a JOIN m b ON {JOIN_KEY} WHERE {condition})"


BY_AGE = joined("b.faixa_etaria AS band, b.sexo AS sex")
SEEKERS = joined("1 AS one", f"b.{V.CARE_SOUGHT} = 'Sim'")
OF_CASES = joined("1 AS one", f"b.{SICK}")


def region_table(ratio: str, name: str, where: str) -> str:
    return union(
        f"SELECT regiao, {ratio} AS {name} FROM m WHERE {where} GROUP BY regiao",
        f"SELECT 'TOTAL' AS regiao, {ratio} AS {name} FROM m WHERE {where}",
    )


def overlap_sql(labels, unknown: bool) -> str:
    a, b = V.AID, V.FAMILY_AID
    no = (lambda c: f"{c} <> 'Sim'") if unknown else (lambda c: f"coalesce({c}, '') <> 'Sim'")
    both, only_a, only_b, none = labels
    return (
        f"CASE WHEN {yes(a)} AND {yes(b)} THEN '{both}' WHEN {yes(a)} AND {no(b)} THEN '{only_a}' "
        f"WHEN {no(a)} AND {yes(b)} THEN '{only_b}' ELSE '{none}' END"
    )


def distribution(category: str, name: str, where: str = "true", extra: str = "") -> str:
    return (
        f"SELECT {name}, {extra} round(CAST(p AS DOUBLE), 2) AS pop, "
        f"round(CAST(p AS DOUBLE) / CAST(sum(p) OVER () AS DOUBLE) * 100, 6) AS pct "
        f"FROM (SELECT {category} AS {name}, sum(w) AS p FROM m WHERE {where} GROUP BY 1)"
    )


def filtered(where_b: str = "", where_a: str = "true") -> str:
    """Rows of m with a matching profile row (a semi-join), as a CTE named f."""
    exists = f"AND EXISTS (SELECT 1 FROM m b WHERE {JOIN_KEY} AND {where_b})" if where_b else ""
    return f", f AS (SELECT * FROM m a WHERE {where_a} {exists}) "


MEDIAN = (
    f"(SELECT min(x) FROM (SELECT x, sum(p) OVER (ORDER BY x) AS c, sum(p) OVER () AS t FROM "
    f"(SELECT {V.INCOME} AS x, sum(w) AS p FROM m WHERE {V.INCOME} > 0 GROUP BY 1)) "
    f"WHERE 2 * c >= t)"
)
INCOME_MEAN = f"(SELECT {avg_sql(V.INCOME)} FROM m WHERE {V.INCOME} > 0)"
HISTOGRAM = (
    "SELECT CAST(bin AS BIGINT) AS bin, round((bin - 1) * 8000.0 / 60, 6) AS bin_lo, "
    "round(bin * 8000.0 / 60, 6) AS bin_hi, {pop} AS pop FROM (SELECT w, "
    "least(CAST(floor(least({x}, 8000) * 60 / 8000) AS INT) + 1, 60) AS bin FROM m "
    "WHERE {x} > 0 {drop}) GROUP BY bin"
)
RISK = (
    f"SELECT regiao, {YEAR}, {pct(SICK)} AS pct_sintomas, {pct(yes(V.BREATHING))} AS pct_dif_respirar, "
    f"{ratio_sql(yes(V.HOME_OFFICE), yes(V.WORKED))} AS pct_home_office, "
    f"{pct(yes(V.AID))} AS pct_auxilio FROM m GROUP BY regiao, MES_REF"
)

SELECTION = Selection(("18-29", "30-44"), ("Mulher",), REGION_NAMES[:2])
SELECTED_PEOPLE = "b.faixa_etaria IN ('18-29', '30-44') AND b.sexo = 'Mulher'"
SELECTED_REGION = "a.regiao IN ('AFRICA', 'AMERICA')"
REASON = (
    f"SELECT {V.AWAY_REASON} AS motivo, sum(w) AS p FROM m WHERE {yes(V.AWAY)} "
)

ANALYSES: dict[str, tuple[Query, str]] = {
    "symptom_prevalence": (on(A.symptom_prevalence), long(V.SYMPTOMS, "sintoma")),
    "symptom_evolution": (
        on(A.symptom_evolution), long(V.SYMPTOMS, "sintoma", YEAR, "MES_REF"),
    ),
    "symptom_evolution_matrix": (
        on(A.symptom_evolution_matrix),
        sql(f"SELECT {YEAR}, "
            + ", ".join(f'{pct(yes(c))} AS "{label}"' for c, label in V.SYMPTOMS.items())
            + " FROM m GROUP BY MES_REF"),
    ),
    "symptom_count": (on(A.symptom_count), sql(distribution(V.SYMPTOM_COUNT, "qtd"))),
    "testing_and_positivity": (
        on(A.testing),
        union(
            f"SELECT '{V.TEST_LABELS[0]}' AS indicador, {pct(yes(V.TEST_TAKEN))} AS pct FROM m",
            f"SELECT '{V.TEST_LABELS[1]}', {pct(POSITIVE)} FROM m",
            f"SELECT '{V.TEST_LABELS[2]}', {ratio_sql(POSITIVE, yes(V.TEST_TAKEN))} FROM m",
        ),
    ),
    "comorbidities_population_vs_positive": (
        on(A.comorbidities_vs_positive),
        union(
            *[
                f"SELECT '{label}' AS comorbidade, {pct(yes(c), within)} AS pct, '{group}' AS grupo FROM m"
                for group, within in ((V.POPULATION_GROUP, None), (V.POSITIVE_GROUP, POSITIVE))
                for c, label in V.COMORBIDITIES.items()
            ]
        ),
    ),
    "comorbidities_by_age": (
        on(A.comorbidities_by_age),
        long(V.COMORBIDITIES, "comorbidade", "band AS faixa_etaria", "band", BY_AGE),
    ),
    "symptom_rate_by_age": (
        on(lambda s: A.symptom_rate_by(s, "faixa_etaria")),
        sql(f"SELECT band AS categoria, {pct(SICK)} AS pct FROM {BY_AGE} GROUP BY band"),
    ),
    "symptom_rate_by_sex": (
        on(lambda s: A.symptom_rate_by(s, "sexo", drop_empty=True)),
        sql(f"SELECT sex AS categoria, {pct(SICK)} AS pct FROM {BY_AGE} "
            "WHERE sex IS NOT NULL GROUP BY sex"),
    ),
    "symptom_rate_by_age_and_sex": (
        on(A.symptom_rate_by_age_and_sex),
        sql(f"SELECT band AS faixa_etaria, sex AS sexo, {pct(SICK)} AS pct FROM {BY_AGE} "
            "GROUP BY band, sex"),
    ),
    "symptom_rate_age_sex_matrix": (
        on(lambda s: A.symptom_rate_age_sex_matrix(s, ["Homem", "Mulher"])),
        sql("SELECT band AS faixa_etaria, "
            + ", ".join(
                f"{pct(SICK, f'sex = {chr(39)}{x}{chr(39)}')} AS \"{x}\"" for x in ("Homem", "Mulher")
            )
            + f" FROM {BY_AGE} GROUP BY band"),
    ),
    "symptoms_by_region_and_month": (
        on(A.symptoms_by_region),
        sql(f"SELECT regiao, {pct(SICK)} AS pct, {YEAR} FROM m GROUP BY regiao, MES_REF"),
    ),
    "symptoms_by_region_left_join": (
        on(A.symptoms_by_region_joined),
        sql(f"SELECT MES_REF, rb AS regiao, {pct(SICK)} AS pct_sintoma FROM "
            f"(SELECT a.*, b.regiao AS rb FROM m a LEFT JOIN m b ON {JOIN_KEY}) GROUP BY MES_REF, rb"),
    ),
    "symptom_evolution_by_age": (
        on(A.symptom_evolution_by_age),
        sql(f"SELECT band AS faixa_etaria, {pct(SICK)} AS pct, {YEAR} FROM {BY_AGE} "
            "GROUP BY band, MES_REF"),
    ),
    "symptomatic_with_comorbidity": (
        on(A.symptomatic_with_comorbidity),
        sql(f"SELECT {pct(COMORBID, SICK)} AS pct_entre_sint, "
            f"{pct(f'{SICK} AND {COMORBID}')} AS pct_populacao FROM m"),
    ),
    "isolation_levels": (
        on(A.isolation_levels),
        sql(
            "SELECT nivel, ordem, pop, pct FROM ("
            + distribution(f"{SHORT_LEVEL}", "nivel", f"{V.ISOLATION} IN ({LEVELS})")
            + f") JOIN (SELECT DISTINCT {SHORT_LEVEL} AS nivel, {LEVEL_ORDER} AS ordem FROM m) USING (nivel)"
        ),
    ),
    "isolation_by_labour_status": (
        on(A.isolation_by_labour_status),
        sql(
            "SELECT situacao, restricao, round(CAST(p AS DOUBLE), 2) AS pop, round(CAST(p AS DOUBLE) / "
            "CAST(sum(p) OVER (PARTITION BY situacao) AS DOUBLE) * 100, 6) AS pct FROM "
            f"(SELECT st AS situacao, {SHORT_LEVEL} AS restricao, sum(w) AS p FROM "
            + joined(f"b.{STATUS} AS st", f"b.{APPLIES} AND a.{V.ISOLATION} IN ({LEVELS})")
            + " GROUP BY 1, 2)"
        ),
    ),
    "behaviour_evolution": (
        on(A.behaviour_evolution),
        union(
            *[
                f"SELECT '{label}' AS indicador, {ratio} AS pct, {YEAR} FROM m GROUP BY MES_REF"
                for label, ratio in zip(
                    V.BEHAVIOUR_LABELS,
                    (
                        pct(f"{V.ISOLATION} = '{V.STRICT_ISOLATION}'"),
                        pct(yes(V.CARE_SOUGHT)),
                        pct(yes(V.HOME_OFFICE), yes(V.WORKED)),
                    ),
                )
            ]
        ),
    ),
    "care_seeking": (
        on(A.care_seeking),
        union(
            f"SELECT '{V.POPULATION_GROUP}' AS grupo, {pct(yes(V.CARE_SOUGHT))} AS pct FROM m",
            f"SELECT '{V.SYMPTOMATIC_GROUP}', {pct(yes(V.CARE_SOUGHT))} FROM {OF_CASES}",
        ),
    ),
    "care_places": (on(A.care_places), long(V.CARE_PLACES, "local", source=SEEKERS)),
    "labour_status_distribution": (
        on(A.labour_status_population), sql(distribution(STATUS, "situacao", APPLIES)),
    ),
    "labour_status_evolution": (
        on(A.labour_status_evolution),
        sql(
            f"SELECT situacao, round(CAST(p AS DOUBLE), 2) AS pop, round(CAST(p AS DOUBLE) / "
            f"CAST(sum(p) OVER (PARTITION BY MES_REF) AS DOUBLE) * 100, 6) AS pct, {YEAR} FROM "
            f"(SELECT MES_REF, {STATUS} AS situacao, sum(w) AS p FROM m WHERE {APPLIES} GROUP BY 1, 2)"
        ),
    ),
    "labour_status_by_age_one_month": (
        on(A.labour_status_by_age, months=["1998"]),
        sql(f"SELECT band AS faixa_etaria, {STATUS}, {pop()} AS populacao_estimada FROM "
            f"(SELECT a.*, b.faixa_etaria AS band FROM m a LEFT JOIN m b ON {JOIN_KEY} "
            f"WHERE a.MES_REF = '1998') GROUP BY 1, 2"),
    ),
    "home_office_by_region": (
        on(A.home_office_by_region), region_table(pct(yes(V.HOME_OFFICE)), "pct", yes(V.WORKED)),
    ),
    "home_office_evolution": (
        on(A.home_office_evolution),
        sql(f"SELECT regiao, {pct(yes(V.HOME_OFFICE))} AS pct, {YEAR} FROM m "
            f"WHERE {yes(V.WORKED)} GROUP BY regiao, MES_REF"),
    ),
    "away_reasons_share_of_shown": (
        on(A.away_reasons),
        sql("SELECT motivo, round(CAST(p AS DOUBLE), 2) AS pop, round(CAST(p AS DOUBLE) / "
            "CAST(sum(p) OVER () AS DOUBLE) * 100, 6) AS pct FROM ("
            + REASON + "GROUP BY 1 ORDER BY p DESC, motivo NULLS LAST LIMIT 6)"),
    ),
    "away_reasons_share_of_all": (
        on(lambda s: A.away_reasons(s, base="all", nulls="drop")),
        sql("SELECT motivo, round(CAST(p AS DOUBLE), 2) AS pop, round(CAST(p AS DOUBLE) / "
            "CAST(t AS DOUBLE) * 100, 6) AS pct FROM (SELECT *, sum(p) OVER () AS t FROM ("
            + REASON + f"AND {V.AWAY_REASON} IS NOT NULL GROUP BY 1)) "
            "ORDER BY p DESC, motivo LIMIT 6"),
    ),
    "benefit_coverage": (on(A.benefit_coverage), long(V.BENEFITS, "beneficio")),
    "aid_evolution": (
        on(A.aid_evolution),
        sql(f"SELECT MES_REF AS mes_ref, {pct(yes(V.AID))} AS pct_ae, {pct(yes(V.FAMILY_AID))} AS pct_bf, "
            f"{avg_sql(V.AID_AMOUNT, yes(V.AID))} AS valor_medio FROM m GROUP BY MES_REF"),
    ),
    "aid_by_region": (
        on(A.aid_by_region),
        region_table(avg_sql(V.AID_AMOUNT), "valor_medio",
                     f"{yes(V.AID)} AND {V.AID_AMOUNT} IS NOT NULL"),
    ),
    "benefit_overlap": (
        on(A.benefit_overlap), sql(distribution(overlap_sql(V.OVERLAP_LABELS, False), "grupo")),
    ),
    "benefit_overlap_unknown_partner": (
        on(lambda s: A.benefit_overlap(s, V.SPEC_OVERLAP_LABELS, "unknown")),
        sql(distribution(overlap_sql(V.SPEC_OVERLAP_LABELS, True), "grupo")),
    ),
    "income_suppression": (
        on(A.income_suppression),
        sql(distribution(
            V.HAS_INCOME, "ind",
            extra="CASE ind WHEN 1 THEN 'Com renda efetiva' WHEN 0 THEN 'Sem renda efetiva' END "
                  "AS situacao,",
        )),
    ),
    "income_summary": (
        on(A.income_summary),
        sql(f"SELECT CAST({MEDIAN} AS DOUBLE) AS mediana, {INCOME_MEAN} AS media, "
            "CAST(1045 AS DOUBLE) AS salario_minimo"),
    ),
    "income_histogram_clipped": (
        on(A.income_histogram), sql(HISTOGRAM.format(x=V.INCOME, pop=pop(), drop="")),
    ),
    "income_histogram_truncated": (
        on(lambda s: A.income_histogram(s, overflow="drop")),
        sql(HISTOGRAM.format(x=V.INCOME, pop=pop(), drop=f"AND {V.INCOME} <= 8000")),
    ),
    "income_by_region": (
        on(A.income_by_region),
        region_table(avg_sql(V.INCOME), "renda_media", f"{V.INCOME} IS NOT NULL"),
    ),
    "regional_risk_panel": (on(A.regional_risk), sql(RISK)),
    "regional_risk_matrix_one_month": (
        on(lambda s: A.regional_risk_matrix(s, "1998")),
        sql("SELECT regiao, pct_sintomas, pct_dif_respirar, pct_home_office, pct_auxilio "
            f"FROM ({RISK}) WHERE mes_ref = '1998'"),
    ),
    "headline_kpis": (
        on(A.headline_kpis),
        sql(f"SELECT {pct(SICK)} AS pct_sintomas, "
            f"{pct(f'{V.ISOLATION} = {chr(39)}{V.STRICT_ISOLATION}{chr(39)}')} AS pct_rigoroso, "
            f"{pct(yes(V.TEST_TAKEN))} AS pct_testou, {pct(COMORBID, SICK)} AS pct_comorbidade_sint, "
            f"{pct(f'{V.HAS_INCOME} = 0')} AS pct_sem_renda, {pct(yes(V.AID))} AS pct_auxilio, "
            f"(SELECT {pct(yes(V.CARE_SOUGHT))} FROM {OF_CASES}) AS pct_atendimento_sintomaticos FROM m"),
    ),
    # -- demographic selections ---------------------------------------------------------------
    "selection_symptom_prevalence": (
        on(A.symptom_prevalence, selection=SELECTION, months=["1996", "1997", "1998"]),
        PANEL_SQL
        + filtered(SELECTED_PEOPLE, SELECTED_REGION + " AND a.MES_REF IN ('1996', '1997', '1998')")
        + " UNION ALL ".join(
            f"SELECT '{label}' AS sintoma, {pct(yes(c))} AS pct FROM f"
            for c, label in V.SYMPTOMS.items()
        ),
    ),
    "selection_skips_plotted_axis": (
        on(A.symptoms_by_region, selection=SELECTION),
        PANEL_SQL + filtered(SELECTED_PEOPLE)
        + f"SELECT regiao, {pct(SICK)} AS pct, {YEAR} FROM f GROUP BY regiao, MES_REF",
    ),
    "selection_by_age": (
        on(lambda s: A.symptom_rate_by(s, "faixa_etaria"), selection=SELECTION),
        sql(f"SELECT band AS categoria, {pct(SICK)} AS pct FROM {BY_AGE} "
            "WHERE sex = 'Mulher' AND regiao IN ('AFRICA', 'AMERICA') GROUP BY band"),
    ),
    "selection_care_seeking": (
        on(A.care_seeking, selection=SELECTION),
        PANEL_SQL + filtered(SELECTED_PEOPLE, SELECTED_REGION)
        + f"SELECT '{V.POPULATION_GROUP}' AS grupo, {pct(yes(V.CARE_SOUGHT))} AS pct FROM f UNION ALL "
        + f"SELECT '{V.SYMPTOMATIC_GROUP}', {pct(yes(V.CARE_SOUGHT))} FROM "
        + f"(SELECT a.* FROM f a JOIN m b ON {JOIN_KEY} WHERE b.{SICK})",
    ),
    "selection_away_reasons": (
        on(A.away_reasons, selection=SELECTION),
        PANEL_SQL + filtered(SELECTED_PEOPLE, SELECTED_REGION)
        + "SELECT motivo, round(CAST(p AS DOUBLE), 2) AS pop, round(CAST(p AS DOUBLE) / "
        "CAST(sum(p) OVER () AS DOUBLE) * 100, 6) AS pct FROM ("
        + REASON.replace("FROM m", "FROM f") + "GROUP BY 1 ORDER BY p DESC, motivo NULLS LAST LIMIT 6)",
    ),
    "selection_income_median": (
        on(A.income_summary, selection=SELECTION),
        PANEL_SQL + filtered(SELECTED_PEOPLE, SELECTED_REGION)
        + f"SELECT CAST({MEDIAN.replace('FROM m', 'FROM f')} AS DOUBLE) AS mediana, "
        f"{INCOME_MEAN.replace('FROM m', 'FROM f')} AS media, CAST(1045 AS DOUBLE) AS salario_minimo",
    ),
    "selection_labour_status_by_age": (
        on(A.labour_status_by_age, selection=SELECTION),
        sql(f"SELECT band AS faixa_etaria, {STATUS}, {pop()} AS populacao_estimada FROM {BY_AGE} "
            "WHERE sex = 'Mulher' AND band IN ('18-29', '30-44') AND regiao IN ('AFRICA', 'AMERICA') GROUP BY 1, 2"),
    ),
    "selection_without_known_options": (
        on(A.symptom_prevalence, selection=Selection(sexes=("Mulher",)), options=Options()),
        PANEL_SQL + filtered("b.sexo = 'Mulher'")
        + " UNION ALL ".join(
            f"SELECT '{label}' AS sintoma, {pct(yes(c))} AS pct FROM f" for c, label in V.SYMPTOMS.items()
        ),
    ),
    "selection_regional_risk": (
        on(A.regional_risk, selection=SELECTION),
        PANEL_SQL + filtered(SELECTED_PEOPLE) + RISK.replace("FROM m", "FROM f"),
    ),
    "selection_benefit_overlap": (
        on(A.benefit_overlap, selection=SELECTION),
        PANEL_SQL + filtered(SELECTED_PEOPLE, SELECTED_REGION)
        + distribution(overlap_sql(V.OVERLAP_LABELS, False), "grupo").replace("FROM m", "FROM f"),
    ),
}


# ---- report questions --------------------------------------------------------------------------


def two(e: str) -> str:
    """The same expression at two decimals."""
    assert e.endswith(", 6)")
    return e[: -len("6)")] + "2)"


def monthly_q(**columns: str) -> str:
    return sql("SELECT MES_REF, " + ", ".join(f"{two(e)} AS {c}" for c, e in columns.items())
               + " FROM m GROUP BY MES_REF")


def regional_q(**columns: str) -> str:
    return sql("SELECT MES_REF, regiao, " + ", ".join(f"{two(e)} AS {c}" for c, e in columns.items())
               + " FROM m GROUP BY MES_REF, regiao")


QUESTION_SQL = {
    "01": monthly_q(pct_populacao_com_sintoma_gripal=pct(SICK)),
    "02": regional_q(pct_sintoma_gripal=pct(SICK)),
    "03": sql(f"SELECT MES_REF, band AS faixa_etaria, {two(pct(SICK))} AS pct_sintoma_gripal "
              f"FROM {BY_AGE} GROUP BY MES_REF, band"),
    "04": monthly_q(pct_dificuldade_respirar=pct(yes(V.BREATHING))),
    "05": monthly_q(pct_sintomaticos_com_comorbidade=pct(f"{SICK} AND {COMORBID}")),
    "06": monthly_q(pct_buscou_atendimento=pct(yes(V.CARE_SOUGHT))),
    "07": union(*[
        f"SELECT '{label}' AS local, {two(pct(yes(c)))} AS pct FROM {SEEKERS}"
        for c, label in V.CARE_PLACES.items()
    ]),
    "08": monthly_q(pct_rigorosamente_em_casa=pct(f"{V.ISOLATION} = '{V.STRICT_ISOLATION}'")),
    "09": regional_q(pct_home_office=pct(yes(V.HOME_OFFICE))),
    "10": sql(f"SELECT MES_REF, {STATUS}, CAST(round_even(CAST(sum(w) AS DOUBLE), 0) AS BIGINT) "
              f"AS populacao_estimada FROM m GROUP BY 1, 2"),
    "11": monthly_q(pct_recebeu_auxilio=pct(yes(V.AID)),
                    valor_medio_auxilio=avg_sql(V.AID_AMOUNT, yes(V.AID))),
    "12": regional_q(renda_efetiva_media=avg_sql(V.INCOME)),
    "13": regional_q(pct_sintomas=pct(SICK), pct_dificuldade_respirar=pct(yes(V.BREATHING)),
                     pct_home_office=pct(yes(V.HOME_OFFICE)), pct_auxilio_emergencial=pct(yes(V.AID))),
}
QUESTION_NAMES = {
    "01": "symptom_rate", "02": "symptom_rate_by_region", "03": "symptom_rate_by_age",
    "04": "breathing_difficulty", "05": "symptomatic_with_comorbidity", "06": "care_seeking",
    "07": "care_places", "08": "strict_isolation", "09": "home_office_by_region",
    "10": "labour_status", "11": "emergency_aid", "12": "income_by_region", "13": "regional_risk",
}


def question(f: Callable[[Survey], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(survey(spark, sf_dir))


QUESTIONS: dict[str, tuple[Query, str]] = {
    f"q{number}_{name}": (question(getattr(Q, name)), QUESTION_SQL[number])
    for number, name in QUESTION_NAMES.items()
}


# ---- files to published star to report ----------------------------------------------------------


def end_to_end(report: Callable[[Survey], DataFrame]) -> Query:
    """Yearly CSVs, found and read, decoded, published and opened again under the unique key."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        base, d = scratch(spark), dictionary()
        # A folder file=survey_12<year>.csv for each year, written in one pass.
        raw = raw_microdata(spark, sf_dir).withColumn("file", F.concat(F.lit("survey_12"), V.PERIOD, F.lit(".csv")))
        with unsorted_writes(spark):
            raw.drop(V.PERIOD).write.partitionBy("file").option("header", True).option("encoding", "ISO-8859-1").csv(f"{base}/files")
        kept, _ = MD.dedupe_period_files(MD.discover_periods(spark, f"{base}/files/*.csv"))
        publish_star(recode(MD.read_periods(spark, kept), d), d, f"{base}/star", regions=regions())
        s = load_star(spark, f"{base}/star", star_schemas(spark, d), weight=Weight(V.WEIGHT, digits=2), regions=regions())
        assert list(s.keys) == list(V.FULL_KEY)
        return report(s).withColumn(V.PERIOD, F.substring(V.PERIOD, 1, 4))

    return run


QUESTIONS["end_to_end_symptom_rate_by_region"] = (end_to_end(Q.symptom_rate_by_region), QUESTION_SQL["02"])
QUESTIONS["end_to_end_symptom_rate_by_age"] = (
    end_to_end(Q.symptom_rate_by_age),
    sql(f"SELECT MES_REF, band AS faixa_etaria, {two(pct(SICK))} AS pct_sintoma_gripal FROM (SELECT a.*, b.faixa_etaria AS band "
        f"FROM m a JOIN m b ON {' AND '.join(f'a.{k} = b.{k}' for k in V.FULL_KEY)}) GROUP BY 1, 2"),
)


# ---- KPI tables --------------------------------------------------------------------------------


def with_total(select: str, source: str = "m") -> list[str]:
    """The select per period and over all periods."""
    return [
        select.format(period="MES_REF") + f" FROM {source} GROUP BY MES_REF",
        select.format(period="'TOTAL'") + f" FROM {source}",
    ]


def clinical_sql() -> str:
    rows = (
        [(c, label, "Sim", "sintoma") for c, label in V.SPEC_SYMPTOMS.items()]
        + [(c, label, "Sim", "comorbidade") for c, label in V.SPEC_COMORBIDITIES.items()]
        + [(V.TEST_TAKEN, "Realizou teste", "Sim", "testagem"),
           (V.TEST_RESULT, "Resultado Positivo", "Positivo", "testagem")]
    )
    parts = []
    for c, label, value, group in rows:
        cond = f"{c} = '{value}'"
        people = f"coalesce(sum(CASE WHEN {cond} THEN w END), 0)"
        parts += with_total(
            f"SELECT {{period}} AS mes_ref, '{c}' AS variavel, '{label}' AS descricao, "
            f"'{value}' AS categoria, CAST(round_even(CAST({people} AS DOUBLE), 0) AS BIGINT) AS pop_ponderada, "
            f"{pct(cond, empty_zero=True)} AS pct_ponderado, '{group}' AS grupo"
        )
    return union(*parts)


def behaviour_sql() -> str:
    strict = f"{V.ISOLATION} = '{V.STRICT_ISOLATION}'"
    rows = [
        (V.ISOLATION, "Ficou rigorosamente em casa", pct(strict), "protecao", "m"),
        ("buscou_atendimento_saude_geral", "Buscou atendimento (geral)", pct(yes(V.CARE_SOUGHT)),
         "atendimento", "m"),
        ("buscou_atendimento_saude_sintomaticos", "Buscou atendimento (sintomáticos)",
         pct(yes(V.CARE_SOUGHT)), "atendimento", OF_CASES),
        (V.HOME_OFFICE, "Home office (entre ocupados)", pct(yes(V.HOME_OFFICE), yes(V.WORKED)),
         "trabalho", "m"),
    ]
    parts = []
    for variable, label, ratio, group, source in rows:
        parts += with_total(
            f"SELECT {{period}} AS mes_ref, '{variable}' AS variavel, '{label}' AS descricao, "
            f"{ratio} AS pct_ponderado, '{group}' AS grupo", source,
        )
    parts.append(
        f"SELECT 'TOTAL', '{STATUS}', situacao, pct, 'mercado_trabalho' FROM ("
        + distribution(STATUS, "situacao", APPLIES) + ")"
    )
    return union(*parts)


def economic_sql() -> str:
    null = "CAST(NULL AS DOUBLE)"
    mean = avg_sql(V.AID_AMOUNT, yes(V.AID))
    rows = [
        (V.AID, "Recebeu Auxílio Emergencial", pct(yes(V.AID)), null, "beneficio"),
        (V.FAMILY_AID, "Recebeu Bolsa Família", pct(yes(V.FAMILY_AID)), null, "beneficio"),
        ("recebeu_seguro_desemprego", "Recebeu Seguro Desemprego",
         pct(yes("recebeu_seguro_desemprego")), null, "beneficio"),
        (V.AID_AMOUNT, "Valor médio Auxílio Emergencial", null, mean, "renda"),
        (V.HAS_INCOME, "Sem renda efetiva no mês", pct(f"{V.HAS_INCOME} = 0"), null, "renda"),
    ]
    parts = []
    for variable, label, share, amount, group in rows:
        parts += with_total(
            f"SELECT {{period}} AS mes_ref, '{variable}' AS variavel, '{label}' AS descricao, "
            f"{share} AS pct_ponderado, {amount} AS valor_medio_ponderado, '{group}' AS grupo"
        )
    parts += [
        f"SELECT 'TOTAL', '{V.INCOME}', 'Mediana renda efetiva', NULL, CAST({MEDIAN} AS DOUBLE), 'renda'",
        f"SELECT 'TOTAL', '{V.INCOME}', 'Média renda efetiva', NULL, {INCOME_MEAN}, 'renda'",
        "SELECT 'TOTAL', 'sobreposicao_bf_ae', grupo, pct, NULL, 'sobreposicao' FROM ("
        + distribution(overlap_sql(V.SPEC_OVERLAP_LABELS, True), "grupo") + ")",
        f"SELECT 'TOTAL', 'valor_auxilio_regiao', 'Auxílio médio - ' || regiao, NULL, {mean}, "
        f"'renda_regiao' FROM m WHERE {yes(V.AID)} AND {V.AID_AMOUNT} IS NOT NULL GROUP BY regiao",
    ]
    return union(*parts)


def added_month(spec: Callable[..., DataFrame], sums: Definition) -> Query:
    """A KPI table from kept sums, to which the last year was added after the others.

    The lines are joined once and kept by year, so that each year's sums read its rows alone.
    """

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s, store = survey_by_year(spark, sf_dir), StoredSums(scratch(spark))
        store.refresh(s, sums, YEARS[:-1])
        store.refresh(s, sums, YEARS[-1:])
        return rounded(spec(s, store.read(s, sums)))

    return run


SPECS: dict[str, tuple[Query, str]] = {
    "a15_added_month_clinical": (added_month(S.clinical_spec, S.clinical_sums), clinical_sql()),
    "a15_added_month_behaviour": (added_month(S.behaviour_spec, S.behaviour_sums), behaviour_sql()),
    "a15_added_month_economic": (added_month(S.economic_spec, S.economic_sums), economic_sql()),
    "q14_clinical_spec": (on(S.clinical_spec), clinical_sql()),
    "selection_clinical_spec": (
        on(S.clinical_spec, selection=SELECTION),
        PANEL_SQL + filtered(SELECTED_PEOPLE, SELECTED_REGION)
        + clinical_sql()[len(PANEL_SQL):].replace("FROM m", "FROM f"),
    ),
    "q15_behaviour_spec": (on(S.behaviour_spec), behaviour_sql()),
    "q16_economic_spec": (on(S.economic_spec), economic_sql()),
}
