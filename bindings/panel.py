"""A survey panel derived from the order tables.

One order line plays one person in one month.  The coded answers are defined once, in SQL
that Spark and DuckDB both read, so both sides start from the same raw microdata; recoding,
decoding, the star schema and every statistic are then computed by the engine on one side
and by hand-written SQL on the other.
"""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.functions.measures import Weight
from surveyspark.operators.filters import Options
from surveyspark.operators.recode import recode
from surveyspark.plans.star import Survey, build_star, shared_folder
from surveyspark.sinks.tables import unsorted_writes, write_partitioned
from surveyspark.sources.dictionary import Dictionary, Variable

REGION_NAMES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
NATIONS = 25
YEARS = tuple(str(y) for y in range(1995, 2002))

# ---- raw microdata ---------------------------------------------------------------------------

LAYERS: tuple[dict[str, str], ...] = (
    {
        "d": "CAST(round(l_discount * 100) AS INT)",
        "t": "CAST(round(l_tax * 100) AS INT)",
        "q": "CAST(l_quantity AS INT)",
    },
    {
        "MES_REF": "CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING)",
        "Ano": "CAST(EXTRACT(YEAR FROM o_orderdate) AS INT)",
        "UF": "c_nationkey",
        "UPA": "l_orderkey % 100000",
        "V1008": "o_custkey",
        "A001": "l_linenumber",
        "V1013": "CAST(EXTRACT(MONTH FROM o_orderdate) AS INT)",
        "V1016": "CAST(EXTRACT(QUARTER FROM o_orderdate) AS INT)",
        "V1022": "CASE WHEN l_suppkey % 3 = 0 THEN 2 ELSE 1 END",
        "V1032": "l_extendedprice",
        "A002": "CASE WHEN t = 8 THEN NULL ELSE q END",
        "A003": "CASE WHEN l_returnflag = 'N' AND d = 7 THEN NULL "
                "WHEN l_linestatus = 'F' THEN 1 ELSE 2 END",
        "B0011": "CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 9 END",
        "B0012": "CASE WHEN d > 5 THEN 1 WHEN d = 0 THEN NULL ELSE 2 END",
        "B0014": "CASE WHEN t > 6 THEN 1 WHEN t = 0 THEN 9 ELSE 2 END",
        "B0019": "CASE WHEN q > 40 THEN 1 ELSE 2 END",
        "B00111": "CASE WHEN l_linestatus = 'F' AND d > 8 THEN 1 ELSE 2 END",
        "B008": "CASE WHEN l_linestatus = 'F' THEN 1 ELSE 2 END",
        "B009F": "CASE WHEN l_linestatus = 'O' THEN NULL WHEN l_returnflag = 'R' THEN 1 "
                 "WHEN l_returnflag = 'A' THEN 2 ELSE 4 END",
        "B0101": "CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 2 END",
        "B0102": "CASE WHEN l_partkey % 4 = 0 THEN 1 ELSE 2 END",
        "B0104": "CASE WHEN l_partkey % 11 = 0 THEN 1 WHEN l_partkey % 13 = 0 THEN 9 ELSE 2 END",
        "B011": "CASE l_suppkey % 6 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 "
                "WHEN 4 THEN 9 ELSE 7 END",
        "B002": "CASE WHEN l_partkey % 3 = 0 THEN 1 WHEN l_partkey % 10 = 1 THEN NULL ELSE 2 END",
        "C001": "CASE WHEN q <= 30 THEN 1 WHEN q <= 45 THEN 2 ELSE NULL END",
        "D0011": "CASE WHEN q > 45 THEN 1 ELSE 2 END",
        "D0031": "CASE WHEN l_returnflag = 'A' AND t > 4 THEN 1 WHEN t = 0 THEN NULL ELSE 2 END",
        "D0041": "CASE WHEN l_partkey % 17 = 0 THEN 1 ELSE 2 END",
        "D0051": "CASE WHEN d >= 5 THEN 1 WHEN d = 0 THEN NULL ELSE 2 END",
    },
    {
        "B0041": "CASE WHEN B002 = 1 AND l_suppkey % 2 = 0 THEN 1 WHEN B002 = 1 THEN 2 END",
        "B0042": "CASE WHEN B002 = 1 AND l_suppkey % 3 = 0 THEN 1 WHEN B002 = 1 THEN 2 END",
        "B0043": "CASE WHEN B002 = 1 AND l_suppkey % 5 = 0 THEN 1 WHEN B002 = 1 THEN 2 END",
        "B0044": "CASE WHEN B002 = 1 AND l_suppkey % 7 = 0 THEN 1 WHEN B002 = 1 THEN 2 END",
        "B0045": "CASE WHEN B002 = 1 AND l_suppkey % 9 = 0 THEN 1 WHEN B002 = 1 THEN 2 END",
        "B0046": "CASE WHEN B002 = 1 AND l_suppkey % 11 = 0 THEN 1 WHEN B002 = 1 THEN 2 END",
        "C002": "CASE WHEN C001 = 2 AND d < 3 THEN 1 WHEN C001 = 2 THEN 2 END",
        "C013": "CASE WHEN C001 = 1 AND l_linestatus = 'O' AND d > 5 THEN 1 "
                "WHEN C001 = 1 THEN 2 WHEN t = 5 THEN 1 END",
        "D0053": "CASE WHEN D0051 = 1 AND t > 0 THEN q * 20 END",
        "C011A12": "CASE WHEN C001 = 1 AND d = 0 THEN 0 "
                   "WHEN C001 = 1 THEN CAST(floor(l_extendedprice / 100) AS INT) * 10 END",
    },
    {
        "C015": "CASE WHEN C002 = 2 AND t < 3 THEN 1 WHEN C002 = 2 AND t < 8 THEN 2 END",
        "C003": "CASE WHEN C002 = 1 THEN CAST(l_suppkey % 9 AS INT) + 1 END",
    },
)

ANSWERS = {1: "Sim", 2: "Não", 3: "Não sabe", 9: "Ignorado"}
ISOLATION = dict(enumerate(V.ISOLATION_LEVELS, start=1)) | {9: "Ignorado"}

# code, name, block, type, labels
QUESTIONNAIRE = (
    ("Ano", "ano_referencia", "id", "integer", None),
    ("UF", "uf", "id", "string", {k: f"NATION_{k}" for k in range(NATIONS)}),
    ("UPA", "upa", "id", "integer", None),
    ("V1008", "id_domicilio", "id", "string", None),
    ("A001", "id_morador", "id", "string", None),
    ("V1013", "mes_entrevista", "id", "integer", None),
    ("V1016", "num_entrevista", "id", "integer", None),
    ("V1022", "situacao_domicilio", "id", "integer", {1: "Urbana", 2: "Rural"}),
    ("V1032", "peso_amostral", "peso", "double", None),
    ("A002", "idade", "perfil", "integer", None),
    ("A003", "sexo", "perfil", "integer", {1: "Homem", 2: "Mulher"}),
    ("B0011", "sintoma_febre", "saude", "integer", ANSWERS),
    ("B0012", "sintoma_tosse", "saude", "integer", ANSWERS),
    ("B0014", "sintoma_dificuldade_respirar", "saude", "integer", ANSWERS),
    ("B0019", "sintoma_fadiga", "saude", "integer", ANSWERS),
    ("B00111", "sintoma_perda_olfato_paladar", "saude", "integer", ANSWERS),
    ("B008", V.TEST_TAKEN, "saude", "integer", ANSWERS),
    ("B009F", V.TEST_RESULT, "saude", "integer", {1: "Positivo", 2: "Negativo"}),
    ("B0101", "medico_deu_diagnostico_diabetes", "saude", "integer", ANSWERS),
    ("B0102", "medico_deu_diagnostico_hipertensao", "saude", "integer", ANSWERS),
    ("B0104", "medico_deu_diagnostico_doencas_coracao_infarto_angina", "saude", "integer", ANSWERS),
    ("B011", V.ISOLATION, "saude", "integer", ISOLATION),
    *[
        (f"B004{i}", name, "saude", "integer", ANSWERS)
        for i, name in enumerate(V.CARE_PLACES, start=1)
    ],
    ("B002", V.CARE_SOUGHT, "comportamento", "integer", ANSWERS),
    ("C001", V.WORKED, "comportamento", "integer", ANSWERS),
    ("C002", V.AWAY, "comportamento", "integer", ANSWERS),
    ("C003", V.AWAY_REASON, "comportamento", "integer", {k: f"Motivo {k}" for k in range(1, 9)}),
    ("C013", V.HOME_OFFICE, "comportamento", "integer", ANSWERS),
    ("C015", V.LOOKED, "comportamento", "integer", ANSWERS),
    ("D0011", "recebeu_aposentadoria_pensao", "economico", "integer", ANSWERS),
    ("D0031", V.FAMILY_AID, "economico", "integer", ANSWERS),
    ("D0041", "recebeu_seguro_desemprego", "economico", "integer", ANSWERS),
    ("D0051", V.AID, "economico", "integer", ANSWERS),
    ("D0053", V.AID_AMOUNT, "economico", "double", None),
    ("C011A12", V.INCOME, "economico", "double", None),
)


def dictionary() -> Dictionary:
    domains = {"mes_entrevista": "1 a 12", "idade": "1 a 50", "upa": "0 a 99999"}
    return Dictionary(
        tuple(
            Variable(code, name, block, kind, domains.get(name, ""), YEARS)
            for code, name, block, kind, _ in QUESTIONNAIRE
        ),
        {name: labels for _, name, _, _, labels in QUESTIONNAIRE if labels},
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the cluster's shared scratch space (a local one on a single machine)."""
    local = spark.sparkContext.master.startswith("local[")
    base = shared_folder(spark, tempfile.gettempdir() + "/surveyspark" if local else "")
    if not base:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base}/{uuid.uuid4().hex}"


def answered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the answers are coded from: order lines with their orders and customers."""
    lines = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders")
    customers = table(spark, sf_dir, "customer")
    # The many lines are exchanged once, by order; only orders meet the customers.
    known = orders.join(customers, orders.o_custkey == customers.c_custkey)
    return lines.join(known, lines.l_orderkey == known.o_orderkey)


def raw_microdata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded microdata, every column text."""
    return coded(answered_lines(spark, sf_dir))


def coded(df: DataFrame) -> DataFrame:
    """The answers of such lines; a year that they have already is kept."""
    for layer in LAYERS:
        df = df.selectExpr("*", *[f"{e} AS {name}" for name, e in layer.items() if name not in df.columns])
    codes = [code for code, *_ in QUESTIONNAIRE]
    return df.select(*[F.col(c).cast("string").alias(c) for c in codes], V.PERIOD)


def regions() -> dict[str, list[str]]:
    return {
        name: [f"NATION_{k}" for k in range(i, NATIONS, len(REGION_NAMES))]
        for i, name in enumerate(REGION_NAMES)
    }


_OPEN: weakref.WeakKeyDictionary[SparkSession, dict[str, Survey]] = weakref.WeakKeyDictionary()


def survey(spark: SparkSession, sf_dir: str) -> Survey:
    """The star schema of the derived panel.  The documented key is used, so joins multiply.

    The plan (no data) is built once per session and folder.
    """
    opened = _OPEN.setdefault(spark, {})
    if sf_dir not in opened:
        opened[sf_dir] = _survey_of(recode(raw_microdata(spark, sf_dir), dictionary()))
    return opened[sf_dir]


#: Columns that the answers are coded from.
SOURCES = (
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount",
    "l_tax", "l_returnflag", "l_linestatus", "o_custkey", "o_orderdate", "c_nationkey",
)


def survey_by_year(spark: SparkSession, sf_dir: str) -> Survey:
    """The same star over lines that are joined and written once, by year: a year is read without the others."""
    folder = f"{scratch(spark)}/lines"
    lines = answered_lines(spark, sf_dir).selectExpr(*SOURCES, f"{LAYERS[1][V.PERIOD]} AS {V.PERIOD}")
    with unsorted_writes(spark):
        write_partitioned(lines, folder)
    return _survey_of(recode(coded(spark.read.schema(lines.schema).parquet(folder)), dictionary()))


def _survey_of(labelled: DataFrame) -> Survey:
    return Survey(
        build_star(labelled, dictionary(), regions()),
        weight=Weight(V.WEIGHT, digits=2),
        keys=V.PANEL_KEY_WITH_PERIOD,
        regions=regions(),
        month_labels={y: f"Ano {y}" for y in YEARS},
        options=Options(V.AGE_BANDS, ("Homem", "Mulher"), REGION_NAMES),
    )


# ---- the same panel in SQL ----------------------------------------------------------------------


def _nested(sql: str) -> str:
    for layer in LAYERS:
        columns = ", ".join(f"{e} AS {name}" for name, e in layer.items())
        sql = f"SELECT *, {columns} FROM ({sql})"
    return sql


def _answer(code: str) -> str:
    return (
        f"CASE {code} WHEN 1 THEN 'Sim' WHEN 2 THEN 'Não' WHEN 3 THEN 'Não sabe' "
        f"WHEN 9 THEN 'Ignorado' END"
    )


def _panel_sql() -> str:
    """CTEs ``raw`` (codes) and ``m`` (labels, derived columns); w is the weight."""
    plain = {
        "uf": "n_name",
        "upa": "UPA",
        "id_domicilio": "V1008",
        "id_morador": "A001",
        "mes_entrevista": "V1013",
        "num_entrevista": "V1016",
        "situacao_domicilio": "CASE V1022 WHEN 1 THEN 'Urbana' WHEN 2 THEN 'Rural' END",
        "idade": "A002",
        "sexo": "CASE A003 WHEN 1 THEN 'Homem' WHEN 2 THEN 'Mulher' END",
        V.TEST_RESULT: "CASE B009F WHEN 1 THEN 'Positivo' WHEN 2 THEN 'Negativo' END",
        V.ISOLATION: "CASE B011 "
        + " ".join(f"WHEN {k} THEN '{text}'" for k, text in ISOLATION.items())
        + " END",
        V.AWAY_REASON: "CASE WHEN C003 BETWEEN 1 AND 8 THEN 'Motivo ' || C003 END",
        V.AID_AMOUNT: "D0053",
        V.INCOME: "C011A12",
    }
    answers = {
        name: _answer(code) for code, name, _, _, labels in QUESTIONNAIRE if labels is ANSWERS
    }
    columns = ", ".join(f"{e} AS {name}" for name, e in (plain | answers).items())
    yes = [f"{c} = 'Sim'" for c in V.SYMPTOMS]
    any_yes = " OR ".join(yes)
    count = " + ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END" for c in yes)
    idle = f"{V.WORKED} = 'Não'"
    return f"""
WITH raw AS ({_nested(
        "SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey "
        "JOIN customer ON o_custkey = c_custkey")}),
coded AS (
  SELECT MES_REF, r_name AS regiao, CAST(V1032 AS DECIMAL(18,2)) AS w, {columns}
  FROM raw JOIN nation ON UF = n_nationkey JOIN region ON n_regionkey = r_regionkey),
m AS (
  SELECT *,
    CASE WHEN idade < 18 THEN '00-17' WHEN idade < 30 THEN '18-29' WHEN idade < 45 THEN '30-44'
         WHEN idade < 60 THEN '45-59' WHEN idade < 75 THEN '60-74' ELSE '75+' END AS faixa_etaria,
    CASE WHEN {any_yes} THEN 1 ELSE 0 END AS {V.HAS_SYMPTOM},
    {count} AS {V.SYMPTOM_COUNT},
    CASE WHEN {V.WORKED} = 'Sim' THEN 'Ocupado - trabalhou'
         WHEN {idle} AND {V.AWAY} = 'Sim' THEN 'Ocupado - afastado'
         WHEN {idle} AND {V.AWAY} = 'Não' AND {V.LOOKED} = 'Sim' THEN 'Desocupado'
         WHEN {idle} AND {V.AWAY} = 'Não' AND {V.LOOKED} = 'Não' THEN 'Fora da forca de trabalho'
         ELSE 'Nao se aplica' END AS {V.LABOUR_STATUS},
    CASE WHEN {V.INCOME} > 0 THEN 1 ELSE 0 END AS {V.HAS_INCOME}
  FROM coded)
"""


PANEL_SQL = _panel_sql()
JOIN_KEY = " AND ".join(f"a.{k} = b.{k}" for k in V.PANEL_KEY_WITH_PERIOD)


# ---- SQL fragments ------------------------------------------------------------------------------


def pct(cond: str, within: str | None = None, w: str = "w", empty_zero: bool = False) -> str:
    """Weighted percentage, six decimals."""
    hit = cond if within is None else f"({within}) AND ({cond})"
    return ratio_sql(hit, within, w, empty_zero)


def ratio_sql(num: str, den: str | None, w: str = "w", empty_zero: bool = False) -> str:
    over = f"sum({w})" if den is None else f"sum(CASE WHEN {den} THEN {w} END)"
    e = (
        f"CAST(coalesce(sum(CASE WHEN {num} THEN {w} END), 0) AS DOUBLE) "
        f"/ nullif(CAST({over} AS DOUBLE), 0) * 100"
    )
    return f"round(coalesce({e}, 0), 6)" if empty_zero else f"round({e}, 6)"


def avg_sql(x: str, where: str = "true", w: str = "w") -> str:
    """Weighted mean over known values, six decimals."""
    known = f"({where}) AND {x} IS NOT NULL"
    return (
        f"round(CAST(sum(CASE WHEN {known} THEN {x} * {w} END) AS DOUBLE) / "
        f"nullif(CAST(sum(CASE WHEN {known} THEN {w} END) AS DOUBLE), 0), 6)"
    )


def pop(w: str = "w") -> str:
    return f"round(CAST(sum({w}) AS DOUBLE), 2)"


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double, so that the order of additions cannot show."""
    doubles = [c for c, kind in df.dtypes if kind == "double"]
    return df.withColumns({c: F.round(c, digits) for c in doubles}) if doubles else df
