"""Every operator on the driver tables, with its SQL twin.

Orders play the interviewed people of a year: the total price is the weight, the status the
answer, the customer's nation the state.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings.panel import (
    JOIN_KEY,
    PANEL_SQL,
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
    table,
)
from surveyspark import fixed_values as V
from surveyspark.functions import columns as C
from surveyspark.functions import measures as M
from surveyspark.functions.measures import Weight
from surveyspark.operators import filters as FI
from surveyspark.operators import joins as J
from surveyspark.operators import recode as R
from surveyspark.operators import reshape as RS
from surveyspark.operators import weighted as W
from surveyspark.plans import questions as Q
from surveyspark.sinks import reports, tables
from surveyspark.sources import dictionary as D
from surveyspark.sources import microdata as MD
from surveyspark.sources.tables import read_spec_csv, read_star_table

Query = Callable[[SparkSession, str], DataFrame]
OPERATORS: dict[str, tuple[Query, str | None]] = {}


def operator(name: str, sql: str | None):
    def add(f: Query) -> Query:
        OPERATORS[name] = (f, sql)
        return f

    return add


# ---- shared inputs -----------------------------------------------------------------------------

PRICE = Weight("o_totalprice", digits=2)
LINE = Weight("l_extendedprice", digits=2)
YEAR_SQL = "strftime(o_orderdate, '%Y')"
PW = "CAST(o_totalprice AS DECIMAL(18,2))"
LW = "CAST(l_extendedprice AS DECIMAL(18,2))"
FLAGS = {
    "f_return": "l_returnflag = 'R'",
    "f_status": "l_linestatus = 'F'",
    "f_discount": "round(l_discount * 100) > 5",
    "f_tax": "round(l_tax * 100) > 4",
    "f_quantity": "l_quantity > 25",
}
FLAG_LABELS = dict(zip(FLAGS, ("Devolvido", "Faturado", "Desconto", "Imposto", "Volume")))
LINES_SQL = (
    f"(SELECT {YEAR_SQL} AS MES_REF, {LW} AS w, *, "
    + ", ".join(f"CASE WHEN {e} THEN 'Sim' ELSE 'Não' END AS {c}" for c, e in FLAGS.items())
    + " FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
)
ORDERS_SQL = f"(SELECT {YEAR_SQL} AS MES_REF, {PW} AS w, * FROM orders)"
HOMES_SQL = (
    f"(SELECT {YEAR_SQL} AS MES_REF, {PW} AS w, orders.*, c_mktsegment, c_acctbal, n_name AS uf, "
    "r_name AS regiao FROM orders JOIN customer ON o_custkey = c_custkey "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
)


def year(c: str = "o_orderdate") -> Column:
    return F.date_format(c, "yyyy").alias(V.PERIOD)


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("*", year())


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with five yes/no answers and the order's year."""
    li = table(spark, sf, "lineitem")
    o = orders(spark, sf)
    answers = [
        F.when(F.expr(e), V.YES).otherwise(V.NO).alias(c) for c, e in FLAGS.items()
    ]
    return li.join(o, li.l_orderkey == o.o_orderkey).select("*", *answers)


def homes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the customer's segment, state and (from the state) region."""
    o, c = orders(spark, sf), table(spark, sf, "customer")
    state = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    return o.join(c, o.o_custkey == c.c_custkey).withColumn("uf", state).withColumn(
        "regiao", C.map_hierarchy("uf", regions())
    )


def placed(report: DataFrame) -> DataFrame:
    """A sorted report (a few rows) with the place of each row, so that a comparison sees the order."""
    return report.coalesce(1).withColumn("place", F.monotonically_increasing_id())


def status(value: str) -> Column:
    return F.col("o_orderstatus") == value


# ---- scans -------------------------------------------------------------------------------------

MONTHS = {"F": "092020", "O": "102020", "P": "112020"}
MONTH_SQL = "CASE o_orderstatus WHEN 'F' THEN '2020-09' WHEN 'O' THEN '2020-10' ELSE '2020-11' END"


def write_months(spark: SparkSession, sf: str, compressed_copy: bool = False) -> str:
    """Orders as monthly files, one month per status; the last has a column more, in the middle."""
    base = scratch(spark)
    text = table(spark, sf, "orders").select(
        "o_orderstatus", F.col("o_orderkey").cast("string").alias("A1"),
        F.concat("o_orderpriority", F.lit(" não")).alias("A2"),
        F.col("o_totalprice").cast("string").alias("A3"),
    )
    for value, month in MONTHS.items():
        extra = [F.lit("x").alias("A1B")] if value == "P" else []
        part = text.where(status(value)).select("A1", *extra, "A2", "A3")
        writer = part.write.option("header", True).option("encoding", "ISO-8859-1")
        writer.csv(f"{base}/survey_{month}.csv")
        if compressed_copy:
            writer.option("compression", "gzip").csv(f"{base}/survey_{month}.csv.gz")
    text.groupBy("o_orderstatus").count().write.csv(f"{base}/readme.csv")
    return base


@operator(
    "s1_read_microdata",
    "SELECT CAST(o_orderkey AS VARCHAR) AS A1, o_orderpriority || ' não' AS A2, "
    "CAST(o_totalprice AS VARCHAR) AS A3 FROM orders",
)
def _(spark, sf):
    base = write_months(spark, sf)
    months = [MD.read_microdata(spark, f"{base}/survey_{m}.csv") for m in MONTHS.values()]
    return MD.union_periods([(str(i), df.select("A1", "A2", "A3")) for i, df in enumerate(months)]).drop(V.PERIOD)


@operator(
    "s2_discover_periods",
    f"SELECT {MONTH_SQL} AS MES_REF, false AS compressed, count(*) AS rows FROM orders GROUP BY 1",
)
def _(spark, sf):
    base = write_months(spark, sf)
    found = MD.list_periods(spark, base + "/*")
    data = MD.read_periods(spark, MD.discover_periods(spark, base + "/*"))
    rows = data.groupBy(V.PERIOD).agg(F.count("*").alias("rows"))
    return found.join(rows, V.PERIOD).select(V.PERIOD, "compressed", "rows")


@operator(
    "s3_dedupe_period_files",
    f"SELECT {MONTH_SQL} AS MES_REF, count(*) AS rows, CAST(1 AS BIGINT) AS ignored "
    "FROM orders GROUP BY 1",
)
def _(spark, sf):
    base = write_months(spark, sf, compressed_copy=True)
    kept, ignored = MD.dedupe_period_files(MD.discover_periods(spark, base + "/*"))
    assert not any(f.compressed for f in kept) and all(f.compressed for f in ignored)
    left_out = spark.createDataFrame([(f.period,) for f in ignored], f"{V.PERIOD} string")
    rows = MD.read_periods(spark, kept).groupBy(V.PERIOD).agg(F.count("*").alias("rows"))
    return rows.join(
        left_out.groupBy(V.PERIOD).agg(F.count("*").alias("ignored")), V.PERIOD
    )


@operator(
    "s3_two_files_one_month",
    f"SELECT {MONTH_SQL} AS MES_REF, count(*) AS rows, CAST(2 AS BIGINT) AS files FROM orders GROUP BY 1",
)
def _(spark, sf):
    """Two different files of each month, one of them also gzipped: both are read, once."""
    base = scratch(spark)
    text = table(spark, sf, "orders").select("o_orderstatus", "o_orderkey", F.col("o_orderkey").cast("string").alias("A1"))
    for value, month in MONTHS.items():
        for half, name in enumerate(("north", "south")):
            part = text.where(status(value) & (F.col("o_orderkey") % 2 == half)).select("A1")
            part.write.option("header", True).csv(f"{base}/{name}_{month}.csv")
            if name == "south":
                part.write.option("header", True).option("compression", "gzip").csv(f"{base}/{name}_{month}.csv.gz")
    kept, _ = MD.dedupe_period_files(MD.discover_periods(spark, base + "/*"))
    files = spark.createDataFrame([(f.period,) for f in kept], f"{V.PERIOD} string").groupBy(V.PERIOD).agg(F.count("*").alias("files"))
    rows = MD.read_periods(spark, kept).groupBy(V.PERIOD).agg(F.count("*").alias("rows"))
    return rows.join(files, V.PERIOD)


@operator(
    "s4_read_periods",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS A1, CASE o_orderstatus WHEN 'P' THEN 'x' END AS A1B, "
    f"o_orderpriority || ' não' AS A2, CAST(o_totalprice AS VARCHAR) AS A3, {MONTH_SQL} AS MES_REF "
    "FROM orders",
)
def _(spark, sf):
    return MD.read_periods(spark, MD.discover_periods(spark, write_months(spark, sf) + "/*"))


CUT_SQL, LONG_SQL = "o_orderkey % 7 = 3", "o_orderkey % 11 = 5"


@operator(
    "s4_malformed_lines",
    f"SELECT {MONTH_SQL} AS MES_REF, "
    + ", ".join(
        f"CASE WHEN NOT ({CUT_SQL} OR {LONG_SQL}) THEN {e} END AS {c}"
        for c, e in {"A1": "CAST(o_orderkey AS VARCHAR)", "A2": "o_orderpriority", "A3": "o_orderstatus"}.items()
    )
    + f", CASE WHEN {CUT_SQL} THEN o_orderkey || ',' || o_orderpriority WHEN {LONG_SQL} THEN "
    "o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus || ',x' END AS line FROM orders",
)
def _(spark, sf):
    """Monthly files in which some lines lack a field and some have one more: no line is lost or padded."""
    base = scratch(spark)
    fields = ["o_orderkey", "o_orderpriority", "o_orderstatus"]
    line = (
        F.when(F.expr(CUT_SQL), F.concat_ws(",", *fields[:2]))
        .when(F.expr(LONG_SQL), F.concat_ws(",", *fields, F.lit("x")))
        .otherwise(F.concat_ws(",", *fields))
    )
    text = table(spark, sf, "orders").select("o_orderstatus", line.alias("A1,A2,A3"))
    for value, month in MONTHS.items():
        # Another separator, so that the line is written as it is.
        text.where(status(value)).drop("o_orderstatus").write.option("header", True).option(
            "sep", "\u0001"
        ).csv(f"{base}/survey_{month}.csv")
    files = MD.discover_periods(spark, base + "/*")
    good, bad = MD.split_malformed(MD.read_periods(spark, files, malformed=MD.MALFORMED))
    return good.unionByName(bad.drop("path"), allowMissingColumns=True)


@operator(
    "s4_union_periods",
    f"SELECT {YEAR_SQL} AS MES_REF, o_orderkey, CASE WHEN {YEAR_SQL} = '2001' THEN NULL ELSE "
    "o_orderpriority END AS o_orderpriority FROM orders",
)
def _(spark, sf):
    o = orders(spark, sf)
    frames = []
    for y in YEARS:
        columns = ["o_orderkey"] if y == "2001" else ["o_orderkey", "o_orderpriority"]
        frames.append((y, o.where(F.col(V.PERIOD) == y).select(*columns)))
    return MD.union_periods(frames)


def write_years(spark: SparkSession, sf: str) -> str:
    """Orders as a month-partitioned table whose later years have a column more."""
    base = scratch(spark)
    o = orders(spark, sf).select("o_orderkey", "o_orderpriority", "o_totalprice", V.PERIOD)
    early = o.where(F.col(V.PERIOD) < "2000").drop("o_orderpriority")
    tables.write_partitioned(early, base + "/pedidos")
    tables.overwrite_period(o.where(F.col(V.PERIOD) >= "2000"), base + "/pedidos")
    return base


@operator(
    "s5_read_star_table",
    f"SELECT {YEAR_SQL} AS MES_REF, o_orderkey, CASE WHEN {YEAR_SQL} >= '2000' THEN "
    "o_orderpriority END AS o_orderpriority, o_totalprice FROM orders",
)
def _(spark, sf):
    return read_star_table(spark, write_years(spark, sf), "pedidos")


BRANDS_SQL = (
    "SELECT p_brand AS codigo_variavel, lower(p_brand) AS nome_semantico, 'tamanho, ' || max(p_type) "
    "AS descricao_variavel, CASE WHEN max(p_size) < 50 THEN 'perfil' ELSE 'saude' END AS bloco, "
    "CASE WHEN count(*) % 2 = 0 THEN 'double' ELSE 'integer' END AS tipo, "
    "CASE WHEN count(*) % 3 = 0 THEN '1 a 50' END AS dominio, 'Parte \"A\"' AS parte, "
    "'092020,102020' AS meses FROM part GROUP BY p_brand"
)


def brands(spark: SparkSession, sf: str) -> DataFrame:
    """A variable dictionary with one variable per brand."""
    n = F.count("*")
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("codigo_variavel")).agg(
        F.lower(F.first("p_brand")).alias("nome_semantico"),
        F.concat(F.lit("tamanho, "), F.max("p_type")).alias("descricao_variavel"),
        F.when(F.max("p_size") < 50, "perfil").otherwise("saude").alias("bloco"),
        F.when(n % 2 == 0, "double").otherwise("integer").alias("tipo"),
        F.when(n % 3 == 0, "1 a 50").alias("dominio"),
        F.lit('Parte "A"').alias("parte"),
        F.lit("092020,102020").alias("meses"),
    )


def write_dictionary(df: DataFrame, path: str) -> str:
    df.write.option("header", True).option("escape", '"').csv(path)
    return path


@operator(
    "s6_variable_dictionary",
    f"SELECT codigo_variavel AS code, nome_semantico AS name, bloco AS block, tipo AS type, "
    f"coalesce(dominio, '') AS domain, CAST(2 AS BIGINT) AS months FROM ({BRANDS_SQL})",
)
def _(spark, sf):
    path = write_dictionary(brands(spark, sf), scratch(spark))
    d = D.read_variable_dictionary(spark, path)
    return spark.createDataFrame(
        [(v.code, v.name, v.block, v.type, v.domain, len(v.months)) for v in d.variables],
        "code string, name string, block string, type string, domain string, months bigint",
    )


VALUE_SQL = (
    "CASE p_partkey % 5 WHEN 0 THEN CAST(p_size AS VARCHAR) WHEN 1 THEN CAST(p_size AS VARCHAR) || '.0' "
    "WHEN 2 THEN NULL WHEN 3 THEN '000 a 130' ELSE ' ' || CAST(p_size AS VARCHAR) END"
)


@operator(
    "s7_category_dictionary",
    "SELECT CASE WHEN p_brand = 'Brand#1' THEN p_brand ELSE lower(p_brand) END AS name, p_size AS code, "
    "'tamanho ' || p_size AS label FROM part WHERE p_partkey % 5 IN (0, 1, 4) GROUP BY ALL",
)
def _(spark, sf):
    value = F.expr(VALUE_SQL.replace("VARCHAR", "STRING"))
    rows = table(spark, sf, "part").select(
        F.col("p_brand").alias("codigo_variavel"), value.alias("valor"),
        F.concat(F.lit("tamanho "), F.col("p_size").cast("string")).alias("descricao_valor"),
    )
    path = scratch(spark)
    known = brands(spark, sf).where(F.col("codigo_variavel") != "Brand#1")
    variables = D.read_variable_dictionary(spark, write_dictionary(known, path + "/v"))
    codes = D.read_dictionary_csv(spark, write_dictionary(rows, path + "/c"))
    return D.category_codes(codes, variables)


@operator(
    "s7_repeated_codes",
    "SELECT lower(p_brand) AS name, p_size AS code, CASE WHEN bool_or(p_partkey % 10 = 0) THEN 'novo ' "
    "ELSE 'antigo ' END || p_size AS label FROM part GROUP BY p_brand, p_size",
)
def _(spark, sf):
    """Two category files: a code that both hold has the label of the file whose name comes last."""
    part, path = table(spark, sf, "part"), scratch(spark)
    variables = D.read_variable_dictionary(spark, write_dictionary(brands(spark, sf), path + "/v"))
    code, files = F.col("p_size").cast("string"), []
    for file, rows, text in (("c2", part.where("p_partkey % 10 = 0"), "novo "), ("c1", part, "antigo ")):
        labelled = rows.select(
            F.col("p_brand").alias("codigo_variavel"), code.alias("valor"),
            F.concat(F.lit(text), code).alias("descricao_valor"),
        )
        files.append(write_dictionary(labelled, f"{path}/{file}"))
    return D.category_codes(D.read_dictionary_csv(spark, files), variables)


# ---- sinks -------------------------------------------------------------------------------------


@operator(
    "s8_k7_report_csv_round_trip",
    f"SELECT {YEAR_SQL} AS MES_REF, 'não; \"' || o_orderstatus || '\"' AS nota, "
    "CAST(count(*) AS VARCHAR) AS linhas FROM orders GROUP BY ALL",
)
def _(spark, sf):
    report = (
        orders(spark, sf).groupBy(V.PERIOD, "o_orderstatus").agg(F.count("*").alias("linhas"))
        .select(
            V.PERIOD,
            F.concat(F.lit('não; "'), "o_orderstatus", F.lit('"')).alias("nota"), "linhas",
        )
    )
    path = scratch(spark)
    reports.write_spec_csv(report, path, sep=";", bom=True)
    return read_spec_csv(spark, path)


@operator(
    "k1_write_partitioned",
    f"SELECT {YEAR_SQL} AS MES_REF, count(*) AS rows, {pop(PW)} AS pop FROM orders GROUP BY 1",
)
def _(spark, sf):
    path = scratch(spark)
    tables.write_partitioned(orders(spark, sf), path + "/pedidos")
    return rounded(W.period_compare_table(read_star_table(spark, path, "pedidos"), PRICE), 2)


@operator(
    "k2_overwrite_period",
    f"SELECT {YEAR_SQL} AS MES_REF, CASE WHEN {YEAR_SQL} = '1997' THEN 'second' ELSE 'first' END AS run, "
    "count(*) AS rows FROM orders GROUP BY ALL",
)
def _(spark, sf):
    path = scratch(spark)
    o = orders(spark, sf)
    tables.overwrite_period(o.withColumn("run", F.lit("first")), path + "/pedidos")
    redone = o.where(F.col(V.PERIOD) == "1997").withColumn("run", F.lit("second"))
    tables.overwrite_period(redone, path + "/pedidos")
    return read_star_table(spark, path, "pedidos").groupBy(V.PERIOD, "run").agg(F.count("*").alias("rows"))


def _table(name: str) -> tuple[str, str]:
    """Database and a table name of its own, so that two runs on one catalog do not meet."""
    return "surveyspark_check", f"{name}_{uuid.uuid4().hex[:12]}"


@operator(
    "k3_publish_table",
    f"SELECT {YEAR_SQL} AS MES_REF, count(*) AS rows FROM orders GROUP BY 1",
)
def _(spark, sf):
    name = tables.publish_table(
        orders(spark, sf), *_table("pedidos_k3"), scratch(spark), buckets=4,
        bucket_keys=["o_custkey"],
    )
    return spark.table(name).groupBy(V.PERIOD).agg(F.count("*").alias("rows"))


@operator(
    "k4_register_partitions",
    f"SELECT {YEAR_SQL} AS MES_REF, count(*) AS rows FROM orders GROUP BY 1",
)
def _(spark, sf):
    path, o = scratch(spark), orders(spark, sf)
    early = o.where(F.col(V.PERIOD) < "2000")
    name = tables.publish_table(early, *_table("pedidos_k4"), path)
    tables.overwrite_period(o.where(F.col(V.PERIOD) >= "2000"), path)
    tables.register_partitions(spark, name)
    return spark.table(name).groupBy(V.PERIOD).agg(F.count("*").alias("rows"))


NAMES = ("customer", "orders", "lineitem", "part")


@operator(
    "k5_validate_counts",
    " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS rows FROM {n}" for n in NAMES),
)
def _(spark, sf):
    return tables.validate_counts({n: table(spark, sf, n) for n in NAMES})


@operator(
    "k6_profile_tables",
    f"SELECT 'pedidos' AS \"table\", {YEAR_SQL} AS MES_REF, count(*) AS rows, 7 AS columns, "
    f"{pop(PW)} AS population, 'Pedidos' AS description FROM orders GROUP BY 2 UNION ALL "
    f"SELECT 'pedidos', 'TOTAL', count(*), 7, {pop(PW)}, 'Pedidos' FROM orders UNION ALL "
    f"SELECT 'datas', {YEAR_SQL}, count(*), 2, NULL, NULL FROM orders GROUP BY 2 UNION ALL "
    "SELECT 'datas', 'TOTAL', count(*), 2, NULL, NULL FROM orders",
)
def _(spark, sf):
    o = orders(spark, sf)
    profile = tables.profile_tables(
        {"pedidos": o, "datas": o.select("o_orderkey", V.PERIOD)}, {"pedidos": "Pedidos"}, PRICE
    )
    return rounded(profile, 2)


@operator(
    "k8_run_index",
    PANEL_SQL
    + "SELECT '01' AS slug, (SELECT count(*) FROM (SELECT DISTINCT MES_REF FROM m)) AS linhas, "
    "2 AS colunas, 'OK' AS status UNION ALL "
    "SELECT '02', (SELECT count(*) FROM (SELECT DISTINCT MES_REF, regiao FROM m)), 3, 'OK' "
    "UNION ALL SELECT '08', 0, 0, 'ERRO'",
)
def _(spark, sf):
    s = survey(spark, sf)
    questions = [
        reports.Question("01", "Sintomas", lambda: Q.symptom_rate(s)),
        reports.Question("08", "Coluna ausente", lambda: s.tables["base_saude"].select("usa_mascara")),
        reports.Question("02", "Sintomas por região", lambda: Q.symptom_rate_by_region(s)),
    ]
    index = reports.run_index(spark, questions, scratch(spark))
    return index.select("slug", "linhas", "colunas", "status")


# ---- dictionary-driven projection ----------------------------------------------------------------

ORDER_DICTIONARY = D.Dictionary(
    (
        D.Variable("o_orderkey", "pedido", "id", "integer", "1 a n", ("09", "10")),
        D.Variable("o_custkey", "cliente", "id", "string", "", ("09", "10")),
        D.Variable("o_totalprice", "peso", "peso", "double", "", ("09", "10")),
        D.Variable("prio", "prioridade", "perfil", "integer", "", ("09", "10")),
        D.Variable("dirty", "sujo", "perfil", "integer", "texto", ("10",)),
        D.Variable("o_absent", "ausente", "saude", "integer"),
    ),
    {"prioridade": {1: "URGENT", 2: "HIGH", 3: "MEDIUM", 4: "OTHER"}, "sujo": {1: "um"}},
)
DIRTY = (
    "CASE o_orderkey % 6 WHEN 0 THEN '1.5' WHEN 1 THEN 'abc' WHEN 2 THEN '99999999999' "
    "WHEN 3 THEN NULL WHEN 4 THEN '-7' ELSE '12' END"
)
DIRTY_INT = "CASE o_orderkey % 6 WHEN 0 THEN 1 WHEN 4 THEN -7 WHEN 5 THEN 12 END"
PRIO = "CAST(substring(o_orderpriority, 1, 1) AS INTEGER)"
PRIO_LABEL = f"CASE {PRIO} WHEN 1 THEN 'URGENT' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MEDIUM' WHEN 4 THEN 'OTHER' END"


def order_text(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as coded text; priority 5 has no label, status is not documented."""
    return orders(spark, sf).select(
        *[F.col(c).cast("string").alias(c) for c in ("o_orderkey", "o_custkey", "o_totalprice")],
        F.substring("o_orderpriority", 1, 1).alias("prio"), F.expr(DIRTY).alias("dirty"),
        "o_orderstatus", V.PERIOD,
    )


@operator(
    "c1_rename_by_dictionary",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS pedido, CAST(o_custkey AS VARCHAR) AS cliente, "
    f"CAST(o_totalprice AS VARCHAR) AS peso, substring(o_orderpriority, 1, 1) AS prioridade, "
    f"{DIRTY} AS sujo, {YEAR_SQL} AS MES_REF FROM orders",
)
def _(spark, sf):
    return R.rename_by_dictionary(order_text(spark, sf), ORDER_DICTIONARY)


@operator(
    "c2_missing_variables",
    "SELECT n_name AS code, lower(n_name) AS name FROM nation WHERE n_nationkey NOT IN "
    "(SELECT c_nationkey FROM customer WHERE c_nationkey < 20)",
)
def _(spark, sf):
    nations = [r["n_name"] for r in table(spark, sf, "nation").orderBy("n_nationkey").collect()]
    columns = homes(spark, sf).where(F.col("c_nationkey") < 20).groupBy(V.PERIOD).pivot("uf").count()
    d = D.Dictionary(tuple(D.Variable(n, n.lower(), "id", "integer") for n in nations))
    return R.missing_variables(columns, d)


@operator(
    "c3_cast_by_dictionary",
    f"SELECT CAST(o_orderkey AS INTEGER) AS pedido, CAST(o_custkey AS VARCHAR) AS cliente, "
    f"o_totalprice AS peso, {PRIO} AS prioridade, {DIRTY_INT} AS sujo, {YEAR_SQL} AS MES_REF FROM orders",
)
def _(spark, sf):
    renamed = R.rename_by_dictionary(order_text(spark, sf), ORDER_DICTIONARY)
    return R.cast_by_dictionary(renamed, ORDER_DICTIONARY)


@operator(
    "c4_override_types",
    f"SELECT CAST(trunc(o_totalprice) AS INTEGER) AS whole, o_totalprice AS exact FROM orders",
)
def _(spark, sf):
    text = table(spark, sf, "orders").select(F.col("o_totalprice").cast("string").alias("p"))
    d = D.Dictionary((D.Variable("p", "peso_domicilio_pessoas", "id", "integer"),))
    renamed = R.rename_by_dictionary(text, d)
    patched = d.override_types(V.TYPE_OVERRIDES)
    name = "peso_domicilio_pessoas"
    return renamed.select(
        C.to_type(name, d.types[name]).alias("whole"), C.to_type(name, patched.types[name]).alias("exact")
    )


@operator(
    "c5_decode_categories",
    f"SELECT CAST(o_orderkey AS INTEGER) AS pedido, CAST(o_custkey AS VARCHAR) AS cliente, "
    f"o_totalprice AS peso, {PRIO_LABEL} AS prioridade, {DIRTY_INT} AS sujo, {YEAR_SQL} AS MES_REF FROM orders",
)
def _(spark, sf):
    renamed = R.rename_by_dictionary(order_text(spark, sf), ORDER_DICTIONARY)
    return R.decode_categories(R.cast_by_dictionary(renamed, ORDER_DICTIONARY), ORDER_DICTIONARY)


@operator(
    "c5_decode_long_code_table",
    "SELECT o_orderkey, CASE WHEN o_custkey < 300 THEN 'cliente ' || o_custkey END AS cliente FROM orders",
)
def _(spark, sf):
    d = D.Dictionary(
        (D.Variable("o_custkey", "cliente", "id", "integer"),),
        {"cliente": {k: f"cliente {k}" for k in range(300)}},
    )
    coded = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").cast("int").alias("cliente"))
    return R.decode_categories(coded, d)


@operator(
    "c6_project_block",
    f"SELECT CAST(o_orderkey AS INTEGER) AS pedido, CAST(o_custkey AS VARCHAR) AS cliente, "
    f"o_totalprice AS peso, {YEAR_SQL} AS MES_REF, {PRIO_LABEL} AS prioridade, {DIRTY_INT} AS sujo FROM orders",
)
def _(spark, sf):
    recoded = R.recode(order_text(spark, sf), ORDER_DICTIONARY)
    return R.project_block(recoded, ORDER_DICTIONARY, "perfil", extra=["pedido", "nowhere"])


@operator(
    "c7_dim_time",
    PANEL_SQL
    + "SELECT DISTINCT mes_entrevista, num_entrevista, MES_REF, "
    "CASE WHEN mes_entrevista IN (5, 6) THEN 'Inicio da Pandemia' WHEN mes_entrevista IN (7, 8, 9) "
    "THEN 'Pico da Primeira Onda' ELSE 'Desaceleracao' END AS fase_pandemia FROM m",
)
def _(spark, sf):
    return survey(spark, sf).tables["dim_tempo"]


@operator(
    "c8_band",
    "SELECT p_partkey, CASE WHEN s < 18 THEN 'a' WHEN s < 30 THEN 'b' WHEN s < 45 THEN 'c' ELSE 'd' END "
    "AS band_last, CASE WHEN s IS NULL THEN NULL WHEN s < 18 THEN 'a' WHEN s < 30 THEN 'b' "
    "WHEN s < 45 THEN 'c' ELSE 'd' END AS band_null FROM (SELECT p_partkey, nullif(p_size, 7) AS s FROM part)",
)
def _(spark, sf):
    size = F.nullif("p_size", F.lit(7))
    return table(spark, sf, "part").select(
        "p_partkey",
        C.band(size, (18, 30, 45), "abcd", "last").alias("band_last"),
        C.band(size, (18, 30, 45), "abcd", "null").alias("band_null"),
    )


@operator(
    "c9_map_hierarchy",
    "SELECT c_custkey, CASE WHEN n_nationkey < 20 THEN r_name END AS regiao FROM customer "
    "JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
)
def _(spark, sf):
    known = {r: [n for n in ns if int(n.split("_")[1]) < 20] for r, ns in regions().items()}
    state = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    return table(spark, sf, "customer").select(
        "c_custkey", C.map_hierarchy(state, known).alias("regiao")
    )


@operator(
    "c10_dim_profile",
    PANEL_SQL + "SELECT MES_REF, faixa_etaria, sexo, count(*) AS rows, CAST(sum(idade) AS BIGINT) AS idade, "
    "count(DISTINCT upa) AS upa FROM m GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return survey(spark, sf).tables["dim_perfil"].groupBy(V.PERIOD, "faixa_etaria", "sexo").agg(
        F.count("*").alias("rows"), F.sum("idade").alias("idade"), F.countDistinct("upa").alias("upa")
    )


@operator(
    "c10_dim_location",
    PANEL_SQL + "SELECT regiao, uf, situacao_domicilio, count(*) AS rows FROM m GROUP BY 1, 2, 3",
)
def _(spark, sf):
    return survey(spark, sf).tables["dim_localizacao"].groupBy(
        "regiao", "uf", "situacao_domicilio"
    ).agg(F.count("*").alias("rows"))


@operator(
    "c11_dim_dictionary",
    "SELECT codigo_variavel, nome_semantico, descricao_variavel, bloco, CASE nome_semantico WHEN 'brand#3' "
    f"THEN 'double' ELSE tipo END AS tipo, dominio, parte, meses FROM ({BRANDS_SQL})",
)
def _(spark, sf):
    path = write_dictionary(brands(spark, sf), scratch(spark))
    return R.dim_dictionary(D.read_dictionary_csv(spark, path), {"brand#3": "double"})


def _flag_sql(c: str) -> str:
    return f"CASE WHEN {c} = 'Sim' THEN 1 ELSE 0 END"


@operator(
    "c12_c13_any_of_count_of",
    "SELECT MES_REF, CASE WHEN " + " OR ".join(f"{c} = 'Sim'" for c in FLAGS) + " THEN 1 ELSE 0 END AS alguma, "
    + " + ".join(_flag_sql(c) for c in FLAGS) + f" AS quantas, count(*) AS rows FROM {LINES_SQL} GROUP BY ALL",
)
def _(spark, sf):
    return lines(spark, sf).groupBy(
        V.PERIOD, C.any_of(list(FLAGS)).alias("alguma"), C.count_of(list(FLAGS)).alias("quantas")
    ).agg(F.count("*").alias("rows"))


@operator(
    "c14_classify",
    PANEL_SQL + f"SELECT {V.LABOUR_STATUS}, count(*) AS rows FROM m GROUP BY 1",
)
def _(spark, sf):
    return survey(spark, sf).tables["base_comportamento"].groupBy(V.LABOUR_STATUS).agg(
        F.count("*").alias("rows")
    )


@operator(
    "c15_positive_flag",
    "SELECT c_custkey, CASE WHEN nullif(c_custkey % 5, 0) * c_acctbal > 0 THEN 1 ELSE 0 END AS saldo FROM customer",
)
def _(spark, sf):
    amount = F.nullif(F.col("c_custkey") % 5, F.lit(0)) * F.col("c_acctbal")
    return table(spark, sf, "customer").select("c_custkey", C.positive_flag(amount).alias("saldo"))


A_SQL = "CASE WHEN l_linenumber = 7 THEN NULL ELSE f_return END"
B_SQL = "CASE WHEN l_linenumber = 1 THEN NULL ELSE f_status END"


def _benefits(spark, sf):
    return lines(spark, sf).withColumns({"a": F.expr(A_SQL), "b": F.expr(B_SQL)})


def _overlap_case(unknown: bool) -> str:
    no = "{} <> 'Sim'" if unknown else "coalesce({}, '') <> 'Sim'"
    return (
        f"CASE WHEN a = 'Sim' AND b = 'Sim' THEN 'AE + BF' WHEN a = 'Sim' AND {no.format('b')} THEN 'Só AE' "
        f"WHEN {no.format('a')} AND b = 'Sim' THEN 'Só BF' ELSE 'Nenhum' END"
    )


BENEFITS_SQL = f"(SELECT {A_SQL} AS a, {B_SQL} AS b, * FROM {LINES_SQL})"


@operator(
    "c16_overlap_groups",
    f"SELECT {_overlap_case(False)} AS absent, {_overlap_case(True)} AS \"unknown\", count(*) AS rows "
    f"FROM {BENEFITS_SQL} GROUP BY 1, 2",
)
def _(spark, sf):
    groups = {
        p: C.overlap_groups("a", "b", V.SPEC_OVERLAP_LABELS, null_policy=p)
        for p in ("absent", "unknown")
    }
    return _benefits(spark, sf).groupBy(*[e.alias(p) for p, e in groups.items()]).agg(
        F.count("*").alias("rows")
    )


@operator(
    "c17_relabel",
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Fechado' WHEN 'P' THEN 'Parcial' END AS rotulo, "
    "CASE o_orderstatus WHEN 'P' THEN 1 WHEN 'F' THEN 2 END AS ordem FROM orders",
)
def _(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", C.relabel("o_orderstatus", {"F": "Fechado", "P": "Parcial"}).alias("rotulo"),
        C.ordinal("o_orderstatus", ["P", "F"]).cast("int").alias("ordem"),
    )


@operator(
    "c18_income_change",
    "SELECT o_orderkey, round(CAST(t - s AS DOUBLE), 2) AS variacao, CASE WHEN t - s < 0 THEN 1 ELSE 0 END AS perdeu "
    f"FROM (SELECT o_orderkey, any_value({PW}) AS t, sum({LW}) AS s FROM orders JOIN lineitem "
    "ON o_orderkey = l_orderkey GROUP BY 1)",
)
def _(spark, sf):
    total = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("usual")
    )
    o = table(spark, sf, "orders").withColumn("now", F.col("o_totalprice").cast("decimal(18,2)"))
    change, fell = C.income_change("now", "usual")
    joined = o.join(total, o.o_orderkey == total.l_orderkey)
    return joined.select(
        "o_orderkey", F.round(change.cast("double"), 2).alias("variacao"), fell.alias("perdeu")
    )


@operator(
    "c19_normalise_encoding",
    f"SELECT {MONTH_SQL} AS MES_REF, o_orderpriority || ' não' AS A2, count(*) AS rows FROM orders GROUP BY ALL",
)
def _(spark, sf):
    base = write_months(spark, sf)
    months = MD.read_periods(spark, MD.discover_periods(spark, base + "/*"))
    tables.write_partitioned(months, base + "/utf8")
    return spark.read.parquet(base + "/utf8").groupBy(V.PERIOD, "A2").agg(F.count("*").alias("rows"))


@operator(
    "c20_dual_code_label",
    f"SELECT CAST(o_orderkey AS INTEGER) AS pedido, {PRIO} AS prioridade, {PRIO_LABEL} AS prioridade_label FROM orders",
)
def _(spark, sf):
    renamed = R.rename_by_dictionary(order_text(spark, sf), ORDER_DICTIONARY, keep=())
    typed = R.cast_by_dictionary(renamed, ORDER_DICTIONARY)
    return R.dual_code_label(typed, ORDER_DICTIONARY).select("pedido", "prioridade", "prioridade_label")


@operator(
    "c21_common_variables",
    f"SELECT CAST(o_orderkey AS VARCHAR) AS pedido, CAST(o_custkey AS VARCHAR) AS cliente, "
    f"CAST(o_totalprice AS VARCHAR) AS peso, substring(o_orderpriority, 1, 1) AS prioridade, "
    f"{YEAR_SQL} AS MES_REF FROM orders",
)
def _(spark, sf):
    renamed = R.rename_by_dictionary(order_text(spark, sf), ORDER_DICTIONARY)
    return R.common_variables(renamed, ORDER_DICTIONARY, ["09", "10"])


@operator(
    "c22_missing_codes_to_null",
    "SELECT p_partkey, CASE WHEN p_size IN (9, 49) THEN NULL ELSE p_size END AS p_size, "
    "nullif(p_brand, 'Brand#9') AS p_brand FROM part",
)
def _(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_size", "p_brand")
    return R.null_missing_codes(part, {"p_size": [9, 49], "p_brand": ["Brand#9"]})


# ---- filters -------------------------------------------------------------------------------------


@operator(
    "f1_period_filter",
    f"SELECT {YEAR_SQL} AS MES_REF, o_orderkey FROM orders WHERE {YEAR_SQL} IN ('1996', '1999')",
)
def _(spark, sf):
    path = scratch(spark)
    tables.write_partitioned(orders(spark, sf), path + "/pedidos")
    kept = FI.period_filter(read_star_table(spark, path, "pedidos"), ["1996", "1999"])
    return kept.select(V.PERIOD, "o_orderkey")


@operator(
    "f2_answer_filter",
    "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' "
    "AND c_acctbal > 0 AND nullif(c_mktsegment, 'BUILDING') IS NOT NULL",
)
def _(spark, sf):
    df = homes(spark, sf).withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    kept = FI.answer_filter(df, {"o_orderstatus": "F"}, positive=["c_acctbal"], known=["segment"])
    return kept.select("o_orderkey")


@operator(
    "f3_exclude_not_applicable",
    "SELECT o_orderkey, s AS o_orderstatus FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN NULL "
    "ELSE o_orderstatus END AS s FROM orders) WHERE s <> 'P'",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_orderstatus")).alias("o_orderstatus")
    )
    return FI.exclude_not_applicable(df, "o_orderstatus", "P")


@operator(
    "f4_valid_levels",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
)
def _(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return FI.valid_levels(df, "o_orderpriority", ["1-URGENT", "2-HIGH"])


@operator(
    "f5_demographic_filter",
    PANEL_SQL + "SELECT MES_REF, uf, count(*) AS rows, " + pop() + " AS pop FROM m a WHERE regiao IN ('ASIA') "
    f"AND EXISTS (SELECT 1 FROM m b WHERE {JOIN_KEY} AND b.faixa_etaria IN ('00-17') AND b.sexo = 'Homem') "
    "GROUP BY 1, 2",
)
def _(spark, sf):
    s = survey(spark, sf)
    kept = FI.demographic_filter(
        s.tables["base_saude"], s.tables["dim_perfil"],
        FI.Selection(["00-17"], ["Homem"], ["ASIA"]), s.options, keys=s.keys, regions=s.regions,
        hot_keys=8,
    )
    return rounded(
        kept.groupBy(V.PERIOD, "uf").agg(
            F.count("*").alias("rows"), s.weight.population(F.sum(s.weight.per_row())).alias("pop")
        ), 2,
    )


@operator(
    "f6_filter_options",
    PANEL_SQL + "SELECT DISTINCT 'faixas' AS axis, faixa_etaria AS value, CASE faixa_etaria WHEN '00-17' THEN 1 "
    "WHEN '18-29' THEN 2 WHEN '30-44' THEN 3 WHEN '45-59' THEN 4 WHEN '60-74' THEN 5 ELSE 6 END AS position FROM m "
    "UNION ALL SELECT DISTINCT 'regioes', regiao, CAST(NULL AS INTEGER) FROM m "
    "UNION ALL SELECT DISTINCT 'sexos', sexo, NULL FROM m WHERE sexo IS NOT NULL",
)
def _(spark, sf):
    s = survey(spark, sf)
    profile = s.tables["dim_perfil"]
    return FI.filter_options(
        {
            "regioes": (s.tables["dim_localizacao"], "regiao"),
            "faixas": (profile, "faixa_etaria"),
            "sexos": (profile, "sexo"),
        },
        {"faixas": V.AGE_BANDS},
    )


# ---- joins ---------------------------------------------------------------------------------------

KEY4 = " AND ".join(f"a.{k} = b.{k}" for k in V.PANEL_KEY)


def _sides(spark, sf):
    s = survey(spark, sf)
    left = s.tables["base_saude"].select(
        *V.PANEL_KEY_WITH_PERIOD, V.HAS_SYMPTOM, s.weight.per_row().alias("w")
    )
    return s, left, s.tables["base_comportamento"]


def _counts() -> dict[str, Column]:
    return {"rows": F.lit(1), "w": F.col("w")}


def _people(sums: DataFrame, *by: str) -> DataFrame:
    return sums.select(*by, "rows", F.round(F.col("w") / 100.0, 2).alias("pop"))


@operator(
    "j1_panel_inner_join",
    PANEL_SQL + f"SELECT a.MES_REF, b.{V.LABOUR_STATUS}, count(*) AS rows, round(CAST(sum(a.w) AS DOUBLE), 2) AS pop "
    f"FROM m a JOIN m b ON {KEY4} GROUP BY 1, 2",
)
def _(spark, sf):
    _, left, right = _sides(spark, sf)
    sums = J.joined_sums(left, right, _counts(), V.PANEL_KEY, [V.PERIOD], [V.LABOUR_STATUS])
    return _people(sums, V.PERIOD, V.LABOUR_STATUS)


@operator(
    "j1_row_level_join_hot_keys_split",
    f"SELECT {YEAR_SQL} AS MES_REF, l_linenumber, l_partkey, o_orderpriority, o_orderkey AS l_orderkey FROM lineitem "
    "JOIN orders ON l_orderkey = o_orderkey",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    right = orders(spark, sf).withColumnRenamed("o_orderkey", "l_orderkey")
    return J.panel_join(li, right, ["l_orderkey"], ["o_orderpriority", V.PERIOD], hot_keys=16)


@operator(
    "j2_panel_inner_join_with_period",
    PANEL_SQL + f"SELECT b.{V.LABOUR_STATUS}, {pct('a.' + V.HAS_SYMPTOM + ' = 1', w='a.w')} AS pct FROM m a "
    f"JOIN m b ON {JOIN_KEY} GROUP BY 1",
)
def _(spark, sf):
    s, left, _ = _sides(spark, sf)
    ratio = M.Ratio("pct", F.col(V.HAS_SYMPTOM) * F.col("w"), F.col("w"), 100.0)
    sums = J.joined_sums(
        left, s.tables["base_comportamento"], ratio.sums(), right_by=[V.LABOUR_STATUS]
    )
    return rounded(W.finish(sums, [ratio], [V.LABOUR_STATUS]))


@operator(
    "j3_panel_left_join",
    PANEL_SQL + ", dim AS (SELECT * FROM m WHERE regiao <> 'ASIA') SELECT a.MES_REF, b.regiao, count(*) AS rows, "
    f"round(CAST(sum(a.w) AS DOUBLE), 2) AS pop FROM m a LEFT JOIN dim b ON {JOIN_KEY} GROUP BY 1, 2",
)
def _(spark, sf):
    s, left, _ = _sides(spark, sf)
    location = s.tables["dim_localizacao"].where(F.col("regiao") != "ASIA")
    sums = J.joined_sums(left, location, _counts(), left_by=[V.PERIOD], right_by=["regiao"], how="left")
    return _people(sums, V.PERIOD, "regiao")


@operator(
    "j3_row_level_left_join_hot_keys_split",
    "SELECT l_orderkey, l_linenumber, l_partkey, o_orderpriority FROM lineitem LEFT JOIN "
    "(SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    right = orders(spark, sf).where(~status("P")).withColumnRenamed("o_orderkey", "l_orderkey")
    return J.panel_join(li, right, ["l_orderkey"], ["o_orderpriority"], "left", hot_keys=16)


def _year_sums(e: str, source: str, name: str, where: str = "true") -> str:
    return f"(SELECT regiao, MES_REF, {e} AS {name} FROM {source} WHERE {where} GROUP BY 1, 2)"


@operator(
    "j4_aggregate_then_join",
    "SELECT x.regiao, x.MES_REF, pct_f, saldo, urgentes FROM "
    + _year_sums(pct("o_orderstatus = 'F'"), HOMES_SQL, "pct_f") + " x LEFT JOIN "
    + _year_sums(avg_sql("c_acctbal"), HOMES_SQL, "saldo", "c_mktsegment = 'BUILDING'")
    + " y ON x.regiao = y.regiao AND x.MES_REF = y.MES_REF LEFT JOIN "
    + _year_sums(pop(), HOMES_SQL, "urgentes", "MES_REF < '1999'")
    + " z ON x.regiao = z.regiao AND x.MES_REF = z.MES_REF",
)
def _(spark, sf):
    h, by = homes(spark, sf), ["regiao", V.PERIOD]
    parts = [
        W.ratio_table(h, [M.share("pct_f", status("F"), PRICE)], by),
        W.ratio_table(
            h.where(F.col("c_mktsegment") == "BUILDING"), [M.mean("saldo", "c_acctbal", PRICE)], by
        ),
        W.weighted_population(h.where(F.col(V.PERIOD) < "1999"), by, PRICE, "urgentes"),
    ]
    joined = J.aggregate_then_join(parts, by)
    return rounded(joined.withColumn("urgentes", F.round("urgentes", 2)))


@operator(
    "j5_rate_by_two_aggregates",
    f"SELECT o_orderpriority, MES_REF, {pct('big')} AS pct FROM (SELECT *, o_totalprice > 499000 AS big FROM "
    f"{ORDERS_SQL}) GROUP BY 1, 2 HAVING bool_or(big)",
)
def _(spark, sf):
    return rounded(
        W.rate_by_group(
            orders(spark, sf), F.col("o_totalprice") > 499000, ["o_orderpriority", V.PERIOD], PRICE
        )
    )


@operator(
    "j6_w2_group_total",
    f"SELECT o_orderpriority, o_orderstatus, {pop()} AS pop, round(CAST(sum(w) AS DOUBLE) / CAST(sum(sum(w)) OVER "
    f"(PARTITION BY o_orderpriority) AS DOUBLE) * 100, 6) AS pct FROM {ORDERS_SQL} GROUP BY 1, 2",
)
def _(spark, sf):
    pops = W.weighted_population(orders(spark, sf), ["o_orderpriority", "o_orderstatus"], PRICE)
    return rounded(W.with_group_share(pops, ["o_orderpriority"]))


@operator(
    "j7_subset_enrich",
    PANEL_SQL + f"SELECT {pct('b.' + V.HOME_OFFICE + chr(61) + chr(39) + 'Sim' + chr(39), w='a.w')} AS pct, count(*) AS rows "
    f"FROM m a JOIN m b ON {JOIN_KEY} WHERE a.{V.HAS_SYMPTOM} = 1",
)
def _(spark, sf):
    s, left, _ = _sides(spark, sf)
    subset = left.where(F.col(V.HAS_SYMPTOM) == 1)
    answers = s.tables["base_comportamento"]
    sums = J.joined_sums(subset, answers, _counts(), right_by=[V.HOME_OFFICE])
    hit = F.sum(F.when(F.col(V.HOME_OFFICE) == V.YES, F.col("w")))
    share = C.safe_ratio(hit, F.sum("w"), 100.0)
    return rounded(sums.agg(share.alias("pct"), F.sum("rows").alias("rows")))


@operator(
    "j8_semi_filter",
    "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey "
    "AND l_quantity > 40)",
)
def _(spark, sf):
    large = table(spark, sf, "lineitem").where(F.col("l_quantity") > 40)
    allowed = large.select(F.col("l_orderkey").alias("o_orderkey"))
    return J.semi_filter(table(spark, sf, "orders"), allowed, ["o_orderkey"]).select("o_orderkey")


@operator(
    "j9_key_audit",
    "SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS keys, max(n) AS max_multiplicity, "
    "CAST(sum(n - 1) AS BIGINT) AS duplicate_rows, CAST(sum(n * n) AS BIGINT) AS self_join_rows FROM "
    "(SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
)
def _(spark, sf):
    audit = J.key_audit(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return audit.withColumn("self_join_rows", F.col("self_join_rows").cast("bigint"))


# ---- shares and means ----------------------------------------------------------------------------


@operator(
    "a1_weighted_share",
    f"SELECT o_orderpriority, {pct(chr(39) + 'F' + chr(39) + ' = s')} AS pct FROM (SELECT *, nullif(o_orderstatus, 'O') AS s "
    f"FROM {ORDERS_SQL}) GROUP BY 1",
)
def _(spark, sf):
    df = orders(spark, sf).withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    return rounded(W.weighted_share(df, "s", "F", PRICE, ["o_orderpriority"]))


def _by_flag(select: str, tail: str) -> str:
    return " UNION ALL ".join(
        select.format(c=c, label=label, pct=pct(f"{c} = 'Sim'")) + f" FROM {LINES_SQL} {tail}"
        for c, label in FLAG_LABELS.items()
    )


@operator("a2_weighted_share_multi_long", _by_flag("SELECT '{label}' AS indicador, {pct} AS pct", ""))
def _(spark, sf):
    df = lines(spark, sf)
    return rounded(W.weighted_share_multi(df, FLAG_LABELS, w=LINE, long=("indicador", "pct")))


@operator(
    "a2_weighted_share_multi_wide",
    "SELECT l_returnflag, " + ", ".join(f'{pct(f"{c} = {chr(39)}Sim{chr(39)}")} AS "{x}"' for c, x in FLAG_LABELS.items())
    + f" FROM {LINES_SQL} GROUP BY 1",
)
def _(spark, sf):
    return rounded(W.weighted_share_multi(lines(spark, sf), FLAG_LABELS, w=LINE, by=["l_returnflag"]))


@operator(
    "a3_weighted_flag_rate",
    f"SELECT o_orderpriority, {pct('late')} AS pct FROM (SELECT *, o_orderstatus = 'F' AS late FROM {ORDERS_SQL}) GROUP BY 1",
)
def _(spark, sf):
    df = orders(spark, sf).withColumn("late", C.holds(status("F")))
    return rounded(W.weighted_flag_rate(df, "late", PRICE, ["o_orderpriority"]))


def _distribution_sql(c: str, source: str, where: str = "true") -> str:
    return (
        f"SELECT {c}, {pop()} AS pop, round(CAST(sum(w) AS DOUBLE) / CAST(sum(sum(w)) OVER () AS DOUBLE) * 100, 6) "
        f"AS pct FROM {source} WHERE {where} GROUP BY 1"
    )


ANSWERED = f"(SELECT *, nullif(o_orderstatus, 'O') AS s FROM {ORDERS_SQL})"


@operator("a4_w3_weighted_distribution_null_dropped", _distribution_sql("s", ANSWERED, "s IS NOT NULL"))
def _(spark, sf):
    df = orders(spark, sf).withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    return rounded(W.weighted_distribution(df, "s", PRICE))


@operator("a4_weighted_distribution_null_kept", _distribution_sql("s", ANSWERED))
def _(spark, sf):
    df = orders(spark, sf).withColumn("s", F.nullif("o_orderstatus", F.lit("O")))
    return rounded(W.weighted_distribution(df, "s", PRICE, nulls="keep"))


@operator(
    "a5_weighted_population",
    f"SELECT MES_REF, o_orderstatus, {pop()} AS pop FROM {ORDERS_SQL} GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(W.weighted_population(orders(spark, sf), [V.PERIOD, "o_orderstatus"], PRICE), 2)


@operator(
    "a6_weighted_mean",
    f"SELECT regiao, {avg_sql('x', 'o_orderstatus <> ' + chr(39) + 'P' + chr(39))} AS mean FROM "
    f"(SELECT *, nullif(c_custkey % 100, 0) AS x FROM (SELECT *, o_custkey AS c_custkey FROM {HOMES_SQL})) GROUP BY 1 UNION ALL "
    f"SELECT 'TOTAL', {avg_sql('x', 'o_orderstatus <> ' + chr(39) + 'P' + chr(39))} FROM "
    f"(SELECT *, nullif(o_custkey % 100, 0) AS x FROM {HOMES_SQL})",
)
def _(spark, sf):
    df = homes(spark, sf).withColumn("x", F.nullif(F.col("o_custkey") % 100, F.lit(0)))
    return rounded(
        W.weighted_mean(df, "x", PRICE, ~status("P"), ["regiao"], total_label=V.TOTAL)
    )


def _median_sql(source: str, by: str) -> str:
    part = f"PARTITION BY {by} " if by else ""
    group = f"{by}, " if by else ""
    return (
        f"SELECT {group} CAST(min(x) AS DOUBLE) AS median FROM (SELECT {group} x, sum(p) OVER ({part}ORDER BY x) AS c, "
        f"sum(p) OVER ({part}) AS t FROM (SELECT {group} x, sum(w) AS p FROM {source} GROUP BY ALL)) "
        f"WHERE 2 * c >= t {'GROUP BY ' + by if by else ''}"
    )


@operator(
    "a7_weighted_median_by_group",
    _median_sql(f"(SELECT *, o_totalprice AS x FROM {ORDERS_SQL})", "o_orderstatus"),
)
def _(spark, sf):
    return W.weighted_median(orders(spark, sf), "o_totalprice", PRICE, ["o_orderstatus"])


@operator("a7_weighted_median", _median_sql(f"(SELECT *, l_extendedprice AS x FROM {LINES_SQL})", ""))
def _(spark, sf):
    return W.weighted_median(table(spark, sf, "lineitem"), "l_extendedprice", LINE)


@operator(
    "w1_running_weight",
    "SELECT o_orderstatus, x, round(CAST(p AS DOUBLE), 2) AS weight, round(CAST(sum(p) OVER (PARTITION BY o_orderstatus "
    "ORDER BY x) AS DOUBLE), 2) AS cumulative, round(CAST(sum(p) OVER (PARTITION BY o_orderstatus) AS DOUBLE), 2) AS total "
    f"FROM (SELECT o_orderstatus, o_custkey AS x, sum(w) AS p FROM {ORDERS_SQL} GROUP BY 1, 2)",
)
def _(spark, sf):
    df = orders(spark, sf).withColumnRenamed("o_custkey", "x")
    run = W.running_weight(df, "x", PRICE, ["o_orderstatus"])
    return rounded(
        run.select(
            "o_orderstatus", "x",
            *[PRICE.population(F.col(c)).alias(c) for c in ("weight", "cumulative", "total")],
        ), 2,
    )


def _histogram_sql(keep: str) -> str:
    return (
        f"SELECT CAST(bin AS BIGINT) AS bin, round((bin - 1) * 400000.0 / 60, 6) AS bin_lo, "
        f"round(bin * 400000.0 / 60, 6) AS bin_hi, {pop()} AS pop FROM (SELECT w, least(CAST(floor(least(o_totalprice, "
        f"400000) / 400000 * 60) AS INT) + 1, 60) AS bin FROM {ORDERS_SQL} WHERE {keep}) GROUP BY bin"
    )


@operator("a8_weighted_histogram_clip", _histogram_sql("true"))
def _(spark, sf):
    return rounded(W.weighted_histogram(orders(spark, sf), "o_totalprice", 60, 400000, w=PRICE))


@operator("a8_weighted_histogram_drop", _histogram_sql("o_totalprice <= 400000"))
def _(spark, sf):
    return rounded(
        W.weighted_histogram(orders(spark, sf), "o_totalprice", 60, 400000, overflow="drop", w=PRICE)
    )


TESTED, HIT = "f_status = 'Sim'", "f_return = 'Sim'"


@operator(
    "a9_ratio_of_conditionals",
    f"SELECT MES_REF, {pct(TESTED)} AS tested, {pct(HIT)} AS positive, {ratio_sql(HIT, TESTED)} AS positive_tested, "
    f"CAST(NULL AS DOUBLE) AS undefined FROM {LINES_SQL} GROUP BY 1",
)
def _(spark, sf):
    tested, hit = F.col("f_status") == V.YES, F.col("f_return") == V.YES
    return rounded(
        W.ratio_of_conditionals(
            lines(spark, sf),
            {"tested": (tested, None), "positive": (hit, None), "positive_tested": (hit, tested),
             "undefined": (hit, F.col("f_status") == "?")},
            LINE, [V.PERIOD],
        )
    )


@operator(
    "a10_compare_subgroup",
    " UNION ALL ".join(
        f"SELECT '{label}' AS indicator, {pct(f'{c} = {chr(39)}Sim{chr(39)}', within)} AS pct, '{group}' AS \"group\" FROM {LINES_SQL}"
        for group, within in (("todos", None), ("devolvidos", HIT)) for c, label in FLAG_LABELS.items()
    ),
)
def _(spark, sf):
    return rounded(
        W.compare_subgroup(
            lines(spark, sf), FLAG_LABELS, F.col("f_return") == V.YES, ("todos", "devolvidos"), w=LINE
        )
    )


@operator(
    "a11_share_by_dimension",
    _by_flag("SELECT faixa, '{label}' AS indicador, {pct} AS pct", "JOIN (SELECT p_partkey, CASE WHEN p_size < 18 "
             "THEN '00-17' WHEN p_size < 30 THEN '18-29' WHEN p_size < 45 THEN '30-44' ELSE '45+' END AS faixa FROM part) "
             "ON l_partkey = p_partkey GROUP BY 1"),
)
def _(spark, sf):
    bands = ["00-17", "18-29", "30-44", "45+"]
    part = table(spark, sf, "part").select(
        F.col("p_partkey").alias("l_partkey"), C.band("p_size", (18, 30, 45), bands).alias("faixa")
    )
    ratios = M.answer_shares(FLAGS, w=LINE)
    sums = J.joined_sums(
        lines(spark, sf), part, M.sums_of(ratios), ["l_partkey"], right_by=["faixa"]
    )
    table_ = W.finish(sums, ratios, ["faixa"])
    return rounded(RS.to_long(table_, ["faixa"], FLAG_LABELS, "indicador", "pct"))


@operator(
    "a12_conditional_denominator_share",
    f"SELECT MES_REF, {pct(HIT, TESTED)} AS pct, {ratio_sql(HIT, TESTED)} AS pct_unrestricted FROM {LINES_SQL} GROUP BY 1",
)
def _(spark, sf):
    df, hit, tested = lines(spark, sf), F.col("f_return") == V.YES, F.col("f_status") == V.YES
    inside = W.conditional_denominator_share(df, hit, tested, LINE, [V.PERIOD])
    outside = W.conditional_denominator_share(df, hit, tested, LINE, [V.PERIOD], restricted=False)
    return rounded(
        inside.join(outside.withColumnRenamed("pct", "pct_unrestricted"), V.PERIOD)
    )


@operator(
    "a13_joint_condition_share",
    f"SELECT MES_REF, {pct('f_tax = ' + chr(39) + 'Sim' + chr(39), HIT)} AS pct_within, "
    f"{pct(HIT + ' AND f_tax = ' + chr(39) + 'Sim' + chr(39))} AS pct_population FROM {LINES_SQL} GROUP BY 1",
)
def _(spark, sf):
    return rounded(
        W.joint_condition_share(
            lines(spark, sf), F.col("f_return") == V.YES, F.col("f_tax") == V.YES, LINE, [V.PERIOD]
        )
    )


@operator("a14_monthly_evolution", _by_flag("SELECT MES_REF, '{label}' AS indicator, {pct} AS pct", "GROUP BY 1"))
def _(spark, sf):
    ratios = M.answer_shares(FLAGS, w=LINE)
    return rounded(W.period_evolution(lines(spark, sf), ratios, FLAG_LABELS))


def _kpi_sql(period: str, tail: str) -> str:
    return (
        f"SELECT {period} AS MES_REF, {pct(HIT)} AS devolvido, {pct(HIT, TESTED)} AS devolvido_faturado, "
        f"{avg_sql('l_quantity')} AS quantidade FROM {LINES_SQL} {tail}"
    )


@operator(
    "a15_period_total_rollup",
    _kpi_sql("MES_REF", "GROUP BY MES_REF") + " UNION ALL " + _kpi_sql("'TOTAL'", ""),
)
def _(spark, sf):
    hit, tested = F.col("f_return") == V.YES, F.col("f_status") == V.YES
    ratios = [
        M.share("devolvido", hit, LINE), M.share("devolvido_faturado", hit, LINE, tested),
        M.mean("quantidade", "l_quantity", LINE),
    ]
    return rounded(W.ratio_table(lines(spark, sf), ratios, [V.PERIOD], V.TOTAL))


@operator(
    "a16_cross_tab_rate",
    f"SELECT o_orderpriority, MES_REF, {pct(chr(39) + 'F' + chr(39) + ' = o_orderstatus')} AS pct FROM {ORDERS_SQL} GROUP BY 1, 2",
)
def _(spark, sf):
    ratio = M.share("pct", status("F"), PRICE)
    return rounded(W.cross_tab_rate(orders(spark, sf), ratio, "o_orderpriority", V.PERIOD))


@operator(
    "a16_r5_cross_tab_matrix",
    "SELECT o_orderpriority, " + ", ".join(
        f"{pct('o_orderstatus = ' + chr(39) + 'F' + chr(39), f'MES_REF = {chr(39)}{y}{chr(39)}')} AS \"{y}\"" for y in YEARS
    ) + f", CAST(NULL AS DOUBLE) AS \"2999\" FROM {ORDERS_SQL} GROUP BY 1",
)
def _(spark, sf):
    ratio = M.share("pct", status("F"), PRICE)
    return rounded(
        W.cross_tab_rate(
            orders(spark, sf), ratio, "o_orderpriority", V.PERIOD, [*YEARS, "2999"]
        )
    )


@operator(
    "a17_composition_within_group",
    f"SELECT c_mktsegment, o_orderstatus, {pop()} AS pop, round(CAST(sum(w) AS DOUBLE) / CAST(sum(sum(w)) OVER "
    f"(PARTITION BY c_mktsegment) AS DOUBLE) * 100, 6) AS pct FROM {HOMES_SQL} GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(W.composition_within_group(homes(spark, sf), ["c_mktsegment"], "o_orderstatus", PRICE))


@operator(
    "a18_composition_by_period",
    f"SELECT MES_REF, o_orderstatus, {pop()} AS pop, round(CAST(sum(w) AS DOUBLE) / CAST(sum(sum(w)) OVER "
    f"(PARTITION BY MES_REF) AS DOUBLE) * 100, 6) AS pct FROM {ORDERS_SQL} GROUP BY 1, 2",
)
def _(spark, sf):
    return rounded(W.composition_by_period(orders(spark, sf), "o_orderstatus", PRICE))


BRAND_SQL = (
    "(SELECT CASE WHEN p_size < 12 THEN NULL ELSE p_brand END AS b, "
    f"{LW} AS w FROM lineitem JOIN part ON l_partkey = p_partkey)"
)


def _brands(spark, sf):
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).withColumn(
        "b", F.when(F.col("p_size") >= 12, F.col("p_brand"))
    )


@operator(
    "a19_top_k_share_of_all",
    "SELECT b, pop, pct FROM (" + _distribution_sql("b", BRAND_SQL, "b IS NOT NULL") + ") ORDER BY pop DESC, b LIMIT 6",
)
def _(spark, sf):
    return rounded(W.top_k_weighted(_brands(spark, sf), "b", 6, LINE))


@operator(
    "a19_r3_top_k_share_of_shown",
    "SELECT b, round(CAST(p AS DOUBLE), 2) AS pop, round(CAST(p AS DOUBLE) / CAST(sum(p) OVER () AS DOUBLE) * 100, 6) AS pct "
    f"FROM (SELECT b, sum(w) AS p FROM {BRAND_SQL} GROUP BY 1 ORDER BY p DESC, b LIMIT 6)",
)
def _(spark, sf):
    return rounded(W.top_k_weighted(_brands(spark, sf), "b", 6, LINE, base="topk", nulls="keep"))


@operator(
    "a20_overlap_distribution",
    " UNION ALL ".join(
        f"SELECT '{p}' AS policy, grupo, pop, pct FROM ("
        + _distribution_sql("grupo", f"(SELECT w, {_overlap_case(p == 'unknown')} AS grupo FROM {BENEFITS_SQL})") + ")"
        for p in ("absent", "unknown")
    ),
)
def _(spark, sf):
    df = _benefits(spark, sf)
    parts = [
        W.overlap_distribution(df, "a", "b", V.SPEC_OVERLAP_LABELS, null_policy=p, w=LINE).withColumn(
            "policy", F.lit(p)
        )
        for p in ("absent", "unknown")
    ]
    return rounded(RS.stack(parts))


@operator(
    "a21_flag_split",
    "SELECT flag, pop, pct, CASE flag WHEN 1 THEN 'Com saldo' ELSE 'Sem saldo' END AS situacao FROM ("
    + _distribution_sql("flag", f"(SELECT w, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS flag FROM {HOMES_SQL})")
    + ") WHERE flag IS NOT NULL",
)
def _(spark, sf):
    flag = F.when(F.col("c_mktsegment") != "BUILDING", C.positive_flag("c_acctbal"))
    df = homes(spark, sf).withColumn("flag", flag)
    return rounded(W.flag_split(df, "flag", {1: "Com saldo", 0: "Sem saldo"}, PRICE))


@operator("a22_benefit_coverage", _by_flag("SELECT '{label}' AS beneficio, {pct} AS pct", ""))
def _(spark, sf):
    table_ = W.weighted_share_multi(lines(spark, sf), FLAG_LABELS, w=LINE, long=("beneficio", "pct"))
    return rounded(table_.orderBy("pct"))


@operator(
    "a23_multi_fact_panel",
    "SELECT o.regiao, o.MES_REF, pct_f, pct_devolvido, pct_saldo FROM "
    f"(SELECT regiao, MES_REF, {pct('o_orderstatus = ' + chr(39) + 'F' + chr(39))} AS pct_f, "
    f"{pct('c_acctbal > 0')} AS pct_saldo FROM {HOMES_SQL} GROUP BY 1, 2) o LEFT JOIN "
    f"(SELECT regiao, MES_REF, {pct('l_returnflag = ' + chr(39) + 'R' + chr(39), w='lw')} AS pct_devolvido FROM "
    f"(SELECT h.regiao, h.MES_REF, l_returnflag, {LW} AS lw FROM {HOMES_SQL} h JOIN lineitem ON l_orderkey = o_orderkey) "
    "GROUP BY 1, 2) l ON o.regiao = l.regiao AND o.MES_REF = l.MES_REF",
)
def _(spark, sf):
    h, by = homes(spark, sf), ["regiao", V.PERIOD]
    people = W.ratio_table(
        h, [M.share("pct_f", status("F"), PRICE), M.share("pct_saldo", F.col("c_acctbal") > 0, PRICE)], by
    )
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    returned = M.share("pct_devolvido", F.col("l_returnflag") == "R", LINE)
    sums = J.joined_sums(li, h.select("o_orderkey", *by), returned.sums(), ["o_orderkey"], right_by=by)
    return rounded(J.aggregate_then_join([people, W.finish(sums, [returned], by)], by))


@operator(
    "a24_spec_long_table",
    " UNION ALL ".join(
        f"SELECT {period} AS mes_ref, '{c}' AS variavel, '{label}' AS descricao, CAST(round_even(CAST(coalesce(sum(CASE WHEN "
        f"{c} = 'Sim' THEN w END), 0) AS DOUBLE), 0) AS BIGINT) AS pop_ponderada, {pct(f'{c} = {chr(39)}Sim{chr(39)}')} "
        f"AS pct_ponderado FROM {LINES_SQL} {tail}"
        for c, label in FLAG_LABELS.items()
        for period, tail in (("MES_REF", "GROUP BY MES_REF"), ("'TOTAL'", ""))
    ),
)
def _(spark, sf):
    from surveyspark.plans.specs import long_table

    ratios = M.answer_shares(FLAGS, w=LINE, empty="zero")
    sums = W.roll_up(J.additive_sums(lines(spark, sf), M.sums_of(ratios), [V.PERIOD]), [V.PERIOD])
    rows = [
        (F.col(V.PERIOD), F.lit(r.name), F.lit(FLAG_LABELS[r.name]),
         C.round_population(LINE.population(F.coalesce(F.col(r.num_sum), F.lit(0)))), r.result())
        for r in ratios
    ]
    names = ["mes_ref", "variavel", "descricao", "pop_ponderada", "pct_ponderado"]
    return rounded(long_table(sums, rows, names))


@operator(
    "a25_headline_kpis",
    f"SELECT (SELECT {pct('o_orderstatus = ' + chr(39) + 'F' + chr(39))} FROM {ORDERS_SQL}) AS pct_f, "
    f"(SELECT {pct(HIT)} FROM {LINES_SQL}) AS pct_devolvido, (SELECT {avg_sql('l_quantity')} FROM {LINES_SQL}) AS quantidade",
)
def _(spark, sf):
    li = lines(spark, sf)
    return rounded(
        W.headline(
            [
                W.ratio_table(orders(spark, sf), [M.share("pct_f", status("F"), PRICE)]),
                W.ratio_table(
                    li, [M.share("pct_devolvido", F.col("f_return") == V.YES, LINE),
                         M.mean("quantidade", "l_quantity", LINE)],
                ),
            ]
        )
    )


@operator("a26_u3_distinct_values", f"SELECT DISTINCT {YEAR_SQL} AS MES_REF, o_orderstatus FROM orders")
def _(spark, sf):
    return W.distinct_values(orders(spark, sf), V.PERIOD, "o_orderstatus")


@operator(
    "a27_period_compare_table",
    f"SELECT MES_REF, count(*) AS rows, {pop()} AS pop FROM {ORDERS_SQL} GROUP BY 1",
)
def _(spark, sf):
    return rounded(W.period_compare_table(orders(spark, sf), PRICE), 2)


# ---- sort, limit, reshape, sets --------------------------------------------------------------------


@operator(
    "r1_sort",
    f"SELECT o_orderpriority, {pop()} AS pop, row_number() OVER (ORDER BY {pop()} DESC) - 1 AS place "
    f"FROM {ORDERS_SQL} GROUP BY 1",
)
def _(spark, sf):
    pops = W.weighted_population(orders(spark, sf), ["o_orderpriority"], PRICE)
    return placed(rounded(pops, 2).orderBy(F.desc("pop")))


@operator(
    "r2_sort_by_canonical_order",
    f"SELECT o_orderstatus, {pop()} AS pop, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END "
    f"AS place FROM {ORDERS_SQL} GROUP BY 1",
)
def _(spark, sf):
    pops = rounded(W.weighted_population(orders(spark, sf), ["o_orderstatus"], PRICE), 2)
    return placed(RS.sort_by_canonical_order(pops, "o_orderstatus", ["P", "F", "O"]))


@operator(
    "r3_limit_k",
    f"SELECT o_custkey, {pop()} AS pop FROM {ORDERS_SQL} GROUP BY 1 ORDER BY pop DESC, o_custkey LIMIT 10",
)
def _(spark, sf):
    pops = rounded(W.weighted_population(orders(spark, sf), ["o_custkey"], PRICE), 2)
    return RS.limit_k(pops, 10, "pop", "o_custkey")


@operator(
    "r4_unpivot",
    f"SELECT MES_REF, 'pedidos' AS medida, CAST(count(*) AS DOUBLE) AS valor FROM {ORDERS_SQL} GROUP BY 1 UNION ALL "
    f"SELECT MES_REF, 'peso', {pop()} FROM {ORDERS_SQL} GROUP BY 1",
)
def _(spark, sf):
    wide = W.period_compare_table(orders(spark, sf), PRICE)
    wide = wide.withColumns({"rows": F.col("rows").cast("double"), "pop": F.round("pop", 2)})
    return RS.to_long(wide, [V.PERIOD], {"rows": "pedidos", "pop": "peso"}, "medida", "valor")


@operator(
    "r5_pivot",
    "SELECT MES_REF, " + ", ".join(f"round(CAST(sum(CASE WHEN o_orderstatus = '{v}' THEN w END) AS DOUBLE), 2) AS \"{v}\"" for v in "FOPX")
    + f" FROM {ORDERS_SQL} GROUP BY 1",
)
def _(spark, sf):
    pops = rounded(W.weighted_population(orders(spark, sf), [V.PERIOD, "o_orderstatus"], PRICE), 2)
    return RS.to_matrix(pops, V.PERIOD, "o_orderstatus", "pop", list("FOPX"))


@operator(
    "r6_round_report",
    f"SELECT MES_REF, round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN w END) AS DOUBLE) / CAST(sum(w) AS DOUBLE) * 100, 2) AS pct, "
    f"CAST(round_even(CAST(sum(w) AS DOUBLE), 0) AS BIGINT) AS pop FROM {ORDERS_SQL} GROUP BY 1",
)
def _(spark, sf):
    df, by = orders(spark, sf), [V.PERIOD]
    sums = J.additive_sums(df, {**M.share("pct", status("F"), PRICE).sums()}, by)
    ratio = M.share("pct", status("F"), PRICE)
    table_ = sums.select(
        V.PERIOD, ratio.result().alias("pct"),
        C.round_population(PRICE.population(F.col(ratio.den_sum))).alias("pop"),
    )
    return RS.round_columns(table_, ["pct"])


@operator(
    "u1_union_by_name",
    "SELECT o_orderkey AS id, o_orderstatus AS estado, CAST(NULL AS VARCHAR) AS segmento FROM orders UNION ALL "
    "SELECT c_custkey, NULL, c_mktsegment FROM customer",
)
def _(spark, sf):
    a = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("estado")
    )
    b = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("segmento"), F.col("c_custkey").alias("id")
    )
    return RS.stack([a, b], fill=True)


@operator(
    "u2_stack_blocks",
    f"SELECT 'estado' AS bloco, o_orderstatus AS valor, {pop()} AS pop FROM {ORDERS_SQL} GROUP BY 2 UNION ALL "
    f"SELECT 'prioridade', o_orderpriority, {pop()} FROM {ORDERS_SQL} GROUP BY 2",
)
def _(spark, sf):
    o = orders(spark, sf)
    blocks = [
        W.weighted_population(o, [c], PRICE).select(
            F.lit(name).alias("bloco"), F.col(c).alias("valor"), "pop"
        )
        for name, c in (("estado", "o_orderstatus"), ("prioridade", "o_orderpriority"))
    ]
    return rounded(RS.stack(blocks), 2)


# ---- microdata to labels, whole ------------------------------------------------------------------


@operator(
    "recode_panel",
    PANEL_SQL + "SELECT MES_REF, uf, sexo, " + f"{V.ISOLATION}, {V.TEST_RESULT}, count(*) AS rows, {pop()} AS pop, "
    "CAST(sum(idade) AS BIGINT) AS idade FROM m GROUP BY 1, 2, 3, 4, 5",
)
def _(spark, sf):
    labelled = R.recode(raw_microdata(spark, sf), dictionary())
    w = Weight(V.WEIGHT, digits=2)
    return rounded(
        labelled.groupBy(V.PERIOD, "uf", "sexo", V.ISOLATION, V.TEST_RESULT).agg(
            F.count("*").alias("rows"), w.population(F.sum(w.per_row())).alias("pop"),
            F.sum("idade").alias("idade"),
        ), 2,
    )
