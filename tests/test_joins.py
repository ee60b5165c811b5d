import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surveyspark.operators import joins as J
from tests.conftest import rows

KEY = st.sampled_from(["a", "b", "c", None])
LEFT = st.lists(st.tuples(KEY, st.sampled_from(["l", None]), st.integers(0, 9)), max_size=25)
RIGHT = st.lists(st.tuples(KEY, st.sampled_from(["r", "s", None])), max_size=15)
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def text(df):
    return sorted(map(str, rows(df)))


@QUICK
@given(left=LEFT, right=RIGHT)
def test_joined_sums_equal_the_row_level_join(spark, left, right):
    a = spark.createDataFrame(left, "k string, g string, x int")
    b = spark.createDataFrame(right, "k string, h string")
    for how in ("inner", "left"):
        expected = a.join(b, "k", how).groupBy("g", "h").agg(F.sum("x").alias("s"))
        got = J.joined_sums(a, b, {"s": F.col("x")}, ["k"], ["g"], ["h"], how)
        assert text(got.select("g", "h", "s")) == text(expected)
        for levels in ({"g": ["l"], "h": ["r", "s"]}, {"h": ["r", "s", "never"]}):
            got = J.joined_sums(a, b, {"s": F.col("x")}, ["k"], ["g"], ["h"], how, levels=levels)
            assert text(got.select("g", "h", "s")) == text(expected)
        by_key = a.join(b, "k", how).groupBy("k", "h").agg(F.sum("x").alias("s"), F.sum("x").alias("t"))
        got = J.joined_sums(
            a.withColumn("kk", F.col("k")), b, {"s": F.col("x"), "t": F.col("x")}, ["k"], ["k", "kk"], ["h"],
            how, levels={"h": ["r", "s"]}, determined=["kk"])
        assert text(got.select("k", "h", "s", "t")) == text(by_key)
    expected = a.join(b, "k", "left_semi").groupBy("g").agg(F.sum("x").alias("s"))
    assert text(J.joined_sums(a, b, {"s": F.col("x")}, ["k"], ["g"], how="left_semi")) == text(expected)


@QUICK
@given(left=LEFT, right=RIGHT, how=st.sampled_from(["inner", "left", "left_semi"]))
def test_splitting_hot_keys_changes_nothing(spark, left, right, how):
    a = spark.createDataFrame(left, "k string, g string, x int")
    b = spark.createDataFrame(right, "k string, h string")
    plain = J.panel_join(a, b, ["k"], how=how)
    split = J.panel_join(a, b, ["k"], how=how, hot_keys=2, salts=3)
    assert split.columns == plain.columns
    assert text(split) == text(plain)


def test_hot_key_on_both_sides_is_summed_before_it_meets(spark):
    """100,000 x 100,000 matches of one key: far too many rows to join, two rows to sum."""
    n = 100_000
    a = spark.range(n).select(F.lit("hot").alias("k"), F.lit(2).alias("x"))
    b = spark.range(n).select(F.lit("hot").alias("k"), F.lit("r").alias("h"))
    assert rows(J.joined_sums(a, b, {"s": F.col("x")}, ["k"], right_by=["h"])) == [("r", 2 * n * n)]


def test_a_value_that_is_not_listed_fails(spark):
    a = spark.createDataFrame([("a", 1)], "k string, x int")
    b = spark.createDataFrame([("a", "r"), ("a", "z")], "k string, h string")
    with pytest.raises(Exception, match="not among the levels given for h: z"):
        J.joined_sums(a, b, {"s": F.col("x")}, ["k"], right_by=["h"], levels={"h": ["r"]}).collect()


def test_hot_key_with_levels_is_a_row_per_task(spark):
    n = 100_000
    a = spark.range(n).select(F.lit("hot").alias("k"), F.lit(2).alias("x"))
    b = spark.range(n).select(F.lit("hot").alias("k"), F.when(F.col("id") % 2 == 0, "r").alias("h"))
    got = J.joined_sums(a, b, {"s": F.col("x")}, ["k"], right_by=["h"], levels={"h": ["r", "q"]})
    assert sorted(map(str, rows(got))) == sorted(map(str, [("r", n * n), (None, n * n)]))


def test_semi_filter_never_multiplies(spark):
    a = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "k string, x int")
    b = spark.createDataFrame([("a",), ("a",), (None,)], "k string")
    assert rows(J.semi_filter(a, b, ["k"]), "x") == [("a", 1), ("a", 2)]


def test_key_audit(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 1), ("b", 2), (None, 2)], "k string, l int")
    assert rows(J.key_audit(df, ["k", "l"])) == [(5, 3, 3, 2, 11)]
    assert rows(J.key_audit(df.limit(0), ["k", "l"])) == [(0, 0, 0, 0, 0)]


def test_grouping_by_a_right_key_is_refused(spark):
    df = spark.createDataFrame([("a", 1)], "k string, x int")
    with pytest.raises(ValueError):
        J.joined_sums(df, df, {"s": F.col("x")}, ["k"], right_by=["k"])


@pytest.mark.parametrize("how", ["right", "full", "outer", "left_anti"])
def test_hot_keys_are_refused_where_their_copies_would_show(spark, how):
    df = spark.createDataFrame([("a", 1)], "k string, x int")
    with pytest.raises(ValueError):
        J.panel_join(df, df.withColumnRenamed("x", "y"), ["k"], how=how, hot_keys=1)
    with pytest.raises(ValueError):
        J.joined_sums(df, df, {"s": F.col("x")}, ["k"], how=how)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salts_follow_the_count_of_a_key(spark, how, monkeypatch):
    monkeypatch.setattr(J, "ROWS_PER_SALT", 10)
    a = spark.createDataFrame([("hot", i) for i in range(95)] + [("b", 1), (None, 2)], "k string, x int")
    b = spark.createDataFrame([("hot", "r"), ("hot", "s"), ("c", "t")], "k string, h string")
    assert text(J.panel_join(a, b, ["k"], how=how, hot_keys=1)) == text(J.panel_join(a, b, ["k"], how=how))


@QUICK
@given(left=LEFT, right=RIGHT)
def test_unreduced_sums_equal_the_reduced_ones(spark, left, right):
    a = spark.createDataFrame(left, "k string, g string, x int")
    b = spark.createDataFrame(right, "k string, h string")
    for how in ("inner", "left"):
        one, two = (J.joined_sums(a, b, {"s": F.col("x")}, ["k"], ["g"], ["h"], how, within=b, unique=u) for u in (True, False))
        assert text(one) == text(two)


def test_a_unique_key_takes_one_exchange_a_side(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        a = spark.createDataFrame([("a", 1)], "k string, x int")
        b = spark.createDataFrame([("a", "r")], "k string, h string")
        plan = J.joined_sums(a, b, {"s": F.col("x")}, ["k"], right_by=["h"], unique=True)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(k") == 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_frame_joined_with_itself_is_aggregated_once(spark):
    data = [(k, g, h, i) for i, (k, g, h) in enumerate([
        ("a", "l", "r"), ("a", "l", "s"), ("a", "m", "r"), ("b", "l", None), ("b", None, "r"), (None, "l", "r"), ("c", "m", "s")])]
    df = spark.createDataFrame(data, "k string, g string, h string, x int")
    where, match, within = F.col("g") == "l", F.col("h") == "r", F.col("x") > 4
    sums, levels = {"s": F.col("x")}, {"g": ["l", "m"], "h": ["r", "s"]}
    for how, left_by, right_by in (
        ("inner", [], []), ("inner", ["g"], ["h"]), ("left_semi", ["k"], []),
    ):
        for w, m, i in ((where, match, None), (None, match, within)):
            left, right = (df if c is None else df.where(c) for c in (w, m))
            expected = J.joined_sums(left, right, sums, ["k"], left_by, right_by, how, within=None if i is None else df.where(i))
            got = J.self_joined_sums(df, sums, ["k"], w, m, left_by, right_by, how, i, levels)
            assert text(got.select(expected.columns)) == text(expected)
    assert J.self_joined_sums(df, sums, ["k"], left_by=["g"]) is None
