import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from surveyspark.functions import measures as M
from surveyspark.functions.measures import Weight
from surveyspark.operators import weighted as W
from tests.conftest import rows

SCHEMA = "m string, g string, a string, x double, w double"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame(
        [
            ("09", "p", "Sim", 10.0, 1.0), ("09", "p", "Não", 20.0, 2.0), ("09", "q", None, None, 1.0),
            ("10", "p", "Sim", 30.0, 4.0), ("10", "q", "Ignorado", 5.0, 2.0), ("10", None, "Sim", 8.0, None),
        ],
        SCHEMA,
    )


@pytest.fixture(scope="module")
def nobody(spark):
    return spark.createDataFrame([], SCHEMA)


def close(got, expected):
    assert len(got) == len(expected)
    for g, e in zip(got, expected):
        assert len(g) == len(e)
        for x, y in zip(g, e):
            assert x == y or (None not in (x, y) and math.isclose(x, y, rel_tol=1e-12)), (g, e)


def test_share_counts_the_unanswered_in_the_denominator(people):
    close(rows(W.weighted_share(people, "a", w="w")), [(50.0,)])
    close(rows(W.weighted_share(people, "a", w="w", by=["m"]), "m"), [("09", 25.0), ("10", 400 / 6)])


def test_empty_input(nobody):
    assert rows(W.weighted_share(nobody, "a", w="w")) == [(0.0,)]
    assert rows(W.weighted_share(nobody, "a", w="w", empty="null")) == [(None,)]
    assert rows(W.weighted_share(nobody, "a", w="w", by=["m"])) == []
    assert rows(W.weighted_mean(nobody, "x", "w")) == [(None,)]
    assert rows(W.weighted_median(nobody, "x", "w")) == [(None,)]
    assert rows(W.weighted_distribution(nobody, "a", "w")) == []
    assert rows(W.weighted_histogram(nobody, "x", w="w")) == []
    pair = {"r": (F.col("a") == "Sim", F.col("a") == "Talvez")}
    assert rows(W.ratio_of_conditionals(nobody, pair, "w")) == [(None,)]


def test_zero_denominator(people):
    pair = {"r": (F.col("a") == "Sim", F.col("a") == "Talvez")}
    assert rows(W.ratio_of_conditionals(people, pair, "w")) == [(None,)]
    assert rows(W.ratio_of_conditionals(people, pair, "w", empty="zero")) == [(0.0,)]


def test_null_categories(people):
    close(rows(W.weighted_distribution(people, "a", "w"), "a"),
          [("Ignorado", 2.0, 200 / 9), ("Não", 2.0, 200 / 9), ("Sim", 5.0, 500 / 9)])
    close(rows(W.weighted_distribution(people, "a", "w", nulls="keep"), "a"),
          [(None, 1.0, 10.0), ("Ignorado", 2.0, 20.0), ("Não", 2.0, 20.0), ("Sim", 5.0, 50.0)])


def test_mean_skips_unknown_values_and_their_weight(people):
    close(rows(W.weighted_mean(people, "x", "w")), [((10 + 40 + 120 + 10) / 9,)])
    close(rows(W.weighted_mean(people, "x", "w", where=F.col("a") == "Sim", by=["m"], total_label="TOTAL"), "m"),
          [("09", 10.0), ("10", 30.0), ("TOTAL", 26.0)])


def test_total_row_beside_a_null_group(people):
    got = rows(W.ratio_table(people, [M.share("pct", F.col("a") == "Sim", "w")], ["m", "g"], "TOTAL", "m"), "m", "g")
    assert [r[:2] for r in got] == [("09", "p"), ("09", "q"), ("10", None), ("10", "p"), ("10", "q"),
                                    ("TOTAL", None), ("TOTAL", "p"), ("TOTAL", "q")]
    close([got[6]], [("TOTAL", "p", 500 / 7)])


def test_restricted_and_unrestricted_numerators(people):
    hit, within = F.col("a") == "Sim", F.col("x") > 15
    close(rows(W.conditional_denominator_share(people, hit, within, "w")), [(400 / 6,)])
    close(rows(W.conditional_denominator_share(people, hit, within, "w", restricted=False)), [(500 / 6,)])


def test_rate_by_group_drops_groups_without_a_hit(people):
    close(rows(W.rate_by_group(people, F.col("a") == "Sim", ["g"], "w")), [("p", 500 / 7)])
    assert len(rows(W.rate_by_group(people, F.col("a") == "Sim", ["g"], "w", drop_empty=False))) == 3


def test_top_k_policies(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 3.0), (None, 4.0), ("d", 1.0)], "c string, w double")
    close(rows(W.top_k_weighted(df, "c", 2, "w")), [("a", 5.0, 500 / 12), ("b", 3.0, 25.0)])
    got = rows(W.top_k_weighted(df, "c", 3, "w", base="topk", nulls="keep"))
    close(sorted(got, key=str), sorted([("a", 5.0, 500 / 12), (None, 4.0, 400 / 12), ("b", 3.0, 25.0)], key=str))


def test_histogram_edges_and_overflow(spark):
    df = spark.createDataFrame([(x, 1.0) for x in (0.0, 9.999, 10.0, 99.0, 100.0, 250.0)], "x double, w double")
    clip = {r["bin"]: r["pop"] for r in W.weighted_histogram(df, "x", 10, 100, w="w").collect()}
    assert clip == {1: 2.0, 2: 1.0, 10: 3.0}
    drop = {r["bin"]: r["pop"] for r in W.weighted_histogram(df, "x", 10, 100, overflow="drop", w="w").collect()}
    assert drop == {1: 2.0, 2: 1.0, 10: 2.0}
    ranged = W.weighted_histogram(df, "x", 10, None, None, w="w").orderBy("bin").collect()
    assert (ranged[0]["bin_lo"], ranged[-1]["bin_hi"]) == (0.0, 250.0)
    assert sum(r["pop"] for r in ranged) == 6.0


def test_headline_puts_one_row_tables_side_by_side(people):
    a = W.weighted_share(people, "a", w="w")
    b = W.weighted_mean(people, "x", "w").withColumn("n", F.lit(1))
    close(rows(W.headline([a, b])), [(50.0, 20.0, 1)])


def test_fixed_point_weights_equal_exact_sums(spark):
    df = spark.range(1000).select(F.lit("a").alias("c"), F.lit(0.1).alias("w"))
    assert W.weighted_population(df, [], Weight("w", digits=1)).first()["pop"] == 100.0


# ---- properties --------------------------------------------------------------------------------

DATA = st.lists(
    st.tuples(st.sampled_from(["p", "q", None]), st.integers(-5, 30), st.integers(1, 9)),
    min_size=1, max_size=40,
)
QUICK = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@QUICK
@given(data=DATA, slices=st.sampled_from([2, 5, 64]))
def test_median_and_running_weight_equal_expansion(spark, data, slices):
    df = spark.createDataFrame(data, "g string, x int, w int")
    got = {r["g"]: r["median"] for r in W.weighted_median(df, "x", "w", ["g"], slices).collect()}
    expected = {}
    for g in {d[0] for d in data}:
        spread = sorted(x for h, x, w in data if h == g for _ in range(w))
        expected[g] = spread[(len(spread) + 1) // 2 - 1]
    assert got == expected
    run = W.running_weight(df, "x", "w", ["g"], slices).collect()
    for r in run:
        upto = [w for h, x, w in data if h == r["g"] and x <= r["x"]]
        assert r["cumulative"] == sum(upto)
        assert r["total"] == sum(w for h, _, w in data if h == r["g"])
    assert len(run) == len({(g, x) for g, x, _ in data})


def test_slices_are_found_by_halving(spark):
    cuts = [0, 1, 1, 1, 4, 9, 9]
    df = spark.createDataFrame([(x,) for x in range(-2, 12)], "x int")
    for n in range(1, len(cuts) + 1):
        own = F.array(*[F.lit(c) for c in cuts[:n]])
        for x, found in df.select("x", W._cuts_below(own, F.col("x"), n)).collect():
            assert found == sum(c < x for c in cuts[:n])
    none = F.array().cast("array<int>")
    assert {r[0] for r in df.select(W._cuts_below(none, F.col("x"), 5)).collect()} == {0}


def test_no_row_carries_the_cuts(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("w"))
    plan = W.running_weight(df, "x", "w")._jdf.queryExecution().optimizedPlan().toString()
    carried = [l for l in plan.splitlines() if "__cuts" in l and ("AS __cuts" in l or "Project [" in l)]
    assert not carried and "filter(" not in plan, plan


def test_median_of_zero_weights_is_the_smallest_value(spark):
    df = spark.createDataFrame([(3, 0), (1, 0), (2, 0)], "x int, w int")
    assert rows(W.weighted_median(df, "x", "w")) == [(1,)]


def test_slices_are_balanced_on_a_heavy_tail(spark):
    """A third of all rows on one value, the rest spread over four orders of magnitude."""
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.pow(F.lit(1.0003), F.col("id"))).alias("x"),
        F.lit(1).alias("w"),
    )
    run = W.running_weight(df, "x", Weight("w", 0), slices=32)
    assert run.count() == df.select("x").distinct().count()
    plan = run._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan
    expected = df.groupBy("x").agg(F.sum("w").alias("n"))
    cut = expected.where(F.col("x") <= 7.0).agg(F.sum("n")).first()[0]
    assert run.where(F.col("x") == 7.0).first()["cumulative"] == cut


@QUICK
@given(data=DATA)
def test_shares_add_up(spark, data):
    df = spark.createDataFrame(data, "g string, x int, w int")
    pops = W.weighted_distribution(df, "g", "w", nulls="keep").collect()
    assert math.isclose(sum(r["pct"] for r in pops), 100.0)
    assert math.isclose(sum(r["pop"] for r in pops), sum(w for _, _, w in data))
    for g in {r["g"] for r in pops}:
        inside = [r["pct"] for r in W.composition_within_group(df, ["g"], "x", "w").collect() if r["g"] == g]
        assert math.isclose(sum(inside), 100.0)


def test_histogram_values_below_the_range(spark):
    df = spark.createDataFrame([(x, 1.0) for x in (-500.0, 0.0, 5.0, 99.0, 200.0)], "x double, w double")
    clip = {r["bin"]: (r["bin_lo"], r["bin_hi"], r["pop"]) for r in W.weighted_histogram(df, "x", 10, 100, w="w").collect()}
    assert clip == {1: (0.0, 10.0, 3.0), 10: (90.0, 100.0, 2.0)}
    drop = {r["bin"]: r["pop"] for r in W.weighted_histogram(df, "x", 10, 100, overflow="drop", w="w").collect()}
    assert drop == {1: 2.0, 10: 1.0}
    one = W.weighted_histogram(df.where("x = 5"), "x", 10, None, None, w="w").collect()
    assert [(r["bin"], r["bin_lo"], r["bin_hi"], r["pop"]) for r in one] == [(1, 5.0, 5.0, 1.0)]


def test_slices_follow_the_shuffle_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.range(2000).select(F.col("id").cast("double").alias("x"), F.lit(1.0).alias("w"))
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        plan = W.running_weight(df, "x", "w")._jdf.queryExecution().logical().toString()
        assert "/ 200" in plan
        assert W.weighted_median(df, "x", "w").first()["median"] == 999.0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
