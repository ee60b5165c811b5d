"""Sample-weighted statistics.

All of them are hash aggregations with map-side partials: what is shuffled is one row per
task and group, so few and uneven groups (months, regions) cost nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.functions import measures as M
from surveyspark.functions.columns import lookup, overlap_groups, safe_ratio
from surveyspark.functions.measures import Ratio, Weight, as_weight
from surveyspark.operators.joins import additive_sums, null_safe
from surveyspark.operators.reshape import to_long

SAMPLE_PER_SLICE = 16

# ---- one pass for any number of ratios ---------------------------------------------------


def regroup(
    sums: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]], label: str = "grouping"
) -> DataFrame:
    """Coarser groupings of one table of sums, each row labelled with the index of its set.

    Works on the aggregated table: grouping sets over the raw rows would copy each of them
    once per set.
    """
    totals = [c for c in sums.columns if c not in by]
    # Spark's grouping id has a bit per column, highest first, set when it is summed over.
    ids = [
        sum(1 << (len(by) - 1 - i) for i, c in enumerate(by) if c not in kept) for kept in sets
    ]
    grouped = sums.groupingSets([list(kept) for kept in sets], *by).agg(
        F.grouping_id().alias("__id"), *[F.sum(c).alias(c) for c in totals]
    )
    index = lookup("__id", {i: n for n, i in enumerate(ids)})
    return grouped.select(index.alias(label), *by, *totals)


def roll_up(
    sums: DataFrame, by: Sequence[str], period: str = V.PERIOD, total_label: str = V.TOTAL
) -> DataFrame:
    """Add the all-periods row to a table of sums."""
    others = [c for c in by if c != period]
    both = regroup(sums, by, [by, others], "__total")
    named = F.when(F.col("__total") == 1, F.lit(total_label)).otherwise(F.col(period))
    return both.withColumn(period, named).drop("__total")


def finish(sums: DataFrame, ratios: Sequence[Ratio], by: Sequence[str] = ()) -> DataFrame:
    """Turn sums into the ratios' values."""
    return sums.select(*by, *[r.result().alias(r.name) for r in ratios])


def ratio_table(
    df: DataFrame,
    ratios: Sequence[Ratio],
    by: Sequence[str] = (),
    total_label: str | None = None,
    period: str = V.PERIOD,
) -> DataFrame:
    """Any number of ratios per group in one aggregation, optionally with a total row."""
    sums = additive_sums(df, M.sums_of(ratios), by)
    if total_label is not None:
        sums = roll_up(sums, by, period, total_label)
    return finish(sums, ratios, by)


# ---- shares and means ----------------------------------------------------------------------


def weighted_share(
    df: DataFrame, c: str, value: Any = V.YES, w: str | Weight = V.WEIGHT,
    by: Sequence[str] = (), empty: str = "zero",
) -> DataFrame:
    """Percentage of the population answering ``value``; unanswered rows count as others."""
    return ratio_table(df, [M.share("pct", F.col(c) == value, w, empty=empty)], by)


def weighted_share_multi(
    df: DataFrame, labels: Mapping[str, str], value: Any = V.YES, w: str | Weight = V.WEIGHT,
    by: Sequence[str] = (), long: tuple[str, str] | None = None, within: Column | None = None,
    empty: str = "null",
) -> DataFrame:
    """Many answer columns at once: one labelled column each, or ``(key, value)`` rows."""
    table = ratio_table(df, M.answer_shares(labels, value, w, within, empty), by)
    if long is not None:
        return to_long(table, by, labels, *long)
    return table.select(*by, *[F.col(c).alias(label) for c, label in labels.items()])


def weighted_flag_rate(
    df: DataFrame, flag: str, w: str | Weight = V.WEIGHT, by: Sequence[str] = ()
) -> DataFrame:
    """Percentage with a 0/1 flag set, by group."""
    return ratio_table(df, [M.flag_rate("pct", flag, w)], by)


def weighted_mean(
    df: DataFrame, x: str, w: str | Weight = V.WEIGHT, where: Column | None = None,
    by: Sequence[str] = (), total_label: str | None = None, empty: str = "null",
) -> DataFrame:
    """Mean over known values; with ``total_label`` also over all groups of ``by[0]``."""
    ratios = [M.mean("mean", x, w, where, empty)]
    return ratio_table(df, ratios, by, total_label, by[0] if by else V.PERIOD)


def conditional_denominator_share(
    df: DataFrame, numerator: Column, within: Column, w: str | Weight = V.WEIGHT,
    by: Sequence[str] = (), restricted: bool = True,
) -> DataFrame:
    """Share among a sub-population.

    ``restricted=False`` leaves numerator rows outside the sub-population in.
    """
    ratio = (
        M.share("pct", numerator, w, within)
        if restricted
        else M.conditional_ratio("pct", numerator, within, w)
    )
    return ratio_table(df, [ratio], by)


def ratio_of_conditionals(
    df: DataFrame, pairs: Mapping[str, tuple[Column, Column | None]],
    w: str | Weight = V.WEIGHT, by: Sequence[str] = (), empty: str = "null",
) -> DataFrame:
    """Shares over different denominators side by side; ``None`` stands for everyone."""
    ratios = [
        M.share(name, num, w, empty=empty) if den is None
        else M.conditional_ratio(name, num, den, w, empty)
        for name, (num, den) in pairs.items()
    ]
    return ratio_table(df, ratios, by)


def joint_condition_share(
    df: DataFrame, a: Column, b: Column, w: str | Weight = V.WEIGHT, by: Sequence[str] = (),
    empty: str = "zero",
) -> DataFrame:
    """Rows meeting a and b: percentage of those meeting a, and of everyone."""
    ratios = [
        M.share("pct_within", b, w, within=a, empty=empty),
        M.share("pct_population", a & b, w, empty=empty),
    ]
    return ratio_table(df, ratios, by)


def rate_by_group(
    df: DataFrame, condition: Column, by: Sequence[str], w: str | Weight = V.WEIGHT,
    drop_empty: bool = True,
) -> DataFrame:
    """Rate per group from one aggregation.

    ``drop_empty`` leaves out groups without a hit and null groups, as joining the hits'
    totals with the groups' totals would.
    """
    ratio = M.share("pct", condition, w)
    sums = additive_sums(df, ratio.sums(), by)
    if drop_empty:
        sums = sums.where(F.col(ratio.num_sum).isNotNull()).na.drop(subset=list(by))
    return finish(sums, [ratio], by)


def compare_subgroup(
    df: DataFrame, labels: Mapping[str, str], subgroup: Column, groups: tuple[str, str],
    value: Any = V.YES, w: str | Weight = V.WEIGHT,
) -> DataFrame:
    """(indicator, pct, group) for everyone and for a subgroup, from one pass."""
    everyone = [
        M.share(f"all_{i}", F.col(c) == value, w) for i, c in enumerate(labels)
    ]
    inside = [
        M.share(f"sub_{i}", F.col(c) == value, w, within=subgroup) for i, c in enumerate(labels)
    ]
    table = ratio_table(df, everyone + inside)
    rows = [
        F.struct(
            F.lit(label).alias("indicator"), F.col(f"{prefix}_{i}").alias("pct"),
            F.lit(group).alias("group"),
        )
        for prefix, group in zip(("all", "sub"), groups)
        for i, label in enumerate(labels.values())
    ]
    return table.select(F.inline(F.array(*rows)))


def period_evolution(
    df: DataFrame, ratios: Sequence[Ratio], labels: Mapping[str, str], key: str = "indicator",
    value: str = "pct", period: str = V.PERIOD,
) -> DataFrame:
    """Indicators per period as rows."""
    return to_long(ratio_table(df, ratios, [period]), [period], labels, key, value)


# ---- populations, distributions, compositions ---------------------------------------------


def weighted_population(
    df: DataFrame, by: Sequence[str] = (), w: str | Weight = V.WEIGHT, name: str = "pop"
) -> DataFrame:
    """Estimated people per group."""
    w = as_weight(w)
    return df.groupBy(*by).agg(w.population(F.sum(w.per_row())).alias(name))


def with_total_share(df: DataFrame, part: str = "pop", name: str = "pct") -> DataFrame:
    """Percentage of the grand total of an aggregated table."""
    total = df.agg(F.sum(part)).scalar()
    return df.withColumn(name, safe_ratio(F.col(part), total, 100.0))


def with_group_share(
    df: DataFrame, group: Sequence[str], part: str = "pop", name: str = "pct"
) -> DataFrame:
    """Percentage of the group's total; ``df`` holds one row per group and label."""
    total = F.sum(part).over(Window.partitionBy(*group))
    return df.withColumn(name, safe_ratio(F.col(part), total, 100.0))


def weighted_distribution(
    df: DataFrame, c: str, w: str | Weight = V.WEIGHT, nulls: str = "drop"
) -> DataFrame:
    """(category, pop, pct).  Null is left out before the denominator, or kept as a category."""
    if nulls not in ("drop", "keep"):
        raise ValueError(f"unknown null policy {nulls!r}")
    answered = df.where(F.col(c).isNotNull()) if nulls == "drop" else df
    return with_total_share(weighted_population(answered, [c], w))


def composition_within_group(
    df: DataFrame, group: Sequence[str], level: str, w: str | Weight = V.WEIGHT
) -> DataFrame:
    """Share of each level inside its group."""
    return with_group_share(weighted_population(df, [*group, level], w), group)


def composition_by_period(
    df: DataFrame, c: str, w: str | Weight = V.WEIGHT, period: str = V.PERIOD
) -> DataFrame:
    """Share of each class inside its period."""
    return composition_within_group(df, [period], c, w)


def top_k_weighted(
    df: DataFrame, c: str, k: int = 6, w: str | Weight = V.WEIGHT, base: str = "all",
    nulls: str = "drop",
) -> DataFrame:
    """The k heaviest categories, ties in category order.

    ``base``: percentages of ``all`` categories, or of the ``topk`` alone.
    """
    return top_k_of(weighted_population(df, [c], w), c, k, base, nulls)


def top_k_of(
    pops: DataFrame, c: str, k: int = 6, base: str = "all", nulls: str = "drop"
) -> DataFrame:
    """The k heaviest categories of a population table."""
    if base not in ("all", "topk") or nulls not in ("drop", "keep"):
        raise ValueError(f"unknown policy {base!r}, {nulls!r}")
    if nulls == "drop":
        pops = pops.where(F.col(c).isNotNull())
    table = with_total_share(pops) if base == "all" else pops
    top = table.orderBy(F.desc("pop"), F.col(c).asc_nulls_last()).limit(k)
    return top if base == "all" else with_total_share(top)


def overlap_distribution(
    df: DataFrame, a: str, b: str, labels: Sequence[str] = V.OVERLAP_LABELS, value: Any = V.YES,
    null_policy: str = "absent", w: str | Weight = V.WEIGHT, group: str = "grupo",
) -> DataFrame:
    """Population and percentage of each membership group of two benefits."""
    grouped = df.withColumn(group, overlap_groups(a, b, labels, value, null_policy))
    return weighted_distribution(grouped, group, w)


def flag_split(
    df: DataFrame, flag: str, labels: Mapping[Any, str], w: str | Weight = V.WEIGHT,
    name: str = "situacao",
) -> DataFrame:
    """Population with and without a flag.  Unmapped values count in the total, then drop."""
    table = weighted_distribution(df, flag, w, nulls="keep")
    return table.withColumn(name, lookup(flag, labels)).where(F.col(name).isNotNull())


def cross_tab_rate(
    df: DataFrame, ratio: Ratio, row: str, column: str, columns: Sequence[str] | None = None
) -> DataFrame:
    """A rate by two attributes, long, or as a matrix with the given columns."""
    table = ratio_table(df, [ratio], [row, column])
    if columns is None:
        return table
    return table.groupBy(row).pivot(column, list(columns)).agg(F.first(ratio.name))


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()


def period_compare_table(
    df: DataFrame, w: str | Weight = V.WEIGHT, period: str = V.PERIOD
) -> DataFrame:
    """Rows and weighted population per period."""
    w = as_weight(w)
    return df.groupBy(period).agg(
        F.count("*").alias("rows"), w.population(F.sum(w.per_row())).alias("pop")
    )


def headline(frames: Sequence[DataFrame]) -> DataFrame:
    """One-row tables (aggregates without groups) side by side."""

    def beside(a: DataFrame, b: DataFrame) -> DataFrame:
        row = b.select(F.struct(*b.columns)).scalar()  # one row by construction
        return a.withColumn("__row", row).select(*a.columns, "__row.*")

    return reduce(beside, frames)


# ---- running weights, medians, histograms ---------------------------------------------------


def running_weight(
    df: DataFrame, x: str, w: str | Weight = V.WEIGHT, by: Sequence[str] = (),
    slices: int | None = None, _around_half: bool = False,
) -> DataFrame:
    """(by..., x, weight, cumulative, total) per distinct value, weights in summed units.

    A running sum orders a whole group.  To keep a large group out of a single task the
    values are cut into ``slices`` ranges; each slice is summed, the few slice totals are
    accumulated, and each slice then runs on its own from where the one before it ended.

    The cut points come from the values of lowest hash, an even sample that any evaluation
    repeats exactly.  They affect balance only: sums are exact.  By default there are as many
    slices as shuffle partitions, 64 at least, so that they follow what the session is set to.
    A value's slice is found by halving the ordered cuts, which stand once in the plan and in no row.
    """
    if slices is None:
        slices = max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if slices < 2:
        raise ValueError("at least two slices are needed")
    by = list(by)
    values = (
        df.where(F.col(x).isNotNull())
        .groupBy(*by, x)
        .agg(F.sum(as_weight(w).per_row()).alias("weight"))
        # All uses below read this table with its weight, so its shuffle is done once.
        .where(F.col("weight").isNotNull())
    )
    sample = (
        values.orderBy(F.xxhash64(*by, x), *by, x)
        .limit(slices * SAMPLE_PER_SLICE)
        .agg(F.array_sort(F.collect_list(x)).alias("s"))
    )
    position = lambda i: F.floor(i * F.size("s") / slices).cast("int")
    cuts = sample.select(
        F.transform(F.sequence(F.lit(1), F.lit(slices - 1)), lambda i: F.get("s", position(i)))
    )
    # Only the plan names the column: the optimizer puts the one subquery in its place.
    sliced = (
        values.withColumn("__cuts", cuts.scalar())
        .withColumn("__slice", _cuts_below(F.col("__cuts"), F.col(x), slices - 1))
        .drop("__cuts")
    )
    in_order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__slice")
    totals = (
        sliced.groupBy(*by, "__slice")
        .agg(F.sum("weight").alias("__in"))
        .withColumn("__upto", F.sum("__in").over(in_order))
        .withColumn(
            "total",
            F.sum("__in").over(Window.partitionBy(*(by or [F.lit(0)]))),
        )
        .withColumn("__before", F.col("__upto") - F.col("__in"))
    )
    if _around_half:
        totals = totals.where(
            (F.col("__upto") * 2 >= F.col("total"))
            & ((F.col("__before") * 2 < F.col("total")) | (F.col("total") == 0))
        )
    totals = totals.select(
        *[F.col(c).alias(f"__{c}") for c in by], F.col("__slice").alias("__at"), "__before", "total"
    )
    pairs = [*[(c, f"__{c}") for c in by], ("__slice", "__at")]
    run = Window.partitionBy(*by, "__slice").orderBy(x).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return sliced.join(totals, null_safe(sliced, totals, pairs)).select(
        *by, x, "weight",
        (F.col("__before") + F.sum("weight").over(run)).alias("cumulative"), "total",
    )


def _cuts_below(cuts: Column, x: Column, n: int) -> Column:
    """How many of ``n`` ordered cuts are smaller than ``x``, in about log2(n) comparisons."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(n.bit_length()))])

    def halved(state: Column, step: Column) -> Column:
        further = F.get(state["cuts"], state["n"] + step - 1) < x
        return F.struct(
            F.when(further, state["n"] + step).otherwise(state["n"]).alias("n"),
            state["cuts"].alias("cuts"),
        )

    # The cuts are named once and handed from step to step: named in each, they would be a column.
    start = F.struct(F.lit(0).alias("n"), cuts.alias("cuts"))
    return F.aggregate(steps, start, halved, lambda state: state["n"])


def weighted_median(
    df: DataFrame, x: str, w: str | Weight = V.WEIGHT, by: Sequence[str] = (),
    slices: int | None = None, name: str = "median",
) -> DataFrame:
    """Lower weighted median: the smallest value at which half the weight is reached.

    Only the slice in which that happens is ordered.
    """
    run = running_weight(df, x, w, by, slices, _around_half=True)
    reached = run.where(F.col("cumulative") * 2 >= F.col("total"))
    return reached.groupBy(*by).agg(F.min(x).alias(name))


def weighted_histogram(
    df: DataFrame, x: str, bins: int = V.INCOME_BINS, hi: float | None = V.INCOME_CAP,
    lo: float | None = 0.0, overflow: str = "clip", w: str | Weight = V.WEIGHT,
    by: Sequence[str] = (),
) -> DataFrame:
    """(by..., bin, bin_lo, bin_hi, pop), equal widths, the last bin closed on both sides.

    Values beyond ``lo`` or ``hi`` are clipped into the first and last bin, or dropped.  Limits
    of ``None`` are taken from the data.  A range without width is bin 1 alone.
    """
    if overflow not in ("clip", "drop"):
        raise ValueError(f"unknown overflow policy {overflow!r}")
    w = as_weight(w)
    known = df.where(F.col(x).isNotNull())
    if hi is not None and overflow == "drop":
        known = known.where(F.col(x) <= hi)
    if lo is not None and overflow == "drop":
        known = known.where(F.col(x) >= lo)

    def bound(limit: float | None, f) -> Column:
        return F.lit(float(limit)) if limit is not None else known.agg(
            f(x).cast("double")
        ).scalar()

    low, high = bound(lo, F.min), bound(hi, F.max)
    value = F.col(x).cast("double")
    return (
        known.select(*by, value.alias("__x"), w.per_row().alias("__w"), low.alias("__lo"),
                     high.alias("__hi"))
        .groupBy(
            *by, "__lo", "__hi",
            F.when(F.col("__lo") == F.col("__hi"), F.lit(1).cast("bigint")).otherwise(
                F.least(
                    F.width_bucket(
                        F.greatest(F.least("__x", "__hi"), "__lo"), F.col("__lo"), F.col("__hi"), F.lit(bins)
                    ),
                    F.lit(bins),
                )
            ).alias("bin"),
        )
        .agg(w.population(F.sum("__w")).alias("pop"))
        .select(
            *by, "bin",
            (F.col("__lo") + (F.col("bin") - 1) * (F.col("__hi") - F.col("__lo")) / bins).alias("bin_lo"),
            (F.col("__lo") + F.col("bin") * (F.col("__hi") - F.col("__lo")) / bins).alias("bin_hi"),
            "pop",
        )
    )
