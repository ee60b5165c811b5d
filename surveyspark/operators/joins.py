"""Panel joins.

The documented panel key is not unique, so a join on it multiplies rows.  Statistics over
such joins are computed from sums taken per key *before* the join (``joined_sums``): the
result is the one the row-level join gives, but what meets in a task is one row per key and
group, however many rows share the key.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product
from math import prod
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from surveyspark import fixed_values as V

#: Left rows of a hot key that one salt takes, about.
ROWS_PER_SALT = 1_000_000

#: Combinations of levels that a key counts side by side, at most.
MOST_SLOTS = 64


def null_safe(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]]) -> Column:
    """Equality on all pairs, null matching null."""
    return reduce(
        Column.__and__, [left[a].eqNullSafe(right[b]) for a, b in pairs], F.lit(True)
    )


def additive_sums(df: DataFrame, sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Named sums per group in one aggregation."""
    return df.groupBy(*by).agg(*[F.sum(e).alias(name) for name, e in sums.items()])


# ---- row-level joins ----------------------------------------------------------------------


def _heavy_keys(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """The ``n`` most frequent keys (a top-k, so at most ``n`` rows).

    Ties are broken by key: both sides of a join must see the same list.
    """
    return (
        df.groupBy(*keys).count().orderBy(F.desc("count"), *keys).limit(n)
        .select(*keys, F.lit(True).alias("__hot"), F.col("count").alias("__rows"))
    )


def panel_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str] = V.PANEL_KEY_WITH_PERIOD,
    columns: Sequence[str] | None = None,
    how: str = "inner",
    hot_keys: int | None = None,
    salts: int | None = None,
) -> DataFrame:
    """Equi-join on the panel key, the right side cut to ``columns`` first.

    Adaptive execution splits skewed partitions by itself.  ``hot_keys=n`` spreads the ``n``
    most frequent keys of the left side over several tasks explicitly, copying only the right
    rows of those keys; the result is the same.  A key gets ``salts`` tasks, by default one for
    each ROWS_PER_SALT of its rows and two at least.  Kinds of join that keep unmatched right
    rows would keep their copies, and are refused.
    """
    if hot_keys is not None and how not in ("inner", "left", "leftouter", "left_outer", "left_semi"):
        raise ValueError(f"a {how} join cannot spread hot keys")
    keys = list(keys)
    if columns is not None:
        right = right.select(*keys, *[c for c in columns if c not in keys])
    if how == "left_semi":
        right = right.select(*keys).distinct()
    if hot_keys is None:
        return left.join(right, keys, how)
    heavy = F.broadcast(_heavy_keys(left, keys, hot_keys))  # at most hot_keys rows
    # Row content plus task number: copies of one row spread out too, and a retried task
    # puts every row where it was before.
    n = F.lit(salts) if salts else F.greatest(F.lit(2), F.ceil(F.col("__rows") / ROWS_PER_SALT)).cast("int")
    content = F.pmod(F.xxhash64(*[left[c] for c in left.columns]), n)
    spread = F.pmod(content + F.spark_partition_id(), n).cast("int")
    salted_left = left.join(heavy, keys, "left").select(
        left["*"], F.when(F.col("__hot"), spread).otherwise(0).alias("__salt")
    )
    copies = F.when(
        F.col("__hot"), F.sequence(F.lit(0), n - 1)
    ).otherwise(F.array(F.lit(0)))
    salted_right = right.join(heavy, keys, "left").select(
        right["*"], F.explode(copies).alias("__salt")
    )
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt")


def semi_filter(
    fact: DataFrame,
    allowed: DataFrame,
    keys: Sequence[str] = V.PANEL_KEY_WITH_PERIOD,
    hot_keys: int | None = None,
) -> DataFrame:
    """Rows of ``fact`` whose key occurs in ``allowed``; never multiplies rows."""
    return panel_join(fact, allowed, keys, how="left_semi", hot_keys=hot_keys)


# ---- statistics over joins ------------------------------------------------------------------


def _slot(columns: Sequence[str], levels: Mapping[str, Sequence[Any]]) -> Column:
    """Number of the combination of levels a row has, in the order of ``product``; null is a column's last level."""
    out = F.lit(0)
    for c in columns:
        chain = F.when(F.col(c).isNull(), len(levels[c]))
        for i, level in enumerate(levels[c]):
            chain = chain.when(F.col(c) == F.lit(level), i)
        unlisted = F.raise_error(F.concat(F.lit(f"not among the levels given for {c}: "), F.col(c).cast("string")))
        out = out * (len(levels[c]) + 1) + chain.otherwise(unlisted.cast("int"))
    return out


def _sums_by_level(
    left: DataFrame, right: DataFrame, sums: Mapping[str, Column], keys: Sequence[str],
    left_by: Sequence[str], free: Sequence[str], right_by: Sequence[str], how: str,
    within: DataFrame | None, levels: Mapping[str, Sequence[Any]],
) -> DataFrame:
    """``joined_sums`` with both sides aggregated by the key alone, side by side for each combination of levels.

    Counts and sums merge before the one exchange a side, so a key of any number of rows is a row
    per task.  ``free`` are the ``left_by`` columns that do not follow from the key.
    """
    left_slots, right_slots = (
        list(product(*[[*levels[c], None] for c in columns])) for columns in (free, right_by)
    )
    fixed = [c for c in left_by if c not in free]
    names = dict.fromkeys([*keys, *fixed])
    rows = left.select(
        *names, _slot(free, levels).alias("__slot"), *[e.alias(name) for name, e in sums.items()]
    )
    partial = rows.groupBy(*keys).agg(
        *[F.any_value(c).alias(c) for c in names if c not in keys],
        *[F.count_if(F.col("__slot") == i).alias(f"__m{i}") for i in range(len(left_slots))],
        *[
            F.sum(F.when(F.col("__slot") == i, F.col(name))).alias(f"__s{i}_{k}")
            for i in range(len(left_slots)) for k, name in enumerate(sums)
        ],
    )
    if within is not None:
        partial = partial.join(within.select(*keys).distinct(), list(keys), "left_semi")
    n = [f"__n{j}" for j in range(len(right_slots))]
    counts = right.select(*keys, _slot(right_by, levels).alias("__slot")).groupBy(*keys).agg(
        *[F.count_if(F.col("__slot") == j).alias(c) for j, c in enumerate(n)]
    )
    matched = partial.join(counts, list(keys), how)
    if how == "left":  # an unmatched row appears once, with nulls
        matched = matched.withColumns(
            {c: F.coalesce(c, F.lit(int(j == len(n) - 1)).cast("bigint")) for j, c in enumerate(n)}
        )
    types = [*left.select(*free).schema, *right.select(*right_by).schema]
    return _level_rows(matched, sums, fixed, left_slots, right_slots, types).select(
        *dict.fromkeys([*left_by, *right_by]), *sums
    )


def _level_rows(
    matched: DataFrame, sums: Mapping[str, Column], fixed: Sequence[str],
    left_slots: Sequence[tuple], right_slots: Sequence[tuple], types: Sequence[StructField],
) -> DataFrame:
    """A row for each combination of levels that meets, from counts and sums side by side for each key."""
    cells = [(i, j) for i in range(len(left_slots)) for j in range(len(right_slots))]
    there = {(i, j): F.col(f"__m{i}") * F.col(f"__n{j}") for i, j in cells}
    wide = matched.groupBy(*fixed).agg(
        *[F.sum(there[i, j]).alias(f"__c{i}_{j}") for i, j in cells],
        *[
            F.sum(F.when(there[i, j] > 0, F.col(f"__s{i}_{k}") * F.col(f"__n{j}"))).alias(f"__t{i}_{j}_{k}")
            for i, j in cells for k in range(len(sums))
        ],
    )
    groups = [
        F.struct(
            *[
                F.lit(v).cast(f.dataType).alias(f.name)
                for v, f in zip((*left_slots[i], *right_slots[j]), types, strict=True)
            ],
            F.col(f"__c{i}_{j}").alias("__c"),
            *[F.col(f"__t{i}_{j}_{k}").alias(name) for k, name in enumerate(sums)],
        )
        for i, j in cells
    ]
    return wide.select(*fixed, F.inline(F.array(*groups))).where(F.col("__c") > 0)


def self_joined_sums(
    rows: DataFrame,
    sums: Mapping[str, Column],
    keys: Sequence[str] = V.PANEL_KEY_WITH_PERIOD,
    where: Column | None = None,
    match: Column | None = None,
    left_by: Sequence[str] = (),
    right_by: Sequence[str] = (),
    how: str = "inner",
    within: Column | None = None,
    levels: Mapping[str, Sequence[Any]] | None = None,
    determined: Sequence[str] = (),
) -> DataFrame | None:
    """``joined_sums`` of rows with other rows of the same frame: those of ``where`` with those of ``match``.

    One aggregation by the key counts and sums both sides, so the frame is read and exchanged once.
    ``within`` keeps the keys that have such a row.  None if what is grouped by is neither
    ``determined`` by the key nor listed in ``levels``.
    """
    keys = list(keys)
    names = dict.fromkeys([*keys, *left_by])
    free = [c for c in dict.fromkeys(left_by) if c not in keys and c not in determined]
    listed = [*free, *right_by]
    if how not in ("inner", "left_semi") or not set(listed) <= set(levels or {}):
        return None
    if prod(len(levels[c]) + 1 for c in listed) > MOST_SLOTS:
        return None
    left_slots, right_slots = (
        list(product(*[[*levels[c], None] for c in columns])) for columns in (free, right_by)
    )
    slot = lambda chosen, by: F.when(F.lit(True) if chosen is None else chosen, _slot(by, levels or {}))
    fixed = [c for c in names if c not in free]
    rows = rows.where(reduce(Column.__and__, [F.col(k).isNotNull() for k in keys]))  # null keys match nothing
    if where is not None and match is not None:
        # By the conditions, not the slots: a filter is pushed down with all that it is computed from.
        rows = rows.where(reduce(Column.__or__, [c for c in (where, match, within) if c is not None]))
    sides = rows.select(
        *fixed, slot(where, free).alias("__left"), slot(match, right_by).alias("__right"),
        *([] if within is None else [within.alias("__within")]),
        *[e.alias(name) for name, e in sums.items()],
    )
    m, n = ([f"__{side}{i}" for i in range(len(slots))] for side, slots in (("m", left_slots), ("n", right_slots)))
    matched = sides.groupBy(*keys).agg(
        *[F.any_value(c).alias(c) for c in fixed if c not in keys],
        *[F.count_if(F.col("__left") == i).alias(c) for i, c in enumerate(m)],
        *[
            F.sum(F.when(F.col("__left") == i, F.col(name))).alias(f"__s{i}_{k}")
            for i in range(len(m)) for k, name in enumerate(sums)
        ],
        *[F.count_if(F.col("__right") == j).alias(c) for j, c in enumerate(n)],
        *([] if within is None else [F.bool_or("__within").alias("__within")]),
    )
    if within is not None:
        matched = matched.where("__within")
    if how == "left_semi":  # a left row counts once
        matched = matched.withColumns({c: F.least(F.col(c), F.lit(1).cast("bigint")) for c in n})
    if not listed:
        met = matched.where((F.col("__m0") > 0) & (F.col("__n0") > 0))
        times = {name: F.col(f"__s0_{k}") * F.col("__n0") for k, name in enumerate(sums)}
        return additive_sums(met, times, list(left_by))
    types = [*rows.select(*free).schema, *rows.select(*right_by).schema]
    beside = [c for c in fixed if c in left_by]
    return _level_rows(matched, sums, beside, left_slots, right_slots, types).select(
        *dict.fromkeys([*left_by, *right_by]), *sums
    )


def joined_sums(
    left: DataFrame,
    right: DataFrame,
    sums: Mapping[str, Column],
    keys: Sequence[str] = V.PANEL_KEY_WITH_PERIOD,
    left_by: Sequence[str] = (),
    right_by: Sequence[str] = (),
    how: str = "inner",
    within: DataFrame | None = None,
    unique: bool = False,
    levels: Mapping[str, Sequence[Any]] | None = None,
    determined: Sequence[str] = (),
) -> DataFrame:
    """Sums of left-side expressions over ``left JOIN right``, by columns of either side.

    Both sides are aggregated on the key first; a left sum then counts once per matching
    right row.  ``left_semi`` counts it once.  ``left`` keeps unmatched rows, their
    right-side groups null.  ``within`` first restricts the left side to keys it contains.
    ``unique`` says that neither side repeats a key: grouping by it would reduce nothing, so the
    rows are joined as they are, with one exchange a side.

    A key that repeats also costs one exchange a side if what it is grouped by is known:
    ``determined`` names ``left_by`` columns that follow from the key, and ``levels`` lists the values
    of all others (null need not be listed; a value that is missing fails the job).  Otherwise a side
    is grouped by key and column, and exchanged by the key once more.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"sums over a {how} join are not defined")
    keys = list(keys)
    if clash := set(right_by) & set(keys):
        raise ValueError(f"group key columns by the left side: {sorted(clash)}")
    by = [*left_by, *right_by]
    if unique:
        names = dict.fromkeys([*keys, *left_by])
        partial = left.select(*names, *[e.alias(name) for name, e in sums.items()])
        if within is not None:
            partial = partial.join(within.select(*keys), keys, "left_semi")
        matched = partial.join(right.select(*keys, *right_by), keys, how)
        return additive_sums(matched, {name: F.col(name) for name in sums}, by)
    beside = [c for c in dict.fromkeys(left_by) if c not in keys]
    free = [c for c in beside if c not in determined]
    listed = [*free, *right_by]
    if how != "left_semi" and listed and set(listed) <= set(levels or {}):
        if prod(len(levels[c]) + 1 for c in listed) <= MOST_SLOTS:
            return _sums_by_level(
                left, right, sums, keys, left_by, free, right_by, how, within, levels
            )
    if free:
        partial = additive_sums(left, sums, [*keys, *beside])
    else:
        partial = left.groupBy(*keys).agg(
            *[F.any_value(c).alias(c) for c in beside],
            *[F.sum(e).alias(name) for name, e in sums.items()],
        )
    if within is not None:
        partial = partial.join(within.select(*keys).distinct(), keys, "left_semi")
    if how == "left_semi":
        matched = partial.join(right.select(*keys).distinct(), keys, "left_semi")
        return additive_sums(matched, {name: F.col(name) for name in sums}, by)
    counts = right.groupBy(*keys, *right_by).agg(F.count("*").alias("__n"))
    matched = partial.join(counts, keys, how)
    times = F.coalesce("__n", F.lit(1))  # a left join's unmatched row appears once
    return additive_sums(matched, {name: F.col(name) * times for name in sums}, by)


def aggregate_then_join(
    frames: Sequence[DataFrame], on: Sequence[str], how: str = "left"
) -> DataFrame:
    """Join tables that are already aggregated to the same grain."""
    return reduce(lambda a, b: a.join(b, list(on), how), frames)


# ---- key audit ------------------------------------------------------------------------------


def key_audit(df: DataFrame, keys: Sequence[str] = V.PANEL_KEY) -> DataFrame:
    """One row: rows, distinct keys, largest multiplicity, surplus rows, self-join size."""
    n = F.col("n")
    return (
        df.groupBy(*keys)
        .agg(F.count("*").alias("n"))
        .agg(
            F.coalesce(F.sum(n), F.lit(0)).alias("rows"),
            F.count("*").alias("keys"),
            F.coalesce(F.max(n), F.lit(0)).alias("max_multiplicity"),
            F.coalesce(F.sum(n - 1), F.lit(0)).alias("duplicate_rows"),
            # n*n of a very hot key does not fit a long.
            F.coalesce(F.sum(n.cast("decimal(19,0)") * n), F.lit(0))
            .cast("decimal(38,0)")
            .alias("self_join_rows"),
        )
    )
