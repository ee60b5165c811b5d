"""Row filters.  Conditions stay on bare columns so they reach partitions and Parquet."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.functions.columns import map_hierarchy, ordinal
from surveyspark.operators.joins import semi_filter


def period_filter(df: DataFrame, periods: Sequence[str], period: str = V.PERIOD) -> DataFrame:
    """Keep the listed periods (partition pruning)."""
    return df.where(F.col(period).isin(*periods))


def answer_filter(
    df: DataFrame,
    equals: Mapping[str, Any] | None = None,
    positive: Sequence[str] = (),
    known: Sequence[str] = (),
) -> DataFrame:
    """Conjunction of ``col = value``, ``col > 0`` and ``col is not null``."""
    for c, value in (equals or {}).items():
        df = df.where(F.col(c) == value)
    for c in positive:
        df = df.where(F.col(c) > 0)
    for c in known:
        df = df.where(F.col(c).isNotNull())
    return df


def exclude_not_applicable(
    df: DataFrame, c: str = V.LABOUR_STATUS, value: Any = V.NOT_APPLICABLE
) -> DataFrame:
    """Drop one class; unanswered rows go with it."""
    return df.where(F.col(c) != value)


def valid_levels(df: DataFrame, c: str, levels: Sequence[Any]) -> DataFrame:
    """Keep the declared levels only."""
    return df.where(F.col(c).isin(*levels))


# ---- demographic selection --------------------------------------------------------------


@dataclass(frozen=True)
class Selection:
    """Chosen values per axis; ``None`` or nothing chosen means all."""

    age_bands: Sequence[str] | None = None
    sexes: Sequence[str] | None = None
    regions: Sequence[str] | None = None


@dataclass(frozen=True)
class Options:
    """All values that exist per axis, in canonical order; empty if they are not known."""

    age_bands: Sequence[str] = V.AGE_BANDS
    sexes: Sequence[str] = ()
    regions: Sequence[str] = tuple(V.REGIONS)


def is_partial(chosen: Sequence[str] | None, options: Sequence[str]) -> bool:
    """Whether something is chosen and it is not everything; without known options, whether anything is."""
    return bool(chosen) and not (options and set(options) <= set(chosen))


def demographic_filter(
    fact: DataFrame,
    profile: DataFrame,
    selection: Selection,
    options: Options,
    skip: Sequence[str] = (),
    keys: Sequence[str] = V.PANEL_KEY_WITH_PERIOD,
    regions: Mapping[str, Sequence[str]] = V.REGIONS,
    hot_keys: int | None = None,
) -> DataFrame:
    """Restrict a fact to a demographic selection.

    An axis counts only when part of its values is chosen and it is not skipped (a chart by
    region is not filtered by region).  Age and sex need the profile: people are kept when a
    matching profile row exists, so rows are never multiplied.  The region follows from the
    state and needs no join.
    """
    conditions: list[Column] = []
    if "age_bands" not in skip and is_partial(selection.age_bands, options.age_bands):
        conditions.append(F.col("faixa_etaria").isin(*selection.age_bands))
    if "sexes" not in skip and is_partial(selection.sexes, options.sexes):
        conditions.append(F.col("sexo").isin(*selection.sexes))
    # Regions first: what they drop is neither counted for hot keys nor exchanged.
    if "regions" not in skip and is_partial(selection.regions, options.regions):
        fact = fact.where(map_hierarchy("uf", regions).isin(*selection.regions))
    if conditions:
        wanted = profile.where(reduce(Column.__and__, conditions))
        fact = semi_filter(fact, wanted, keys, hot_keys)
    return fact


def filter_options(
    frames: Mapping[str, tuple[DataFrame, str]],
    canonical: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(axis, value, position): distinct known values per axis in canonical order.

    Axes without a canonical order are alphabetical.
    """
    parts = []
    for axis, (df, c) in frames.items():
        order = (canonical or {}).get(axis)
        values = df.select(F.col(c).alias("value")).where(F.col(c).isNotNull()).distinct()
        position = ordinal("value", order) if order else F.lit(None)
        if order:
            values = values.where(F.col("value").isin(*order))
        parts.append(
            values.select(F.lit(axis).alias("axis"), "value", position.cast("int").alias("position"))
        )
    return reduce(DataFrame.unionByName, parts).orderBy("axis", "position", "value")


def collect_options(options: DataFrame) -> dict[str, list[str]]:
    """The option lists, for building an :class:`Options` (domain labels, a few dozen)."""
    lists: dict[str, list[str]] = {}
    for r in options.collect():
        lists.setdefault(r["axis"], []).append(r["value"])
    return lists
