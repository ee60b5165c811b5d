"""Ordering and reshaping of result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyspark.functions.columns import ordinal, round_report


def sort_by_canonical_order(
    df: DataFrame, c: str, levels: Sequence[Any], *then: str
) -> DataFrame:
    """Order by the position in ``levels``; other values come last."""
    return df.orderBy(ordinal(c, levels).asc_nulls_last(), *then)


def limit_k(df: DataFrame, k: int, by: str, *ties: str) -> DataFrame:
    """The k largest rows by a metric, ties broken by name."""
    return df.orderBy(F.desc(by), *ties).limit(k)


def to_long(
    df: DataFrame, ids: Sequence[str], labels: Mapping[str, str], key: str, value: str
) -> DataFrame:
    """One row per id and labelled column."""
    wide = df.select(*ids, *[F.col(c).alias(label) for c, label in labels.items()])
    return wide.unpivot(list(ids), list(labels.values()), key, value)


def to_matrix(
    df: DataFrame, index: str | Sequence[str], column: str, value: str, columns: Sequence[Any]
) -> DataFrame:
    """Pivot to a fixed set and order of columns; an absent cell is null."""
    index = [index] if isinstance(index, str) else list(index)
    return df.groupBy(*index).pivot(column, list(columns)).agg(F.first(value))


def round_columns(df: DataFrame, columns: Sequence[str], digits: int = 2) -> DataFrame:
    return df.withColumns({c: round_report(c, digits) for c in columns})


def stack(frames: Sequence[DataFrame], fill: bool = False) -> DataFrame:
    """Concatenate by column name, duplicates kept; ``fill`` adds absent columns as null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=fill), frames)
