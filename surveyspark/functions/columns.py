"""Derived columns, each a built-in Spark expression that stays inside code generation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import add, or_
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyspark import fixed_values as V


def as_column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- permissive casts ---------------------------------------------------------------


def to_int(c: str | Column) -> Column:
    """Text to integer: fractions are cut, anything unreadable or too large is null."""
    c = as_column(c)
    # Nearly all cells are plain digits; only the rest pays for parsing a decimal.
    return F.coalesce(c.try_cast("int"), c.try_cast("double").try_cast("int"))


def to_type(c: str | Column, declared: str) -> Column:
    """Cast to a declared dictionary type; ``string`` is left alone."""
    if declared == "integer":
        return to_int(c)
    if declared == "string":
        return as_column(c)
    return as_column(c).try_cast(declared)


def missing_codes_to_null(c: str | Column, codes: Sequence[Any]) -> Column:
    """Null when the value is one of the "ignored" codes."""
    c = as_column(c)
    return F.when(~c.isin(*codes), c) if codes else c


# ---- lookups ------------------------------------------------------------------------


def literal_map(mapping: Mapping[Any, Any]) -> Column:
    return F.create_map(*[F.lit(item) for pair in mapping.items() for item in pair])


def lookup(c: str | Column, mapping: Mapping[Any, Any]) -> Column:
    """Literal-map lookup; a key outside the map (and null) gives null."""
    if not mapping:
        return F.lit(None).cast("string")
    return literal_map(mapping)[as_column(c)]


def relabel(c: str | Column, labels: Mapping[Any, str]) -> Column:
    """Short report labels; unmapped values become null."""
    return lookup(c, labels)


def ordinal(c: str | Column, levels: Sequence[Any]) -> Column:
    """1-based position of a value in its canonical order; null when it has none."""
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), as_column(c)), F.lit(0))


def map_hierarchy(c: str | Column, children: Mapping[str, Sequence[str]] = V.REGIONS) -> Column:
    """Parent of a value, e.g. the region of a state; null when the value is unknown."""
    return lookup(c, {child: parent for parent, kids in children.items() for child in kids})


# ---- classifications ----------------------------------------------------------------


def band(
    c: str | Column,
    cuts: Sequence[float] = V.AGE_CUTS,
    labels: Sequence[str] = V.AGE_BANDS,
    null_policy: str = "last",
) -> Column:
    """Left-closed bands.  A null value lands in the last band (``last``) or stays null."""
    if len(labels) != len(cuts) + 1:
        raise ValueError("one label more than cut points is needed")
    if null_policy not in ("last", "null"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    c = as_column(c)
    below = [(c < cut, label) for cut, label in zip(cuts, labels)]
    if null_policy == "null":
        below.insert(0, (c.isNull(), None))
    return classify(below, labels[-1])


def classify(rules: Sequence[tuple[Column, Any]], otherwise: Any = None) -> Column:
    """First rule that holds wins; a rule that is null does not hold."""
    if not rules:
        return F.lit(otherwise)
    chain = F
    for condition, label in rules:
        chain = chain.when(condition, F.lit(label))
    return chain.otherwise(F.lit(otherwise))


def phase(
    c: str | Column,
    phases: Mapping[str, Sequence[int]] = V.PHASES,
    otherwise: str = V.PHASE_OTHERWISE,
) -> Column:
    """Phase of an interview month; null and unlisted months fall in the last phase."""
    c = as_column(c)
    return classify([(c.isin(*months), name) for name, months in phases.items()], otherwise)


def labour_status(
    worked: str = V.WORKED, away: str = V.AWAY, looked: str = V.LOOKED
) -> Column:
    """Five-way labour-market status from three answers."""
    idle = F.col(worked) == V.NO
    jobless = idle & (F.col(away) == V.NO)
    return classify(
        [
            (F.col(worked) == V.YES, V.STATUS_WORKED),
            (idle & (F.col(away) == V.YES), V.STATUS_AWAY),
            (jobless & (F.col(looked) == V.YES), V.STATUS_UNEMPLOYED),
            (jobless & (F.col(looked) == V.NO), V.STATUS_OUT),
        ],
        V.NOT_APPLICABLE,
    )


def overlap_groups(
    a: str,
    b: str,
    labels: Sequence[str] = V.OVERLAP_LABELS,
    value: Any = V.YES,
    null_policy: str = "absent",
) -> Column:
    """2x2 membership: (both, only a, only b, none).

    ``absent``: an unanswered partner counts as not received.
    ``unknown``: an unanswered partner leaves the row in the last group.
    """
    if null_policy not in ("absent", "unknown"):
        raise ValueError(f"unknown null policy {null_policy!r}")
    has_a, has_b = F.col(a) == value, F.col(b) == value
    if null_policy == "absent":
        has_a, has_b = (F.coalesce(c, F.lit(False)) for c in (has_a, has_b))
    both, only_a, only_b, none = labels
    return classify(
        [(has_a & has_b, both), (has_a & ~has_b, only_a), (~has_a & has_b, only_b)], none
    )


# ---- flags --------------------------------------------------------------------------


def holds(condition: Column) -> Column:
    """1 when the condition holds, 0 when it is false or null."""
    return F.when(condition, 1).otherwise(0)


def any_of(columns: Sequence[str], value: Any = V.YES) -> Column:
    """1 when any column equals the value, else 0."""
    if not columns:
        return F.lit(0)
    return holds(reduce(or_, [F.col(c) == value for c in columns]))


def count_of(columns: Sequence[str], value: Any = V.YES) -> Column:
    """Number of columns that equal the value."""
    return reduce(add, [holds(F.col(c) == value) for c in columns], F.lit(0))


def positive_flag(c: str | Column) -> Column:
    """1 when an amount is above zero, else 0."""
    return holds(as_column(c) > 0)


def income_change(effective: str | Column, usual: str | Column) -> tuple[Column, Column]:
    """Effective minus usual income, and 1 when it fell."""
    change = as_column(effective) - as_column(usual)
    return change, holds(change < 0)


# ---- reporting ----------------------------------------------------------------------


def round_report(c: str | Column, digits: int = 2) -> Column:
    return F.round(as_column(c), digits)


def round_population(c: str | Column) -> Column:
    """Whole people, ties to the even number."""
    return F.bround(as_column(c), 0).cast("bigint")


def safe_ratio(num: Column, den: Column, times: float = 1.0, empty: str = "null") -> Column:
    """num / den * times as double; a missing or zero denominator gives null or 0."""
    if empty not in ("null", "zero"):
        raise ValueError(f"unknown empty policy {empty!r}")
    ratio = F.try_divide(num.cast("double"), den.cast("double"))
    if times != 1.0:
        ratio = ratio * F.lit(float(times))
    return F.coalesce(ratio, F.lit(0.0)) if empty == "zero" else ratio
