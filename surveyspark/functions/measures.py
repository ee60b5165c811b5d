"""Sample weights and additive ratios.

Every statistic of the engine is a quotient of two sums.  Keeping the sums apart until the
last projection lets one pass compute any number of statistics, lets totals be rolled up
from the finest group, and lets sums be taken before a join rather than after it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.functions.columns import safe_ratio


@dataclass(frozen=True)
class Weight:
    """A weight column.

    With ``digits`` the weight is summed as a whole number of 10^-digits units: integer
    addition does not depend on task order, so results repeat bit for bit, at the speed of
    doubles.  An overflow raises (ANSI mode) instead of wrapping.
    """

    column: str = V.WEIGHT
    digits: int | None = None
    summed: bool = False  # the column already holds a sum of ``per_row`` values

    def per_row(self) -> Column:
        w = F.col(self.column)
        if self.summed:
            return w
        if self.digits is None:
            return w.cast("double")
        return F.rint(w.cast("double") * float(10**self.digits)).cast("bigint")

    @property
    def everyone(self) -> str:
        """Name of the sum over all rows."""
        return f"{self.column}__everyone"

    def population(self, total: Column) -> Column:
        """Turn a sum of ``per_row`` back into people."""
        total = total.cast("double")
        return total if self.digits is None else total / F.lit(float(10**self.digits))


def as_weight(w: str | Weight) -> Weight:
    return w if isinstance(w, Weight) else Weight(w)


def sums_of(ratios: Iterable[Ratio]) -> dict[str, Column]:
    """All sums the ratios need, shared denominators once."""
    return {name: e for r in ratios for name, e in r.sums().items()}


@dataclass(frozen=True)
class Ratio:
    """``times * sum(num) / sum(den)``; num and den are per-row expressions."""

    name: str
    num: Column
    den: Column
    times: float = 1.0
    empty: str = "null"
    # Ratios over one denominator name its sum alike, so that it is taken once.
    den_sum: str = ""

    def __post_init__(self) -> None:
        if not self.den_sum:
            object.__setattr__(self, "den_sum", f"{self.name}__den")

    @property
    def num_sum(self) -> str:
        return f"{self.name}__num"

    def sums(self) -> dict[str, Column]:
        return {self.num_sum: self.num, self.den_sum: self.den}

    def result(self) -> Column:
        return safe_ratio(
            F.coalesce(F.col(self.num_sum), F.lit(0)), F.col(self.den_sum), self.times, self.empty
        )


def share(
    name: str,
    condition: Column,
    w: str | Weight = V.WEIGHT,
    within: Column | None = None,
    empty: str = "null",
) -> Ratio:
    """Weighted percentage of rows meeting a condition, optionally within a sub-population.

    Without ``within`` the denominator is everyone, unanswered rows included.
    """
    weight = as_weight(w)
    each = weight.per_row()
    if within is None:
        return Ratio(name, F.when(condition, each), each, 100.0, empty, weight.everyone)
    return Ratio(name, F.when(within & condition, each), F.when(within, each), 100.0, empty)


def conditional_ratio(
    name: str, numerator: Column, denominator: Column, w: str | Weight = V.WEIGHT,
    empty: str = "null",
) -> Ratio:
    """Percentage whose numerator need not lie inside its denominator."""
    weight = as_weight(w).per_row()
    return Ratio(
        name, F.when(numerator, weight), F.when(denominator, weight), 100.0, empty
    )


def flag_rate(name: str, flag: str, w: str | Weight = V.WEIGHT, empty: str = "null") -> Ratio:
    """Weighted mean of a 0/1 column, in percent."""
    weight = as_weight(w)
    each = weight.per_row()
    return Ratio(name, F.col(flag) * each, each, 100.0, empty, weight.everyone)


def mean(
    name: str,
    x: str | Column,
    w: str | Weight = V.WEIGHT,
    where: Column | None = None,
    empty: str = "null",
) -> Ratio:
    """Weighted mean over rows where the value is known (and a condition holds)."""
    x = F.col(x) if isinstance(x, str) else x
    weight = as_weight(w).per_row()
    known = x.isNotNull() if where is None else x.isNotNull() & where
    return Ratio(name, F.when(known, x * weight), F.when(known, weight), 1.0, empty)


def answer_shares(
    columns: Sequence[str] | Mapping[str, Any],
    value: Any = V.YES,
    w: str | Weight = V.WEIGHT,
    within: Column | None = None,
    empty: str = "null",
) -> list[Ratio]:
    """One share per answer column, named after the column."""
    return [share(c, F.col(c) == value, w, within, empty) for c in columns]
