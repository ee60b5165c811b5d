"""Monthly sums that are kept, so that an added month reads only its own rows.

Every statistic is a quotient of sums, and sums of months add up.  A definition, such as
``specs.clinical_sums``, maps a survey to named tables of sums that carry the period; its tables
are written by period, and evolutions and totals are regrouped from what is kept.
"""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame

from surveyspark import fixed_values as V
from surveyspark.plans.star import Survey
from surveyspark.sinks.tables import replace_periods

Definition = Callable[[Survey], Mapping[str, DataFrame]]


@dataclass(frozen=True)
class StoredSums:
    """A folder of sums of one survey: of one weight, selection, key and region map."""

    base: str

    def refresh(self, s: Survey, sums: Definition, months: Sequence[str]) -> list[str]:
        """Compute the sums of ``months`` anew from their rows alone; returns the tables written.

        A month without rows loses what was kept of it; all other months stay as they are.
        """
        if V.PERIOD not in s.keys:
            raise ValueError("rows of different months could join: sums by month do not add up")
        if not months:
            return []
        tables = sums(s.where(months=list(months)))
        for name, df in tables.items():
            if V.PERIOD not in df.columns:
                raise ValueError(f"{name} does not tell months apart")
            replace_periods(df, self._path(name), months)
        return list(tables)

    def read(self, s: Survey, sums: Definition) -> dict[str, DataFrame]:
        """The kept tables, in the chosen months; the survey gives their schemas and is not read."""
        kept = {
            name: s.tables["dim_tempo"].sparkSession.read.schema(df.schema).parquet(self._path(name))
            for name, df in sums(s).items()
        }
        if not s.months:
            return kept
        return {name: df.where(df[V.PERIOD].isin(*s.months)) for name, df in kept.items()}

    def _path(self, name: str) -> str:
        return posixpath.join(self.base, name)
