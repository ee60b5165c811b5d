"""Report CSVs and the run index."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BYTE_ORDER_MARK = "\ufeff"
INDEX_SCHEMA = (
    "slug string, titulo string, arquivo_csv string, linhas bigint, colunas int, "
    "status string, erro string"
)


def write_spec_csv(df: DataFrame, path: str, sep: str = ",", bom: bool = False) -> None:
    """An aggregated report as one UTF-8 CSV file with header (under the folder ``path``).

    Only report tables belong here: the rows, a few dozen, go through one task.  Their
    order is kept.
    """
    if bom:
        first = df.columns[0]
        df = df.select(F.col(first).alias(BYTE_ORDER_MARK + first), *df.columns[1:])
    (
        df.coalesce(1)
        .write.mode("overwrite")
        .option("header", True)
        .option("sep", sep)
        .option("encoding", "UTF-8")
        .option("escape", '"')
        .csv(path)
    )


def write_counted(df: DataFrame, path: str, sep: str = ";") -> int:
    """``write_spec_csv`` with byte-order mark; the rows are counted as they are written, not read again."""
    seen = Observation()
    write_spec_csv(df.observe(seen, F.count(F.lit(1)).alias("rows")), path, sep=sep, bom=True)
    return seen.get["rows"]


@dataclass(frozen=True)
class Question:
    slug: str
    title: str
    build: Callable[[], DataFrame]


def run_index(
    spark: SparkSession, questions: Sequence[Question], out: str, sep: str = ";"
) -> DataFrame:
    """Run each question, write its CSV, and report what happened.

    A question that fails is recorded as ``ERRO`` with its message; the others still run.
    """
    entries = []
    for q in questions:
        path = posixpath.join(out, q.slug)
        try:
            result = q.build()
            rows = write_counted(result, path, sep)
            entries.append((q.slug, q.title, path, rows, len(result.columns), "OK", None))
        except Exception as failure:  # whatever a question raises, the others still run
            kind = "" if isinstance(failure, PySparkException) else f"{type(failure).__name__}: "
            entries.append((q.slug, q.title, None, 0, 0, "ERRO", f"{kind}{failure}"))
    return spark.createDataFrame(entries, INDEX_SCHEMA)
