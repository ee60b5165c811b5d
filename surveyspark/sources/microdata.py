"""Monthly microdata files: wide, coded, every column text, header drifting between months."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.fixed_values import PERIOD

# A month is a file, or a folder of part files, named <anything>_MMYYYY.csv or .csv.gz.
# The first two groups of a pattern are month and year.
MONTH_PATTERN = r"[^/]*_(\d{2})(\d{4})\.csv(\.gz)?"
ENCODING = "ISO-8859-1"
#: Name for the column of lines that do not fit their file's header.
MALFORMED = "_malformed"
HEADER_READERS = 8


@dataclass(frozen=True)
class PeriodFile:
    period: str
    path: str
    compressed: bool = False


def read_microdata(
    spark: SparkSession,
    path: str | Sequence[str],
    sep: str = ",",
    encoding: str = ENCODING,
    schema: T.StructType | None = None,
    malformed: str | None = None,
) -> DataFrame:
    """Read header CSV with every column as text.

    With a schema nothing is inferred and each file's header is checked against it, so a
    file whose columns moved fails instead of being read out of line.

    A line with fewer or more fields than the header is filled with nulls or cut.  ``malformed``
    (with a schema) names a column that holds such a line as it stands, null for the others.
    """
    reader = (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("encoding", encoding)
        .option("inferSchema", False)
    )
    if schema is not None:
        if malformed is not None:
            if malformed in schema.names:
                raise ValueError(f"the files have a column {malformed}")
            schema = T.StructType([*schema, T.StructField(malformed, T.StringType())])
            # A parser that skips columns does not see how many fields a line has.
            reader = reader.option("columnNameOfCorruptRecord", malformed).option("columnPruning", False)
        reader = reader.schema(schema).option("enforceSchema", False)
    elif malformed is not None:
        raise ValueError("lines are checked against a schema: pass one")
    df = reader.csv(path if isinstance(path, str) else list(path))
    if malformed is None:
        return df
    # Spark refuses a scan of this column alone: nothing of another column makes it ask for both.
    nothing = F.substring(F.coalesce(F.col(f"`{schema.names[0]}`"), F.lit("")), 1, 0)
    return df.withColumn(malformed, F.concat(F.col(malformed), nothing))


def _month_path(pattern: str) -> str:
    """Matches a path whose file, or the folder right above the file, carries the month."""
    return f"^(.*/{pattern})(?:/[^/]+)?$"


def list_periods(spark: SparkSession, glob: str, pattern: str = MONTH_PATTERN) -> DataFrame:
    """(MES_REF, path, compressed) per month found; names that do not match are skipped.

    The listing is a file-source scan that never opens the files, so any file system Spark
    can read works.
    """
    whole = _month_path(pattern)
    part = lambda group: F.regexp_extract("path", whole, group)
    return (
        spark.read.format("binaryFile")
        .load(glob)
        .select("path")
        .where(F.col("path").rlike(whole))
        .groupBy(F.concat_ws("-", part(3), part(2)).alias(PERIOD), part(1).alias("month_path"))
        .agg(F.bool_or(F.col("path").endswith(".gz")).alias("compressed"))
        .withColumnRenamed("month_path", "path")
    )


def discover_periods(
    spark: SparkSession, glob: str, pattern: str = MONTH_PATTERN
) -> list[PeriodFile]:
    """Matching files in period order; fails when there are none."""
    try:
        rows = list_periods(spark, glob, pattern).orderBy(PERIOD, "path").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = []
    if not rows:
        raise FileNotFoundError(f"no microdata file matches {glob}")
    return [PeriodFile(r[PERIOD], r["path"], r["compressed"]) for r in rows]


def dedupe_period_files(
    files: Iterable[PeriodFile],
) -> tuple[list[PeriodFile], list[PeriodFile]]:
    """Drop the gzip twin of a plain file; returns (kept, ignored).

    Twins differ in their ending only.  Other files of the same month are different files and
    are all kept.
    """
    seen: set[tuple[str, str]] = set()
    kept: list[PeriodFile] = []
    ignored: list[PeriodFile] = []
    for f in sorted(files, key=lambda f: (f.period, f.compressed, f.path)):
        name = (f.period, re.sub(r"(\.csv)?(\.gz)?$", "", f.path))
        (ignored if name in seen else kept).append(f)
        seen.add(name)
    return kept, ignored


def union_periods(
    frames: Sequence[tuple[str, DataFrame]], period: str = PERIOD
) -> DataFrame:
    """Tag each month's frame with its period and stack by name; absent columns are null."""
    tagged = [df.withColumn(period, F.lit(value)) for value, df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def read_periods(
    spark: SparkSession,
    files: Sequence[PeriodFile],
    sep: str = ",",
    encoding: str = ENCODING,
    pattern: str = MONTH_PATTERN,
    period: str = PERIOD,
    spread: int | None = None,
    malformed: str | None = None,
) -> DataFrame:
    """All months in one frame, aligned by column name.

    Files that share a header are read by one scan, so the plan grows with the number of
    questionnaire versions rather than with the number of months, and a period filter
    prunes files at planning.  ``spread`` redistributes gzipped months, which a single task
    has to inflate, over that many partitions before the recode.

    ``malformed`` names a column of (path, line) that is filled for lines that do not fit their
    header (see :func:`split_malformed`); reading it parses whole lines instead of the columns
    that are asked for.
    """

    def header_of(f: PeriodFile) -> tuple[str, ...]:
        return tuple(read_microdata(spark, f.path, sep, encoding).columns)

    with ThreadPoolExecutor(HEADER_READERS) as pool:
        headers = list(pool.map(header_of, files))
    by_layout: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for f, header in zip(files, headers):
        by_layout.setdefault((header, f.compressed), []).append(f.path)

    month = F.regexp_replace("_metadata.file_path", _month_path(pattern), "$3-$2")
    scans = []
    for (header, compressed), paths in by_layout.items():
        schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
        scan = read_microdata(spark, paths, sep, encoding, schema, malformed).select(
            "*", month.alias(period)
        )
        if malformed is not None:
            place = F.struct(F.col("_metadata.file_path").alias("path"), F.col(malformed).alias("line"))
            scan = scan.withColumn(malformed, F.when(F.col(malformed).isNotNull(), place))
        scans.append(scan.repartition(spread) if compressed and spread else scan)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), scans)


def split_malformed(
    df: DataFrame, malformed: str = MALFORMED, period: str = PERIOD
) -> tuple[DataFrame, DataFrame]:
    """(rows of lines that fit, (path, line, period) of those that do not)."""
    bad = df.where(F.col(malformed).isNotNull())
    return df.where(F.col(malformed).isNull()).drop(malformed), bad.select(f"{malformed}.*", period)
