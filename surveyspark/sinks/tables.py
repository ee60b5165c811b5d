"""Partitioned Parquet tables, catalog publication and post-write checks."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager, suppress
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.fixed_values import PERIOD, TOTAL
from surveyspark.functions.measures import Weight, as_weight
from surveyspark.sources.tables import VERSION


#: Months that a task writes side by side.
OPEN_WRITERS = 16


@contextmanager
def unsorted_writes(spark: SparkSession) -> Iterator[None]:
    """Let tasks keep a file open for each of a few months.

    Spark else sorts the rows of a task by month before it writes them; wide rows then spill.
    """
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, str(OPEN_WRITERS))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def write_partitioned(
    df: DataFrame,
    path: str,
    partition: str | None = PERIOD,
    mode: str = "overwrite",
    max_records_per_file: int | None = None,
) -> None:
    """Snappy Parquet, one folder per period; ``partition=None`` for the metadata table.

    No shuffle is added: input splits already belong to one month, so a task opens one file.
    """
    writer = df.write.mode(mode).option("compression", "snappy")
    if partition:
        # A full rewrite, whatever the session's overwrite mode is.
        writer = writer.option("partitionOverwriteMode", "static").partitionBy(partition)
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", max_records_per_file)
    writer.parquet(path)


def overwrite_period(df: DataFrame, path: str, partition: str = PERIOD) -> None:
    """Replace only the periods present in ``df``; the others stay as they are."""
    (
        df.write.mode("overwrite")
        .option("compression", "snappy")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition)
        .parquet(path)
    )


def replace_periods(
    df: DataFrame, path: str, periods: Sequence[str], partition: str = PERIOD
) -> None:
    """Let ``df`` stand for all of ``periods``: those it has no rows of go, others stay as they are.

    The old rows of a period go after the new ones are written, so a failed write loses nothing.
    """
    spark = df.sparkSession

    def files(period: str) -> list[str]:
        fs, folder = _jvm_file(spark, f"{path}/{partition}={period}")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    before = {p: files(p) for p in periods}
    overwrite_period(df, path, partition)
    for p, old in before.items():
        if old and files(p) == old:
            remove_folder(spark, f"{path}/{partition}={p}")


def publish_table(
    df: DataFrame,
    database: str,
    table: str,
    path: str,
    partition: str | None = PERIOD,
    buckets: int | None = None,
    bucket_keys: Sequence[str] = (),
) -> str:
    """Create or replace an external catalog table at ``path``; returns its full name.

    Tables bucketed by the panel key (same ``buckets``) join with each other without a
    shuffle, which is where most of the cost of fact-to-dimension joins lies.  A bucketed table
    is dealt by bucket before it is written, so each bucket and period is one file, and is
    written whole.
    """
    spark = df.sparkSession
    name = f"`{database}`.`{table}`"
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{database}`")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.write.format("parquet").mode("overwrite").option("path", path)
    if partition:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition)
    if buckets:
        writer = df.repartition(buckets, *bucket_keys).write.format("parquet").mode("overwrite").option("path", path)
        writer = writer.partitionBy(partition) if partition else writer
        writer = writer.bucketBy(buckets, *bucket_keys).sortBy(*bucket_keys)
    writer.saveAsTable(name)
    return name


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it lives."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


# ---- versions that switch at once ------------------------------------------------------------

MANIFESTS = "_manifests"


def _jvm_file(spark: SparkSession, path: str):
    """(file system, path) of a JVM path."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()), jvm_path


def _manifest_numbers(spark: SparkSession, base: str) -> list[int]:
    fs, folder = _jvm_file(spark, f"{base}/{MANIFESTS}")
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def read_manifest(spark: SparkSession, base: str, number: int | None = None) -> dict[str, dict[str, str]] | None:
    """{table: {period folder: version}} of the newest (or the given) manifest under ``base``; None if there is none."""
    numbers = _manifest_numbers(spark, base)
    if not numbers:
        return None
    text = spark.read.text(f"{base}/{MANIFESTS}/{number or numbers[-1]}.json", wholetext=True).first()[0]
    return json.loads(text)


def write_version(df: DataFrame, base: str, table: str, version: str, partition: str = PERIOD) -> list[str]:
    """Write a table's periods to a folder of this version, which nobody reads yet; returns the period folders."""
    path = f"{base}/{table}/{VERSION}={version}"
    write_partitioned(df, path, partition)
    return period_folders(df.sparkSession, path, partition)


def period_folders(spark: SparkSession, path: str, partition: str = PERIOD) -> list[str]:
    """Names of a table's period folders, in order."""
    fs, folder = _jvm_file(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(n for n in names if n.startswith(f"{partition}="))


def switch_manifest(
    spark: SparkSession, base: str, version: str, written: Mapping[str, Sequence[str]],
    incremental: bool = True, replaced: Sequence[str] = (),
) -> int:
    """Let readers see ``written`` (table: period folders) from now on; returns the manifest's number.

    The manifest is written aside and renamed to the next number, so a reader sees all tables of
    the old or all of the new state.  With ``incremental`` the periods that were not written stay,
    but for those that are ``replaced``: a table that has no rows of them now loses its old ones.  If another publication took the number, nothing is switched and the call fails.
    """
    old = (read_manifest(spark, base) or {}) if incremental else {}
    tables = {
        t: {p: v for p, v in old.get(t, {}).items() if t not in written or p not in replaced}
        | {p: version for p in written.get(t, ())}
        for t in dict.fromkeys([*old, *written])
    }
    number = (_manifest_numbers(spark, base) or [0])[-1] + 1
    fs, aside = _jvm_file(spark, f"{base}/{MANIFESTS}/.{version}")
    out = fs.create(aside)
    out.write(bytearray(json.dumps(tables, indent=1).encode()))
    out.close()
    final = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{MANIFESTS}/{number}.json")
    try:
        if fs.exists(final) or not _renamed(fs, aside, final):
            raise FileExistsError(f"manifest {number} of {base} was written by another publication")
    finally:
        fs.delete(aside, False)
    return number


def _renamed(fs, aside, final) -> bool:
    """Give a file a name that must be free.  A rename on a local disk would replace what has the name, a link fails."""
    real = fs.resolvePath(aside).toUri()
    if real.getScheme() != "file":
        return fs.rename(aside, final)
    with suppress(FileExistsError):
        os.link(real.getPath(), os.path.join(os.path.dirname(real.getPath()), final.getName()))
        return True
    return False


def drop_old_versions(spark: SparkSession, base: str, keep: int = 1) -> list[str]:
    """Delete the version folders that none of the newest ``keep`` manifests names, and older manifests; for when no reader has them open."""
    numbers = _manifest_numbers(spark, base)
    kept = [read_manifest(spark, base, n) for n in numbers[-keep:]]
    named = {(t, v) for m in kept for t, periods in m.items() for v in periods.values()}
    gone = []
    for table in {t for m in kept for t in m}:
        fs, folder = _jvm_file(spark, f"{base}/{table}")
        for status in fs.listStatus(folder):
            version = status.getPath().getName().removeprefix(f"{VERSION}=")
            if status.isDirectory() and (table, version) not in named:
                fs.delete(status.getPath(), True)
                gone.append(f"{table}/{version}")
    for n in numbers[:-keep]:
        remove_folder(spark, f"{base}/{MANIFESTS}/{n}.json")
    return sorted(gone)


def register_partitions(spark: SparkSession, table: str) -> None:
    """Pick up partition folders the catalog does not know yet."""
    spark.catalog.recoverPartitions(table)


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def validate_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rows), one job for all tables."""
    return _stack(
        [
            df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
            for name, df in tables.items()
        ]
    )


def profile_tables(
    tables: Mapping[str, DataFrame],
    descriptions: Mapping[str, str] | None = None,
    w: str | Weight | None = None,
    period: str = PERIOD,
) -> DataFrame:
    """Rows, column count and weighted population per table and period, plus a total row.

    Tables without the weight column get a null population.
    """
    weight = as_weight(w) if w is not None else Weight()
    frames = []
    for name, df in tables.items():
        weighted = weight.column in df.columns
        by_period = df.groupBy(period).agg(
            F.count("*").alias("rows"),
            (F.sum(weight.per_row()) if weighted else F.max(F.lit(None).cast("bigint"))).alias(
                "weight"
            ),
        )
        frames.append(
            by_period.groupingSets([[period], []], period)
            .agg(
                F.grouping(period).alias("is_total"),
                F.sum("rows").alias("rows"),
                weight.population(F.sum("weight")).alias("population"),
            )
            .select(
                F.lit(name).alias("table"),
                F.when(F.col("is_total") == 1, F.lit(TOTAL)).otherwise(F.col(period)).alias(period),
                "rows",
                F.lit(len(df.columns)).alias("columns"),
                "population",
                F.lit((descriptions or {}).get(name)).cast("string").alias("description"),
            )
        )
    return _stack(frames)
