"""Readers of the published star tables and of report CSVs."""

from __future__ import annotations

import posixpath
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.fixed_values import PERIOD

#: Folder level that tells versions of a table apart (see ``sinks.tables.write_version``).
VERSION = "_version"


def read_star_table(
    spark: SparkSession,
    base: str,
    table: str,
    schema: T.StructType | None = None,
) -> DataFrame:
    """A month-partitioned Parquet table; the period comes back from the path as text.

    Months written at different times may differ in columns.  Without a schema the footers
    are merged by name, which reads every footer once; passing the schema (see
    ``plans.star.star_schemas``) skips that, and is what a large table should do.
    """
    reader = spark.read
    reader = reader.option("mergeSchema", True) if schema is None else reader.schema(schema)
    df = reader.parquet(posixpath.join(base, table))
    if dict(df.dtypes).get(PERIOD, "string") != "string":
        # Folder names that look like numbers are inferred as such; periods are labels.
        df = df.withColumn(PERIOD, F.col(PERIOD).cast("string"))
    return df


def read_versioned_table(
    spark: SparkSession,
    base: str,
    table: str,
    periods: Mapping[str, str],
    schema: T.StructType | None = None,
) -> DataFrame:
    """A table of a star that was published with a manifest: {period folder: version}.

    Only the folders that the manifest names are listed, so what a failed or later publication
    wrote is not seen.
    """
    folder = posixpath.join(base, table)
    paths = [posixpath.join(folder, f"{VERSION}={v}", p) for p, v in sorted(periods.items())]
    if not paths:
        if schema is None:
            raise ValueError(f"{table} has no periods: pass its schema")
        return spark.createDataFrame([], schema)
    reader = spark.read.option("basePath", folder)
    reader = reader.option("mergeSchema", True) if schema is None else reader.schema(
        T.StructType([*schema, T.StructField(VERSION, T.StringType())])
    )
    df = reader.parquet(*paths).drop(VERSION)
    return df.withColumn(PERIOD, F.col(PERIOD).cast("string"))


def read_spec_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A report CSV, with or without byte-order mark, quoted fields may span lines."""
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
    )
