"""Shared helpers: stored intermediates, row keys, text buffers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Start of every internal column name, so that extra columns of the input cannot clash.
OWN = "__llm_"
_STORED: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that `spark.checkpoint.dir` names; on one machine a temporary one if it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/llm-{label}-{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read again: lineage ends here and a lost executor loses nothing."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> None:
    """Delete what `stored` and `new_path` made; for callers that have written their results."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(conf).delete(path, True)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def row_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Columns that tell rows apart by id and content: equal for repeated rows only."""
    return [F.col(doc_id).alias(f"{OWN}id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias(f"{OWN}th")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of the `row_key` columns of two frames."""
    return a[f"{OWN}id"].eqNullSafe(b[f"{OWN}id"]) & (a[f"{OWN}th"] == b[f"{OWN}th"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, also where the body uses it for every element of an array.

    A column that is named once inside a lambda is put in its place by the optimizer, and would be
    computed anew for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
