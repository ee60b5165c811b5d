"""Mixing sources to target weights by weighted fair queueing.

Every shuffled document gets a virtual finish time: the words of its source up to and including it,
divided by the source's target. Over all sources the documents stand in order of that time, and the
mix is the longest start of this order within the budget. A source that has to be repeated queues
again behind itself, in the same order.

Defined cases: a null text has size 0; a null source is a source, last in order; rows with equal ids
(nulls too) queue by size; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import load, stored

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
#: Rows whose running sum is taken in one task, about.
RANGE_ROWS = 5_000


def n_words(text: Column) -> Column:
    """Number of runs without space, tab, newline, vertical tab, form feed or return; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MAX_EPOCHS) -> DataFrame:
    """of, rank, rows, source_size, total, target: the budget shared by weight, none above `most` times its source.

    Capping the sources in order of cap over weight leaves the level that the others share, which is
    where resharing again and again ends. `sizes` has source and size; one row per source passes
    through one task.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    by = by.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    by = by.withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * most)
    every, ratio = Window.partitionBy(), F.col("cap") / F.col("weight")
    before = Window.orderBy(ratio, "rank").rowsBetween(Window.unboundedPreceding, -1)
    left = lambda c, of: of - F.coalesce(F.sum(c).over(before), F.lit(0))
    by = by.withColumn("total", F.sum("source_size").over(every) * F.lit(float(budget)))
    by = by.withColumn("level", left("cap", F.col("total")) / left("weight", F.sum("weight").over(every)))
    by = by.withColumn("full", F.col("cap") <= F.col("level") * F.col("weight"))
    share = F.min(F.when(~F.col("full"), F.struct(ratio, "rank", "level"))).over(every)["level"]
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share * F.col("weight"))
    return by.select(F.col("source").alias("of"), "rank", "rows", "source_size", "total", target.alias("target"))


def queue(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The rows of `sizes` with their source's target and `upto`, the source's words up to and including the row.

    A source's rows are cut into ranges of the deal of about RANGE_ROWS rows; only the sums of ranges
    are accumulated over the whole source.
    """
    place = F.conv(F.substring("deal", 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    rows = sizes.join(targets, F.col("source").eqNullSafe(F.col("of")))
    rows = rows.withColumn("part", F.floor(place * F.ceil(F.col("rows") / RANGE_ROWS)))
    sums = rows.groupBy(F.col("rank").alias("r"), F.col("part").alias("p")).agg(F.sum("size").alias("n"))
    sums = sums.select("r", "p", (F.sum("n").over(Window.partitionBy("r").orderBy("p")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("rank", "part").orderBy("deal", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(sums, (F.col("rank") == F.col("r")) & (F.col("part") == F.col("p"))).withColumn("upto", F.col("before") + F.sum("size").over(inside))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words, repeats counted) of every document.

    The global order is cut into ranges of the finish time. Sums of ranges tell which range the
    budget ends in, and only that range's rows are ordered; the driver gets its bounds, two rows.
    """
    deal = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sizes = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), deal.alias("deal")), "mix-sizes")
    kept = ("doc_id", "source", "size", "source_size", "target", "rank", "total", "upto")
    rows = stored(queue(sizes, source_targets(sizes, weights, budget, most)).select(*kept), "mix-queue")

    ranges = max(1, -(-sizes.count() * most // RANGE_ROWS))
    finish = lambda epoch: F.coalesce(F.try_divide((F.lit(epoch) * F.col("source_size") + F.col("upto")).cast("double"), F.col("target")), F.lit(0.0))
    # All sources reach their targets at 1. What lies far beyond is one range: it is never cut.
    every = F.explode(F.array(*[F.struct(finish(e).alias("finish"), "rank", F.lit(e).alias("epoch")) for e in range(most)]))
    turns = rows.select("size", "total", every.alias("at")).withColumn("range", F.least(F.floor(F.col("at.finish") * ranges), F.lit(2 * ranges)))
    sums = turns.groupBy("range").agg(F.sum("size").alias("n"), F.max("total").alias("total"))
    sums = sums.withColumn("upto", F.sum("n").over(Window.orderBy("range")))
    cut = sums.where(F.col("upto") > F.col("total")).orderBy("range").limit(1).select("range", (F.col("upto") - F.col("n")).alias("before")).first()
    if cut is None:
        taken = F.col("size") * most
    else:
        order = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        last = turns.where(F.col("range") == cut["range"]).withColumn("upto", F.lit(cut["before"]) + F.sum("size").over(order))
        last = last.where(F.col("upto") <= F.col("total")).agg(F.max("at").alias("at")).first()["at"]
        taken = F.lit(0)
        for e in range(most):
            within = F.floor(finish(e) * ranges) < cut["range"]
            if last is not None:
                key = F.struct(finish(e), F.col("rank"), F.lit(e))
                within = within | (key <= F.struct(F.lit(last["finish"]), F.lit(last["rank"]), F.lit(last["epoch"])))
            taken = taken + F.when(within, F.col("size")).otherwise(0)
    return rows.select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).drop("source")


SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix' || coalesce(doc_id::VARCHAR, '')) AS deal FROM documents),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM (SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source)),
weighed AS (
  SELECT *, [3, 1, 2][rank % 3 + 1] AS weight, source_size * 2 AS cap, sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE AS total FROM ranked),
levels AS (
  SELECT *, (total - coalesce(sum(cap) OVER w, 0)::DOUBLE) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0))::DOUBLE AS level
  FROM weighed WINDOW w AS (ORDER BY cap::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT *, CASE WHEN cap::DOUBLE <= level * weight THEN cap::DOUBLE
    ELSE (SELECT arg_min(level, (cap::DOUBLE / weight, rank)) FROM levels WHERE cap::DOUBLE > level * weight) * weight END AS target FROM levels),
queued AS (
  SELECT doc_id, size, source_size, target, rank, total, sum(size) OVER (PARTITION BY rank ORDER BY deal, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM sizes JOIN targets ON sizes.source IS NOT DISTINCT FROM targets.source),
turns AS (
  SELECT *, coalesce((epoch * source_size + upto)::DOUBLE / nullif(target, 0), 0) AS finish FROM queued, (VALUES (0), (1)) e(epoch)),
summed AS (
  SELECT *, sum(size) OVER (ORDER BY finish, rank, epoch, upto ROWS UNBOUNDED PRECEDING) AS mixed FROM turns)
SELECT doc_id, size, source_size, target, sum(CASE WHEN mixed::DOUBLE <= total THEN size ELSE 0 END)::BIGINT AS taken
FROM summed GROUP BY doc_id, size, source_size, target, rank, upto
"""
