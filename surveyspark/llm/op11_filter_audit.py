"""Filter interaction audit: count-weighted decision diagrams of failure masks, reordered by adjacent level swaps.

A document's failure mask has a bit for each filter that it fails. Spark counts the masks of each part,
at most 2^filters rows a part whatever the number of documents. From them each part gets a decision
diagram with a level for each filter: a node's low branch is what passes, its high branch what fails,
equal sub-diagrams are one node, and a node weighs the counts below it. All orders of the filters are
visited by swaps of neighbouring levels (plain changes, one swap an order); a swap rebuilds two levels
and leaves the others as they are. In every order the path on which everything passes gives the steps:
the high branch of its node at a level is what the filter removes there, the low branch what is kept.
A filter that stands first removes all that fail it, one that stands last only what fails nothing else.

Defined cases: a null text is empty; a null part is the empty string; null doc_ids are larger than all
others, and rows that share the smallest id of a text are none of them a copy; a document with several
label rows has a label if any of them has it, label rows with a null id are nobody's; an empty table
gives an empty result; extra columns are ignored. Parts are counted, not listed: a text that a third of
all documents share is one row for each part and task before anything is shuffled by it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import count, permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm.common import OWN, load

#: Counts of documents, of good and of toxic ones.
WEIGHTS = ("n", "good", "toxic")
STEP_COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

MASK, PART, HASH = f"{OWN}mask", f"{OWN}part", f"{OWN}hash"


# ---- filters ---------------------------------------------------------------------------------


def text_filters() -> dict[str, Column]:
    """Failure conditions A to D of the column `text`, which is not null; `OWN words` holds its words."""
    words, text = F.col(f"{OWN}words"), F.col("text")
    n = F.size(words)
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)) * 100 < n * 50,
        "C": F.regexp_count(text, F.lit("[A-Z]")) * 100 > F.length(text) * 3,
        "D": text.rlike("[#$%&*|]"),
    }


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Callable[[], Mapping[str, Column]] = text_filters, part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): `filters` are the lowest bits in their order, the highest is E, a smaller id with equal text.

    A text's smallest id and how many rows have it come from counts by text, part and labels, so
    rows are never joined with their copies.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col(part), F.lit("")).alias(PART), text.alias("text")).withColumn(f"{OWN}words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    fails = list(filters().values())
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)), F.lit(0))
    rows = rows.select("doc_id", PART, mask.alias(MASK), F.struct(F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.length("text")).alias(HASH))
    # Rows that are repeated are one row from here on.
    keys = ["doc_id", PART, MASK, HASH]
    rows = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias(f"{OWN}of")).agg(*[F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for c, name in (("quality", "g"), ("toxic", "t"))])
    # Null ids have no labels, and would meet in one task of a join.
    named = rows.where("doc_id IS NOT NULL").join(known, F.col("doc_id") == F.col(f"{OWN}of"), "left").select(*keys, "n", F.coalesce("g", F.lit(0)).alias("g"), F.coalesce("t", F.lit(0)).alias("t"))
    rows = named.union(rows.where("doc_id IS NULL").select(*keys, "n", F.lit(0), F.lit(0)))

    id_of = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    by_id = rows.groupBy(HASH, PART, MASK, "g", "t", "doc_id").agg(F.sum("n").alias("n"))
    by_text = by_id.groupBy(HASH, PART, MASK, "g", "t").agg(F.min(F.struct(id_of.alias("id"), "n")).alias("first"), F.sum("n").alias("n"))
    least = by_text.groupBy(HASH).agg(F.min("first.id").alias("least")).withColumnRenamed(HASH, f"{OWN}text")
    by_text = by_text.join(least, F.col(HASH) == F.col(f"{OWN}text"))
    own = F.when(F.col("first.id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0).cast("long"))
    both = F.array(F.struct(F.lit(0).alias("e"), own.alias("n")), F.struct(F.lit(1 << len(fails)).alias("e"), (F.col("n") - own).alias("n")))
    split = by_text.select(PART, MASK, "g", "t", F.explode(both).alias("x")).where("x.n > 0")
    n = F.col("x.n")
    return split.groupBy(F.col(PART).alias("part"), (F.col(MASK) + F.col("x.e")).alias("mask")).agg(F.sum(n).alias("n"), F.sum(n * F.col("g")).alias("good"), F.sum(n * F.col("t")).alias("toxic"))


# ---- diagrams --------------------------------------------------------------------------------


class Diagram:
    """A diagram of counts over masks of k bits; `order[level]` is the bit that the level asks for.

    `levels[i]` maps a node to its (low, high) nodes on level i + 1; the last level's are leaves.
    """

    def __init__(self, counts: Mapping[int, tuple[int, ...]], k: int):
        self.order = list(range(k))
        self.levels: list[dict[int, tuple[int, int]]] = [{} for _ in range(k)]
        self.weights: dict[int, tuple[int, ...]] = {}
        self.names = count()
        zero = (0,) * len(next(iter(counts.values()), WEIGHTS))
        leaves: dict[tuple[int, ...], int] = {}

        def built(level: int, mask: int, nodes: list[dict]) -> int:
            if level == k:
                weight = counts.get(mask, zero)
                if weight not in leaves:
                    leaves[weight] = self._new(weight)
                return leaves[weight]
            pair = built(level + 1, mask, nodes), built(level + 1, mask | 1 << self.order[level], nodes)
            return self._node(level, pair, nodes[level])

        self.root = built(0, 0, [{} for _ in range(k)])

    def _new(self, weight: tuple[int, ...]) -> int:
        node = next(self.names)
        self.weights[node] = weight
        return node

    def _node(self, level: int, pair: tuple[int, int], known: dict[tuple[int, int], int]) -> int:
        """The node with these branches, shared with an equal one of its level."""
        if pair not in known:
            low, high = (self.weights[p] for p in pair)
            known[pair] = self._new(tuple(a + b for a, b in zip(low, high, strict=True)))
            self.levels[level][known[pair]] = pair
        return known[pair]

    def swap(self, level: int) -> None:
        """Exchange the filters of `level` and the next one; nodes of `level` keep their names, so those above stay as they are."""
        below = self.levels[level + 1]
        self.levels[level + 1] = {}
        known: dict[tuple[int, int], int] = {}
        for node, (low, high) in self.levels[level].items():
            crossed = zip(below[low], below[high], strict=True)
            self.levels[level][node] = tuple(self._node(level + 1, pair, known) for pair in crossed)
        for gone in below.keys() - self.levels[level + 1].keys():
            del self.weights[gone]
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weights kept, weights removed) down the path on which everything passes."""
        out, node = [], self.root
        for bit, nodes in zip(self.order, self.levels, strict=True):
            node, high = nodes[node]
            out.append((bit, self.weights[node], self.weights[high]))
        return out


def plain_changes(k: int) -> Iterator[int]:
    """The levels to swap with their next ones, one at a time, that lead through all orders of k things."""
    if k < 2:
        return
    down = True
    for swap in [*plain_changes(k - 1), None]:
        yield from (range(k - 2, -1, -1) if down else range(k - 1))
        if swap is not None:
            yield swap + 1 if down else swap
        down = not down


def audit_rows(counts: Mapping[int, tuple[int, ...]], names: str) -> Iterator[tuple]:
    """(filter_order, step, *STEP_COLUMNS) of every order of the filters `names`."""
    k = len(names)
    diagram = Diagram(counts, k)
    orders = [(list(diagram.order), diagram.steps())]
    for level in plain_changes(k):
        diagram.swap(level)
        orders.append((list(diagram.order), diagram.steps()))
    fails, alone, shapley = [0] * k, [0] * k, [0] * k
    for _, steps in orders:
        fails[steps[0][0]] = steps[0][2][0]
        alone[steps[-1][0]] = steps[-1][2][0]
        for bit, _, removed in steps:
            shapley[bit] += removed[0]
    for order, steps in orders:
        word = "".join(names[b] for b in order)
        for step, (bit, kept, removed) in enumerate(steps, 1):
            yield (word, step, kept[0], removed[0], fails[bit] - removed[0], alone[bit], removed[1], removed[2], shapley[bit])


def _audited(names: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), pa.int32(), *[pa.int64()] * len(STEP_COLUMNS)]
        for batch in batches:
            for part, masks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = {m["mask"]: tuple(m[w] for w in WEIGHTS) for m in masks}
                columns = zip(*[(part, *row) for row in audit_rows(counts, names)], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["part", "filter_order", "step", *STEP_COLUMNS])

    return run


def audit(counts: DataFrame, names: str) -> DataFrame:
    """part, filter_order, step and STEP_COLUMNS of every part and order, from (part, mask, n, good, toxic); a letter of `names` a bit.

    A part is one row of at most 2^len(names) masks, and gives len(names)! * len(names) rows.
    """
    by_part = counts.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("masks"))
    numbers = ", ".join(f"{c} long" for c in STEP_COLUMNS)
    return by_part.select("part", "masks").mapInArrow(_audited(names), f"part string, filter_order string, step int, {numbers}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    return audit(mask_counts(docs, labels), "ABCDE")


_ORDERS = ", ".join(f"('{''.join(p)}')" for p in permutations("ABCDE"))

SQL = rf"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS words FROM documents),
known AS (
  SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
failed AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
          100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text), regexp_matches(text, '[#$%&*|]'),
          coalesce(d.doc_id > min(d.doc_id) OVER w, min(d.doc_id) OVER w IS NOT NULL)] AS fails
  FROM docs d LEFT JOIN known k ON d.doc_id = k.doc_id WINDOW w AS (PARTITION BY text)),
masks AS (
  SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
orders AS (SELECT * FROM (VALUES {_ORDERS}) o(filter_order)),
steps AS (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM orders),
tested AS (
  SELECT part, filter_order, step, n, good, toxic,
         fails[ascii(substr(filter_order, step, 1)) - 64] AS fail,
         len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i::INT, 1)) - 64])) > 0 AS before,
         len(list_filter(fails, lambda f: f)) = 1 AS alone
  FROM masks CROSS JOIN steps),
counted AS (
  SELECT part, filter_order, step,
         coalesce(sum(n) FILTER (WHERE NOT fail AND NOT before), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (WHERE fail AND NOT before), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (WHERE fail AND before), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (WHERE fail AND alone), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (WHERE fail AND NOT before), 0)::BIGINT AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE fail AND NOT before), 0)::BIGINT AS toxic_lost
  FROM tested GROUP BY part, filter_order, step)
SELECT *, sum(removed) OVER (PARTITION BY part, substr(filter_order, step, 1))::BIGINT AS shapley FROM counted
"""
