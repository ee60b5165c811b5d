"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment of words.

A test item is cut into blocks of at most BLOCK words. Every n-gram of a block is a seed: which of them
an edited copy has left is not known before, so a copy with any SEED words in a row untouched is found,
however often the item was copied. Places of documents that hold a seed are joined with the blocks that
hold it, and the words around them are aligned with the block: matches score 2, substitutions,
insertions and deletions -1. A document is contaminated by an item if an alignment reaches `threshold`
of a block's full score. A match takes a word of the block, so a pair is not aligned if too few of the
block's words are there at all.

One pass over the texts. It looks n-grams up in a bitmap of fixed size first, of which false hits fall
out in the join after it; only what hits is shuffled.

Defined cases: words are runs of letters and digits, A-Z lower-cased; null and empty texts hold
nothing; items of fewer words than a seed are ignored; repeated documents or items give one row for
each distinct (doc_id, item_id); null doc_ids or item_ids are values of their own; of rows that share an
id only those go whose own text is contaminated; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import wordbytes as W
from surveyspark.llm.common import OWN, load, row_key, stored
from surveyspark.llm.hashbits import bitmap, holds

SEED = 3
BLOCK = 100
THRESHOLD = 0.5
#: Size of the bitmaps of hashes: 2^25 bits, 4 MB, whatever the number of items.
BITMAP_BITS = 25


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item row, text) -> (item row, block, words)."""
    for batch in batches:
        data, offsets = W.buffer(batch.column(1))
        for i, j in W.pieces(offsets):
            h, _, _, of = W.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], W.NON_WORD)
            row, block, found = [], [], []
            for k in range(j - i):
                own = h[of[k] : of[k + 1]].view(np.int64)
                for b, part in enumerate(np.array_split(own, max(1, -(-len(own) // BLOCK)))):
                    if len(part) >= SEED:
                        row.append(i + k)
                        block.append(b)
                        found.append(part)
            ends = np.cumsum([0, *map(len, found)])
            values = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(block, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))], names=["item_id", "block", "words"])


def _block_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, block, words) -> (item_id, block, h)."""
    for batch in batches:
        for k in range(batch.num_rows):
            g = W.grams(np.array(batch.column(2)[k].as_py(), np.int64).view(np.uint64), SEED)
            n = pa.array(np.full(len(g), k), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(n), batch.column(1).take(n), pa.array(g.view(np.int64))], names=["item_id", "block", "h"])


def _hits(h: np.ndarray, of: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, word, hash) of the n-grams in the bitmap; none runs over the end of its text."""
    g = W.grams(h, SEED)
    at = np.flatnonzero(holds(bits, g))
    text = np.searchsorted(of, at, "right") - 1
    inside = at + SEED <= of[text + 1]
    return text[inside], at[inside], g[at[inside]]


def _windows(bits, longest: int):
    """Words around the places with hits, with the hits' hashes; places that are near are one window."""
    reach = longest + longest // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffer(batch.column(2))
            for i, j in W.pieces(offsets):
                h, _, _, of = W.word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], W.NON_WORD)
                text, at, g = _hits(h, of, bits.value)
                if not len(at):
                    continue
                new = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (at[1:] - at[:-1] > 2 * reach)]))
                last = np.concatenate([new[1:], [len(at)]])
                rows, first, words, seeds = [], [], [], []
                for a, b in zip(new, last, strict=True):
                    lo, hi = max(of[text[a]], at[a] - reach), min(of[text[a] + 1], at[b - 1] + SEED + reach)
                    rows.append(i + text[a])
                    first.append(lo - of[text[a]])
                    words.append(h[lo:hi].view(np.int64))
                    seeds.append(np.unique(g[a:b]).view(np.int64))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(first, pa.int64()), pa.array(words, pa.list_(pa.int64())), pa.array(seeds, pa.list_(pa.int64()))], names=[f"{OWN}id", f"{OWN}th", "first", "words", "seeds"])

    return run


def _ends(item: np.ndarray, words: np.ndarray) -> tuple[float, int]:
    """Best local alignment score and the word it ends with."""
    place = np.arange(len(words))
    row = np.zeros(len(words), np.int64)
    best, end = 0, 0
    for w in item:
        diagonal = np.concatenate([[0], row[:-1]]) + np.where(words == w, 2, -1)
        row = np.maximum(np.maximum(diagonal, row - 1), 0)
        row = np.maximum.accumulate(row + place) - place
        if row.max() > best:
            end = int(row.argmax())
            best = int(row[end])
    return best, end


def align(item: np.ndarray, words: np.ndarray) -> tuple[float, int, int]:
    """(share of the item's full score, first and last word) of the best local alignment."""
    best, end = _ends(item, words)
    _, back = _ends(item[::-1], words[: end + 1][::-1])
    return best / (2 * len(item)), end - back, end


def _aligned(threshold: float):
    """(id, th, item_id, first, words, item words) -> (id, th, item_id, score, start_word, end_word) of what reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = [], []
            for k in range(batch.num_rows):
                words, item = (batch.column(c)[k].values.to_numpy() for c in (4, 5))
                # The score cannot be above the share of the item's words that are there.
                if np.isin(item, words).sum() / len(item) < threshold:
                    continue
                score, a, b = align(item, words)
                if score >= threshold:
                    first = batch.column(3)[k].as_py()
                    rows.append(k)
                    out.append((score, first + a, first + b))
            score, a, b = zip(*out, strict=True) if out else ((), (), ())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(take) for c in range(3)], pa.array(score, pa.float64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=[f"{OWN}id", f"{OWN}th", "item_id", "score", "start_word", "end_word"])

    return run


def alignments(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The `row_key` columns, item_id, score, start_word and end_word of each alignment that reaches the threshold."""
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    blocks = items.select("item_id", "text").distinct().mapInArrow(_blocks, f"item_id {item_kind}, block int, words array<long>")
    blocks = stored(blocks, "blocks")
    seeds = stored(blocks.mapInArrow(_block_grams, f"item_id {item_kind}, block int, h long").distinct(), "seeds")
    longest = blocks.agg(F.max(F.size("words"))).first()[0] or 0

    kinds = f"{OWN}id {doc_kind}, {OWN}th long, first long, words array<long>, seeds array<long>"
    found = docs.select(*row_key(), "text").mapInArrow(_windows(spark.sparkContext.broadcast(bitmap(seeds, BITMAP_BITS)), longest), kinds)
    found = stored(found, "windows")
    pairs = found.select(f"{OWN}id", f"{OWN}th", "first", F.explode("seeds").alias("h")).join(seeds, "h").drop("h").distinct()
    pairs = pairs.withColumnsRenamed({f"{OWN}id": "i", f"{OWN}th": "t", "first": "f"})
    pairs = pairs.join(found.drop("seeds"), F.col("i").eqNullSafe(F.col(f"{OWN}id")) & (F.col("t") == F.col(f"{OWN}th")) & (F.col("f") == F.col("first")))
    own = blocks.select(F.col("item_id").alias("of"), F.col("block").alias("b"), F.col("words").alias("item"))
    pairs = pairs.join(own, F.col("item_id").eqNullSafe(F.col("of")) & (F.col("block") == F.col("b"))).select("i", "t", "item_id", "first", "words", "item")
    return pairs.mapInArrow(_aligned(threshold), f"{OWN}id {doc_kind}, {OWN}th long, item_id {item_kind}, score double, start_word long, end_word long")


def leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) of the best alignment of each contaminated pair, words counted from 0."""
    best = F.max_by(F.struct("score", "start_word", "end_word"), F.struct("score", -F.col("start_word"), -F.col("end_word"))).alias("b")
    scored = alignments(docs, items, threshold).withColumnRenamed(f"{OWN}id", "doc_id")
    return scored.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean_rows(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` less the rows that an item contaminates; other rows of the same id stay."""
    gone = alignments(docs, items, threshold).select(F.col(f"{OWN}id").alias(f"{OWN}gone"), F.col(f"{OWN}th").alias(f"{OWN}of")).distinct()
    keyed = docs.select("*", *row_key())
    return keyed.join(gone, F.col(f"{OWN}id").eqNullSafe(F.col(f"{OWN}gone")) & (F.col(f"{OWN}th") == F.col(f"{OWN}of")), "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
