"""I-Match fingerprints over randomised lexicon subsets.

The lexicon holds the terms of middling inverse document frequency, neither common nor unique. A
document's distinct terms of the lexicon are sorted; each of a number of random subsets of the lexicon
keeps some of them, and the hash of what it keeps is one part of the fingerprint. Subsets come in
falling densities, so that for short and long documents some of them keep few terms: those parts
survive edits elsewhere. The likeness of two fingerprints is the share of equal parts among those of
one density where either has a term, at the density where it is largest.

Terms are counted over all documents, as 2^TERM_BITS hashed features, so that the lexicon is a bitmap
of 2 MB however large the corpus is.

Defined cases: terms are runs of letters and digits, A-Z lower-cased; a null text is empty; two
documents without a term of the lexicon have likeness 1; documents stand in order of descending
doc_id, null last, equal ids by a hash of their text; the last one's next is the first; a table of one
row is its own next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import wordbytes as W
from surveyspark.llm.common import load
from surveyspark.llm.hashbits import bitmap, holds

TERM_BITS = 24
#: The band of inverse document frequency, as shares of its largest value, the log of the number of documents.
BAND = (0.2, 0.9)
FAMILIES = 16
#: Subsets of each family keep 1 of 4, 16, ... terms.
DENSITIES = 5
PARTS = 1 + FAMILIES * DENSITIES
#: Parts of one density with a term, from which on their share counts.
ENOUGH = 6
#: Rows that are neighbours in one range of ids, about, and the most ranges.
RANGE_ROWS = 2000
MOST_RANGES = 10_000


def _document_terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, term) of the distinct terms of each text, sorted."""
    h, _, _, of = W.word_hashes(data, offsets, W.NON_WORD)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(of))
    # A term is its feature; its text stands in the bits above.
    both = np.unique((text.astype(np.uint64) << np.uint64(TERM_BITS)) | (h >> np.uint64(64 - TERM_BITS)))
    return (both >> np.uint64(TERM_BITS)).astype(np.int64), both << np.uint64(64 - TERM_BITS)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = W.buffer(batch.column(0))
        terms = [_document_terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1] for i, j in W.pieces(offsets)]
        h, n = np.unique(np.concatenate(terms) if terms else np.zeros(0, np.uint64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["h", "n"])


def lexicon(docs: DataFrame, band: tuple[float, float] = BAND) -> np.ndarray:
    """Bitmap of the terms whose inverse document frequency lies in the band."""
    counts = docs.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    most = math.log(max(2, docs.count()))
    idf = F.lit(most) - F.log("n")
    return bitmap(counts.where(idf.between(band[0] * most, band[1] * most)).select("h"), TERM_BITS)


def fingerprints(texts: pa.Array, words: np.ndarray) -> np.ndarray:
    """PARTS numbers of 24 bits for each text; 0: no term."""
    data, offsets = W.buffer(texts)
    out = np.zeros((len(texts), PARTS), np.int64)
    for i, j in W.pieces(offsets):
        text, term = _document_terms(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        own = holds(words, term)
        text, term = text[own], term[own]
        n = j - i
        for family in range(FAMILIES):
            g = W.mixed(term ^ W.mixed(np.full(1, family + 1, np.uint64)))
            level = np.minimum(np.bitwise_count((g & (~g + np.uint64(1))) - np.uint64(1)) >> 1, DENSITIES).astype(np.int64)
            place = text * (DENSITIES + 1) + level
            sums, counts = (np.bincount(place, weights=v, minlength=n * (DENSITIES + 1)).reshape(n, -1)[:, ::-1].cumsum(1)[:, ::-1] for v in ((W.mixed(g) >> np.uint64(40)).astype(np.float64), np.ones(len(g))))
            part = np.where(counts > 0, np.maximum(sums.astype(np.int64) & 0xFFFFFF, 1), 0)
            out[i:j, 1 + family * DENSITIES : 1 + (family + 1) * DENSITIES] = part[:, 1:]
            if family == 0:
                out[i:j, 0] = part[:, 0]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row the share of equal parts among those where a or b has a term, of the density where it is largest.

    Densities with fewer than ENOUGH such parts count only together with all others. 1 if there are none at all.
    """
    some, same = (a != 0) | (b != 0), (a == b) & (a != 0)
    share = np.where(some.any(1), same.sum(1) / np.maximum(some.sum(1), 1), 1.0)
    for d in range(DENSITIES):
        n = some[:, 1 + d :: DENSITIES].sum(1)
        share = np.where(n >= ENOUGH, np.maximum(share, same[:, 1 + d :: DENSITIES].sum(1) / np.maximum(n, 1)), share)
    return share


def text_of(parts: np.ndarray) -> list[str]:
    """Each fingerprint in hexadecimal, six digits a part."""
    body = parts.astype(">u4").view(np.uint8).reshape(len(parts), -1, 4)[:, :, 1:].reshape(len(parts), -1)
    return [row.tobytes().hex() for row in body]


def edited(text: str, following: str) -> str:
    """`text` with its last half replaced by the start of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _ranges(cuts: np.ndarray, ids: pa.Array) -> np.ndarray:
    """The range of each id; null goes with the smallest."""
    return np.array([0 if i is None else int(np.searchsorted(cuts, i, "right")) for i in ids.to_pylist()], np.int64)


def _placed(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_ranges(cuts, batch.column(0))), *batch.columns], names=["range", "doc_id", "th"])

    return run


def _packed(cuts: np.ndarray, tails: dict[tuple, int]):
    """(doc_id, th, text) -> (range, doc_id, th, tail, packed text); the first row of a range also as the last of the range before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zs.ZstdCompressor(level=1).compress
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            place = _ranges(cuts, batch.column(0))
            body = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(2).to_pylist()]
            more = [k for k, row in enumerate(zip(ids, hashes, strict=True)) if row in tails]
            take = pa.array([*range(len(ids)), *more], pa.int64())
            ranges = pa.array([*place, *[tails[ids[k], hashes[k]] for k in more]], pa.int64())
            tail = pa.array([False] * len(ids) + [True] * len(more))
            yield pa.RecordBatch.from_arrays([ranges, batch.column(0).take(take), batch.column(1).take(take), tail, pa.array(body, pa.binary()).take(take)], names=["range", "doc_id", "th", "tail", "body"])

    return run


def _compared(words):
    """Rows in order -> the result; a range's last row is the following range's first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zs.ZstdDecompressor().decompress
        rest: list[tuple] = []
        for batch in batches:
            rows = rest + list(zip(*[batch.column(k).to_pylist() for k in (0, 1, 3)], (unpack(b).decode("utf-8", "surrogatepass") for b in batch.column(4).to_pylist()), strict=True))
            if not rows:
                continue
            texts = [r[3] for r in rows]
            own = [k for k in range(len(rows) - 1) if not rows[k][2]]
            changed = [edited(texts[k], texts[k + 1]) for k in own]
            a = fingerprints(pa.array(texts, pa.large_string()), words.value)
            b = fingerprints(pa.array(changed, pa.large_string()), words.value)
            following = a[[k + 1 for k in own]] if own else a[:0]
            a = a[own]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([rows[k][1] for k in own], batch.schema.field(1).type), pa.array([len(texts[k]) for k in own], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()), pa.array(text_of(a), pa.string()), pa.array(text_of(b), pa.string()),
                    pa.array(likeness(a, b), pa.float64()), pa.array(likeness(a, following), pa.float64()),
                ],
                names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )
            rest = [] if rows[-1][2] else rows[-1:]

    return run


def compared_with_next(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    Documents are dealt into ranges of ids; the texts move once. The driver gets the cuts between ranges
    and the first row of each, at most MOST_RANGES of either.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    n = docs.count()
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    cuts = [] if ranges < 2 else docs.agg(F.percentile_approx("doc_id", [k / ranges for k in range(1, ranges)], 10 * MOST_RANGES)).first()[0] or []
    cuts = np.unique(np.array(cuts, np.int64))
    placed = keyed.select("doc_id", "th").mapInArrow(_placed(cuts), f"range long, doc_id {kind}, th long")
    first = placed.groupBy("range").agg(F.max(F.struct("doc_id", "th")).alias("f")).collect()
    first = {r["range"]: (r["f"]["doc_id"], r["f"]["th"]) for r in first}
    order = sorted(first, reverse=True)
    tails = {first[after]: at for at, after in zip(order, order[1:] + order[:1], strict=True)}

    words = spark.sparkContext.broadcast(lexicon(docs, band))
    rows = keyed.mapInArrow(_packed(cuts, tails), f"range long, doc_id {kind}, th long, tail boolean, body binary")
    rows = rows.repartition("range").sortWithinPartitions("range", "tail", F.col("doc_id").desc_nulls_last(), F.desc("th"))
    return rows.mapInArrow(_compared(words), f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared_with_next(load(spark, sf_dir, "documents").select("doc_id", "text"))
