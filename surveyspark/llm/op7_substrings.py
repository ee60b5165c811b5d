"""Removal of repeated byte strings: every byte of a string of LENGTH bytes that also starts elsewhere.

Every string of LENGTH bytes has one anchor, its GRAM bytes of smallest hash (the first such). Equal
strings have the same anchor at the same place, so strings are compared only where they share one. The
strings of one anchor start at neighbouring places; the bytes that they cover together are the
anchor's context. Most repeated strings lie in contexts that are repeated as a whole, which counting
(anchor, context) finds. What is left are anchors with several contexts, near the ends of matches:
one copy of each different context goes on. Those of an anchor come together in one task, in shards by
document. Each shard gets its Burrows-Wheeler transform over blocks of bytes, the transforms are merged
by iterative interleave refinement, and the intervals of suffixes that have LENGTH bytes in common are
the repeated strings.

Transforms of all text are not built: the README has the figures. Two passes over the texts, then one
to cut the bytes. The second pass looks anchors up in bitmaps of fixed size; what they let through by
chance falls out in joins with the counts. An anchor with more than HOT contexts is not held in one task: its
strings are counted by hash.

Defined cases: null and short texts keep all bytes; rows with equal doc_id and text are two
documents with equal bytes, so both lose what is long enough; null doc_ids take part; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from surveyspark.llm import wordbytes as W
from surveyspark.llm.bwt import Suffixes, merge, order, suffixes, transform
from surveyspark.llm.common import OWN, load, row_key, stored
from surveyspark.llm.hashbits import bitmap, holds

LENGTH = 200
GRAM = 64
HOT = 10_000
#: Size of each bitmap: 2^27 bits, 16 MB.
BITMAP_BITS = 27
#: Bytes that are hashed at once; a longer text is hashed alone.
PIECE = 1 << 18
#: Shards of the texts that are compared, by their hash, and the largest block of bytes that is a symbol.
SHARDS = 4
MOST_BLOCK = 25
ID, TH = f"{OWN}id", f"{OWN}th"
_PLACE_BITS = np.uint64(28)
_PLACE = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Of each anchor: text, lo and hi (the first and last string that has it, as a place in its text), key, ctx, and at (lo as a place in data)."""
    n, w = len(data), length - gram + 1
    if n < length:
        return {k: np.zeros(0, np.int64 if k not in ("key", "ctx") else np.uint64) for k in ("text", "lo", "hi", "key", "ctx", "at")}
    h = W.prefix_hash(data)
    m = n - gram + 1
    g = (h[gram:] - h[:m]) * W.powers(m, inverse=True)[:m]
    v = (g * np.uint64(0xD6E8FEB86659FD93)) & ~_PLACE
    v |= np.arange(m, dtype=np.uint64)
    # Minimum over w neighbours: of the rest of its block of w, and of the start of the next.
    full = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:m] = v
    blocks = full.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    strings = n - length + 1
    pos = (np.minimum(back[:strings], ahead[w - 1 : w - 1 + strings]) & _PLACE).astype(np.int64)
    # Strings that cross the end of a text are none.
    inside = np.ones(strings, bool)
    for end in offsets[1:-1]:
        inside[max(0, end - length + 1) : end] = False
    new = np.empty(strings, bool)
    new[0] = True
    new[1:] = (pos[1:] != pos[:-1]) | ~inside[:-1]
    lo = np.flatnonzero(new & inside)
    stop = np.flatnonzero(np.concatenate([new[1:] | ~inside[1:], [True]]) & inside)
    pos = pos[lo]
    text = np.searchsorted(offsets, lo, "right") - 1
    key = W.range_hash(h, pos, pos + gram)
    ctx = W.mixed(W.range_hash(h, lo, stop + length) + (pos - lo).astype(np.uint64))
    return {"text": text, "lo": lo - offsets[text], "hi": stop - offsets[text], "key": key, "ctx": ctx, "at": lo}


def _pieces(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[tuple]:
    """(batch, first text, bytes, offsets, anchors) of (id, th, text) batches."""
    for batch in batches:
        data, offsets = W.buffer(batch.column(2))
        for i, j in W.pieces(offsets, PIECE):
            part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            yield batch, i, part, at, anchors(part, at, length, gram)


def _rows(batch: pa.RecordBatch, text: np.ndarray, *more: pa.Array) -> list[pa.Array]:
    take = pa.array(text, pa.int64())
    return [batch.column(0).take(take), batch.column(1).take(take), *more]


def _occurrence(batch: pa.RecordBatch, i: int, a: dict) -> np.ndarray:
    """A hash of the row and the place."""
    th = batch.column(1).to_numpy()[a["text"] + i].view(np.uint64)
    return W.mixed(W.mixed(th + a["lo"].astype(np.uint64)) ^ a["key"])


def _counted(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, _, _, a in _pieces(batches, length, gram):
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a["key"], a["ctx"], _occurrence(batch, i, a))], names=["key", "ctx", "occ"])

    return run


def _found(whole, apart, length: int, gram: int):
    """Rows of anchors that the bitmaps hold: of repeated contexts, and with `body` of the chosen copies of different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, i, data, _, a in _pieces(batches, length, gram):
            occ = _occurrence(batch, i, a)
            body = holds(apart.value, occ)
            at = np.flatnonzero(body | holds(whole.value, a["ctx"]))
            bodies = [data[p : p + q + length].tobytes() if b else None for p, q, b in zip(a["at"][at], (a["hi"] - a["lo"])[at], body[at], strict=True)]
            more = [pa.array(a["lo"][at], pa.int32()), pa.array(a["hi"][at], pa.int32()), pa.array(a["key"][at].view(np.int64)), pa.array(a["ctx"][at].view(np.int64)), pa.array(occ[at].view(np.int64)), pa.array(bodies, pa.binary())]
            yield pa.RecordBatch.from_arrays(_rows(batch, a["text"][at] + i, *more), names=[ID, TH, "lo", "hi", "key", "ctx", "occ", "body"])

    return run


def _strings(bodies: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place in it, hash) of all strings of the bodies."""
    data, offsets = W.buffer(bodies)
    row, place, found = [], [], []
    for i, j in W.pieces(offsets):
        at = offsets[i : j + 1] - offsets[i]
        h = W.prefix_hash(data[offsets[i] : offsets[j]])
        n = np.diff(at) - length + 1
        r = np.repeat(np.arange(j - i), n)
        p = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = at[r] + p
        row.append(r + i)
        place.append(p)
        found.append(W.range_hash(h, start, start + length))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, place, found))


def _runs(batch: pa.RecordBatch, row: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
    """(id, th, lo, hi) of the runs of neighbouring strings."""
    start = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)])[: len(row)])
    stop = np.concatenate([start[1:], [len(row)]])[: len(start)] - 1
    lo = batch.column(2).to_numpy()[row[start]]
    return pa.RecordBatch.from_arrays(_rows(batch, row[start], pa.array(lo + place[start], pa.int32()), pa.array(lo + place[stop], pa.int32())), names=[ID, TH, "lo", "hi"])


def shared_strings(bodies: pa.Array, shard: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(body, place) of the strings that start more than once, from the merged transforms of the bodies' shards."""
    block = max(k for k in range(1, MOST_BLOCK + 1) if length % k == 0)
    data, offsets = W.buffer(bodies)
    size = np.diff(offsets)
    # Bodies in order of their shards, so that symbols can be numbered once for all.
    deal = np.argsort(shard, kind="stable")
    base = np.repeat(offsets[deal], size[deal] + 1)
    at = np.arange(len(base)) - np.repeat(np.cumsum(size[deal] + 1) - (size[deal] + 1), size[deal] + 1)
    body = np.repeat(deal, size[deal] + 1)
    whole = size[body] - at >= block
    start = (base + at)[whole]
    every = suffixes(W.range_hash(W.prefix_hash(data), start, start + block), size[deal], block)
    cuts = np.concatenate([[0], np.cumsum(np.bincount(shard, weights=size + 1, minlength=SHARDS).astype(np.int64))])
    orders, transforms, ends = [], [], []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = Suffixes(every.symbol[a:b], np.where(every.following[a:b] >= 0, every.following[a:b] - a, -1))
        ordered = order(own)
        orders.append(ordered + a)
        transforms.append(transform(own, ordered))
        ends.append(int((~whole[a:b]).sum()))
    interleave, classes = merge(transforms, ends, length // block)
    of = np.empty(len(classes), np.int64)
    of[np.concatenate(orders)] = classes[np.argsort(interleave, kind="stable")]
    again = np.flatnonzero(np.bincount(of)[of] > 1)
    again = again[np.lexsort((at[again], body[again]))]
    return body[again], at[again]


def _compared(length: int):
    """(id, th, lo, key, body), keys together -> runs of strings that another place has too."""

    def settled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        key = batch.column(3).to_numpy()
        _, offsets = W.buffer(batch.column(4))
        last = np.flatnonzero(np.concatenate([key[1:] != key[:-1], [True]])) + 1
        a = 0
        while a < len(key):
            # Whole keys, of about PIECE bytes together.
            b = int(last[min(max(np.searchsorted(last, a, "right"), np.searchsorted(offsets[last], offsets[a] + PIECE, "right") - 1), len(last) - 1)])
            part = batch.slice(a, b - a)
            shard = (part.column(1).to_numpy() % SHARDS).astype(np.int64)
            yield _runs(part, *shared_strings(part.column(4), shard, length))
            a = b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            key = batch.column(3).to_numpy()
            # The last key may go on in the next batch.
            cut = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1]) if len(key) else 0
            if cut:
                yield from settled(batch.slice(0, cut))
            rest = batch.slice(cut)
        if rest is not None and rest.num_rows:
            yield from settled(rest)

    return run


def _exploded(length: int):
    """(id, th, lo, key, body) -> (id, th, lo, h) of all strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, place, h = _strings(batch.column(4), length)
            lo = batch.column(2).to_numpy()[row]
            yield pa.RecordBatch.from_arrays(_rows(batch, row, pa.array(lo + place, pa.int32()), pa.array(h.view(np.int64))), names=[ID, TH, "lo", "h"])

    return run


def repeated(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(id, th, lo, hi): runs of places where strings start that also start elsewhere."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(*row_key(), "text").where(F.octet_length("text") >= length)
    counts = keyed.mapInArrow(_counted(length, gram), "key long, ctx long, occ long").groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.min("occ").alias("occ"))
    by_key = counts.groupBy("key").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("contexts"))
    # All but the anchors of one occurrence: few enough to go on with.
    counts = stored(counts.join(by_key.where("total > 1"), "key"), "contexts")
    whole = spark.sparkContext.broadcast(bitmap(counts.where("n > 1").select(F.col("ctx").alias("h")), BITMAP_BITS))
    apart = spark.sparkContext.broadcast(bitmap(counts.where("contexts > 1").select(F.col("occ").alias("h")), BITMAP_BITS))
    found = stored(keyed.mapInArrow(_found(whole, apart, length, gram), f"{ID} {kind}, {TH} long, lo int, hi int, key long, ctx long, occ long, body binary"), "found")

    same = found.select(ID, TH, "lo", "hi", "key", "ctx").join(counts.where("n > 1").select("key", "ctx"), ["key", "ctx"]).select(ID, TH, "lo", "hi")
    hot = counts.where(F.col("contexts") > HOT).select("key").distinct().withColumn("hot", F.lit(True))
    # One body for each context: what the bitmap let through by chance goes, and so do repeated rows.
    bodies = found.where("body is not null").select(ID, TH, "lo", "key", "ctx", "occ", "body").dropDuplicates(["key", "ctx", "occ"])
    bodies = bodies.join(counts.where("contexts > 1").select("key", "ctx", "occ"), ["key", "ctx", "occ"])
    bodies = bodies.join(hot, "key", "left").select(ID, TH, "lo", "key", "body", "hot")
    bodies = stored(bodies, "bodies")
    runs = f"{ID} {kind}, {TH} long, lo int, hi int"
    few = bodies.where("hot is null").drop("hot").repartition("key").sortWithinPartitions("key").mapInArrow(_compared(length), runs)
    many = bodies.where("hot").drop("hot").mapInArrow(_exploded(length), f"{ID} {kind}, {TH} long, lo int, h long")
    many = many.join(many.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "h").select(ID, TH, "lo", F.col("lo").alias("hi"))
    return same.union(few).union(many)


def _cut(passed: int, length: int):
    """(..., text, lo[], hi[]) -> (..., text, n_bytes, n_removed, n_spans, kept): kept is null if nothing goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = W.buffer(batch.column(passed))
            ranges = batch.column(passed + 1)
            first, last = (x.to_numpy(zero_copy_only=False) for x in ranges.flatten().flatten()) if len(ranges.flatten()) else (np.zeros(0, np.int64),) * 2
            ends = np.concatenate([[0], np.cumsum([len(r) if r.is_valid else 0 for r in ranges])])
            removed, spans, sha, kept = [], [], [], []
            for k in range(batch.num_rows):
                own = data[offsets[k] : offsets[k + 1]]
                a, b = first[ends[k] : ends[k + 1]].astype(np.int64), last[ends[k] : ends[k + 1]].astype(np.int64)
                if len(a):
                    step = np.zeros(len(own) + 1, np.int64)
                    np.add.at(step, a, 1)
                    np.add.at(step, b + length, -1)
                    gone = np.cumsum(step[:-1]) > 0
                    removed.append(int(gone.sum()))
                    spans.append(int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()))
                    own = own[~gone]
                    kept.append(own.tobytes())
                else:
                    removed.append(0)
                    spans.append(0)
                    kept.append(None)
                sha.append(hashlib.sha256(own.tobytes()).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], pa.array(np.diff(offsets), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], names=[*batch.schema.names[:passed], *_CUT])

    return run


_CUT = [f"{OWN}{c}" for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")]


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """`docs` with n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes; null: all) under the internal prefix."""
    ranges = repeated(docs, length, gram).groupBy(F.col(ID).alias(f"{OWN}i"), F.col(TH).alias(f"{OWN}t")).agg(F.collect_set(F.struct("lo", "hi")).alias(f"{OWN}ranges"))
    keyed = docs.select("*", *row_key())
    rows = keyed.join(ranges, F.col(ID).eqNullSafe(F.col(f"{OWN}i")) & (F.col(TH) == F.col(f"{OWN}t")), "left")
    rows = rows.select(*docs.columns, F.col("text").alias(f"{OWN}text"), f"{OWN}ranges")
    schema = StructType(list(docs.schema))
    for c, kind in zip(_CUT, ("long", "long", "long", "string", "binary"), strict=True):
        schema = schema.add(c, kind)
    return rows.mapInArrow(_cut(len(docs.columns), length), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", *[F.col(c).alias(c.removeprefix(OWN)) for c in _CUT[:4]])


SQL = None
