"""Near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Shingles are put to places 0 .. D-1 by a first permutation (a hash). One second permutation of the D
places, circularly shifted by 0 .. K-1, gives all K signature coordinates: coordinate k of a set is
the smallest value that the permutation, shifted by k, has on its places. The K values of a place
stand side by side in the (wrapped) permutation, so a signature is the minimum over a few slices.

Bands of coordinates make buckets of candidates. Documents with equal shingle sets are one class
first. In each bucket the classes are compared with a hub of the bucket, not with each other; links
make components, and only buckets with several components go on to a next round with other hubs. What
is then apart is compared in pairs, but only where two texts share enough of their edits against the
first hub to be similar at all (`_sharing_edits`). Every link is confirmed on the full sets; which
links within one component are found does not change the result.

With 32 bands of 5, a pair at similarity 0.8 meets in no bucket with probability 3e-6.

Defined cases: a text without words, or null, has an empty set and is linked with nothing; fewer
words than a shingle make one shingle; null doc_ids take part, and a component's id is its smallest
id that is not null; rows with equal ids are rows of their own, and the query's kept column marks all
that carry the smallest id, while `kept_rows` keeps one text of a component; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm import wordbytes as W
from surveyspark.llm.common import OWN, load, row_key, stored
from surveyspark.llm.components import components

SHINGLE = 5
THRESHOLD = 80
BANDS = 32
ROWS = 5
PLACES_BITS = 20
#: Rounds of hubs before what is still apart in a bucket is compared in pairs.
HUBS = 2
#: Rows of a group that are indexed in one task, about.
BLOCK = 10_000
#: Places whose values are gathered at once.
AT_ONCE = 2048
ID, TH = f"{OWN}id", f"{OWN}th"


@cache
def circulant(k: int = BANDS * ROWS, bits: int = PLACES_BITS) -> np.ndarray:
    """Row p: the values of place p under the permutation shifted by k-1 .. 0."""
    permutation = np.random.default_rng(5).permutation(1 << bits).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([permutation[1 - k :], permutation]), k)


def signature(shingles: np.ndarray) -> np.ndarray:
    """The K coordinates of a set of at least one shingle hash."""
    table = circulant()
    places = (W.mixed(shingles) >> np.uint64(64 - PLACES_BITS)).astype(np.int64)
    out = table[places[:AT_ONCE]].min(axis=0)
    for i in range(AT_ONCE, len(places), AT_ONCE):
        np.minimum(out, table[places[i : i + AT_ONCE]].min(axis=0), out=out)
    return out


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = W.buffer(texts)
    for i, j in W.pieces(offsets):
        at = offsets[i : j + 1] - offsets[i]
        h, _, _, of = W.word_hashes(data[offsets[i] : offsets[j]], at)
        g = W.grams(h, n)
        for a, b in zip(of[:-1], of[1:], strict=True):
            if b - a >= n:
                s = np.sort(g[a : b - n + 1])
                yield s[np.concatenate([[True], s[1:] != s[:-1]])]
            else:
                yield W.grams(h[a:b], max(b - a, 1)) ^ np.uint64(b - a)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each signature, different for equal values of different bands."""
    v = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40), v.shape[:2])
    for r in range(ROWS):
        out = W.mixed(out + v[:, :, r])
    return out.view(np.int64)


def _signed(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            size, cls, signatures = [], [], []
            for s in shingle_sets(batch.column(2), n):
                size.append(len(s))
                cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                if len(s):
                    signatures.append(signature(s))
            keys = band_keys(np.array(signatures, np.uint32).reshape(-1, BANDS * ROWS)).reshape(-1)
            ends = np.concatenate([[0], np.cumsum(np.array(size) > 0)]) * BANDS
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(cls, pa.binary()), bands], names=[ID, TH, "n", "cls", "bands"])

    return run


def _confirmed(n: int, threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keep = []
            for a, b in zip(shingle_sets(batch.column(2), n), shingle_sets(batch.column(3), n), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True)) if threshold * max(len(a), len(b)) <= 100 * min(len(a), len(b)) else 0
                keep.append(both > 0 and 100 * both >= threshold * (len(a) + len(b) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _links(pairs: DataFrame, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Those of `pairs` (a, b) whose full sets are similar."""
    side = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirmed(n, threshold), "a binary, b binary")


def _edits(n: int, threshold: int):
    """(hub, cls, root, inside, hub text, text) -> (hub, cls, root, inside, f, edits); see `_sharing_edits`."""
    c = threshold / (100 + threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits, f = [], []
            for h, v in zip(shingle_sets(batch.column(4), n), shingle_sets(batch.column(5), n), strict=True):
                removed, added = np.setdiff1d(h, v, assume_unique=True), np.setdiff1d(v, h, assume_unique=True)
                f.append((1 - c) * len(removed) + c * len(added) - (0.5 - c) * len(h))
                edits.append(np.concatenate([added, removed ^ np.uint64(0x5851F42D4C957F2D)]).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(f, pa.float64()), pa.array(edits, pa.list_(pa.int64()))], names=["hub", "cls", "root", "inside", "f", "edits"])

    return run


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hub, block, probe, cls, root, inside, f, edits), sorted by the first three: a block's rows, then what is to be compared with them."""
    now, index = None, []
    for batch in batches:
        a, b = [], []
        columns = [batch.column(k).to_pylist() for k in range(7)]
        edits = batch.column(7)
        values, ends = edits.flatten().to_numpy(), np.concatenate([[0], np.cumsum(edits.value_lengths().to_numpy())])
        for k, (hub, block, probe, cls, root, inside, f) in enumerate(zip(*columns, strict=True)):
            own = values[ends[k] : ends[k + 1]]
            if (hub, block) != now:
                now, index, built = (hub, block), [], None
            if not probe:
                index.append((cls, root, inside, f, own))
                continue
            if built is None:
                of = np.repeat(np.arange(len(index)), [len(x[4]) for x in index])
                flat = np.concatenate([x[4] for x in index]) if index else np.zeros(0, np.int64)
                order = np.argsort(flat, kind="stable")
                built = flat[order], of[order], np.array([x[3] for x in index])
            at = np.searchsorted(built[0], own), np.searchsorted(built[0], own, "right")
            shared = np.bincount(np.concatenate([built[1][i:j] for i, j in zip(*at, strict=True)]) if len(own) else np.zeros(0, np.int64), minlength=len(index))
            for x in np.flatnonzero((shared > 0) & (shared >= built[2] + f - 1e-6)):
                other = index[x]
                # Of two that are both compared with the block's rows one way is enough.
                if other[1] != root and (other[2] or cls < other[0]):
                    a.append(min(cls, other[0]))
                    b.append(max(cls, other[0]))
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def _sharing_edits(at: DataFrame, hubs: DataFrame, roots: DataFrame | None, texts: DataFrame, n: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of bucket mates in different components whose sets are similar.

    With r and a shingles removed from and added to a hub of size s, two sets share s - r - r' shingles
    and the edits that they have in common. A similarity of T % takes f + f' common edits, where
    f = (1 - c) r + c a - (1/2 - c) s and c = T / (100 + T). One of the two is not in the hub's
    component, so f + f' is positive: what shares no edit is out. The hub's mates are dealt into blocks
    of about BLOCK rows, and those outside its component look their edits up in each block, so that
    neither a group nor its pairs are ever held or written whole.
    """
    pairs = at.select("key", "cls", "root").join(hubs.select("key", "hub"), "key").select("hub", "cls", "root").distinct()
    own = (roots if roots is not None else at.select(F.col("cls").alias("node"), "root")).select(F.col("node").alias("hub"), F.col("root").alias("hub_root")).distinct()
    pairs = pairs.join(own, "hub", "left").withColumn("inside", F.col("root") == F.coalesce("hub_root", "hub"))
    side = lambda c: texts.select(F.col("cls").alias(c), F.col("text").alias(f"text_{c}"))
    both = pairs.join(side("hub"), "hub").join(side("cls"), "cls").select("hub", "cls", "root", "inside", "text_hub", "text_cls")
    edits = stored(both.mapInArrow(_edits(n, threshold), "hub binary, cls binary, root binary, inside boolean, f double, edits array<long>"), "edits")
    blocks = edits.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    edits = edits.join(blocks, "hub")
    row = ["cls", "root", "inside", "f", "edits"]
    index = edits.select("hub", F.pmod(F.xxhash64("cls"), "blocks").alias("block"), F.lit(False).alias("probe"), *row)
    probe = edits.where("not inside").select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.lit(True).alias("probe"), *row)
    dealt = index.union(probe).repartition("hub", "block").sortWithinPartitions("hub", "block", "probe")
    return dealt.mapInArrow(_matched, "a binary, b binary").distinct()


def _grouped(docs: DataFrame, shingle: int, threshold: int) -> DataFrame:
    """The `row_key` columns, n, component_id and `stays` (the row key of the component's first row; null without shingles) of every row of `docs`."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = docs.select(*row_key(), "text")
    signed = stored(keyed.mapInArrow(_signed(shingle), f"{ID} {kind}, {TH} long, n long, cls binary, bands array<long>"), "signed")
    by_class = F.min(ID).alias("first"), F.min(F.struct(F.col(ID).isNull(), ID, TH)).alias("row"), F.first("n").alias("n"), F.first("bands").alias("bands")
    classes = stored(signed.where("n > 0").groupBy("cls").agg(*by_class), "classes")

    buckets = classes.select("cls", "n", F.explode("bands").alias("key"))
    full = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    members = stored(buckets.join(full, "key").select("key", "cls", "n", "c"), "members")
    # How many bucket mates a class has in all: the text that the others were edited from has most.
    mates = members.groupBy("cls").agg(F.sum("c").alias("mates"))
    members = stored(members.join(mates, "cls").select("key", "cls", "n", "mates"), "members")
    rows = members.select("cls").distinct().join(classes, "cls").select("cls", F.col(f"row.{ID}").alias("i"), F.col(f"row.{TH}").alias("t"))
    texts = keyed.join(rows, F.col(ID).eqNullSafe(F.col("i")) & (F.col(TH) == F.col("t"))).select("cls", "text")
    texts = stored(texts.dropDuplicates(["cls"]), "texts")

    similar_sizes = (F.col("n") * 100 >= F.col("m") * threshold) & (F.col("m") * 100 >= F.col("n") * threshold)
    compared, links, roots, first_hubs = None, None, None, None
    for turn in range(HUBS + 1):
        at = members.withColumn("root", F.col("cls"))
        if roots is not None:
            at = members.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node")
        if turn:
            # Buckets within one component are done, and hubs have met all the others.
            at = at.join(hubs.select(F.col("key").alias("k"), F.col("hub").alias("u")), (F.col("key") == F.col("k")) & (F.col("cls") == F.col("u")), "left_anti")
            apart = at.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r != s").select("key")
            at = stored(at.join(apart, "key"), "members")
            members = at.drop("root")
        if turn < HUBS:
            hubs = at.groupBy("key").agg(F.max(F.struct("mates", "cls", "n", "root")).alias("h")).select("key", F.col("h.cls").alias("hub"), F.col("h.n").alias("m"), F.col("h.root").alias("hub_root"))
            hubs = stored(hubs, "hubs")
            pairs = at.join(hubs, "key").where("root != hub_root").where(similar_sizes).select(F.least("cls", "hub").alias("a"), F.greatest("cls", "hub").alias("b")).distinct()
        else:
            pairs = _sharing_edits(at, first_hubs, roots, texts, shingle, threshold)
        first_hubs = hubs if turn == 0 else first_hubs
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = stored(pairs, "pairs")
        if pairs.isEmpty():
            continue
        found = stored(_links(pairs, texts, shingle, threshold), "links")
        compared = pairs if compared is None else compared.union(pairs)
        links = found if links is None else links.union(found)
        roots = components(links)
    if roots is None:
        roots = members.select(F.col("cls").alias("node"), F.col("cls").alias("root")).where("false")

    of = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "first", "row", F.coalesce("root", "cls").alias("root"))
    ids = of.groupBy("root").agg(F.min("first").alias("component_id"), F.min("row").alias("stays"))
    named = of.join(ids, "root").select("cls", "component_id", "stays")
    return signed.join(named, "cls", "left").select(ID, TH, "n", "component_id", "stays")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """The `row_key` columns, n_shingles and component_id of every row of `docs`."""
    return _grouped(docs, shingle, threshold).select(ID, TH, F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col(ID)).alias("component_id"))


def kept_rows(docs: DataFrame, shingle: int = SHINGLE, threshold: int = THRESHOLD, repeats: bool = True) -> DataFrame:
    """`docs` less all rows but the first of each component, by (id is null, id, text hash).

    Rows that are equal in id and text to the first stay with it; with `repeats` off one of them does.
    Rows without shingles are in no component and stay.
    """
    first = F.col(ID).eqNullSafe(F.col(f"stays.{ID}")) & (F.col(TH) == F.col(f"stays.{TH}"))
    found = _grouped(docs, shingle, threshold).where("n > 0").groupBy(ID, TH).agg(F.max(first).alias("first"), F.count(F.lit(1)).alias("c"))
    found = stored(found.where("not first or c > 1").select(F.col(ID).alias(f"{OWN}i"), F.col(TH).alias(f"{OWN}t"), F.col("first").alias(f"{OWN}first")), "gone")
    same = F.col(ID).eqNullSafe(F.col(f"{OWN}i")) & (F.col(TH) == F.col(f"{OWN}t"))
    keyed = docs.select("*", *row_key())
    again = found.where(f"{OWN}first")
    if repeats or again.isEmpty():
        return keyed.join(found.where(f"not {OWN}first"), same, "left_anti").select(*docs.columns)
    once = keyed.join(again, same, "left_semi").dropDuplicates([ID, TH])
    return keyed.join(found, same, "left_anti").union(once).select(*docs.columns)


def _kept() -> Column:
    return F.col(ID).eqNullSafe(F.col("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(load(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)
    return found.select(F.col(ID).alias("doc_id"), "n_shingles", "component_id", _kept().alias("kept"))


SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_zip(w[1:-2], w[2:]) WHEN len(w) = 1 THEN [(w[1], NULL)] ELSE [] END) AS s FROM docs)),
sized AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN sized p1 ON p1.doc_id = a JOIN sized p2 ON p2.doc_id = b WHERE 100 * shared >= 80 * (p1.n + p2.n - shared)),
reach AS (SELECT doc_id AS d, doc_id AS r FROM docs UNION SELECT reach.d, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept
FROM docs LEFT JOIN sized USING (doc_id) JOIN (SELECT d AS doc_id, min(r) AS c FROM reach GROUP BY d) USING (doc_id)
"""
