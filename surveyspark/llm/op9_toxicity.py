"""Toxicity by compression distance: two zstandard dictionaries, compared window by window.

The ordinary dictionary is text of documents labelled 0. The toxic one is the same text behind the
words that tell label 1: words with a stem that is many times as frequent among documents labelled 1.
A window of a text is compressed with both; what the toxic dictionary saves is its gain. A document's
largest gains and its length go through a logistic curve that was calibrated on the labelled sample.

Dictionaries and curve come from a bounded sample of labelled rows: at most N_TOXIC and N_ORDINARY
documents of at most MAX_CHARS characters, by hash of their id, never of the held-out fold. All
windows of all whole texts are scored.

Defined cases: a null text is empty; empty texts have one empty window; a null doc_id is not held out and
teaches nothing; a document labelled both ways counts as toxic; with no documents of label 1 to learn
from all scores are 0; rows with equal texts get equal scores; empty tables give an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from surveyspark.llm.common import OWN, load, stored

FOLDS = 5
N_TOXIC = 2000
N_ORDINARY = 4000
MAX_CHARS = 20_000
#: Bytes of a window, cut at the next space.
WINDOW = 96
#: Bytes of the ordinary and of the toxic dictionary's own part.
ORDINARY_BYTES = 96 << 10
TOXIC_BYTES = 16 << 10
#: A stem is toxic if it is in this share of the toxic documents, and so many times as frequent there.
LEAST_SHARE = 0.01
LEAST_RATIO = 25
STEM = range(4, 11)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def windows(text: str | None, size: int = WINDOW) -> list[bytes]:
    """The text's bytes, A-Z lower-cased, in windows that begin with a space."""
    body = b" " + (text or "").encode("utf-8", "replace").lower().replace(b"\n", b" ")
    out, i = [], 0
    while i < len(body):
        j = body.find(b" ", i + size)
        # A word that is longer than a window is cut.
        j = min(j if j >= 0 else len(body), i + 8 * size)
        out.append(body[i:j])
        i = j
    return out


def stems(text: str) -> set[bytes]:
    return {b" " + w[:k] for w in set(text.encode("utf-8", "replace").lower().split()) for k in STEM if len(w) >= k}


@dataclass(frozen=True)
class Model:
    """Dictionaries, and the curve's weights: constant, largest gain, sum of the next two, log of the windows."""

    ordinary: bytes
    toxic: bytes
    weights: tuple[float, ...] = ()

    def compressors(self) -> list[zs.ZstdCompressor]:
        """Of the ordinary dictionary, and of the toxic one."""
        kind = zs.ZstdCompressionParameters(window_log=18, hash_log=18, chain_log=18, search_log=6, min_match=4, strategy=zs.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        parts = (self.ordinary, self.toxic + self.ordinary)
        return [zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(p, dict_type=zs.DICT_TYPE_RAWCONTENT), compression_params=kind) for p in parts]

    def features(self, text: str | None, compressors: list[zs.ZstdCompressor]) -> tuple[float, float, float]:
        ordinary, toxic = (c.compress for c in compressors)
        parts = windows(text)
        gains = [len(ordinary(w)) - len(toxic(w)) for w in parts]
        gains = sorted(filter(lambda g: g > 0, gains), reverse=True)[:3] + [0, 0, 0]
        return float(gains[0]), float(gains[1] + gains[2]), float(np.log(len(parts)))

    def score(self, features: np.ndarray) -> np.ndarray:
        z = np.concatenate([np.ones((len(features), 1)), features], axis=1) @ np.array(self.weights)
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(toxic, text) of the documents to learn from; see the module's text for its bounds."""
    by = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").alias(f"{OWN}of")).agg(F.max("toxic").alias("toxic"))
    order = F.md5(F.col(f"{OWN}of").cast("string")), F.col(f"{OWN}of")
    some = by.where("toxic = 1").orderBy(*order).limit(N_TOXIC).union(by.where("toxic = 0").orderBy(*order).limit(N_ORDINARY))
    texts = docs.select(F.col("doc_id").alias(f"{OWN}id"), F.col("text").alias(f"{OWN}text")).where(F.length("text") <= MAX_CHARS)
    rows = texts.join(F.broadcast(some), F.col(f"{OWN}id") == F.col(f"{OWN}of")).select(F.col("toxic").cast("int").alias("toxic"), F.col(f"{OWN}text").alias("text"))
    # Copies would make the chance words of one text look frequent.
    return stored(rows.dropDuplicates(), "sample")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: tuple[Counter, Counter] = Counter(), Counter()
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen[toxic].update(stems(text))
        terms = list(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), *[pa.array([seen[k][t] for t in terms], pa.int64()) for k in (1, 0)]], names=["stem", "c", "o"])


def _told(chosen: tuple[bytes, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = Counter(w for text in batch.column(0).to_pylist() for w in text.encode("utf-8", "replace").lower().split() if (b" " + w).startswith(chosen))
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([w for text in batch.column(0).to_pylist() for w in windows(text)], pa.binary())], names=["w"])


def _featured(model: Model, passed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            rows = [model.features(t, compressors) for t in batch.column(passed).to_pylist()]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns[:passed], *[pa.array(c, pa.float64()) for c in columns]], names=[*batch.schema.names[:passed], "f1", "f2", "f3"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a logistic regression with a constant, by Newton's method."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None if there is nothing toxic to learn from."""
    rows = sample(docs, labels)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not n.get(1):
        return None
    counts = rows.mapInArrow(_counted, "stem binary, c long, o long").groupBy("stem").agg(F.sum("c").alias("c"), F.sum("o").alias("o"))
    ratio = (F.col("c") / n[1]) / ((F.col("o") + 3) / (n.get(0, 0) + 3))
    top = counts.where((F.col("c") >= max(3.0, LEAST_SHARE * n[1])) & (ratio >= LEAST_RATIO)).orderBy(F.desc("c"), F.length("stem"), "stem").limit(1000).collect()
    chosen = {bytes(r["stem"]) for r in top}
    chosen = tuple(sorted(s for s in chosen if not any(s[:k] in chosen for k in range(STEM[0] + 1, len(s)))))
    words = rows.where("toxic = 1").select("text").mapInArrow(_told(chosen), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")) if chosen else None
    words = [bytes(r["word"]) for r in words.orderBy(F.desc("n"), "word").limit(TOXIC_BYTES // 5).collect()] if chosen else []
    # The most frequent words stand last, where an entry is cheapest.
    toxic = b"".join(b" " + w for w in reversed(words))[-TOXIC_BYTES:]
    parts = rows.where("toxic = 0").select("text").mapInArrow(_cut, "w binary").orderBy(F.xxhash64("w"), "w").limit(ORDINARY_BYTES // WINDOW).collect()
    model = Model(b"".join(bytes(r["w"]) for r in parts)[:ORDINARY_BYTES] or b" ", toxic or b" ")
    known = rows.mapInArrow(_featured(model, 1), "toxic int, f1 double, f2 double, f3 double").toPandas()
    known = known.sort_values(list(known.columns))
    return Model(model.ordinary, model.toxic, logistic(known[["f1", "f2", "f3"]].to_numpy(), known["toxic"].to_numpy(float)))


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` with a score of 0 to 1 under the internal prefix."""
    model = fit(docs, labels)
    score = f"{OWN}score"
    if model is None:
        return docs.withColumn(score, F.lit(0.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = model.compressors()
        for batch in batches:
            at = batch.schema.get_field_index(f"{OWN}t")
            features = np.array([model.features(t, compressors) for t in batch.column(at).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(model.score(features), pa.float64())], names=[*batch.schema.names[:at], score])

    kinds = StructType(list(docs.schema)).add(score, "double")
    return docs.select("*", F.col("text").alias(f"{OWN}t")).mapInArrow(run, kinds)


def ordinary_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` less those that score 0.5 or more."""
    return scored(docs, labels).where(F.col(f"{OWN}score") < 0.5).drop(f"{OWN}score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored(load(spark, sf_dir, "documents").select("doc_id", "text"), load(spark, sf_dir, "labels"))
    score = F.col(f"{OWN}score")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))
