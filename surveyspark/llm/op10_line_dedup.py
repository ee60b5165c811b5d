"""Line dedup: repeated runs of lines by prefix doubling over line-ID sequences.

The suffixes of all line-ID sequences get names by doubling: a suffix's name for 2k lines is made of
its names for k lines, here and k lines on, so that suffixes with equal names share so long a prefix.
All suffixes with one name are a longest-common-prefix interval. A run of lines is repeated if it has
`min_lines` lines, or one line of `min_words` words; any longer repeated run is covered by such ones, so
doubling stops there: there is no suffix array, and maximal runs are not formed.
Of each interval the first suffix (by doc_id, then place) is the original, the lines of the others go.

The shift by k stays inside a document, so doubling needs no shuffle; one shuffle forms the intervals.
Names are 128 bits of hash.

Defined cases: lines end at "\n" (a null text has none, an empty text one empty line); null doc_ids
come last; rows with equal doc_id and text are one document and keep the same lines; blank lines
alone are never a run; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm.common import OWN, let, load, row_key

MIN_LINES = 3
MIN_WORDS = 10

LINES, NAMES, GONE = f"{OWN}lines", f"{OWN}names", f"{OWN}gone"


def line_ids(lines: Column) -> Column:
    """Two 64-bit hashes of each line."""
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))


def doubled(names: Column, shift: int) -> Column:
    """Names of the suffixes for `shift` more lines than `names` stands for; suffixes that are too short have none."""
    pair = lambda p, q: F.struct(F.xxhash64(p["a"], q["a"]).alias("a"), F.xxhash64(q["b"], p["b"]).alias("b"))
    return F.when(F.size(names) > shift, F.zip_with(F.slice(names, 1, F.size(names) - shift), F.slice(names, shift + 1, F.size(names)), pair)).otherwise(F.slice(names, 1, 0))


def runs(rows: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(id, th, at, span, a, b): the suffixes of each text with their names for one and for `min_lines` lines."""
    length, out = 1, rows.withColumn(NAMES, line_ids(F.col(LINES))).withColumn(f"{NAMES}1", F.col(NAMES))
    while length < min_lines:
        step = min(length, min_lines - length)
        out = out.withColumn(NAMES, doubled(F.col(NAMES), step))
        length += step
    words = lambda x: F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+"))
    told = F.zip_with(F.col(LINES), F.col(f"{NAMES}1"), lambda x, n: F.struct(n.alias("n"), (words(x) >= min_words).alias("ok")))
    one = F.filter(F.transform(told, lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("span"), x["n"].alias("n"), x["ok"].alias("ok"))), lambda x: x["ok"])
    filled = F.transform(F.col(LINES), lambda x: F.trim(x) != "")
    ok = lambda some, i: F.exists(F.slice(some, i + 1, F.lit(min_lines)), lambda x: x)
    spans = lambda some: F.transform(F.col(NAMES), lambda n, i: F.struct(i.alias("at"), F.lit(min_lines).alias("span"), n.alias("n"), ok(some, i).alias("ok")))
    many = F.filter(let(filled, spans), lambda x: x["ok"])
    out = out.select(f"{OWN}id", f"{OWN}th", F.explode(F.concat(one, many)).alias("r"))
    return out.select(f"{OWN}id", f"{OWN}th", "r.at", "r.span", "r.n.a", "r.n.b")


def removed_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, th, gone): the places of the lines that go, of the documents that lose any."""
    rows = docs.select(*row_key(), F.split("text", "\n", -1).alias(LINES))
    found = runs(rows, min_lines, min_words)
    place = F.struct(F.col(f"{OWN}id").isNull(), f"{OWN}id", f"{OWN}th", "at")
    first = found.groupBy("span", "a", "b").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = found.join(first, ["span", "a", "b"]).where(place > F.col("first"))
    lines = later.groupBy(f"{OWN}id", f"{OWN}th").agg(F.collect_set(F.struct("at", "span")).alias("r"))
    return lines.select(f"{OWN}id", f"{OWN}th", F.array_distinct(F.flatten(F.transform("r", lambda x: F.sequence(x["at"], x["at"] + x["span"] - 1)))).alias(GONE))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with `text` less the repeated lines, and n_lines, n_removed, n_runs (runs of removed lines) under the internal prefix."""
    keyed = docs.select("*", *row_key())
    gone = removed_lines(docs, min_lines, min_words).withColumnsRenamed({f"{OWN}id": f"{OWN}gid", f"{OWN}th": f"{OWN}gth"})
    out = keyed.join(gone, F.col(f"{OWN}id").eqNullSafe(F.col(f"{OWN}gid")) & (F.col(f"{OWN}th") == F.col(f"{OWN}gth")), "left")
    lines, none = F.split("text", "\n", -1), F.array().cast("array<int>")
    at = F.coalesce(F.col(GONE), none)
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), at)
    some = let(lines, lambda own: F.transform(left, lambda i: F.get(own, i)))
    kept = F.when(F.col(GONE).isNull(), F.col("text")).otherwise(F.array_join(some, "\n"))
    counts = {
        f"{OWN}n_lines": F.coalesce(F.when(F.col("text").isNotNull(), F.size(lines)), F.lit(0)).cast("long"),
        f"{OWN}n_removed": F.size(at).cast("long"),
        f"{OWN}n_runs": F.size(F.array_except(at, F.transform(at, lambda i: i + 1))).cast("long"),
        f"{OWN}kept": kept,
    }
    out = out.withColumns(counts)
    return out.withColumn("text", F.col(f"{OWN}kept")).drop(f"{OWN}kept", f"{OWN}id", f"{OWN}th", f"{OWN}gid", f"{OWN}gth", GONE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *[F.col(f"{OWN}{c}").alias(c) for c in ("n_lines", "n_removed", "n_runs")], F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, string_split(text, chr(10)) AS lines FROM documents),
lines AS (SELECT doc_id, text, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM docs),
ahead AS (
  SELECT *, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2 FROM lines WINDOW w AS (PARTITION BY doc_id, md5(text) ORDER BY pos)),
runs AS (
  SELECT doc_id, pos, 1 AS span, line AS run FROM lines WHERE len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) >= 10
  UNION ALL
  SELECT doc_id, pos, 3, line || chr(10) || l1 || chr(10) || l2 FROM ahead WHERE l2 IS NOT NULL AND trim(line || l1 || l2, ' ') <> ''),
firsts AS (SELECT *, min((doc_id, pos)) OVER (PARTITION BY span, run) AS first FROM runs),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM firsts, (VALUES (0), (1), (2)) v(k) WHERE (doc_id, pos) > first AND k < span),
marked AS (
  SELECT l.doc_id, l.pos, l.line, g.pos IS NOT NULL AS gone, lag(g.pos IS NOT NULL, 1, false) OVER (PARTITION BY l.doc_id ORDER BY l.pos) AS was
  FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_removed, count(*) FILTER (WHERE gone AND NOT was)::BIGINT AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
