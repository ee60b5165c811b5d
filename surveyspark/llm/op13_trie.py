"""Conversation prefix trie: an Euler tour of enter and exit arcs, list-ranked by Spark.

Turns are numbered in one global order (`numbered`: a range sort, and an offset for each range), which
gives each its place in its conversation, however long that is. A prefix of d turns is named by d and by
the exclusive or of hashes of (place, turn) over its turns, 128 bits; names of all prefixes of a
conversation are running values over blocks of turns. Equal names are one node of the trie.

Every node has an enter and an exit arc. An enter arc leads to that of the node's first child, or to the
node's exit; an exit arc to the enter arc of the next sibling, or to the parent's exit. Nodes are
numbered by smallest member and depth, so that most arcs lead to a near number: each block of nodes first
joins the arcs that follow each other inside it to runs, and pointer doubling over the table of runs
ranks them, in as many rounds as the logarithm of their number. A run's rank and an arc's place in it
give the arc's position in the tour. Running sums of leaves and of saved bytes over the positions, in
blocks of equal size, then give a subtree's sum as the difference between its exit and its enter arc.

Nothing is gathered by key: children of one parent, turns of one conversation and members of one node are
cut into blocks by their numbers (`attached`, `sibling_links`), and only a row for each block meets at the
key. What is stored goes to the shared folder.

The digest of a node's ends is one hash of one text, so it is taken over a stream of ids in order; these
are joined to texts of up to CHUNK ids before, so that the stream has few rows, and are never held at once.

Defined cases: turns of null conv_id belong to no conversation; null turns come first; turns with equal
numbers stand in order of the MD5 of their role and text, repeated rows are turns of their own; null
roles and texts are empty; an empty table has no root and gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import OWN, load, stored

#: Rows of a block: turns of a conversation, children of a parent, places of the tour.
BLOCK = 50_000
#: Conversation ids whose texts are joined before they are hashed, at most.
CHUNK = 16_384
#: Turns that a rebuilt conversation can take from its base.
MOST_SHARED = 8

_LOW = (1 << 33) - 1


# ---- numbers and hot keys --------------------------------------------------------------------


def numbered(rows: DataFrame, order: list[Column | str], label: str) -> DataFrame:
    """`rows`, stored, with `number` from 0 in the given order; one small row for each range is summed in one task."""
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged = stored(ranged, label)
    part = F.shiftright("at", 33)
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    joined = ranged.withColumn("part", part).join(F.broadcast(sizes), "part")
    return joined.withColumn("number", F.col("before") + F.col("at").bitwiseAND(F.lit(_LOW))).drop("part", "before", "at")


def attached(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """`rows` (with `number`) inner joined with `table`, which has each `key` once; rows of a hot key meet it in blocks."""
    rows = rows.withColumn(f"{OWN}b", F.floor(F.col("number") / BLOCK))
    blocks = rows.select(key, f"{OWN}b").distinct().join(table, key)
    return rows.join(blocks, [key, f"{OWN}b"]).drop(f"{OWN}b")


# ---- rebuilt conversations -------------------------------------------------------------------


def shared_turns(conv: Column) -> Column:
    """How many turns conversation `conv` takes from its base: crc32 of its decimal id, modulo 9."""
    return (F.crc32(conv.cast("string")) % (MOST_SHARED + 1)).cast("int")


def base_of(conv: Column) -> Column:
    return conv - conv % 5


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv, turn, a, b, bytes): the identity of each turn's role and text in two numbers, and its text's bytes."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    part = lambda k: F.conv(F.substring("md5", k, 16), 16, -10).cast("long")
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").alias("conv"), "turn", digest.alias("md5"), F.octet_length(text).cast("long").alias("bytes"))
    # Repeated rows are told apart by a stored number, so that they too can be cut into ranges.
    return rows.select("conv", "turn", "md5", part(1).alias("a"), part(17).alias("b"), "bytes", F.monotonically_increasing_id().alias("copy"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv, size; turns: conv, place from 1, size, a, b, bytes), with the first turns taken from the base."""
    rows = stored(turn_rows(conversations), "turns")
    rows = numbered(rows, [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("md5"), F.col("copy")], "ordered").drop("md5", "copy", "turn")
    convs = rows.groupBy("conv").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("own"))
    convs = convs.withColumn("base", base_of(F.col("conv")))
    lent = convs.select(F.col("conv").alias("of"), F.col("own").alias("lent"), F.col("first").alias("base_first"))
    convs = convs.join(lent, F.col("base") == F.col("of"), "left")
    h = F.when(F.col("conv") == F.col("base"), 0).otherwise(shared_turns(F.col("conv")))
    taken = F.least(F.col("h").cast("long"), F.coalesce("lent", F.lit(0).cast("long")))
    convs = convs.withColumn("h", h).withColumn("taken", taken).withColumn("size", F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0).cast("long")))
    convs = stored(convs.select("conv", "base", "first", "base_first", "h", "taken", "size"), "convs")

    own = attached(rows, convs, "conv").withColumn("place", F.col("number") - F.col("first") + 1).where(F.col("place") > F.col("h"))
    own = own.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "size", "a", "b", "bytes")
    # A base lends its first turns, at most MOST_SHARED, to the few conversations that have it.
    places = F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken") - 1)).alias("k")
    wanted = convs.where("taken > 0").select("conv", "size", "base_first", places)
    wanted = wanted.select("conv", "size", (F.col("k") + 1).alias("place"), (F.col("base_first") + F.col("k")).alias("number"))
    lent_turns = wanted.join(rows.select("number", "a", "b", "bytes"), "number").select("conv", "place", "size", "a", "b", "bytes")
    return convs.select("conv", "size"), stored(own.union(lent_turns), "rebuilt")


# ---- nodes -----------------------------------------------------------------------------------


def prefixes(turns: DataFrame) -> DataFrame:
    """`turns` with x, y: the name of the prefix that ends here; and px, py: of the one before."""
    hashed = lambda k: F.xxhash64(F.lit(k), "place", "a", "b")
    turns = turns.withColumns({"hx": hashed(1), "hy": hashed(2), "block": F.floor(F.col("place") / BLOCK)})
    inside = Window.partitionBy("conv", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumns({"x": F.bit_xor("hx").over(inside), "y": F.bit_xor("hy").over(inside)})
    # Conversations shorter than a block have no second one.
    blocks = turns.where(F.col("size") >= BLOCK).groupBy("conv", "block").agg(F.bit_xor("hx").alias("bx"), F.bit_xor("hy").alias("by"))
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv", "block", F.bit_xor("bx").over(before).alias("bx"), F.bit_xor("by").over(before).alias("by")).where("block > 0")
    rows = rows.join(blocks, ["conv", "block"], "left")
    whole = lambda c, b: F.col(c).bitwiseXOR(F.coalesce(F.col(b), F.lit(0).cast("long")))
    rows = rows.withColumns({"x": whole("x", "bx"), "y": whole("y", "by")})
    return rows.withColumns({"px": F.col("x").bitwiseXOR(F.col("hx")), "py": F.col("y").bitwiseXOR(F.col("hy"))}).select("conv", "place", "size", "bytes", "x", "y", "px", "py")


def trie_nodes(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(x, y, depth, px, py, conv_id, n_convs, saved) of every node, the root (0, 0, 0) too; saved: the node's own bytes."""
    named = rows.groupBy("x", "y", F.col("place").alias("depth")).agg(
        F.first("px").alias("px"), F.first("py").alias("py"), F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    root = root.select(zero.alias("x"), zero.alias("y"), zero.alias("depth"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), "conv_id", "n_convs", zero.alias("bytes"))
    every = named.unionByName(root)
    return every.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes")


def end_digests(convs: DataFrame, rows: DataFrame) -> DataFrame:
    """(x, y, depth, ends_sha256) of the nodes at which a conversation ends; see the module's text."""
    zero = F.lit(0).cast("long")
    ends = rows.where("place = size").select("x", "y", F.col("place").alias("depth"), "conv")
    ends = ends.union(convs.where("size = 0").select(zero, zero, zero, "conv"))
    chunk = F.floor(F.col("conv") / CHUNK)
    chunks = ends.groupBy("x", "y", "depth", chunk.alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    key = ["x", "y", "depth"]
    return chunks.repartition(*key).sortWithinPartitions(*key, "chunk").select(*key, "ids").mapInArrow(_digests, "x long, y long, depth long, ends_sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash the rows of one key after the other, joined by commas."""
    names = ["x", "y", "depth", "ends_sha256"]
    last, digest = None, hashlib.sha256()
    for batch in batches:
        done: list[tuple] = []
        for *key, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if key == last:
                digest.update(b",")
            else:
                if last is not None:
                    done.append((*last, digest.hexdigest()))
                last, digest = key, hashlib.sha256()
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip(names, d, strict=True)) for d in done], _DIGESTS)
    if last is not None:
        yield pa.RecordBatch.from_pylist([dict(zip(names, (*last, digest.hexdigest()), strict=True))], _DIGESTS)


_DIGESTS = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("depth", pa.int64()), ("ends_sha256", pa.string())])


# ---- the tour --------------------------------------------------------------------------------


def sibling_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by child number: parent, parent_conv_id, next_sibling; by parent number: first_child, n_children).

    Children stand in the order of their numbers. Those of one parent are cut into blocks of numbers:
    neighbours are found inside a block, and from block to block over one row for each.
    """
    key = ["px", "py", "depth"]
    rows = nodes.where("depth > 0").select(*key, "number").withColumn("block", F.floor(F.col("number") / BLOCK))
    blocks = rows.groupBy(*key, "block").agg(F.min("number").alias("first"), F.count(F.lit(1)).alias("n"))
    blocks = blocks.withColumn("next_first", F.lead("first").over(Window.partitionBy(*key).orderBy("block")))
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), (F.col("depth") + 1).alias("depth"), F.col("number").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    blocks = stored(blocks.join(parents, key), "siblings")
    ahead = F.lead("number").over(Window.partitionBy(*key, "block").orderBy("number"))
    children = rows.withColumn("ahead", ahead).join(blocks.drop("first", "n"), [*key, "block"])
    children = children.select("number", "parent", "parent_conv_id", F.coalesce("ahead", "next_first").alias("next_sibling"))
    families = blocks.groupBy("parent").agg(F.min("first").alias("first_child"), F.sum("n").alias("n_children"))
    return children, families


def arcs(tree: DataFrame) -> DataFrame:
    """(arc, next): node n has the enter arc 2n and the exit arc 2n + 1; the root's exit leads nowhere."""
    into, out = F.col("number") * 2, F.col("number") * 2 + 1
    down = F.coalesce(F.col("first_child") * 2, out)
    on = F.coalesce(F.col("next_sibling") * 2, F.col("parent") * 2 + 1)
    both = F.array(F.struct(into.alias("arc"), down.alias("next")), F.struct(out.alias("arc"), on.alias("next")))
    return tree.select(F.explode(both).alias("x")).select("x.*")


def joined_runs(arc: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first arc of each arc's run, its place in the run, run length and the arc after the run, both at the first arc).

    -1 follows the last arc of all. By pointer doubling towards the start of the run.
    """
    n = len(arc)
    order = np.argsort(arc)
    arc, following = arc[order], following[order]
    at = np.searchsorted(arc, following)
    inside = (at < n) & (arc[np.minimum(at, n - 1)] == following)
    back = np.arange(n)
    back[at[inside]] = np.flatnonzero(inside)
    place = (back != np.arange(n)).astype(np.int64)
    while True:
        ahead = back[back]
        if (ahead == back).all():
            break
        place += place[back]
        back = ahead
    length, after = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    tail = np.flatnonzero(~inside)
    length[back[tail]], after[back[tail]] = place[tail] + 1, following[tail]
    undo = np.empty(n, np.int64)
    undo[order] = np.arange(n)
    return arc[back][undo], place[undo], length[undo], after[undo]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, arc, next), sorted by block -> (arc, head, place, length, after) of each block's runs."""
    held: list[pa.RecordBatch] = []

    def settled() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        arc = table.column("arc").to_numpy()
        head, place, length, after = joined_runs(arc, table.column("next").fill_null(-1).to_numpy())
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (arc, head, place, length, after)], names=["arc", "head", "place", "length", "after"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1), len(blocks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and a < b and held[0].column(0)[0].as_py() != blocks[a]:
                yield settled()
                held.clear()
            if a < b:
                held.append(batch.slice(a, b - a))
    if held:
        yield settled()


def ranked(runs: DataFrame) -> DataFrame:
    """(head, left): arcs from each run's first arc to the end of the tour, by pointer doubling over all runs."""
    runs = stored(runs.select("head", F.col("length").alias("left"), F.when(F.col("after") >= 0, F.col("after")).alias("after")), "ranks")
    while runs.where("after IS NOT NULL").agg(F.count(F.lit(1))).first()[0]:
        ahead = runs.select(F.col("head").alias("of"), F.col("left").alias("more"), F.col("after").alias("far"))
        open_ = runs.where("after IS NOT NULL").join(ahead, F.col("after") == F.col("of"))
        runs = stored(runs.where("after IS NULL").union(open_.select("head", F.col("left") + F.col("more"), "far")), "ranks")
    return runs.select("head", "left")


def subtree_sums(tree: DataFrame, n_nodes: int) -> DataFrame:
    """(number, n_leaves, saved_tokens) of every node, from the tour of `tree` (number, links, saved)."""
    links = arcs(tree).withColumn("block", F.floor(F.col("arc") / (2 * BLOCK)))
    runs = links.repartition("block").sortWithinPartitions("block").select("block", "arc", "next").mapInArrow(_runs, "arc long, head long, place long, length long, after long")
    runs = stored(runs, "runs")
    ranks = ranked(runs.where("arc = head"))
    at = F.lit(2 * n_nodes) - F.col("left") + F.col("place")
    placed = runs.select("arc", "head", "place").join(ranks, "head").select("arc", at.alias("position"), F.floor(F.col("arc") / 2).alias("number"))
    weighed = placed.join(tree.select("number", F.col("first_child").isNull().cast("long").alias("leaf"), "saved"), "number")
    enters = F.col("arc") % 2 == 0
    weight = {c: F.when(enters, F.col(c)).otherwise(F.lit(0).cast("long")) for c in ("leaf", "saved")}
    tour = stored(weighed.select("number", "arc", "position", *[w.alias(c) for c, w in weight.items()], F.floor(F.col("position") / BLOCK).alias("block")), "tour")
    sums = tour.groupBy("block").agg(*[F.sum(c).alias(f"{c}_in") for c in weight])
    every = Window.orderBy("block")
    sums = sums.select(F.col("block"), *[(F.sum(f"{c}_in").over(every) - F.col(f"{c}_in")).alias(f"{c}_before") for c in weight])
    inside = Window.partitionBy("block").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    run = tour.select("number", "arc", "block", *[F.sum(c).over(inside).alias(f"{c}_run") for c in weight], *weight).join(sums, "block")
    # Up to and including the exit arc, less what came before the enter arc.
    part = lambda c: F.sum(F.when(enters, F.col(c) - F.col(f"{c}_before") - F.col(f"{c}_run")).otherwise(F.col(f"{c}_before") + F.col(f"{c}_run")))
    return run.groupBy("number").agg(part("leaf").alias("n_leaves"), part("saved").alias("saved_tokens"))


def trie(conversations: DataFrame) -> DataFrame:
    """A row for every node of the prefix trie of the rebuilt conversations."""
    convs, turns = rebuilt(conversations)
    rows = stored(prefixes(turns), "prefixes")
    nodes = numbered(trie_nodes(convs, rows), ["conv_id", "depth"], "nodes")
    children, families = sibling_links(nodes)
    tree = nodes.join(children, "number", "left").join(families.withColumnRenamed("parent", "number"), "number", "left")
    tree = stored(tree, "tree")
    n_nodes = tree.count()
    out = tree.join(subtree_sums(tree, n_nodes), "number").join(end_digests(convs, rows), ["x", "y", "depth"], "left")
    nobody = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(load(spark, sf_dir, "conversations"))


#: CRC-32 of a decimal id, bit by bit.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::INT, 1))::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))))"""

SQL = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (
  SELECT conv_id, list([role, text] ORDER BY turn NULLS FIRST, md5(strlen(role)::VARCHAR || ':' || role || text)) AS turns FROM rows GROUP BY conv_id),
shared AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base, {_CRC} % 9 AS h, turns FROM own),
rebuilt AS (
  SELECT s.conv_id, CASE WHEN s.base = s.conv_id THEN s.turns ELSE coalesce(b.turns, [])[1:h] || s.turns[h + 1:] END AS turns
  FROM shared s LEFT JOIN own b ON s.base = b.conv_id),
prefixed AS (
  SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
nodes AS (
  SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256,
         CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(any_value(turns[depth][2])) END AS saved
  FROM prefixed GROUP BY turns[1:depth], depth),
linked AS (
  SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND c.prefix[1:n.depth] = n.prefix) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]),
above AS (
  SELECT prefix[1:d] AS top, d, saved, (n_children = 0)::INT AS leaf FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM linked)),
sums AS (SELECT top, d, sum(leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY top, d)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN sums ON top = prefix AND d = depth
"""
