"""Token counts that follow edits: a segment tree of pre-token runs for each document.

A text is cut into leaves of about LEAF characters, before single spaces between letters or digits: there
a pre-token ends whatever stands on either side, so that the token counts of leaves add up to that of
the text. The tree keeps the sums of characters and tokens of its subtrees. An edit finds its leaves by
descending the sums; they and one leaf of context on either side are put together with the edit, cut
and encoded again, and the sums above them are updated. A slot that has outgrown its size many times
makes the tree be built anew from its leaves, without encoding.

Edits are (start, stop, text) in characters of the text before all edits, in any order; one that begins
within an earlier one (by start, stop, text) begins where that ends; places beyond the end mean the end.
The tokenizer is a byte-level BPE file, of which the path is a parameter.

Defined cases: a null text is empty and has no tokens; null edits or replacement texts are none, null
places are 0; rows with equal ids are rows of their own; an empty table gives an empty result; a text
without a place to cut is one leaf.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.llm.common import OWN, load, stored

LEAF = 128
#: A slot of so many times LEAF characters makes the tree be built anew.
OUTGROWN = 8
EDITS = "array<struct<start:int,stop:int,text:string>>"


@cache
def counter(path: str | None = None) -> Callable[[str], int]:
    """Number of tokens of a text by the ranks file at `path`; None: the byte-level BPE of the public tokenizers."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    encoding = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(encoding.encode_ordinary(text))


def leaves(text: str, size: int = LEAF) -> list[str]:
    """The text in runs of at least `size` characters, cut where pre-tokens end in any context."""
    out, first, at = [], 0, size
    while (at := text.find(" ", at)) >= 0:
        if at + 1 < len(text) and text[at - 1].isalnum() and text[at + 1].isalnum():
            out.append(text[first:at])
            first = at
            at += size
        else:
            at += 1
    if first < len(text):
        out.append(text[first:])
    return out


class Tree:
    """Sums of characters and tokens over the leaves of one text; slot i stands at node size + i."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, len(chars) - 1).bit_length()
        pad = [0] * (self.size - len(chars))
        self.chars, self.tokens = [0] * self.size + chars + pad, [0] * self.size + tokens + pad
        for i in range(self.size - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def slot(self, place: int) -> tuple[int, int]:
        """(slot that holds the character at `place`, or the last that is not empty; first character of it)."""
        place, i, first = min(place, max(0, self.chars[1] - 1)), 1, 0
        while i < self.size:
            i *= 2
            if place - first >= self.chars[i]:
                first += self.chars[i]
                i += 1
        return i - self.size, first

    def put(self, i: int, chars: int, tokens: int) -> None:
        i += self.size
        self.chars[i], self.tokens[i] = chars, tokens
        while i := i // 2:
            self._sum(i)

    def used(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that are not empty."""
        both = [(c, t) for c, t in zip(self.chars[self.size :], self.tokens[self.size :], strict=True) if c]
        return [c for c, _ in both], [t for _, t in both]


def ordered(edits: list[tuple[int, int, str]], n: int) -> list[tuple[int, int, str]]:
    """Edits by place, none overlapping; see the module's text."""
    out, end = [], 0
    for start, stop, text in sorted((max(0, a or 0), b or 0, t or "") for a, b, t in edits):
        start = min(max(start, end), n)
        end = min(max(stop, start), n)
        out.append((start, end, text))
    return out


def apply(text: str, tree: Tree, edits: list[tuple[int, int, str]], count: Callable[[str], int]) -> tuple[str, Tree, int]:
    """(edited text, tree of it, characters encoded): only the touched leaves and their neighbours are encoded again."""
    regions: list[list] = []
    for edit in ordered(edits, len(text)):
        # The end's own slot too: what is put there may join with what follows.
        lo, hi = max(0, tree.slot(edit[0])[0] - 1), min(tree.size - 1, tree.slot(edit[1])[0] + 1)
        if regions and lo <= regions[-1][1]:
            regions[-1][1] = max(hi, regions[-1][1])
            regions[-1][2].append(edit)
        else:
            regions.append([lo, hi, [edit]])
    pieces, done, encoded, put = [], 0, 0, []
    ends = tree.chars[tree.size :]
    start_of, total = [], 0
    for c in ends:
        start_of.append(total)
        total += c
    for lo, hi, own in regions:
        a, b = start_of[lo], start_of[hi] + ends[hi]
        parts, at = [], a
        for start, stop, new in own:
            parts += [text[at:start], new]
            at = stop
        region = "".join([*parts, text[at:b]])
        pieces += [text[done:a], region]
        done = b
        encoded += len(region)
        new = leaves(region)
        slots = hi - lo + 1
        new = new[: slots - 1] + ["".join(new[slots - 1 :])] if len(new) > slots else new + [""] * (slots - len(new))
        put += [(lo + k, len(s), count(s) if s else 0) for k, s in enumerate(new)]
    for slot in put:
        tree.put(*slot)
    if any(c > OUTGROWN * LEAF for _, c, _ in put):
        tree = Tree(*tree.used())
    return "".join([*pieces, text[done:]]), tree, encoded


def count_trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """`docs` with the leaves' characters and tokens under the internal prefix."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            cut = [leaves(t or "") for t in batch.column(len(columns)).to_pylist()]
            kind = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([[len(s) for s in c] for c in cut], kind), pa.array([[count(s) for s in c] for c in cut], kind)], names=[*columns, f"{OWN}chars", f"{OWN}tokens"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.select("*", F.col("text").alias(f"{OWN}text")).mapInArrow(run, f"{kinds}, {OWN}chars array<int>, {OWN}tokens array<int>")


def with_edits(trees: DataFrame, edits: DataFrame) -> DataFrame:
    """`trees` with the edits (doc_id, start, stop, text) of their doc_id."""
    by = edits.groupBy(F.col("doc_id").alias(f"{OWN}of")).agg(F.collect_list(F.struct("start", "stop", "text")).cast(EDITS).alias(f"{OWN}edits"))
    return trees.join(by, F.col("doc_id").eqNullSafe(F.col(f"{OWN}of")), "left").drop(f"{OWN}of")


def edited(trees: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text (edited), the edited tree's leaves, n_chars, n_tokens, edited_n_chars, edited_n_tokens, reencoded_chars of rows with trees and edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            rows = []
            for text, chars, tokens, edits in zip(*[batch.column(k).to_pylist() for k in range(1, 5)], strict=True):
                tree = Tree(chars, tokens)
                n = tree.chars[1], tree.tokens[1]
                new, tree, encoded = apply(text or "", tree, [(e["start"], e["stop"], e["text"]) for e in edits or []], count)
                rows.append((new, *tree.used(), *n, tree.chars[1], tree.tokens[1], encoded))
            kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())] + [pa.int64()] * 5
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "text", f"{OWN}chars", f"{OWN}tokens", *_COUNTS])

    kind = trees.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in _COUNTS)
    return trees.select("doc_id", "text", f"{OWN}chars", f"{OWN}tokens", f"{OWN}edits").mapInArrow(run, f"doc_id {kind}, text string, {OWN}chars array<int>, {OWN}tokens array<int>, {counts}")


_COUNTS = ("n_chars", "n_tokens", "edited_n_chars", "edited_n_tokens", "reencoded_chars")


def three_edits(docs: DataFrame) -> DataFrame:
    """`docs` with a replacement, a deletion and an insertion at the quarters of every text."""
    n = F.length(F.coalesce("text", F.lit("")))
    at = lambda k: F.floor(n * k / 4).cast("int")
    edit = lambda start, length, text: F.struct(start.alias("start"), (start + length).alias("stop"), text.alias("text"))
    return docs.withColumn(f"{OWN}edits", F.array(edit(at(1), 8, F.concat(F.lit("edit "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), edit(at(2), 5, F.lit("")), edit(at(3), 0, F.lit(" inserted words"))).cast(EDITS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after `three_edits`, of all documents."""
    trees = stored(count_trees(load(spark, sf_dir, "documents").select("doc_id", "text")), "trees")
    rows = edited(three_edits(trees))
    return rows.select("doc_id", *_COUNTS, F.sha2("text", 256).alias("edited_sha256"))
