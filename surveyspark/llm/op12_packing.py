"""Best-fit packing: Martello-Toth dominance reduction, then best fit of what is left.

A document's tokens, and one separator after them, are a piece; a longer one is cut into pieces of the
limit. A piece's length is all that packing needs, and there are at most `limit` lengths, so Spark counts
the pieces of each length and the plan is made on that table of counts, whose size is the limit whatever
the number of documents. The plan is a table of runs: pieces of one length, by number, that go to
consecutive sequences at one place. Pieces are numbered within their length by Spark, in blocks, and look
their run up.

Reduction. A set of pieces that fits into a sequence dominates another with the same piece j if the
other's pieces can be parted into groups, each no longer than a piece of the first: in any packing the
groups and those pieces can change places, so some best packing holds the dominating set. For j, room
r = limit - j and the other pieces left, `dominating` finds
  {j} if nothing else fits;
  {j, x}, x the longest that fits, if x fills the room, or at most one more fits, or at most two and no
  pair that fits is longer than x;
  {j, x, b}, b the longest that fits beside both, if at most two more fit and the shorter piece of any
  pair that fits is at most b.
Such sets are fixed as often as counts allow (what is taken away only removes alternatives, so the proof
stays good), from the longest j down, and again until no j is fixed any more. Best fit then takes what is
left, longest first, into the sequence with the least room that is enough.

Defined cases: a null or empty text is one piece, the separator; texts without a token too; rows with
equal ids, and null ids, are documents of their own; an empty table gives an empty result; other columns
are ignored. A text is tokenised between ASCII white space, which the tokenizer drops and never joins
over; Arrow tells the different words of many texts, which alone are looked up, and words are remembered
from one call to the next. A word of letters of Latin-1 and ASCII marks goes to the tokenizer's model run by
run, as its normalizer and splitter would leave it; other words pass them. A tokenizer that splits otherwise
(`splits_alike`) gets whole texts, one with other steps (`plain_steps`) all words whole. Texts are read in
parts of CHUNK bytes, so that a very long one holds no more than its ids.
"""

from __future__ import annotations

import bisect
import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import OWN, load, stored

LIMIT = 2048
SEPARATOR = 0
#: Bytes of texts that are cut into words at once.
CHUNK = 1 << 23
#: Bytes of ids that are handed on at once, about.
HANDED = 1 << 24
#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 600_000
#: Words that are encoded in one call.
AT_ONCE = 20_000
#: Their length, about.
BYTES_AT_ONCE = 1 << 19
#: Limits are below this, so that the plan stays small.
MOST = 1 << 15
#: Pieces that are numbered in one task, about.
BLOCK_ROWS = 100_000

#: End of the splitting pattern of tokenizers whose words can be told apart beforehand (a fixed value of the public file).
SPLIT = r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What stands before it where a word may be split into runs: contractions, which need an apostrophe.
CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_GAP = re.compile(rb"[\t-\r ]")
#: ASCII but "'" and "<", which contractions and special tokens need, and letters of Latin-1, which are composed already.
_PLAIN = "^[!-&(-;=-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*$"
#: The parts of such words, in lower case and a line each, and the ends of lines.
_RUNS = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|\n|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff\n]+")
#: The characters that byte-level tokenizers take for bytes; a line's end stays.
_AS_BYTES = np.arange(256, dtype="<u2")
_AS_BYTES[[*range(0x21), *range(0x7F, 0xA1), 0xAD]] = np.arange(0x100, 0x100 + 68)
_AS_BYTES[10] = 10
LENGTH, NUMBER, DEAL = f"{OWN}length", f"{OWN}number", f"{OWN}deal"


# ---- tokens ----------------------------------------------------------------------------------


def splits_alike(path: str) -> bool:
    """Whether the tokenizer lower-cases, drops white space, and splits letters, single digits and other runs apart."""
    with open(path, encoding="utf-8") as file:
        kind = json.load(file)
    steps = [step.get("type") for step in (kind.get("normalizer") or {}).get("normalizers", [])]
    splits = (kind.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    return steps == ["NFC", "Replace", "Lowercase"] and splits[0].get("pattern", {}).get("Regex", "").endswith(SPLIT)


def plain_steps(path: str) -> bool:
    """Whether the tokenizer does nothing else to a plain word than to lower its case, split it into runs and map their bytes."""
    with open(path, encoding="utf-8") as file:
        kind = json.load(file)
    normal, splits, model = kind.get("normalizer") or {}, (kind.get("pre_tokenizer") or {}).get("pretokenizers", []), kind.get("model") or {}
    return (
        normal.get("normalizers") == [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
        and splits[:1] == [{"type": "Split", "pattern": {"Regex": CONTRACTIONS + SPLIT}, "behavior": "Removed", "invert": True}]
        and [(s.get("type"), s.get("add_prefix_space"), s.get("use_regex")) for s in splits[1:]] == [("ByteLevel", False, False)]
        and model.get("type") == "BPE" and not model.get("dropout")
        and all("<" in t["content"] and not t["normalized"] for t in kind.get("added_tokens", []))
    )


def plain_form(word: bytes) -> tuple[bytes, bytes]:
    """(word, mark after it) that have the same ids together: no full stop or comma after a letter or digit, ASCII in lower case."""
    mark = word[-1:] if word[-1:] in b".," and word[-2:-1].isalnum() else b""
    if mark:
        word = word[:-1]
    # Lower case would make a special token of its likeness, and other letters may compose differently.
    return (word.lower() if word.isascii() and b"<" not in word else word), mark


class Words:
    """The ids of words as little-endian 32-bit bytes; a generation of words that was not met again is forgotten."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.alike = splits_alike(path)
        self.model = self.tokenizer.model if self.alike and plain_steps(path) else None
        #: Ids by run of a plain word (str) and by other word (bytes).
        self.young: dict[str | bytes, bytes] = {}
        self.old: dict[str | bytes, bytes] = {}

    def of(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of each text; texts are taken together up to CHUNK bytes, and cut at white space beyond."""
        if not self.alike:
            yield from (np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch([t.decode("utf-8") for t in texts], add_special_tokens=False))
            return
        held, size = [], 0
        for text in texts:
            if size + len(text) > CHUNK:
                yield from self._short(held)
                held, size = [], 0
            if len(text) > CHUNK:
                yield b"".join(i for part in self._parts(text) for i in self._short([part]))
            else:
                held.append(text)
                size += len(text)
        yield from self._short(held)

    def _parts(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while at < len(text):
            gap = _GAP.search(text, at + CHUNK)
            end = gap.start() if gap else len(text)
            yield text[at:end]
            at = end

    def _short(self, texts: list[bytes]) -> Iterator[bytes]:
        """The ids of texts whose words are held at once; each different word is looked up once, and what is not known is learnt."""
        if not texts:
            return
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}
        split = pc.ascii_split_whitespace(pa.array(texts, pa.binary()).view(pa.string()))
        told = split.values.dictionary_encode()
        words, at = told.dictionary, told.indices.to_numpy()
        if self.model is None:
            found = self._others(words)
        else:
            plain = pc.match_substring_regex(words, _PLAIN)
            found = pa.concat_arrays([self._plain(words.filter(plain)), self._others(words.filter(pc.invert(plain)))])
            is_plain = plain.to_numpy(zero_copy_only=False)
            at = np.where(is_plain, np.cumsum(is_plain), is_plain.sum() + np.cumsum(~is_plain))[at] - 1
        _, ends, data = found.take(pa.array(at)).buffers()
        cuts = np.frombuffer(ends, np.int64)[split.offsets.to_numpy()].tolist()
        data = memoryview(data or b"")
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield bytes(data[a:b])

    def _plain(self, words: pa.Array) -> pa.Array:
        """The ids of plain words, run by run."""
        if not len(words):
            return pa.array([], pa.large_binary())
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), "\n")[0].as_py()
        runs = _RUNS.findall(lines.lower() + "\n")
        self._learn(set(runs) - {"\n"}, self.modelled)
        self.young["\n"] = b""
        ids = list(map(self.young.__getitem__, runs))
        last = np.flatnonzero(np.fromiter((run == "\n" for run in runs), bool, len(runs)))
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))[last]
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(b"".join(ids))])

    def _others(self, words: pa.Array) -> pa.Array:
        """The ids of words, each as a whole but for a mark after it."""
        forms = [plain_form(w) for w in words.view(pa.binary()).to_pylist()]
        self._learn({part for both in forms for part in both}, self.encoded)
        return pa.array([self.young[form] + self.young[mark] for form, mark in forms], pa.large_binary())

    def _learn(self, needed: set, ids_of: Callable[[list], list[bytes]]) -> None:
        young, old = self.young, self.old
        needed = [part for part in needed if part not in young]
        young.update((part, old[part]) for part in needed if part in old)
        unknown = [part for part in needed if part not in young] if old else needed
        # Long words take a call of their own, as a call holds much for each of its tokens.
        at, size = 0, 0
        for k, part in enumerate(unknown):
            size += len(part)
            if k + 1 == len(unknown) or k + 1 - at == AT_ONCE or size > BYTES_AT_ONCE:
                some = unknown[at : k + 1]
                young.update(zip(some, ids_of(some), strict=True))
                at, size = k + 1, 0

    def modelled(self, runs: list[str]) -> list[bytes]:
        """The ids of runs of plain words: what the model makes of their bytes."""
        tokenize, ids, cuts = self.model.tokenize, [], [0]
        data = np.frombuffer("\n".join(runs).encode(), np.uint8)
        for run in _AS_BYTES[data].tobytes().decode("utf-16-le").split("\n"):
            ids += [t.id for t in tokenize(run)]
            cuts.append(4 * len(ids))
        flat = np.array(ids, "<u4").tobytes()
        return [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of words: all in one call, cut where the tokenizer says that a word ends."""
        found = self.tokenizer.encode([w.decode("utf-8") for w in words], is_pretokenized=True, add_special_tokens=False)
        ids = np.array(found.ids, "<u4").tobytes()
        cuts = (4 * np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(words) + 1))).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


@cache
def words_of(path: str) -> Words:
    """A worker's words, kept from task to task."""
    return Words(path)


def _pieces(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(path)
        size, end = 4 * limit, np.array([SEPARATOR], "<u4").tobytes()
        for batch in batches:
            rows, piece, cut, held = [], [], [], 0
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            for k, ids in enumerate(words.of(texts)):
                ids += end
                for p in range(-(-len(ids) // size)):
                    rows.append(k)
                    piece.append(p)
                    cut.append(ids[p * size : (p + 1) * size])
                held += len(ids)
                if held > HANDED or k == len(texts) - 1:
                    number = pa.array(piece, pa.int32())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), number, pa.array([p * limit for p in piece], pa.int64()), pa.array([len(c) // 4 for c in cut], pa.int64()), pa.array(cut, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])
                    rows, piece, cut, held = [], [], [], 0

    return run


def default_tokenizer() -> str:
    """The public word-level BPE of this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length and ids (little-endian 32 bits each) of all documents, by the tokenizer file at `path`."""
    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(_pieces(path or default_tokenizer(), limit), f"doc_id {kind.simpleString()}, piece int, start long, length long, ids binary")


# ---- the plan --------------------------------------------------------------------------------


class Left:
    """How many pieces of each length are left."""

    def __init__(self, counts: Mapping[int, int]):
        self.count = {s: n for s, n in counts.items() if n > 0}
        self.sizes = sorted(self.count)

    def take(self, size: int, n: int) -> None:
        self.count[size] -= n
        if not self.count[size]:
            del self.count[size]
            del self.sizes[bisect.bisect_left(self.sizes, size)]

    def longest(self, room: int, without: Iterable[int] = ()) -> int:
        """The longest length of at most `room`, of the pieces but one of each of `without`; 0: none."""
        without = list(without)
        for i in range(bisect.bisect_right(self.sizes, room) - 1, -1, -1):
            size = self.sizes[i]
            if self.count[size] > without.count(size):
                return size
        return 0

    def shortest(self, n: int, without: int) -> list[int]:
        """The n shortest pieces but one of length `without`; fewer if there are no more."""
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(n - len(out), self.count[size] - (size == without))
            if len(out) == n:
                break
        return out


def dominating(left: Left, j: int, limit: int) -> tuple[int, ...] | None:
    """A set of lengths with j that dominates all others with j; None if the rules above name none."""
    room = limit - j
    x = left.longest(room, [j])
    if not x:
        return (j,)
    few = left.shortest(3, j)
    if x == room or len(few) < 2 or few[0] + few[1] > room:
        return (j, x)
    if len(few) == 3 and sum(few) <= room:
        return None
    # At most two more fit. The longest pair, and the longest shorter half of any pair.
    pair, half = 0, 0
    seen: int | None = None
    for size in reversed(left.sizes[: bisect.bisect_right(left.sizes, room)]):
        n = left.count[size] - (size == j)
        if not n:
            continue
        mate = size if n > 1 else seen
        if not half and mate is not None and size + mate <= room:
            half = size
        other = left.longest(min(size, room - size), [j, size])
        pair = max(pair, size + other if other else 0)
        seen = size
        if half and 2 * size <= pair:
            break
    if pair <= x:
        return (j, x)
    b = left.longest(room - x, [j, x])
    return (j, x, b) if b and half <= b else None


def reduced(counts: Mapping[int, int], limit: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """(sets with how often each is fixed, counts of what is left)."""
    left, fixed, again = Left(counts), [], True
    while again:
        again = False
        for j in reversed(list(left.sizes)):
            while left.count.get(j) and (found := dominating(left, j, limit)):
                n = min(left.count[s] // found.count(s) for s in set(found))
                for s in set(found):
                    left.take(s, n * found.count(s))
                fixed.append((found, n))
                again = len(found) > 1 or again
    return fixed, left.count


def best_fit(counts: Mapping[int, int], limit: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, times)]): groups of equal sequences, filled longest piece first where the least room is enough.

    Pieces of one length go on into the sequence that took the first of them, as it then has the
    least room, so they are placed in bulk.
    """
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms: list[int] = []

    def put(room: int, n: int, held: list[tuple[int, int]]) -> None:
        if room not in groups:
            bisect.insort(rooms, room)
        groups.setdefault(room, []).append((n, held))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                some, held = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[at]
            else:
                room, some, held = limit, n, []
            each = room // size
            full = min(some, n // each)
            n -= full * each
            if full:
                put(room - each * size, full, [*held, (size, each)])
            if full < some:
                # Fewer than fill one sequence are left.
                if n:
                    put(room - n * size, 1, [*held, (size, n)])
                if held and some - full > (n > 0):
                    put(room, some - full - (n > 0), held)
                n = 0
    return [group for room in rooms for group in groups[room]]


def runs(counts: Mapping[int, int], limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """(rows of length, first number, times, first sequence, offset by length and number, number of sequences).

    The piece with the n-th number of its length, of a run from number f on that puts `times` in a
    sequence, is in sequence first + (n - f) // times, (n - f) % times places after the offset.
    """
    fixed, left = reduced(counts, limit)
    sets = [(n, [(s, found.count(s)) for s in dict.fromkeys(found)]) for found, n in fixed] + best_fit(left, limit)
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for n, held in sets:
        offset = 0
        for size, times in held:
            rows.append((size, used.get(size, 0), times, sequence, offset))
            used[size] = used.get(size, 0) + n * times
            offset += size * times
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


# ---- packing ---------------------------------------------------------------------------------


def numbered(rows: DataFrame, total: int) -> DataFrame:
    """`rows` with a number from 0 within their length: blocks of a length are numbered each on its own."""
    blocks = max(1, -(-total // BLOCK_ROWS))
    rows = rows.withColumn(f"{OWN}block", F.pmod(F.col(DEAL), F.lit(blocks)))
    sums = rows.groupBy(F.col("length").alias("l"), F.col(f"{OWN}block").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("l", "b", (F.sum("n").over(Window.partitionBy("l").orderBy("b")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("length", f"{OWN}block").orderBy(DEAL)
    joined = rows.withColumn(NUMBER, F.row_number().over(inside) - 1).join(sums, (F.col("length") == F.col("l")) & (F.col(f"{OWN}block") == F.col("b")))
    return joined.withColumn(NUMBER, F.col(NUMBER) + F.col("before")).drop("l", "b", "before", f"{OWN}block", DEAL)


def _placed(plan, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = plan.value
        # Runs by length, then number, as one sorted key.
        first = rows[:, 0] << 48 | rows[:, 1]
        for batch in batches:
            length, number = (batch.column(names.index(c)).to_numpy() for c in ("length", NUMBER))
            own = rows[np.searchsorted(first, length << 48 | number, "right") - 1]
            n = number - own[:, 1]
            kept = [k for k, c in enumerate(names) if c != NUMBER]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in kept], pa.array(own[:, 3] + n // own[:, 2]), pa.array(own[:, 4] + n % own[:, 2] * length)], names=[*[names[k] for k in kept], "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, limit: int = LIMIT) -> DataFrame:
    """`pieces` (any columns, and `length` of 1 to `limit`) with sequence_id and offset.

    The pieces are stored once with a deal of their own, from which their blocks come: repeated pieces
    are spread like others, and what a lost task does again is the same.
    """
    deal = F.xxhash64(F.monotonically_increasing_id())
    rows = stored(pieces.withColumn(DEAL, deal), "pieces")
    if not 0 < limit < MOST:
        raise ValueError(f"the limit must be below {MOST}")
    outside = F.count_if(F.col("length").isNull() | ~F.col("length").between(1, limit))
    if rows.agg(outside).first()[0]:
        raise ValueError(f"lengths must be 1 to {limit}")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, _ = runs(counts, limit)
    dealt = numbered(rows, sum(counts.values()))
    plan = pieces.sparkSession.sparkContext.broadcast(table)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.select(*pieces.columns, NUMBER).mapInArrow(_placed(plan, [*pieces.columns, NUMBER]), f"{kinds}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and ids of each sequence, from packed pieces that carry `ids`; at most the limit of ids each."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "").alias("ids")).withColumn("ids", F.unhex("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = pieces(load(spark, sf_dir, "documents"))
    return pack(cut.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
