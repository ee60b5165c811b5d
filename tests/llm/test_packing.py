"""Best-fit packing: round trips, exact ids, and reductions against the best packing of small tables."""

import random
import zlib
from collections import Counter
from functools import cache

import numpy as np
import pytest
from .conftest import SF
from pyspark.sql import functions as F

from surveyspark.llm import op12_packing as packing
from surveyspark.llm.common import load


@cache
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_tokenizer())


def whole(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [0]


def best(items, limit):
    """Least number of sequences, by trying every place of every piece."""
    items = sorted(items, reverse=True)
    least = len(items)

    def go(k, rooms):
        nonlocal least
        if len(rooms) >= least:
            return
        if k == len(items):
            least = len(rooms)
            return
        for room in set(rooms):
            if room >= items[k]:
                rest = list(rooms)
                rest.remove(room)
                go(k + 1, [*rest, room - items[k]])
        go(k + 1, [*rooms, limit - items[k]])

    go(0, [])
    return least


def test_words_apart_are_tokens_of_the_whole_text():
    deal = random.Random(7)
    odd = [*" \t\n\r\x0b\x0c\x1c\x85\xa0 　​́'aA1Σςİß٣½;<|>日😀\x00", "'s", "<|endoftext|>", "<|ENDOFTEXT|>", "H\u0331", "é", "don't ", ". ", ",", "a.", "B,\n"]
    texts = ["".join(deal.choices(odd, k=deal.randint(0, 40))) for _ in range(400)] + ["", "a " * 5000, "b" * 30_000]
    words = packing.Words(packing.default_tokenizer())
    found = list(words.of([t.encode() for t in texts]))
    assert [np.frombuffer(i, "<u4").tolist() + [0] for i in found] == [whole(t) for t in texts]


def latin(deal, n):
    """Texts of what plain words are made of, and of what is next to it."""
    marks = [chr(c) for c in (*range(0x21, 0x7F), *range(0xBF, 0x100), 0xA0, 0xAA, 0xAD, 0xB2, 0xB5, 0x301, 0x17F, 0x130)]
    return ["".join(deal.choices([*marks, "a", "B", "É", "ß", " ", " ", "\n", "the", "'s", "<|endoftext|>"], k=deal.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("other", [None, "CONTRACTIONS"])
def test_plain_words_have_the_ids_of_the_whole_text(monkeypatch, other):
    if other:
        monkeypatch.setattr(packing, other, "other")
    texts = [*latin(random.Random(17), 1500), *map(chr, range(0x21, 0x250)), *(f"a{chr(c)}B1" for c in range(0x21, 0x250)), "\n a", "a \n", " "]
    words = packing.Words(packing.default_tokenizer())
    assert (words.model is None) == bool(other)
    assert [np.frombuffer(i, "<u4").tolist() + [0] for i in words.of([t.encode() for t in texts])] == [whole(t) for t in texts]


def test_plain_words_pass_the_model_only_and_once(monkeypatch):
    words = packing.Words(packing.default_tokenizer())
    seen, encoded, tokenize = [], words.encoded, words.modelled
    monkeypatch.setattr(words, "encoded", lambda some: pytest.fail(f"{some} passed all steps") if any(some) else encoded(some))
    monkeypatch.setattr(words, "modelled", lambda runs: (seen.extend(runs), tokenize(runs))[1])
    texts = ["The größte, the GRÖSSTE!! x1", "größte (the) Éa&&&", "the,the"]
    for _ in range(2):
        assert [np.frombuffer(i, "<u4").tolist() + [0] for i in words.of([t.encode() for t in texts])] == [whole(t) for t in texts]
    assert sorted(seen) == sorted({"the", "größte", ",", "grösste", "!!", "x", "1", "(", ")", "éa", "&&&"})


def test_a_call_takes_few_bytes(monkeypatch):
    monkeypatch.setattr(packing, "BYTES_AT_ONCE", 50)
    words = packing.Words(packing.default_tokenizer())
    sizes = []
    for name in ("encoded", "modelled"):
        monkeypatch.setattr(words, name, lambda some, ids_of=getattr(words, name): (sizes.append(sum(map(len, some[:-1]))), ids_of(some))[1])
    texts = ["".join(random.Random(k).choices("日本語の文章", k=40)) + " " + "".join(random.Random(k).choices("abcdef", k=40)) for k in range(30)]
    assert [np.frombuffer(i, "<u4").tolist() + [0] for i in words.of([t.encode() for t in texts])] == [whole(t) for t in texts]
    assert len(sizes) > 30 and max(sizes) <= 50


def test_ids_are_handed_on_by_size(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "HANDED", 100)
    texts = ["one two " * k for k in (0, 1, 30, 2, 0, 7)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(texts, pa.string())], names=["doc_id", "text"])
    batches = list(packing._pieces(packing.default_tokenizer(), 8)(iter([batch, batch.slice(0, 0)])))
    rows = [r for b in batches for r in b.to_pylist()]
    assert len(batches) == 2 and max(r["length"] for r in rows) == 8
    for k, text in enumerate(texts):
        own = [r for r in rows if r["doc_id"] == k]
        assert [r["piece"] for r in own] == list(range(len(own)))
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u4").tolist() == whole(text)


def test_long_texts_are_read_in_parts_and_old_words_forgotten(monkeypatch):
    monkeypatch.setattr(packing, "CHUNK", 64)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    deal = random.Random(3)
    texts = ["".join(deal.choices("ab c\nd1", k=n)) for n in (0, 10, 63, 64, 65, 1000, 20_000)]
    words = packing.Words(packing.default_tokenizer())
    assert [np.frombuffer(i, "<u4").tolist() + [0] for i in words.of([t.encode() for t in texts])] == [whole(t) for t in texts]
    assert len(words.young) + len(words.old) < 2000


@pytest.mark.parametrize("seed", range(60))
def test_fixed_sets_are_part_of_some_best_packing(seed):
    deal = random.Random(seed)
    limit = deal.choice((10, 20, 50))
    items = [deal.randint(deal.choice((1, 2, 3, limit // 3)), limit) for _ in range(deal.randint(1, 9))]
    fixed, left = packing.reduced(Counter(items), limit)
    used = Counter()
    for found, n in fixed:
        assert sum(found) <= limit
        for s in found:
            used[s] += n
    assert used + Counter(left) == Counter(items)
    assert sum(n for _, n in fixed) + best(list(Counter(left).elements()), limit) == best(items, limit)


def test_best_fit_in_bulk_equals_one_piece_at_a_time():
    deal = random.Random(5)
    for _ in range(200):
        limit = deal.choice((7, 20, 100))
        items = sorted((deal.randint(1, limit) for _ in range(deal.randint(0, 60))), reverse=True)
        rooms = []
        for s in items:
            fit = min((r for r in rooms if r >= s), default=limit)
            if fit in rooms:
                rooms.remove(fit)
            rooms.append(fit - s)
        groups = packing.best_fit(Counter(items), limit)
        assert sorted(limit - sum(s * t for s, t in held) for n, held in groups for _ in range(n)) == sorted(rooms)
        assert Counter({s: sum(n * dict(held).get(s, 0) for n, held in groups) for s in items}) == Counter(items)


def test_tokenizers_that_split_otherwise_get_whole_texts(monkeypatch):
    monkeypatch.setattr(packing, "SPLIT", "other")
    words = packing.Words(packing.default_tokenizer())
    texts = ["One two, three.", "", "don't <|endoftext|>"]
    assert not words.alike and [np.frombuffer(i, "<u4").tolist() + [0] for i in words.of([t.encode() for t in texts])] == [whole(t) for t in texts]


def check(packed, limit):
    """Sequences are gapless from 0 and hold at most the limit; returns their number."""
    by = {}
    for r in packed:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= limit
    return len(by)


def test_query_round_trip(spark):
    docs = {r.doc_id: r.text for r in load(spark, SF, "documents").collect()}
    rows = packing.query(spark, SF).collect()
    ids = {i: whole(t) for i, t in docs.items()}
    found = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows}
    expected = {}
    for i, own in ids.items():
        for p, start in enumerate(range(0, len(own), 2048)):
            cut = np.array(own[start : start + 2048], "<u4")
            expected[i, p] = (start, len(cut), zlib.crc32(cut.tobytes()))
    assert found == expected and len(rows) == len(expected)
    least = -(-sum(map(len, ids.values())) // 2048)
    assert least <= check(rows, 2048) <= least + 2


def test_sequences_hold_the_ids_of_their_pieces(spark):
    docs = load(spark, SF, "documents").limit(60)
    packed = packing.pack(packing.pieces(docs, limit=300), 300).cache()
    rows = packed.collect()
    check(rows, 300)
    held = {r.sequence_id: r.ids for r in packing.sequences(packed).collect()}
    for r in rows:
        assert bytes(held[r.sequence_id][4 * r.offset : 4 * (r.offset + r.length)]) == bytes(r.ids)
    assert sum(map(len, held.values())) == 4 * sum(r.length for r in rows)
    packed.unpersist()


def test_odd_rows_ties_and_blocks(spark, odd, none, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_ROWS", 3)
    cut = packing.pieces(odd)
    rows = packing.pack(cut).collect()
    check(rows, 2048)
    assert Counter((r.doc_id, r.piece, r.length) for r in rows) == Counter((r.doc_id, r.piece, r.length) for r in cut.collect())
    assert sum(1 for r in rows if r.doc_id == 4) == 1 and {r.length for r in rows if r.doc_id in (3, 4, 8)} == {1}
    assert packing.pack(packing.pieces(none)).count() == 0
    same = spark.range(50).select(F.lit(None).cast("long").alias("doc_id"), F.lit(40).cast("long").alias("length"), F.lit("x").alias("sequence"))
    assert check(packing.pack(same, 100).collect(), 100) == 25
    with pytest.raises(ValueError):
        packing.pack(same, 39)
