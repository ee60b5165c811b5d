"""Operators against plain versions on small tables, and on odd rows."""

import hashlib
import random
import time

from . import brute
import numpy as np
import pytest
from .conftest import SF
from pyspark.sql import functions as F

from surveyspark.llm import op1_arc_warc as arc
from surveyspark.llm import op2_decontaminate as leak
from surveyspark.llm import op3_mixing as mixing
from surveyspark.llm import op4_minhash as minhash
from surveyspark.llm import op5_edit_counts as counts
from surveyspark.llm import op6_imatch as imatch
from surveyspark.llm import op7_substrings as substrings
from surveyspark.llm import op8_pii as pii
from surveyspark.llm import op9_toxicity as toxicity
from surveyspark.llm import op10_line_dedup as lines
from surveyspark.llm.common import OWN, load
from surveyspark.llm.components import components


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def small(spark):
    return [(r.doc_id, r.text) for r in load(spark, SF, "documents").select("doc_id", "text").collect()]


# --- 1 -----------------------------------------------------------------------------------------------


def test_arc_headers_of_both_versions_and_declared_lengths():
    blocks = [b"HTTP/1.1 200 OK\r\n\r\nfirst\n\nhttp://x 1 2 3 4\n", b"", "café".encode()]
    for version in (1, 2):
        rows = [(f"http://a b/{k}", "1.2.3.4", "19970102030405", "text/html", b) for k, b in enumerate(blocks)]
        data = b"".join(p + b"\n" for p in arc.arc_file(version, iter(rows), "f.arc"))
        found = list(arc.parse_arc(data))
        assert [f[5] for f in found] == blocks and {f[0] for f in found} == {version}
        assert found[0][1] == "http://a%20b/0" and found[0][3] == "19970102030405"


def test_arc_urls_with_blanks_and_other_versions_in_one_file():
    old = b"http://a b c/ 1.2.3.4 1997 text/html 3\nabc\n"
    assert list(arc.parse_arc(old))[0][1:] == ("http://a b c/", "1.2.3.4", "1997", "text/html", b"abc")
    assert arc.iso("1997") == "1997-01-01T00:00:00Z" and arc.iso("19970102030405") == "1997-01-02T03:04:05Z"


def test_warc_record_round_trip():
    block = b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nWARC/1.0\r\n\r\n"
    data = b"".join(arc.warc_record({"WARC-Type": "response", "K": str(k)}, block) + b"\r\n\r\n" for k in range(3))
    assert [(h["K"], b) for h, b in arc.parse_warc(data)] == [(str(k), block) for k in range(3)]


def test_arc_to_warc_on_odd_pages(spark, monkeypatch):
    pages = [(3, "http://x/ y", "same"), (1, None, "same"), (2, "u", None), (5, "u", ""), (5, "u", ""), (None, "n", "same"), (7, "v", "a\r\n\r\nWARC/1.0\r\n\r\nb" * 5000)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("key", F.lit(1))
    monkeypatch.setattr(arc, "load", lambda *_: frame)
    rows = sorted(map(tuple, arc.query(spark, "").collect()), key=str)
    sha = lambda t: arc.digest((t or "").encode())
    first = {"same": 1, "": 2}
    want = [(i, len((t or "").encode()), sha(t), "revisit" if first.get(t or "", i) != i else "response", first.get(t or "", i) if first.get(t or "", i) != i else None) for i, _, t in pages]
    assert rows == sorted(want, key=str)
    monkeypatch.setattr(arc, "load", lambda *_: frame.where("false"))
    assert arc.query(spark, "").count() == 0


def test_blocks_cross_to_python_and_back_once_and_are_not_dealt_out(spark, monkeypatch):
    plans, write = [], arc.write_pieces
    monkeypatch.setattr(arc, "write_pieces", lambda df, *a: (plans.append(df._jdf.queryExecution().toString()), write(df, *a))[1])
    pages = [(k, f"http://h/{k}", f"page {k % 7}" * 50) for k in range(60)] + [(None, "n", "page 3" * 50)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5)
    monkeypatch.setattr(arc, "load", lambda *_: frame)
    found = {r.page_id: (r.record_type, r.refers_to, r.payload_digest) for r in arc.query(spark, "").collect()}
    want = {k: ("revisit" if k is None or k > 6 else "response", 3 if k is None else k % 7 if k > 6 else None, arc.digest(t.encode())) for k, _, t in pages}
    assert found == want
    physical = [p.split("== Physical Plan ==")[1] for p in plans]
    assert [p.count("MapInArrow") for p in physical] == [1, 1] and "block" not in "".join(physical)


def test_pieces_are_handed_on_by_size(monkeypatch):
    monkeypatch.setattr(arc, "HANDED", 10)
    pieces = [b"abcd"] * 7 + [b"", b"x" * 30]
    batches = [b.column(0).to_pylist() for b in arc._handed(pieces)]
    assert [len(b) for b in batches] == [3, 3, 3] and [p for b in batches for p in b] == pieces and not list(arc._handed([]))


# --- 2 -----------------------------------------------------------------------------------------------


def test_alignment_scores():
    r = random.Random(1)
    for _ in range(30):
        item, text = ([r.randint(0, 5) for _ in range(n)] for n in (r.randint(3, 12), r.randint(1, 40)))
        score, a, b = leak.align(np.array(item), np.array(text))
        assert score == brute.align(item, text) / (2 * len(item))
        assert score == 0 or brute.align(item, text[a : b + 1]) == brute.align(item, text)


def test_leaks_are_all_that_alignment_finds(spark):
    docs, items = small(spark), [(r.item_id, r.text) for r in load(spark, SF, "benchmark").collect()][:20]
    want = set()
    for d, t in docs:
        w = brute.letters(t)
        for i, x in items:
            v = brute.letters(x)
            if len(set(v) & set(w)) * 3 > len(set(v)) and len(w) < 1500 and brute.align(v, w) >= leak.THRESHOLD * 2 * len(v):
                want.add((d, i))
    found = leak.leaks(texts(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    short = {d for d, t in docs if len(brute.letters(t)) < 1500}
    assert {(r.doc_id, r.item_id) for r in found if r.doc_id in short} == want


def test_edited_and_reordered_copies(spark, odd, none):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = passage.split()
    edited = " ".join(w[:5] + ["NEW"] + w[6:11] + w[12:])
    docs = texts(spark, [(1, f"start {passage.upper()}, end"), (2, "x " * 50 + edited), (3, "nothing of the kind"), (4, " ".join(w[::-1])), (None, passage), (5, None)])
    items = spark.createDataFrame([(9, passage), (9, passage), (8, "too short"), (None, "one two three four five six seven")], "item_id long, text string")
    found = leak.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 9), (2, 9), (None, 9)} and len(found) == 3
    assert [(r.start_word, r.end_word) for r in found if r.doc_id == 1] == [(1, 20)]
    assert {r.doc_id for r in leak.clean_rows(docs, items).collect()} == {3, 4, 5}
    assert leak.clean_rows(odd, items).count() == odd.count() and leak.leaks(none, items).count() == 0
    assert leak.leaks(docs, items.where("false")).count() == 0


@pytest.mark.parametrize("exact", [0, 1, 40])
def test_copies_with_edits_spread_over_them(spark, exact):
    passage = [f"w{k}" for k in range(40)]
    edits = {n: " ".join(f"new{k}" if k % n == n - 1 else w for k, w in enumerate(passage)) for n in (4, 5, 6)}
    docs = texts(spark, [(n, f"before {t} after") for n, t in edits.items()] + [(100 + k, " ".join(passage)) for k in range(exact)])
    items = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    found = {r.doc_id: r.score for r in leak.leaks(docs, items).collect()}
    assert set(found) == {4, 5, 6} | {100 + k for k in range(exact)}
    assert all(found[n] == brute.align(passage, t.split()) / 80 for n, t in edits.items())


def test_clean_rows_of_a_shared_id_stay(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    docs = texts(spark, [(None, f"{passage} end"), (None, "clean words"), (None, None), (1, passage), (1, "clean too"), (1, passage)])
    items = spark.createDataFrame([(9, passage)], "item_id long, text string")
    found = leak.clean_rows(docs, items)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(None, "clean words"), (None, None), (1, "clean too")], key=str)


# --- 3 -----------------------------------------------------------------------------------------------


def test_mix_equals_plain_queueing(spark):
    docs = [(r.doc_id, r.source, r.text) for r in load(spark, SF, "documents").collect()] + [(10_000, None, "a b c"), (10_001, None, None), (10_002, "zz", "")]
    found = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string")).collect()
    want = brute.mix(docs)
    assert {r.doc_id: (r.size, pytest.approx(r.target), r.taken) for r in found} == want
    by = {}
    for r in found:
        by.setdefault(r.source, [r.target, 0, 0])
        by[r.source][1] += r.taken
        by[r.source][2] = max(by[r.source][2], r.size)
        assert r.taken <= 2 * r.size
    assert all(abs(t - n) <= 2 * most + 1 for t, n, most in by.values())


def test_mix_on_odd_rows(spark, odd, none, monkeypatch):
    assert mixing.mix(odd).count() == odd.count() and mixing.mix(none).count() == 0
    first = sorted(map(str, mixing.mix(odd).collect()))
    monkeypatch.setattr(mixing, "RANGE_ROWS", 1)
    assert sorted(map(str, mixing.mix(odd.repartition(3)).collect())) == first


# --- 4 -----------------------------------------------------------------------------------------------


def found_components(docs, n):
    return {r[f"{OWN}id"]: r.component_id for r in minhash.near_duplicates(docs, n).collect()}


def test_components_of_links(spark):
    r = random.Random(2)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(40)] + [(k, k + 1) for k in range(100, 140)]
    found = {x.node: x.root for x in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {k: k for p in pairs for k in p}
    for _ in range(200):
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {k: v for k, v in root.items() if k != v}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_equal_exact_ones(spark, n):
    docs = small(spark)
    assert found_components(texts(spark, docs), n) == brute.components(docs, n, 80)


def test_group_of_edited_copies_with_texts_at_the_threshold(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{k}" for k in range(80)]
    docs = []
    for i in range(160):
        w = list(base)
        for _ in range(r.choice([0, 2, 4, 6, 7])):
            del w[r.randrange(len(w))]
        docs.append((i, " ".join(w)))
    monkeypatch.setattr(minhash, "BLOCK", 20)
    assert found_components(texts(spark, docs), 2) == brute.components(docs, 2, 80)


def test_near_duplicates_on_odd_rows(odd, none):
    rows = [(r[f"{OWN}id"], r.n_shingles, r.component_id) for r in minhash.near_duplicates(odd, 2).collect()]
    assert sorted(rows, key=str) == sorted([(1, 11, 1), (1, 11, 1), (2, 11, 1), (2, 5, 2), (3, 0, 3), (4, 0, 4), (None, 6, None), (None, 0, None), (5, 1, 5), (6, 2, 6), (7, 1, 7), (8, 0, 8)], key=str)
    kept = minhash.kept_rows(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 1
    assert minhash.near_duplicates(none).count() == 0 and minhash.kept_rows(none).count() == 0


def test_one_row_of_each_group_stays(spark):
    near = [" ".join(f"w{k}" for k in range(n)) for n in (60, 61, 62)]
    other, repeated = "five words that stand alone", "one more text that comes again"
    docs = texts(spark, [(None, near[0]), (None, near[1]), (None, near[1]), (None, near[2]), (None, other), (3, repeated), (3, repeated), (None, repeated), (4, None), (None, "")])
    found = minhash.kept_rows(docs, repeats=False)
    rows = [tuple(r) for r in found.collect()]
    assert found.columns == docs.columns and len(rows) == 5
    assert sum(t in near for _, t in rows) == 1 and [i for i, t in rows if t == repeated] == [3]
    assert {(None, other), (4, None), (None, "")} <= set(rows)


# --- 5 -----------------------------------------------------------------------------------------------


def test_tree_counts_follow_edits(spark):
    count, r = counts.counter(), random.Random(4)
    for text in [t for _, t in small(spark)][:80] + ["", " ", "x" * 3000, "a b " * 400, "don't 's  s \n\n x" * 40]:
        parts = counts.leaves(text)
        tree = counts.Tree([len(p) for p in parts], [count(p) for p in parts])
        assert "".join(parts) == text and tree.tokens[1] == count(text)
        for _ in range(2):
            edits = [(a := r.randint(0, len(text)), a + r.choice([0, 1, 5, 400]), r.choice(["", " ", "a", "'s", "\n\n", " new words", "z" * 50, " lots of" * 200])) for _ in range(r.randint(0, 4))]
            want, at = [], 0
            for a, b, new in counts.ordered(edits, len(text)):
                want, at = [*want, text[at:a], new], b
            want = "".join(want) + text[at:]
            text, tree, _ = counts.apply(text, tree, edits, count)
            assert text == want and tree.tokens[1] == count(want) and tree.chars[1] == len(want)


def test_edit_counts_of_tables(spark, odd, none):
    count = counts.counter()
    rows = counts.edited(counts.three_edits(counts.count_trees(odd.select("doc_id", "text")))).collect()
    assert len(rows) == odd.count()
    assert all(r.edited_n_tokens == count(r.text) and r.edited_n_chars == len(r.text) for r in rows)
    assert max(rows, key=lambda r: len(r.text)).reencoded_chars < 3000
    edits = none.sparkSession.createDataFrame([(1, 0, 3, "THE"), (None, None, None, None), (5, 2, 99, "x")], "doc_id long, start int, stop int, text string")
    found = counts.edited(counts.with_edits(counts.count_trees(odd), edits)).collect()
    assert {r.text for r in found if r.doc_id == 5} == {"wox"} and [r.text[:9] for r in found if r.doc_id == 1] == ["THE quick"] * 2
    assert counts.edited(counts.three_edits(counts.count_trees(none))).count() == 0


# --- 6 -----------------------------------------------------------------------------------------------


def test_fingerprints_and_next_documents(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_ROWS", 20)
    docs = small(spark) + [(10_000, None), (10_001, "")]
    found = {r.doc_id: r for r in imatch.compared_with_next(texts(spark, docs).repartition(5)).collect()}
    order = sorted(docs, reverse=True)
    near, far = [], []
    for (i, t), (j, nxt) in zip(order, order[1:] + order[:1], strict=True):
        t, nxt, r = t or "", nxt or "", found[i]
        half = len(t) // 2
        changed = t[: len(t) - half] + nxt[:half]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1) >= (t == nxt)
        near.append(r.near_edited)
        far.append(r.near_next)
        assert all((found[i].fingerprint == found[k].fingerprint) >= ((u or "") == t) for k, u in docs)
    assert sum(near) > 2 * sum(far)


def test_fingerprints_on_odd_rows(odd, none):
    assert imatch.compared_with_next(odd).count() == odd.count() and imatch.compared_with_next(none).count() == 0
    one = imatch.compared_with_next(odd.where("doc_id = 5")).first()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"wowo").hexdigest()


# --- 7 -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "gram", "hot"), [(200, 64, 10_000), (40, 16, 2)])
def test_repeated_strings(spark, monkeypatch, length, gram, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "PIECE", 5000)
    r = random.Random(5)
    shared = ["".join(r.choice("ab é") for _ in range(n)) for n in (39, 40, 41, 199, 200, 201, 500)]
    odd = [(20_000 + k, r.choice(["", "x"]) + s + r.choice(["", "yy"])) for k, s in enumerate(shared * 2)] + [(30_000, "ab" * 300), (30_001, "z" * 450), (30_002, None), (30_003, "")]
    docs = small(spark)[:80] + odd
    rows = substrings.without_repeats(texts(spark, docs), length, gram).collect()
    found = {x.doc_id: tuple(x[f"{OWN}{c}"] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for x in rows}
    assert found == brute.repeats(docs, length)


def test_repeated_strings_on_odd_rows(odd, none):
    rows = substrings.without_repeats(odd)
    assert rows.count() == odd.count() and rows.columns[: len(odd.columns)] == odd.columns
    assert {r[f"{OWN}n_removed"] for r in rows.where("doc_id = 7").collect()} == {70_000}
    assert substrings.without_repeats(none).count() == 0


def test_one_body_of_each_context_is_compared(spark, monkeypatch):
    kept, keep = {}, substrings.stored
    monkeypatch.setattr(substrings, "stored", lambda df, label: kept.setdefault(label, keep(df, label)))
    # So small a bitmap that much is let through by chance.
    monkeypatch.setattr(substrings, "BITMAP_BITS", 10)
    r = random.Random(7)
    a, b, c = ("".join(r.choice("abcdefgh ") for _ in range(300)) for _ in range(3))
    docs = [(k, a + b) for k in range(30)] + [(None, a + b)] * 30 + [(100, a + c), (101, c[:150] + b)]
    rows = substrings.without_repeats(texts(spark, docs)).collect()
    found = {x.doc_id: tuple(x[f"{OWN}{c}"] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for x in rows}
    assert found == brute.repeats(docs[:31] + docs[-2:], 200)
    bodies = {x.key: x["count"] for x in kept["bodies"].groupBy("key").count().collect()}
    contexts = {x.key: x.contexts for x in kept["contexts"].where("contexts > 1").select("key", "contexts").distinct().collect()}
    assert contexts and bodies == contexts


# --- 8 -----------------------------------------------------------------------------------------------

PRIVATE = [
    "mail a.b+c@x-y.org, then d@e and f@g.h.i@j.k_l@m.n end",
    "1.2.3.4 and 1.2.3.4.5.6.7.8.9 and 256.1.1.1 and 001.02.3.0255 é 9.9.9",
    "4111 1111 1111 1111 and 4111-1111-1111-1112; 4111111111111111  4111111111111111",
    "+1 (456) 555-2186, +12, +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7, ++49 30 1234567- x",
    "1 " * 3000 + "4111111111111111 " * 400, "a" * 30_000 + "@" + "b." * 2000 + "c", "1." * 3000, "+1" * 2000, "@", "", None, "9" * 5000,
]


def test_personal_data(spark, odd, none):
    docs = small(spark) + [(10_000 + k, t) for k, t in enumerate(PRIVATE)]
    rows = pii.find(texts(spark, docs)).select("doc_id", pii.written("base").alias("base"), pii.written("all").alias("every")).collect()
    assert {r.doc_id: r.base for r in rows} == {i: ",".join(brute.private(t)) for i, t in docs}
    assert all(set(filter(None, r.base.split(","))) <= set(r.every.split(",")) for r in rows)
    assert pii.find(odd).count() == odd.count() and pii.find(none).count() == 0


# --- 9 -----------------------------------------------------------------------------------------------


def labelled(spark):
    r = random.Random(6)
    calm, rude = [f"calm{k}word" for k in range(200)], ["hatefulness", "despicable", "vermin"]
    rows = []
    for i in range(600):
        w = [r.choice(calm) for _ in range(60)]
        if i % 6 == 0:
            for _ in range(3):
                w[r.randrange(60)] = r.choice(rude)
        rows.append((i, " ".join(w)))
    return texts(spark, rows), spark.createDataFrame([(i, int(i % 6 == 0), 1) for i, _ in rows], "doc_id long, toxic int, quality int")


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    rows = toxicity.scored(docs.withColumn("out", toxicity.held_out(F.col("doc_id"))), labels).join(labels, "doc_id").where("out").collect()
    right = [(r[f"{OWN}score"] >= 0.5) == (r.toxic == 1) for r in rows]
    assert len(right) > 80 and sum(right) >= 0.97 * len(right)
    changed = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    again = {r.doc_id: r[f"{OWN}score"] for r in toxicity.scored(docs, changed).collect()}
    assert all(again[r.doc_id] == r[f"{OWN}score"] for r in rows), "held-out labels were learnt"


def test_toxicity_on_odd_rows(spark, odd, none):
    docs, labels = labelled(spark)
    bad = labels.union(spark.createDataFrame([(None, 1, 1), (3, None, 1)], labels.schema))
    assert toxicity.scored(odd, bad).count() == odd.count() and toxicity.scored(none, bad).count() == 0
    assert toxicity.ordinary_rows(odd, labels.where("false")).count() == odd.count()
    assert toxicity.windows(None) == [b" "] and b"".join(toxicity.windows("A b\nC" * 500)) == b" " + b"a b c" * 500


# --- 10 ----------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    long = "a line of just ten words that is there again"
    docs = small(spark) + [(10_000, f"{long}\nx\n{long}"), (10_001, "p\nq\nr\ns\n\n\n\n"), (10_002, "o\np\nq\nr\ns"), (10_003, "same\n" * 50), (10_004, None), (10_005, ""), (None, f"{long}\nnew")]
    found = {r.doc_id: r.text for r in lines.dedup_lines(texts(spark, docs)).collect()}
    assert found == brute.lines_left(docs, lines.MIN_LINES, lines.MIN_WORDS)


def test_line_dedup_on_odd_rows(odd, none):
    rows = lines.dedup_lines(odd)
    assert rows.count() == odd.count() and rows.columns[: len(odd.columns)] == odd.columns
    assert {r.text for r in rows.where("doc_id = 1").collect()} == {"the quick brown fox jumps over the lazy dog again and again"}
    assert [r.text for r in rows.where("doc_id = 2 and source = 'b'").collect()] == [""]
    assert lines.dedup_lines(none).count() == 0


def test_many_lines_in_one_text_cost_no_square(spark):
    def spent(n):
        body = "\n".join(f"line {k % (n // 2)} of the text" for k in range(n))
        start = time.time()
        left = lines.dedup_lines(texts(spark, [(1, body), (2, "other")])).where("doc_id = 1").first()["text"]
        assert left == "\n".join(f"line {k} of the text" for k in range(n // 2))
        return time.time() - start

    spent(100)
    few, many = spent(20_000), spent(160_000)
    assert many < 24 * few + 5, (few, many)
