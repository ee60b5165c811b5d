"""Conversation prefix trie against dictionaries of prefixes."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from surveyspark.llm import op13_trie as trie

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def plain(rows):
    """{(conv_id, depth): (parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)}."""

    def digest(role, text):
        return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()

    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, digest(role or "", text or ""), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        built[c] = tuple(turns) if base == c else tuple(own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, {}
    for p in sorted(members, key=len, reverse=True):
        under = children.get(p, [])
        leaves[p] = sum(leaves[c] for c in under) if under else 1
        saved[p] = sum(saved[c] for c in under) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(built[c]) == len(p))
        out[min(members[p]), len(p)] = (min(members[p[:-1]]) if p else None, len(members[p]), len(under), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest())
    return out


def check(spark, rows):
    df = trie.trie(frame(spark, rows))
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len({r[:2] for r in found})
    assert {r[:2]: r[2:] for r in found} == plain(rows)


def talk(conv, turns):
    return [(conv, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(turns)]


@pytest.mark.parametrize("block", [4, 50_000])
def test_shared_prefixes_and_copies(spark, monkeypatch, block):
    monkeypatch.setattr(trie, "BLOCK", block)
    monkeypatch.setattr(trie, "CHUNK", 3)
    deal = random.Random(block)
    rows = []
    for c in [*range(-6, 30), 1 << 60, (1 << 60) + 1]:
        rows += talk(c, [deal.choice(("é", "b", "")) for _ in range(deal.randint(1, 6))])
    for c in range(100, 130):
        rows += talk(c, ["the same", "conversation", "again"])
    deal.shuffle(rows)
    check(spark, rows)


def test_hot_parent_and_a_deep_conversation(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 16)
    rows = [r for c in range(0, 300, 5) for r in talk(c, ["start", f"own {c}"])]
    rows += talk(1000, [f"turn {k}" for k in range(150)]) + talk(1001, [f"turn {k}" for k in range(150)])
    check(spark, rows)


def test_nulls_ties_and_repeated_rows(spark):
    rows = [(5, None, "user", "first"), (5, None, None, None), (5, 1, "user", "a"), (5, 1, "user", "a"), (5, 1, "user", None), (5, 1, "", "usera"), (6, 3, "x", "y"), (7, 0, "us", "era"), (7, 0, "user", "a"), (None, 0, "user", "nobody"), (8, 2, None, "")]
    check(spark, rows)
    extra = frame(spark, rows).selectExpr("*", "1 as conv", "2 as number", "3 as block", "4 as x")
    assert trie.trie(extra).count() == len(plain(rows))
    assert trie.trie(frame(spark, rows).where("false")).count() == 0
    assert trie.trie(frame(spark, rows).where("conv_id IS NULL")).count() == 0


def test_turnless_conversations_belong_to_the_root(spark):
    # Base 10 is absent: who drops as many turns as it has is left without any.
    rows = [r for c in range(11, 15) for r in talk(c, ["only"])]
    check(spark, rows)
    check(spark, talk(10, ["a", "b"]) + rows)


def test_runs_join_arcs_within_a_block():
    deal = np.random.default_rng(1)
    for n in (1, 2, 50, 1000):
        tour = deal.permutation(n)
        following = np.full(n, -1)
        following[tour[:-1]] = tour[1:]
        some = np.sort(deal.choice(n, max(1, n // 2), replace=False))
        head, place, length, after = trie.joined_runs(some, following[some])
        for k, arc in enumerate(some):
            at = head[k]
            for _ in range(place[k]):
                at = following[at]
            assert at == arc
            if head[k] == arc:
                for _ in range(length[k]):
                    assert at in some
                    at = following[at]
                assert after[k] == at and at not in some
