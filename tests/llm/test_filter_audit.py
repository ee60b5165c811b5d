"""Filter interaction audit against counting every order by itself."""

import random
from itertools import permutations

import pytest
from .conftest import SF

from surveyspark.llm import op11_filter_audit as audit
from surveyspark.llm.common import load


def plain(counts, names):
    """Every order and step by filtering the masks one filter after the other."""
    out = {}
    for order in permutations(range(len(names))):
        left = dict(counts)
        for step, bit in enumerate(order, 1):
            gone = {m: w for m, w in left.items() if m >> bit & 1}
            left = {m: w for m, w in left.items() if not m >> bit & 1}
            total = lambda part, i: sum(w[i] for w in part.values())
            fails = sum(w[0] for m, w in counts.items() if m >> bit & 1)
            alone = counts.get(1 << bit, (0, 0, 0))[0]
            out["".join(names[b] for b in order), step] = (total(left, 0), total(gone, 0), fails - total(gone, 0), alone, total(gone, 1), total(gone, 2))
    return out


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
def test_every_order_equals_plain_counting(k):
    deal = random.Random(k)
    names = "ABCDE"[:k]
    for density in (0.0, 0.3, 1.0):
        counts = {m: (n := deal.randint(1, 50), deal.randint(0, n), deal.randint(0, n)) for m in range(1 << k) if deal.random() < density}
        expected = plain(counts, names)
        found = {row[:2]: row[2:] for row in audit.audit_rows(counts, names)}
        assert {key: row[:6] for key, row in found.items()} == expected
        for letter in names:
            total = sum(row[1] for (order, step), row in expected.items() if order[step - 1] == letter)
            assert {row[6] for (order, step), row in found.items() if order[step - 1] == letter} == {total}


def test_a_swap_keeps_names_above_and_shares_equal_branches():
    diagram = audit.Diagram({m: (1,) for m in range(32)}, 5)
    assert [len(level) for level in diagram.levels] == [1, 1, 1, 1, 1]
    diagram = audit.Diagram({m: (m,) for m in range(32)}, 5)
    above = [dict(level) for level in diagram.levels[:2]]
    nodes = set(diagram.levels[2])
    diagram.swap(2)
    assert diagram.levels[:2] == above and set(diagram.levels[2]) == nodes and diagram.order == [0, 1, 3, 2, 4]
    diagram.swap(2)
    assert diagram.order == [0, 1, 2, 3, 4] and diagram.weights[diagram.root] == (sum(range(32)),)


def test_plain_changes_lead_through_every_order():
    for k in range(1, 6):
        order = list(range(k))
        seen = {tuple(order)}
        for level in audit.plain_changes(k):
            order[level], order[level + 1] = order[level + 1], order[level]
            seen.add(tuple(order))
        assert seen == set(permutations(range(k)))


def test_odd_rows(spark, odd, none):
    docs = odd.withColumnRenamed("lines", "lang").drop("toxic")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    counts = {(r.part, r.mask): (r.n, r.good, r.toxic) for r in audit.mask_counts(docs, labels).collect()}
    # 1 stands twice with the smallest id, 2 repeats its text; 3 and 4 are empty, and so is the null id's row.
    short = {1: 1, 2: 1 | 16, 5: 1}
    assert sum(n for n, _, _ in counts.values()) == docs.count()
    assert counts["lines", short[2]] == (3, 0, 0) and counts["lines", 1][1:] == (2, 2)
    assert counts["lines", 2] == (1, 0, 1)
    rows = audit.audit(audit.mask_counts(docs.withColumn("lang", docs.lang.substr(9, 1)), labels), "ABCDE").collect()
    assert {r.part for r in rows} == {""} and len(rows) == 600
    assert audit.audit(audit.mask_counts(none.withColumnRenamed("lines", "lang"), labels), "ABCDE").count() == 0


def test_other_filters_and_parts(spark):
    docs, labels = load(spark, SF, "documents"), load(spark, SF, "labels")
    counts = audit.mask_counts(docs, labels, lambda: {"L": audit.F.length("text") > 1000, "N": audit.F.col("text").rlike("[0-9]")}, "source")
    rows = audit.audit(counts, "LNE").collect()
    parts = docs.select(audit.F.coalesce("source", audit.F.lit(""))).distinct().count()
    assert len(rows) == parts * 18 and {r.filter_order for r in rows} == {"".join(p) for p in permutations("LNE")}
    first = {(r.part, r.filter_order): r.kept + r.removed for r in rows if r.step == 1}
    assert sum(n for (_, order), n in first.items() if order == "NEL") == docs.count()
