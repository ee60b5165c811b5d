"""Personal data: candidate spans, scored by gradient-boosted trees.

Base patterns with their checks find what is certain. High-recall generators propose more spans, which
may overlap: digits in groups, dotted numbers, spelled-out addresses. Boosted trees score them by
format (length, digits, groups, brackets, largest part) and context (neighbouring characters, a telling
word before). They learn from all candidates of all documents whether a base span is there, but not
by the base's own rule: features are taken from a form of the span in which a leading plus, the kind of
separator and the check digit do not show and [at] and [dot] are signs, so that a span that lacks only
the rule looks like one that has it. Features are small whole numbers, so candidates are counted by
their features first and the trees weigh each such form by its count. On a third of the documents that
the trees do not see, a threshold is calibrated for each kind: the least score from which on PRECISION
of all its candidates are right. Candidates that reach it and
overlap no base span are added; base spans always stay.

All in DataFrame functions: matches and the gaps between them give places, the trees become a CASE
expression. Patterns are anchored at the start of a run of their characters and take runs
possessively, so that they read a text once and need no stack, however long its runs are. Spans meet each
other in order of their places, so the work grows with the number of spans, not with its square.

Defined cases: a null text is empty; rows with equal ids or texts are rows of their own; documents
without candidates have no spans; with nothing to learn from nothing is added; an empty table gives an
empty result; other columns are ignored. Places are code points, the end is exclusive.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from surveyspark.llm.common import let, load, stored

KINDS = ("email", "ip", "card", "phone")
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
BASE = {
    "email": _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GENERATORS = {
    "email": _LOCAL + r"(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)*+",
    "ip": r"(?<![0-9.])[0-9]++(?:[.:][0-9]++){2,7}+",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){10,19}+",
    "phone": r"(?<![0-9])[+(]?[0-9](?:[\x20().-]{0,3}+[0-9]){5,19}+",
}
#: What a text must hold for a pattern to be tried.
NEEDS = {"email": "@", "phone": "+"}
#: Features stop at this value, so that the number of forms does not grow with the texts' length.
TOP = 63
#: Cuts of a feature that the trees weigh: more than it has values.
BINS = 128
TREES, DEPTH, STEP = 10, 3, 0.3
#: Share of base spans among the candidates from a threshold on. The others are what is sought as well as
#: what is not, so it is a lower bound of the precision, and cannot be near 1 where look-alikes are frequent.
PRECISION = 0.9
BLOCK = 256


def summed(lengths: Column) -> Column:
    """Running sums of an array, by blocks, so that the cost is not the square of its size."""
    add = lambda a, x: a + x
    part = lambda a, first, n: F.aggregate(F.slice(a, first, n), F.lit(0), add)
    number = lambda i: F.floor(i / BLOCK).cast("int")
    blocks = lambda a: F.transform(F.sequence(F.lit(0), number(F.size(a) - 1)), lambda b: part(a, b * BLOCK + 1, F.lit(BLOCK)))
    before = lambda sums: F.transform(sums, lambda _, b: part(sums, F.lit(1), b))
    inside = lambda a, upto: F.transform(a, lambda _, i: F.get(upto, number(i)) + part(a, number(i) * BLOCK + 1, i % BLOCK + 1))
    return let(lengths, lambda a: let(blocks(a), lambda sums: let(before(sums), lambda upto: inside(a, upto))))


def located(rows: DataFrame, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """`rows` with a column for each pattern: structs (start, stop, s, before, after), or null if there is no match.

    Each step is a column of its own: an expression that is used twice would be computed twice.
    """
    keep = rows.columns
    rows = rows.select(*keep, *[F.when(need, F.regexp_extract_all("text", F.lit(p), F.lit(0))).alias(f"m_{k}") for k, (p, need) in patterns.items()])
    some = {k: F.size(f"m_{k}") > 0 for k in patterns}
    rows = rows.select("*", *[F.when(some[k], F.split("text", p, -1)).alias(f"g_{k}") for k, (p, _) in patterns.items()])
    ends = {k: F.when(some[k], summed(F.zip_with(F.slice(f"g_{k}", 1, F.size(f"m_{k}")), f"m_{k}", lambda g, m: F.length(g) + F.length(m)))) for k in patterns}
    rows = rows.select("*", *[c.alias(f"e_{k}") for k, c in ends.items()])

    def spans(k: str) -> Column:
        gap = lambda i: F.get(F.col(f"g_{k}"), i)
        one = lambda s, i: F.struct((F.get(F.col(f"e_{k}"), i) - F.length(s)).alias("start"), F.get(F.col(f"e_{k}"), i).alias("stop"), s.alias("s"), F.right(gap(i), F.lit(16)).alias("before"), F.left(gap(i + 1), F.lit(1)).alias("after"))
        return F.when(some[k], F.transform(f"m_{k}", one))

    return rows.select(*keep, *[spans(k).alias(k) for k in patterns])


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    double = lambda x, i: F.when(i % 2 == 1, 2 * x - F.when(x > 4, 9).otherwise(0)).otherwise(x)
    ones = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x, i: double(F.ascii(x) - 48, i))
    return F.aggregate(ones, F.lit(0), lambda a, x: a + x) % 10 == 0


def small_parts(s: Column, sep: str) -> Column:
    """Whether all parts are numbers of at most 255."""
    value = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(s, sep), lambda p: (F.length(value(p)) < 3) | ((F.length(value(p)) == 3) & (value(p) <= "255")))


def passes(kind: str, s: Column) -> Column:
    """The check of a base match."""
    digits = F.regexp_replace(s, "[^0-9]", "")
    n = F.length(digits)
    return {"email": F.lit(True), "ip": small_parts(s, r"\."), "card": n.between(16, 19) & luhn(digits), "phone": n.between(8, 15)}[kind]


FEATURES = ("kind", "chars", "digits", "groups", "parts", "brackets", "small", "joined", "told")


def unruled(s: Column) -> Column:
    """A span without what makes it a base span: [at] and [dot] as signs, no leading plus, one kind of separator."""
    signs = F.regexp_replace(F.regexp_replace(s, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    return F.regexp_replace(F.regexp_replace(signs, r"^\+", ""), r"[\x20-]+", "-")


def features(kind: str, c: Column) -> list[Column]:
    """The FEATURES of a candidate, as doubles."""
    s, digits = unruled(c["s"]), F.regexp_replace(c["s"], "[^0-9]", "")
    joined = F.coalesce(F.right(c["before"], F.lit(1)).rlike(r'[A-Za-z0-9="_:/]'), F.lit(False)) | F.coalesce(c["after"].rlike(r'[A-Za-z0-9="_:/]'), F.lit(False))
    told = c["before"].rlike(r"(?i)(tel|phone|call|fax|mail|card|visa|address|contact|\bip\b)")
    groups = F.size(F.filter(F.split(s, "[^A-Za-z0-9]+"), lambda x: x != ""))
    # The exact length is part of a card's rule: its digits count in fours.
    n, chars = (F.ceil(F.length(digits) / 4),) * 2 if kind == "card" else (F.length(digits), F.length(s))
    values = (F.lit(KINDS.index(kind)), chars, n, groups, F.regexp_count(s, F.lit(r"\.")), s.contains("("), s.rlike("^[0-9.]+$") & small_parts(s, r"\."), joined, told)
    return [F.least(F.coalesce(v.cast("double"), F.lit(0.0)), F.lit(float(TOP))) for v in values]


def _has(kind: str) -> Column:
    return F.contains(F.col("text"), F.lit(NEEDS[kind])) if kind in NEEDS else F.col("digit")


def candidates(docs: DataFrame) -> DataFrame:
    """row, doc_id, deal, base (an array of spans a kind) and more (kind number, start, stop, known, features), one row for each document."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("deal"), F.monotonically_increasing_id().alias("row"))
    rows = rows.withColumn("digit", F.col("text").rlike("[0-9]"))
    tried = {f"base_{k}": (BASE[k], _has(k)) for k in KINDS} | {f"more_{k}": (GENERATORS[k], F.col("digit") | F.contains(F.col("text"), F.lit("@")) if k != "email" else F.col("text").rlike(r"@|[(\[]at[)\]]")) for k in KINDS}
    found = located(rows, tried)

    def certain(k: str) -> Column:
        spans = F.transform(F.filter(f"base_{k}", lambda c: passes(k, c["s"])), lambda c: F.struct(c["start"].cast("int").alias("start"), c["stop"].cast("int").alias("stop")))
        return F.coalesce(spans, F.array().cast("array<struct<start:int,stop:int>>"))

    base = {f"base_{k}": certain(k) for k in KINDS}
    found = found.withColumns(base)

    def more(k: str) -> Column:
        # In order of places a base span stands just before the candidate of the same place.
        place = lambda c, own, s: F.struct(c["start"].cast("int").alias("start"), c["stop"].cast("int").alias("stop"), F.lit(own).alias("own"), *[v.alias(n) for n, v in zip(("s", "before", "after"), s, strict=True)])
        none = [F.lit(None).cast("string")] * 3
        both = F.concat(F.transform(f"base_{k}", lambda c: place(c, 0, none)), F.transform(f"more_{k}", lambda c: place(c, 1, (c["s"], c["before"], c["after"]))))

        def told(spans: Column) -> Column:
            known = lambda c, i: F.coalesce((F.get(spans, i - 1)["own"] == 0) & (F.get(spans, i - 1)["start"] == c["start"]) & (F.get(spans, i - 1)["stop"] == c["stop"]), F.lit(False))
            return F.transform(spans, lambda c, i: F.struct(F.lit(KINDS.index(k)).alias("k"), c["start"].alias("start"), c["stop"].alias("stop"), (known(c, i) & (i > 0)).alias("known"), c.alias("c")))

        own = F.filter(let(F.array_sort(both), told), lambda c: c["c"]["own"] == 1)
        one = lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["stop"].alias("stop"), c["known"].alias("known"), F.array(*features(k, c["c"])).alias("x"))
        return F.coalesce(F.transform(own, one), F.array().cast("array<struct<k:int,start:int,stop:int,known:boolean,x:array<double>>>"))

    return found.select("row", "doc_id", "deal", *base, F.concat(*[more(k) for k in KINDS]).alias("more"))


def _case(node, x: Column) -> Column:
    """A tree as nested conditions."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(split.featureIndex())) <= float(split.threshold()), _case(node.leftChild(), x)).otherwise(_case(node.rightChild(), x))


def forms(found: DataFrame) -> DataFrame:
    """k, x, known, held and n: how many candidates there are of each kind, features, label and part."""
    every = found.where(F.size("more") > 0).select((F.pmod("deal", F.lit(3)) == 0).alias("held"), F.explode("more").alias("c"))
    return every.groupBy("held", "c.k", "c.x", "c.known").agg(F.count(F.lit(1)).alias("n"))


def scorer(counted: DataFrame):
    """A function from the feature array to the probability that a span is personal data; None if all or none are."""
    kinds = counted.agg(F.min(F.col("known").cast("int")), F.max(F.col("known").cast("int"))).first()
    if kinds[0] == kinds[1]:
        return None
    rows = counted.select(F.col("known").cast("double").alias("label"), F.col("n").cast("double").alias("weight"), *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(FEATURES)])
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=STEP, maxBins=BINS, weightCol="weight", seed=1).fit(rows)
    trees = [(w, t._java_obj.rootNode()) for w, t in zip(model.treeWeights, model.trees, strict=True)]

    def score(x: Column) -> Column:
        total = sum((F.lit(float(w)) * _case(t, x) for w, t in trees), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * total))

    return score


def thresholds(counted: DataFrame, score) -> dict[int, float]:
    """For each kind the least score from which on PRECISION of the candidates are known."""
    rows = counted.select("k", (F.floor(score(F.col("x")) * 10_000) / 10_000).alias("p"), F.when(F.col("known"), F.col("n")).otherwise(0).alias("y"), "n").groupBy("k", "p").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    down = Window.partitionBy("k").orderBy(F.desc("p"))
    rows = rows.withColumn("right", F.sum("y").over(down) / F.sum("n").over(down)).where(F.col("right") >= PRECISION)
    return {r["k"]: r["p"] for r in rows.groupBy("k").agg(F.min("p").alias("p")).collect()}


def added(found: DataFrame, score, bound: dict[int, float]) -> DataFrame:
    """(row, extra): the candidates of each document that reach their kind's threshold and overlap no base span.

    Only documents with such candidates are looked at; their spans pass in order of their starts, once
    forwards for the base spans before and once backwards for those after.
    """
    limit = F.coalesce(*[F.when(F.col("c.k") == k, F.lit(float(p))) for k, p in bound.items()], F.lit(2.0))
    likely = found.where(F.size("more") > 0).select("row", F.explode("more").alias("c")).where(score(F.col("c.x")) >= limit)
    likely = likely.select("row", F.lit(1).alias("own"), "c.k", "c.start", "c.stop").distinct()
    base = found.select("row", F.explode(F.concat(*[F.col(f"base_{k}") for k in KINDS])).alias("b"))
    base = base.join(likely.select("row").distinct(), "row", "left_semi").select("row", F.lit(0).alias("own"), F.lit(-1).alias("k"), "b.start", "b.stop")
    up = Window.partitionBy("row").orderBy("start", "own", "stop", "k").rowsBetween(Window.unboundedPreceding, -1)
    down = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("own"), F.desc("stop"), F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    certain = lambda c: F.when(F.col("own") == 0, F.col(c))
    spans = likely.unionByName(base).withColumns({"ended": F.max(certain("stop")).over(up), "begins": F.min(certain("start")).over(down)})
    free = (F.coalesce("ended", "start") <= F.col("start")) & (F.coalesce("begins", "stop") >= F.col("stop"))
    return spans.where((F.col("own") == 1) & free).groupBy("row").agg(F.collect_list(F.struct("k", "start", "stop")).alias("extra"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, and for each kind the sorted places of base_<kind> and of all_<kind>."""
    found = stored(candidates(docs), "candidates")
    counted = stored(forms(found), "forms")
    score = scorer(counted.where(~F.col("held")))
    bound = thresholds(counted.where("held"), score) if score else {}
    out = found.drop("more")
    if bound:
        out = out.join(added(found, score, bound), "row", "left")
    else:
        out = out.withColumn("extra", F.lit(None).cast("array<struct<k:int,start:int,stop:int>>"))
    extra = F.coalesce("extra", F.array().cast("array<struct<k:int,start:int,stop:int>>"))
    own = lambda i: F.transform(F.filter(extra, lambda c: c["k"] == i), lambda c: F.struct(c["start"].alias("start"), c["stop"].alias("stop")))
    return out.select("doc_id", *[f"base_{k}" for k in KINDS], *[F.array_sort(F.array_distinct(F.concat(f"base_{k}", own(i)))).alias(f"all_{k}") for i, k in enumerate(KINDS)])


def written(spans: str) -> Column:
    """kind:start:stop of the columns <spans>_<kind>, comma-joined."""
    one = lambda k: F.transform(f"{spans}_{k}", lambda c: F.concat_ws(":", F.lit(k), c["start"].cast("string"), c["stop"].cast("string")))
    return F.array_join(F.concat(*[one(k) for k in KINDS]), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find(load(spark, sf_dir, "documents"))
    return rows.select("doc_id", *[F.size(f"base_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(written("base"), 256).alias("base_sha256"), written("all").alias("spans"))
