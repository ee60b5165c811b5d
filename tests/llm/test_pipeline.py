"""The pipeline against plain versions of its stages, and registered SQL against DuckDB."""

from pathlib import Path

from . import brute
import duckdb
import pytest
from .conftest import SF

import corpus_pipeline
from surveyspark.llm import op2_decontaminate, op9_toxicity, op10_line_dedup
from surveyspark.llm.common import load, stored
from surveyspark.llm.queries import QUERIES


def test_every_dealt_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline")
    assert numbers == list(range(1, 1 + len(QUERIES) - 1)) and "pipeline" in QUERIES


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    query, sql = QUERIES[name]
    df = query(spark, SF)
    answer = con.execute(sql)
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(df.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, df.select(*columns).collect()), key=key) == sorted(answer.fetchall(), key=key)


def test_pipeline_equals_plain_stages(spark):
    docs = [(r.doc_id, r.source, r.text) for r in load(spark, SF, "documents").collect()]
    items = [r.text for r in load(spark, SF, "benchmark").collect()]
    model = op9_toxicity.fit(load(spark, SF, "documents"), load(spark, SF, "labels"))
    if model:
        press = model.compressors()
        docs = [d for d in docs if model.score(op9_toxicity.np.array([model.features(d[2], press)]))[0] < 0.5]
    left = brute.lines_left([(i, t) for i, _, t in docs], op10_line_dedup.MIN_LINES, op10_line_dedup.MIN_WORDS)
    docs = [(i, s, left[i]) for i, s, t in docs if left[i] == t or brute.words(left[i])]
    root = brute.components([(i, t) for i, _, t in docs], 5, 80)
    docs = [d for d in docs if root[d[0]] == d[0]]
    passages = [brute.letters(x) for x in items]

    def leaks(text):
        w = brute.letters(text)
        return any(len(set(v) & set(w)) * 3 > len(set(v)) and brute.align(v, w) >= op2_decontaminate.THRESHOLD * 2 * len(v) for v in passages)

    docs = [d for d in docs if not leaks(d[2])]
    found = {r.doc_id: (r.size, pytest.approx(r.target), r.taken) for r in corpus_pipeline.run(spark, SF).collect()}
    assert found == brute.mix(docs)


def test_stages_keep_columns_and_odd_rows(spark, odd, none):
    for frame in (odd.withColumnRenamed("toxic", "n_chars").withColumn("n_chars", odd["size"].cast("int")), none):
        docs = frame
        for name, stage in corpus_pipeline.STAGES:
            out = stored(stage(spark, docs, SF), name)
            if name != "mixing":
                assert out.columns == docs.columns
            docs = out
        assert (docs.count() > 0) == (frame is not none)
