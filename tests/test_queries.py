"""Every registered query against DuckDB at the smallest scale."""

import re
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
# The queries of the llm subpackage have tests of their own.
DEALT = re.compile(r"op\d+_|pipeline$")
QUERIES = {n: q for n, q in entry.queries().items() if not DEALT.match(n)}
ORACLES = {n: q for n, q in entry.oracle_sql().items() if not DEALT.match(n)}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def comparable(value):
    if isinstance(value, Decimal):
        value = float(value)
    return 0.0 if value == 0 and isinstance(value, float) else value


def order(row):
    return tuple((v is None, str(v)) for v in row)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) > 140


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(comparable(r[c]) for c in columns) for r in df.collect()]
    answer = duck.execute(ORACLES[name])
    names = [c[0] for c in answer.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = [tuple(comparable(r[i]) for i in at) for r in answer.fetchall()]
    assert sorted(got, key=order) == sorted(expected, key=order)
    assert got, "no rows"


def test_entry(spark):
    assert entry.entry(spark).columns == ["MES_REF", "regiao", "pct_sintoma_gripal"]
