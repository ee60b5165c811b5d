import pytest
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.functions import columns as C
from tests.conftest import rows


def one(spark, value, kind, expression):
    df = spark.createDataFrame([(value,)], f"x {kind}")
    return df.select(expression.alias("y")).first()["y"]


@pytest.mark.parametrize(
    "text, expected",
    [("12", 12), (" 7 ", 7), ("1.5", 1), ("-3.9", -3), ("abc", None), ("", None), (None, None),
     ("99999999999", None), ("011", 11)],
)
def test_permissive_integer(spark, text, expected):
    assert one(spark, text, "string", C.to_int("x")) == expected


@pytest.mark.parametrize("age, band", [(0, "00-17"), (17, "00-17"), (18, "18-29"), (29, "18-29"),
                                       (30, "30-44"), (59, "45-59"), (74, "60-74"), (75, "75+"),
                                       (120, "75+"), (None, "75+")])
def test_bands(spark, age, band):
    assert one(spark, age, "int", C.band("x")) == band
    expected = None if age is None else band
    assert one(spark, age, "int", C.band("x", null_policy="null")) == expected


@pytest.mark.parametrize("month, phase", [(5, "Inicio da Pandemia"), (8, "Pico da Primeira Onda"),
                                          (11, "Desaceleracao"), (None, "Desaceleracao")])
def test_phases(spark, month, phase):
    assert one(spark, month, "int", C.phase("x")) == phase


def test_lookup_misses_are_null(spark):
    for value, expected in (("a", "A"), ("z", None), (None, None)):
        assert one(spark, value, "string", C.lookup("x", {"a": "A"})) == expected
    assert one(spark, "a", "string", C.lookup("x", {})) is None
    assert one(spark, "Bahia", "string", C.map_hierarchy("x")) == "Nordeste"
    assert one(spark, "Lisboa", "string", C.map_hierarchy("x")) is None
    assert one(spark, "b", "string", C.ordinal("x", ["a", "b"])) == 2
    assert one(spark, "c", "string", C.ordinal("x", ["a", "b"])) is None


def test_all_states_have_one_region():
    states = [s for group in V.REGIONS.values() for s in group]
    assert len(states) == len(set(states)) == 27


@pytest.mark.parametrize(
    "worked, away, looked, status",
    [("Sim", None, None, "Ocupado - trabalhou"), ("Não", "Sim", None, "Ocupado - afastado"),
     ("Não", "Não", "Sim", "Desocupado"), ("Não", "Não", "Não", "Fora da forca de trabalho"),
     ("Não", "Não", None, "Nao se aplica"), ("Não", None, "Sim", "Nao se aplica"),
     (None, "Sim", "Sim", "Nao se aplica"), ("Ignorado", "Sim", "Sim", "Nao se aplica")],
)
def test_labour_status(spark, worked, away, looked, status):
    df = spark.createDataFrame(
        [(worked, away, looked)], f"{V.WORKED} string, {V.AWAY} string, {V.LOOKED} string"
    )
    assert df.select(C.labour_status()).first()[0] == status


@pytest.mark.parametrize(
    "a, b, absent, unknown",
    [("Sim", "Sim", "ab", "ab"), ("Sim", "Não", "a", "a"), ("Não", "Sim", "b", "b"),
     ("Não", "Não", "0", "0"), ("Sim", None, "a", "0"), (None, "Sim", "b", "0"),
     (None, None, "0", "0")],
)
def test_overlap_policies(spark, a, b, absent, unknown):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    labels = ("ab", "a", "b", "0")
    got = df.select(*[C.overlap_groups("a", "b", labels, null_policy=p) for p in ("absent", "unknown")])
    assert tuple(got.first()) == (absent, unknown)


def test_flags_treat_null_as_no(spark):
    df = spark.createDataFrame([("Sim", None), (None, None), ("Não", "Sim"), ("Sim", "Sim")], "a string, b string")
    assert rows(df.select(C.any_of(["a", "b"]), C.count_of(["a", "b"]))) == [(1, 1), (0, 0), (1, 1), (1, 2)]
    assert df.select(C.any_of([]), C.count_of([])).first() == (0, 0)
    assert [one(spark, x, "double", C.positive_flag("x")) for x in (1.0, 0.0, -1.0, None)] == [1, 0, 0, 0]


def test_income_change(spark):
    df = spark.createDataFrame([(50.0, 80.0), (80.0, 80.0), (None, 80.0)], "e double, u double")
    assert rows(df.select(*C.income_change("e", "u"))) == [(-30.0, 1), (0.0, 0), (None, 0)]


def test_missing_codes(spark):
    assert [one(spark, x, "int", C.missing_codes_to_null("x", [9, 99])) for x in (1, 9, 99, None)] == [
        1, None, None, None]


def test_populations_round_half_to_even(spark):
    assert [one(spark, x, "double", C.round_population("x")) for x in (0.5, 1.5, 2.5, 2.51)] == [0, 2, 2, 3]


def test_unknown_policies_are_refused():
    for call in (lambda: C.band(F.col("x"), null_policy="?"), lambda: C.overlap_groups("a", "b", null_policy="?"),
                 lambda: C.safe_ratio(F.lit(1), F.lit(1), empty="?"), lambda: C.band("x", (1,), ("a",))):
        with pytest.raises(ValueError):
            call()
