import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark.sources import microdata as MD
from tests.conftest import PEOPLE, rows, write_csv


def test_every_column_is_text_and_latin1_is_decoded(spark, survey_files):
    df = MD.read_microdata(spark, str(survey_files / "survey_092020.csv"))
    assert {t for _, t in df.dtypes} == {"string"}
    assert df.first()["NOTA"] == "não documentada"
    assert df.where(F.col("C002").isNull()).count() == 2  # blank cells are null


def test_periods_are_found_and_strays_skipped(spark, survey_files):
    found = MD.discover_periods(spark, f"{survey_files}/*.csv*")
    assert [f.period for f in found] == ["2020-09", "2020-10", "2020-10", "2020-11"]
    assert [f.compressed for f in found] == [False, False, True, False]


def test_no_file_is_an_error(spark, survey_files, tmp_path):
    with pytest.raises(FileNotFoundError):
        MD.discover_periods(spark, f"{survey_files}/leia*.csv")
    with pytest.raises(FileNotFoundError):
        MD.discover_periods(spark, f"{tmp_path}/nothing*.csv")


def test_plain_file_wins_over_gzip(spark, survey_files):
    kept, ignored = MD.dedupe_period_files(MD.discover_periods(spark, f"{survey_files}/*.csv*"))
    assert [f.period for f in kept] == ["2020-09", "2020-10", "2020-11"]
    assert not any(f.compressed for f in kept)
    assert [(f.period, f.compressed) for f in ignored] == [("2020-10", True)]


def test_gzip_alone_is_read(spark, survey_files):
    found = [f for f in MD.discover_periods(spark, f"{survey_files}/*.gz")]
    df = MD.read_periods(spark, found, spread=3)
    assert df.count() == len(PEOPLE)
    assert df.rdd.getNumPartitions() == 3


def test_drifting_columns_align_by_name(raw):
    # The inserted column shifts every later one; values must still be under their names.
    got = rows(raw.groupBy("MES_REF").agg(F.max("A006A"), F.max("C007"), F.count("*")), "MES_REF")
    assert got == [("2020-09", None, "4", 5), ("2020-10", None, "4", 5), ("2020-11", "1", "4", 5)]


def test_months_of_one_layout_share_a_scan_and_filters_prune_files(spark, survey_files, raw):
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2  # two layouts, three months
    one = raw.where(F.col("MES_REF") == "2020-10")
    assert one.count() == len(PEOPLE)
    files = one.select(F.input_file_name().alias("f")).distinct().collect()
    assert [r["f"].rsplit("/", 1)[-1] for r in files] == ["survey_102020.csv"]
    assert one._jdf.queryExecution().executedPlan().toString().count("DataFilters: [(regexp") >= 1


def test_same_result_as_one_union_branch_per_month(spark, survey_files, raw):
    kept, _ = MD.dedupe_period_files(MD.discover_periods(spark, f"{survey_files}/*.csv*"))
    union = MD.union_periods([(f.period, MD.read_microdata(spark, f.path)) for f in kept])
    columns = sorted(raw.columns)
    assert sorted(map(str, rows(union.select(columns)))) == sorted(map(str, rows(raw.select(columns))))


def test_a_header_that_does_not_match_the_schema_fails(spark, tmp_path):
    write_csv(tmp_path / "survey_012021.csv", ["a", "b"], [["1", "2"]])
    schema = T.StructType([T.StructField(c, T.StringType()) for c in ("b", "a")])
    with pytest.raises(Exception, match="header does not conform"):
        MD.read_microdata(spark, str(tmp_path / "survey_012021.csv"), schema=schema).collect()


def test_month_as_a_folder_of_part_files(spark, tmp_path):
    spark.range(10).selectExpr("cast(id as string) id").repartition(3).write.option(
        "header", True
    ).csv(str(tmp_path / "survey_052021.csv"))
    found = MD.discover_periods(spark, f"{tmp_path}/survey_*")
    assert [(f.period, f.compressed) for f in found] == [("2021-05", False)]
    assert rows(MD.read_periods(spark, found).groupBy("MES_REF").count()) == [("2021-05", 10)]


def test_two_files_of_one_month_are_both_kept():
    names = ["d/north_092020.csv", "d/south_092020.csv", "d/south_092020.csv.gz", "d/old_102020.csv.gz"]
    files = [MD.PeriodFile("2020-10" if "10" in n else "2020-09", n, n.endswith(".gz")) for n in names]
    kept, ignored = MD.dedupe_period_files(files)
    assert sorted(f.path for f in kept) == sorted(n for n in names if n != "d/south_092020.csv.gz")
    assert [f.path for f in ignored] == ["d/south_092020.csv.gz"]


@pytest.fixture(scope="module")
def uneven(tmp_path_factory):
    """Two months; the first has a line that is cut short and one that is too long."""
    root = tmp_path_factory.mktemp("uneven")
    write_csv(root / "survey_012021.csv", ["a", "b", "c"], [["1", "2", "3"], ["4", "5"], ["6", "7", "8", "9"], ["10", "", ""]])
    write_csv(root / "survey_022021.csv", ["a", "c"], [["11", "12"]])
    return root


def test_lines_that_do_not_fit_the_header_are_kept_apart(spark, uneven):
    files = MD.discover_periods(spark, f"{uneven}/*")
    good, bad = MD.split_malformed(MD.read_periods(spark, files, malformed=MD.MALFORMED))
    assert rows(good.select("MES_REF", "a", "b", "c"), "a") == [
        ("2021-01", "1", "2", "3"), ("2021-01", "10", None, None), ("2021-02", "11", None, "12"),
    ]
    assert [(r["MES_REF"], r["line"]) for r in bad.orderBy("line").collect()] == [
        ("2021-01", "4,5"), ("2021-01", "6,7,8,9"),
    ]
    assert {r["path"].rsplit("/", 1)[-1] for r in bad.collect()} == {"survey_012021.csv"}
    assert (good.count(), bad.count()) == (3, 2)


def test_malformed_lines_need_a_schema_and_a_free_name(spark, uneven):
    path = str(uneven / "survey_022021.csv")
    with pytest.raises(ValueError, match="schema"):
        MD.read_microdata(spark, path, malformed="x")
    with pytest.raises(ValueError, match="column a"):
        MD.read_microdata(spark, path, schema=T.StructType([T.StructField(c, T.StringType()) for c in ("a", "c")]), malformed="a")
