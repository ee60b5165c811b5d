"""Sums kept by month: an added month reads only its own rows, the tables equal the full run."""

import pytest
from pyspark.sql import functions as F

from bindings.panel import YEARS, dictionary, raw_microdata, regions, survey
from surveyspark import fixed_values as V
from surveyspark.operators.recode import recode
from surveyspark.plans import specs as S
from surveyspark.plans.star import build_star
from surveyspark.plans.stored_sums import StoredSums
from tests.conftest import rows

SF = "/root/testdata/sf0.001"
SPECS = [
    (S.clinical_spec, S.clinical_sums),
    (S.behaviour_spec, S.behaviour_sums),
    (S.economic_spec, S.economic_sums),
]


@pytest.fixture(scope="module")
def full(spark):
    return survey(spark, SF)


@pytest.fixture(scope="module")
def only(spark, full, tmp_path_factory):
    """The same survey with no other year than the given ones."""
    path = str(tmp_path_factory.mktemp("decoded"))
    recode(raw_microdata(spark, SF), dictionary()).write.mode("overwrite").parquet(path)

    def of(years):
        some = spark.read.parquet(path).where(F.col(V.PERIOD).isin(*years))
        return full.where(tables=build_star(some, dictionary(), regions()))

    return of


def text(df):
    return sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in rows(df))


@pytest.mark.parametrize("spec,sums", SPECS)
def test_tables_from_kept_sums_equal_the_full_run(full, only, tmp_path, spec, sums):
    store = StoredSums(str(tmp_path))
    early, late = list(YEARS[:-1]), [YEARS[-1]]
    names = store.refresh(only(early), sums, early)
    # Nothing but the added year is there to be read.
    assert store.refresh(only(late), sums, late) == names
    assert text(spec(full, store.read(full, sums))) == text(spec(full))
    some = full.where(months=late)
    assert text(spec(some, store.read(some, sums))) == text(spec(some))


def test_a_month_is_replaced_or_goes_and_others_stay(spark, full, only, tmp_path):
    store = StoredSums(str(tmp_path))
    first, second = YEARS[0], YEARS[1]

    def kept():
        return {r[V.PERIOD]: r for r in store.read(full, S.clinical_sums)["clinico"].collect()}

    store.refresh(full, S.clinical_sums, [first, second])
    before = kept()
    assert set(before) == {first, second}
    store.refresh(full, S.clinical_sums, [first])  # the same rows again are not added twice
    assert kept() == before
    store.refresh(only([second]), S.clinical_sums, [first])  # a survey without rows of the first year
    assert kept() == {second: before[second]}
    assert store.refresh(full, S.clinical_sums, []) == []


def test_definitions_that_do_not_add_up_are_refused(full, tmp_path):
    store = StoredSums(str(tmp_path))
    with pytest.raises(ValueError, match="different months"):
        store.refresh(full.where(keys=V.PANEL_KEY), S.clinical_sums, YEARS[:1])
    with pytest.raises(ValueError, match="tell months apart"):
        store.refresh(full, lambda s: {"x": s.sums("base_saude", {"w": s.weight.per_row()})}, YEARS[:1])
