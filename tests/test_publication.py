"""Publication of a whole star: versions that switch at once, and bucketed catalog tables."""

import threading

import pytest
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.operators.filters import Options, Selection
from surveyspark.operators.recode import recode
from surveyspark.plans import analyses as A
from surveyspark.plans import star as S
from surveyspark.sinks import tables
from surveyspark.sources import microdata as MD
from surveyspark.sources.tables import VERSION
from tests.conftest import rows

STAR = ["dim_tempo", "dim_perfil", "dim_localizacao", "base_saude", "base_comportamento", "base_economico", "base_trabalho"]


def content(survey):
    """Every table's rows, as text."""
    return {n: sorted(map(str, survey.tables[n].select(sorted(survey.tables[n].columns)).collect())) for n in STAR}


def months(survey):
    return {n: sorted(r[0] for r in rows(survey.tables[n].select(V.PERIOD).distinct())) for n in STAR}


def test_versions_hold_what_folders_hold(spark, labelled, dictionary, tmp_path):
    plain, base = str(tmp_path / "plain"), str(tmp_path / "versions")
    S.publish_star(labelled, dictionary, plain)
    assert S.publish_star(labelled, dictionary, base, atomic=True) == STAR
    schemas = S.star_schemas(spark, dictionary)
    expected = content(S.load_star(spark, plain, schemas))
    assert content(S.load_star(spark, base, schemas)) == expected == content(S.load_star(spark, base))
    assert VERSION not in S.load_star(spark, base).tables["base_saude"].columns


@pytest.mark.parametrize("failing", ["base_saude", "base_trabalho"])
def test_a_failing_table_leaves_all_tables_old(spark, labelled, dictionary, tmp_path, monkeypatch, failing):
    base = str(tmp_path)
    S.publish_star(labelled.where(F.col(V.PERIOD) == "2020-09"), dictionary, base, atomic=True)
    before = content(S.load_star(spark, base))
    write = S.write_version

    def broken(df, base, table, version):
        if table == failing:
            raise OSError("disk full")
        return write(df, base, table, version)

    monkeypatch.setattr(S, "write_version", broken)
    with pytest.raises(OSError):
        S.publish_star(labelled.withColumn("idade", F.lit(1)), dictionary, base, atomic=True)
    assert content(S.load_star(spark, base)) == before
    monkeypatch.undo()
    S.publish_star(labelled, dictionary, base, atomic=True)
    after = S.load_star(spark, base)
    assert set(map(tuple, months(after).values())) == {("2020-09", "2020-10", "2020-11")}
    kept = {n: [r for r in before[n] if r in content(after)[n]] for n in STAR}
    assert kept == before


def test_an_open_star_does_not_change(spark, labelled, dictionary, tmp_path):
    base = str(tmp_path)
    S.publish_star(labelled, dictionary, base, atomic=True)
    opened = S.load_star(spark, base)
    S.publish_star(labelled.where(F.col(V.PERIOD) == "2020-10"), dictionary, base, atomic=True, incremental=False)
    assert months(opened)["base_saude"] == ["2020-09", "2020-10", "2020-11"]
    assert set(map(tuple, months(S.load_star(spark, base)).values())) == {("2020-10",)}


def test_old_versions_go_and_named_ones_stay(spark, labelled, dictionary, tmp_path):
    base = str(tmp_path)
    for month in ("2020-09", "2020-10", "2020-10"):
        S.publish_star(labelled.where(F.col(V.PERIOD) == month), dictionary, base, atomic=True)
    before = content(S.load_star(spark, base))
    gone = tables.drop_old_versions(spark, base)
    assert len(gone) == len(STAR) and tables.drop_old_versions(spark, base) == []
    assert content(S.load_star(spark, base)) == before
    assert set(map(tuple, months(S.load_star(spark, base)).values())) == {("2020-09", "2020-10")}


def test_two_publications_cannot_take_one_number(spark, labelled, dictionary, tmp_path, monkeypatch):
    base = str(tmp_path)
    S.publish_star(labelled, dictionary, base, atomic=True)
    found, start = [], threading.Barrier(2)

    def publish(version):
        start.wait()
        try:
            found.append(tables.switch_manifest(spark, base, version, {"base_saude": []}))
        except FileExistsError:
            found.append(None)

    threads = [threading.Thread(target=publish, args=(v,)) for v in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    taken = [n for n in found if n]
    assert len(taken) == len(set(taken)) and tables.read_manifest(spark, base)["base_saude"]


def test_a_taken_number_is_never_replaced(spark, tmp_path, monkeypatch):
    """All publications see the same newest number and, as long as none has its name, a free next one."""
    base, all_looked = str(tmp_path), threading.Barrier(4)
    monkeypatch.setattr(tables, "_manifest_numbers", lambda *_: [])
    renamed = tables._renamed
    monkeypatch.setattr(tables, "_renamed", lambda *a: (all_looked.wait(60), renamed(*a))[1])
    won = []

    def publish(version):
        try:
            tables.switch_manifest(spark, base, version, {"t": ["p"]})
            won.append(version)
        except FileExistsError:
            pass

    threads = [threading.Thread(target=publish, args=(v,)) for v in "abcd"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.undo()
    assert len(won) == 1 and tables.read_manifest(spark, base) == {"t": {"p": won[0]}}
    assert sorted(f.name for f in (tmp_path / tables.MANIFESTS).iterdir()) == ["1.json"]


def test_a_bucketed_star_joins_without_an_exchange(spark, labelled, dictionary, tmp_path):
    base = str(tmp_path / "star")
    S.publish_star(labelled, dictionary, base, database="stardb", buckets=4)
    plain = str(tmp_path / "plain")
    S.publish_star(labelled, dictionary, plain)
    chosen = {"selection": Selection(("18-29", "30-44"), ("Mulher", "Homem")), "options": Options(V.AGE_BANDS, ("Homem", "Mulher"), tuple(V.REGIONS))}
    bucketed, folders = S.load_star(spark, database="stardb", **chosen), S.load_star(spark, plain, **chosen)
    for name, value in (("autoBroadcastJoinThreshold", "-1"), ("requireAllClusterKeysForCoPartition", "false"), ("optimizer.dynamicPartitionPruning.enabled", "false")):
        spark.conf.set(f"spark.sql.{name}", value)
    try:
        for table in (A.symptom_evolution, A.symptom_evolution_by_age, lambda s: s.fact("base_saude")):
            plan = table(bucketed)._jdf.queryExecution().executedPlan().toString()
            assert not [l for l in plan.splitlines() if "Exchange hashpartitioning" in l and "id_morador" in l], plan
            a, b = (sorted(str(r.asDict(True).items()) for r in table(s).select(sorted(table(s).columns)).collect()) for s in (bucketed, folders))
            assert a == b
    finally:
        for name in ("autoBroadcastJoinThreshold", "requireAllClusterKeysForCoPartition", "optimizer.dynamicPartitionPruning.enabled"):
            spark.conf.unset(f"spark.sql.{name}")
    with pytest.raises(ValueError):
        S.publish_star(labelled, dictionary, base, buckets=4)


@pytest.mark.parametrize("atomic", [False, True])
def test_malformed_lines_are_published_beside_the_star(spark, survey_files, dictionary, tmp_path, atomic):
    source, base = tmp_path / "raw", str(tmp_path / "star")
    source.mkdir()
    text = {m: (survey_files / f"survey_{m}.csv").read_bytes() for m in ("092020", "102020")}
    (source / "survey_092020.csv").write_bytes(text["092020"] + b"2020,35\n")
    (source / "survey_102020.csv").write_bytes(text["102020"] + b"2020," * 60 + b"1\n")

    def publish(month="*"):
        files = MD.discover_periods(spark, f"{source}/survey_{month}.csv")
        raw = MD.read_periods(spark, files, malformed=MD.MALFORMED)
        labelled = recode(raw, dictionary, keep=(V.PERIOD, MD.MALFORMED))
        names = S.publish_star(labelled, dictionary, base, atomic=atomic, malformed=MD.MALFORMED)
        assert names == [*STAR, S.QUARANTINE]
        bad = {r[V.PERIOD]: r["line"] for r in S.load_quarantine(spark, base).collect()}
        return bad, S.load_star(spark, base, S.star_schemas(spark, dictionary))

    bad, star = publish()
    assert bad == {"2020-09": "2020,35", "2020-10": "2020," * 60 + "1"}
    assert rows(star.tables["base_saude"].groupBy(V.PERIOD).count(), V.PERIOD) == [("2020-09", 5), ("2020-10", 5)]
    assert MD.MALFORMED not in star.tables["base_saude"].columns
    # The mended month loses its old line, the other month keeps its own.
    (source / "survey_092020.csv").write_bytes(text["092020"])
    bad, star = publish("092020")
    assert list(bad) == ["2020-10"]
    assert star.tables["base_saude"].count() == 10
    (source / "survey_102020.csv").write_bytes(text["102020"])
    assert publish("102020")[0] == {}
