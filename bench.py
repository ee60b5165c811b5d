"""Headline queries on a published star, one JSON line.

The star is built once from ``$BENCH_SF_DIR`` (timed as ``csv_to_star``); the analyses then
read its Parquet tables, as users do.  Each query is warmed once and timed as the best of two.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from bindings import panel
from surveyspark import fixed_values as V
from surveyspark.functions import measures as M
from surveyspark.functions.measures import Weight
from surveyspark.operators import weighted as W
from surveyspark.operators.filters import Options, Selection
from surveyspark.operators.joins import key_audit
from surveyspark.operators.recode import recode
from surveyspark.plans import analyses as A
from surveyspark.plans import questions as Q
from surveyspark.plans import specs as S
from surveyspark.plans.star import (
    Survey,
    load_star,
    publish_star,
    shared_folder,
    star_schemas,
    wide_row_codegen,
)
from surveyspark.sources import microdata as MD

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("surveyspark-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        # Off: recording a Python call site for every column expression doubles planning time.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        # Off: panel joins carry the partition column in their key, and both sides hold the
        # same periods, so there is nothing to prune.
        .config("spark.sql.optimizer.dynamicPartitionPruning.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def write_microdata(spark: SparkSession, folder: str) -> None:
    """The coded panel as yearly Latin-1 CSVs, the raw input of the star (not timed)."""
    with wide_row_codegen(spark):
        raw = panel.raw_microdata(spark, SF_DIR).repartition(int(CPUS)).persist()
        for y in panel.YEARS:
            part = raw.where(F.col(V.PERIOD) == y).drop(V.PERIOD)
            part.write.option("header", True).option("encoding", "ISO-8859-1").csv(
                f"{folder}/survey_12{y}.csv"
            )
        raw.unpersist()


def publish(spark: SparkSession, files: str, base: str) -> Survey:
    """CSV to star: discover, align, recode, write all tables."""
    d = panel.dictionary()
    raw = MD.read_periods(spark, MD.discover_periods(spark, f"{files}/*"))
    publish_star(recode(raw, d), d, base, regions=panel.regions())
    return load_star(
        spark, base, star_schemas(spark, d), weight=Weight(digits=2),
        keys=V.PANEL_KEY_WITH_PERIOD, regions=panel.regions(),
        options=Options(V.AGE_BANDS, ("Homem", "Mulher"), panel.REGION_NAMES),
    )


def per_cell_clinical(s: Survey) -> int:
    """The clinical table one aggregate job per cell, for comparison with the single pass."""
    fact, jobs = s.tables["base_saude"], 0
    for month in (*[f"{y}-12" for y in panel.YEARS], None):
        rows = fact if month is None else fact.where(F.col(V.PERIOD) == month)
        rows.agg(F.sum(V.WEIGHT)).collect()
        jobs += 1
        for c, value in [
            *[(c, V.YES) for c in (*V.SYMPTOMS, *V.COMORBIDITIES, V.TEST_TAKEN)],
            (V.TEST_RESULT, V.POSITIVE),
        ]:
            rows.where(F.col(c) == value).agg(F.sum(V.WEIGHT)).collect()
            jobs += 1
    return jobs


def main() -> None:
    spark = session()
    base = f"{shared_folder(spark, tempfile.gettempdir())}/surveyspark-bench-{uuid.uuid4().hex}"
    write_microdata(spark, f"{base}/raw")
    publish(spark, f"{base}/raw", f"{base}/warm")
    started = time.time()
    s = publish(spark, f"{base}/raw", f"{base}/star")
    timings = {"csv_to_star": round(time.time() - started, 3)}
    chosen = s.where(selection=Selection(("18-29", "30-44"), ("Mulher",)))
    queries = {
        "rate_by_period_region": lambda: Q.symptom_rate_by_region(s),
        "symptom_prevalence": lambda: A.symptom_prevalence(s),
        "clinical_spec_one_pass": lambda: S.clinical_spec(s),
        "behaviour_spec": lambda: S.behaviour_spec(s),
        "economic_spec": lambda: S.economic_spec(s),
        "regional_risk_panel": lambda: A.regional_risk(s),
        "comorbidities_by_age_join": lambda: A.comorbidities_by_age(s),
        "isolation_by_labour_join": lambda: A.isolation_by_labour_status(s),
        "selection_semi_join": lambda: A.symptom_evolution(chosen),
        "weighted_median_by_group": lambda: W.weighted_median(
            s.tables["base_economico"], V.INCOME, s.weight, [V.PERIOD]
        ),
        "income_histogram": lambda: A.income_histogram(s),
        "aid_evolution": lambda: A.aid_evolution(s),
        "key_audit": lambda: key_audit(s.tables["base_saude"], V.PANEL_KEY_WITH_PERIOD),
        "benefit_overlap": lambda: A.benefit_overlap(s),
        "mean_income_by_region": lambda: A.income_by_region(s),
        "many_ratios_one_pass": lambda: W.ratio_table(
            s.tables["base_saude"], M.answer_shares([*V.SYMPTOMS, *V.COMORBIDITIES], w=s.weight),
            [V.PERIOD, "uf"], V.TOTAL,
        ),
    }
    for name, build in queries.items():
        best = float("inf")
        for attempt in range(3):
            t0 = time.time()
            build().collect()
            if attempt:
                best = min(best, time.time() - t0)
        timings[name] = round(best, 3)
    t0 = time.time()
    jobs = per_cell_clinical(s)
    comparison = {"clinical_spec_per_cell": round(time.time() - t0, 3), "jobs": jobs}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds", "value": round(sum(timings.values()), 3), "unit": "sec",
                "queries": timings, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS), "comparison": comparison,
            }
        )
    )


if __name__ == "__main__":
    main()
