"""Microdata to star schema, and the published star as one object."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from surveyspark import fixed_values as V
from surveyspark.functions.columns import (
    any_of,
    band,
    count_of,
    labour_status,
    map_hierarchy,
    positive_flag,
)
from surveyspark.functions.measures import Weight
from surveyspark.operators.filters import Options, Selection, is_partial, demographic_filter
from surveyspark.operators.joins import additive_sums, joined_sums, self_joined_sums
from surveyspark.operators.recode import dim_dictionary, dim_location, dim_profile, dim_time, project_block
from surveyspark.sinks.tables import (
    overwrite_period, period_folders, publish_table, read_manifest, remove_folder,
    replace_periods, switch_manifest, unsorted_writes, write_partitioned, write_version,
)
from surveyspark.sources.dictionary import Dictionary
from surveyspark.sources.microdata import split_malformed
from surveyspark.sources.tables import read_star_table, read_versioned_table

# ---- building ------------------------------------------------------------------------------


class Tables(Mapping[str, DataFrame]):
    """Star tables whose plans are built when first asked for."""

    def __init__(
        self, builders: Mapping[str, Callable[[], DataFrame]],
        rows: Callable[[], DataFrame] | None = None,
    ):
        self._builders = dict(builders)
        self._built: dict[str, DataFrame] = {}
        self._rows = rows

    def rows(self) -> DataFrame | None:
        """The one frame that facts, profile and location are projections of; None if they are stored apart."""
        return self._rows() if self._rows else None

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._builders[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)


def build_star(
    labelled: DataFrame,
    dictionary: Dictionary,
    regions: Mapping[str, Sequence[str]] = V.REGIONS,
    age_cuts: Sequence[float] = V.AGE_CUTS,
    age_bands: Sequence[str] = V.AGE_BANDS,
) -> Tables:
    """Dimension and fact tables of decoded microdata (lazy)."""

    def block(name: str) -> DataFrame:
        return project_block(labelled, dictionary, V.BLOCK_TABLES[name])

    def health() -> DataFrame:
        symptoms = [c for c in V.SYMPTOMS if c in labelled.columns]
        return block("base_saude").withColumns(
            {V.HAS_SYMPTOM: any_of(symptoms), V.SYMPTOM_COUNT: count_of(symptoms)}
        )

    def behaviour() -> DataFrame:
        return block("base_comportamento").withColumn(V.LABOUR_STATUS, labour_status())

    def economy() -> DataFrame:
        df = block("base_economico")
        return df.withColumn(V.HAS_INCOME, positive_flag(V.INCOME)) if V.INCOME in df.columns else df

    def rows() -> DataFrame:
        """All tables' columns, for statistics over several of them."""
        have = set(labelled.columns)
        symptoms = [c for c in V.SYMPTOMS if c in have]
        derived = {V.HAS_SYMPTOM: any_of(symptoms), V.SYMPTOM_COUNT: count_of(symptoms)} if symptoms else {}
        if {V.WORKED, V.AWAY, V.LOOKED} <= have:
            derived[V.LABOUR_STATUS] = labour_status()
        if V.INCOME in have:
            derived[V.HAS_INCOME] = positive_flag(V.INCOME)
        if "idade" in have:
            derived["faixa_etaria"] = band("idade", age_cuts, age_bands)
        return labelled.withColumns(derived)

    return Tables(
        {
            "dim_tempo": lambda: dim_time(labelled),
            "dim_perfil": lambda: dim_profile(labelled, dictionary, age_cuts, age_bands),
            "dim_localizacao": lambda: dim_location(labelled, regions),
            "base_saude": health,
            "base_comportamento": behaviour,
            "base_economico": economy,
            "base_trabalho": lambda: block("base_trabalho"),
        },
        rows,
    )


def star_schemas(spark: SparkSession, dictionary: Dictionary) -> dict[str, T.StructType]:
    """Schema of every published table, derived from the dictionary alone.

    Reading with these costs no footer scan and gives months written before a question
    existed a null column.
    """
    labelled_type = {
        v.name: "string" if v.is_coded and dictionary.categories.get(v.name) else
        {"integer": "int"}.get(v.type, v.type)
        for v in dictionary.variables
    }
    columns = [f"`{n}` {t}" for n, t in labelled_type.items()] + [f"{V.PERIOD} string"]
    empty = spark.createDataFrame([], ", ".join(columns))
    return {name: df.schema for name, df in build_star(empty, dictionary).items()}


def shared_folder(spark: SparkSession, otherwise: str) -> str:
    """The cluster's shared scratch folder; ``otherwise`` when the session names none."""
    return spark.conf.get("spark.checkpoint.dir", None) or otherwise


WRITERS = 4
#: Table of the lines that did not fit their file's header.
QUARANTINE = "quarentena"
QUARANTINE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "line", V.PERIOD)])


@contextmanager
def wide_row_codegen(spark: SparkSession) -> Iterator[None]:
    """Settings for jobs that compute over a hundred columns per row.

    Generated methods beyond 8,000 bytes of bytecode are not compiled by the JVM and run
    interpreted.  With this limit Spark drops to its split, compilable projections instead,
    which recodes several times faster.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def publish_star(
    labelled: DataFrame,
    dictionary: Dictionary,
    base: str,
    dictionary_table: DataFrame | None = None,
    incremental: bool = True,
    stage: str | None = None,
    keep_stage: bool = False,
    atomic: bool = False,
    database: str | None = None,
    buckets: int | None = None,
    malformed: str | None = None,
    **options,
) -> list[str]:
    """Write all tables under ``base``; returns their names.

    The decoded microdata are written once, columnar, to a shared folder, and each table
    then reads back only its own columns: the CSVs are parsed and decoded once instead of
    once per table.  The stage is removed at the end, also after a failure; a table whose write
    failed keeps its old months.  With ``incremental``
    only the months present are replaced.

    ``atomic`` writes every table to folders of a new version and then moves a manifest to its place,
    which ``load_star`` reads: all tables change at once, or none if one fails.  ``database``
    publishes the tables in the catalog, whole; with ``buckets`` those with person keys are dealt
    by the key, so that ``load_star(database=)`` joins them without an exchange.

    ``malformed`` is the column of ``read_periods(malformed=)``, kept by ``recode(keep=)``: rows that
    have it go to the table ``quarentena`` (see :func:`load_quarantine`) and to no other.  A month
    that is published again replaces its quarantined lines too, also when there are none now.
    """
    if atomic and database:
        raise ValueError("a catalog table is replaced by itself, not with a manifest")
    if buckets and not database:
        raise ValueError("bucketed tables need a catalog database")
    spark = labelled.sparkSession
    stage = stage or posixpath.join(
        shared_folder(spark, base), f"_decoded_{uuid.uuid4().hex}"
    )
    try:
        with wide_row_codegen(spark), unsorted_writes(spark):
            write_partitioned(labelled, stage)
        decoded = spark.read.schema(labelled.schema).parquet(stage)
        bad = None
        if malformed is not None:
            decoded, bad = split_malformed(decoded, malformed)
        built = build_star(decoded, dictionary, **options)
        tables = {name: built[name] for name in built}  # all are analysed before the first write
        write = overwrite_period if incremental else write_partitioned
        version = uuid.uuid4().hex
        months = period_folders(spark, stage)
        if bad is not None:
            tables[QUARANTINE] = bad

        def publish(name: str) -> list[str] | None:
            if atomic:
                return write_version(tables[name], base, name, version)
            if database:
                # The key without the period, which is the folder: bucketing cannot use it too.
                keys = [k for k in V.FULL_KEY if k != V.PERIOD]
                person = set(keys) <= set(tables[name].columns)
                publish_table(
                    tables[name], database, name, posixpath.join(base, name),
                    buckets=buckets if person else None, bucket_keys=keys if person else (),
                )
                return None
            path = posixpath.join(base, name)
            if name == QUARANTINE and incremental:
                # A month without such lines has no rows that would replace the old ones.
                replace_periods(tables[name], path, [m.split("=", 1)[1] for m in months])
            else:
                write(tables[name], path)
            return None

        # Independent jobs: the tail of one leaves room for the next.
        with unsorted_writes(spark), ThreadPoolExecutor(WRITERS) as pool:
            written = dict(zip(tables, pool.map(publish, tables), strict=True))
        if atomic:
            switch_manifest(spark, base, version, written, incremental, months)
    finally:
        if not keep_stage:
            remove_folder(spark, stage)
    if dictionary_table is not None:
        write_partitioned(
            dim_dictionary(dictionary_table), posixpath.join(base, "dim_dicionario"), None
        )
        return [*tables, "dim_dicionario"]
    return list(tables)


# ---- using ---------------------------------------------------------------------------------


@dataclass(frozen=True)
class Survey:
    """The star tables with the choices every analysis shares.

    ``keys`` joins facts and dimensions.  The default is unique per person and month; pass
    ``PANEL_KEY_WITH_PERIOD`` for the narrower documented key, which multiplies rows.
    """

    tables: Mapping[str, DataFrame]
    weight: Weight = Weight()
    keys: Sequence[str] = V.FULL_KEY
    regions: Mapping[str, Sequence[str]] = field(default_factory=lambda: V.REGIONS)
    months: Sequence[str] | None = None
    month_labels: Mapping[str, str] = field(default_factory=lambda: V.MONTH_LABELS)
    age_bands: Sequence[str] = V.AGE_BANDS
    selection: Selection = Selection()
    options: Options = Options()

    def where(self, **changes) -> Survey:
        """The same survey with other months, selection, weight or keys."""
        return replace(self, **changes)

    # -- rows ------------------------------------------------------------------------------

    def period_rows(self, table: str) -> DataFrame:
        return self._in_months(self.tables[table])

    def _in_months(self, df: DataFrame) -> DataFrame:
        return df if not self.months else df.where(F.col(V.PERIOD).isin(*self.months))

    def rows(self) -> DataFrame | None:
        """Rows with the columns of all facts, in the chosen months, if the tables are projections of one frame."""
        rows = self.tables.rows() if isinstance(self.tables, Tables) else None
        return None if rows is None else self._in_months(rows)

    def _region_rows(self, df: DataFrame, skip: Sequence[str]) -> DataFrame:
        df = df.withColumn("regiao", map_hierarchy("uf", self.regions))
        if "regions" not in skip and is_partial(self.selection.regions, self.options.regions):
            df = df.where(F.col("regiao").isin(*self.selection.regions))
        return df

    def fact(
        self, table: str, skip: Sequence[str] = (), hot_keys: int | None = None
    ) -> DataFrame:
        """Rows of a fact in the chosen months and demographic selection, region attached.

        The analyses use :meth:`sums` instead, which reduces the rows before it joins.
        """
        df = self._region_rows(self.period_rows(table), skip)
        return demographic_filter(
            df, self.period_rows("dim_perfil"), self.selection, self.options,
            ["regions", *skip], self.keys, self.regions, hot_keys,
        )

    def people(self, skip: Sequence[str] = ()) -> DataFrame | None:
        """Profile rows in the chosen age bands and sexes; None when nothing is chosen."""
        chosen = self.chosen(skip)
        return None if chosen is None else self.period_rows("dim_perfil").where(chosen)

    def chosen(self, skip: Sequence[str] = ()) -> Column | None:
        """The condition of :meth:`people`."""
        chosen: list[Column] = []
        if "age_bands" not in skip and is_partial(self.selection.age_bands, self.options.age_bands):
            chosen.append(F.col("faixa_etaria").isin(*self.selection.age_bands))
        if "sexes" not in skip and is_partial(self.selection.sexes, self.options.sexes):
            chosen.append(F.col("sexo").isin(*self.selection.sexes))
        if not chosen:
            return None
        return reduce(Column.__and__, chosen)

    # -- sums ------------------------------------------------------------------------------

    def levels(self) -> dict[str, Sequence[str]]:
        """Values that the star's derived columns can have, by construction; ``age_bands`` are the star's own."""
        return {"faixa_etaria": self.age_bands, V.LABOUR_STATUS: V.LABOUR_STATUSES}

    def _determined(self) -> list[str]:
        """Columns that follow from the key: the state gives the region."""
        return ["regiao"] if "uf" in self.keys else []

    def sums(
        self,
        table: str | Sequence[str],
        sums: Mapping[str, Column],
        by: Sequence[str] = (),
        skip: Sequence[str] = (),
        where: Column | None = None,
        match: DataFrame | str | None = None,
        match_by: Sequence[str] = (),
        how: str = "inner",
        derive: Mapping[str, Column] | None = None,
        within: Column | None = None,
        levels: Mapping[str, Sequence] | None = None,
        match_where: Column | None = None,
    ) -> DataFrame:
        """Sums over a fact, optionally joined with another table on the panel key.

        ``match`` is the other table or its name; of a named one, the rows of ``match_where``.  Tables
        that are projections of one frame (:meth:`rows`) are not joined but aggregated together, and
        sums over several of them are taken in one pass.
        ``derive`` adds columns to group by.  ``within`` is the condition of the profile rows to restrict
        the fact to instead of the selection's.  ``levels`` lists the values of further columns to group by
        (see ``joined_sums``), of the rows that ``where`` leaves.
        """
        unique = set(V.FULL_KEY) <= set(self.keys)
        chosen = self.chosen(skip) if within is None else within
        known = {**self.levels(), **(levels or {})}
        rows = self.rows() if match is None or isinstance(match, str) else None
        if rows is not None and (match is not None or chosen is not None):
            # Regions restrict the left side only.
            left, place = where, map_hierarchy("uf", self.regions)
            if "regions" not in skip and is_partial(self.selection.regions, self.options.regions):
                inside = F.col("regiao").isin(*self.selection.regions)
                left = inside if left is None else left & inside
            rows = rows.withColumn("regiao", place).withColumns(dict(derive or {}))
            if match is None:
                together = self_joined_sums(
                    rows, sums, self.keys, left, chosen, by, how="left_semi", levels=known,
                    determined=self._determined(),
                )
            else:
                together = self_joined_sums(
                    rows, sums, self.keys, left, match_where, by, match_by, how, chosen, known,
                    self._determined(),
                )
            if together is not None:
                return together
        if not isinstance(table, str):
            df = self.rows()
            if df is None:
                raise ValueError("tables that are stored apart are summed one by one")
        else:
            df = self.period_rows(table)
        df = self._region_rows(df, skip)
        if derive:
            df = df.withColumns(dict(derive))
        if where is not None:
            df = df.where(where)
        people = None if chosen is None else self.period_rows("dim_perfil").where(chosen)
        if isinstance(match, str):
            match = self.period_rows(match)
            match = match if match_where is None else match.where(match_where)
        if match is not None:
            return joined_sums(
                df, match, sums, self.keys, by, match_by, how, within=people, unique=unique,
                levels=known, determined=self._determined(),
            )
        if people is not None:
            return joined_sums(
                df, people, sums, self.keys, by, how="left_semi", determined=self._determined()
            )
        return additive_sums(df, sums, by)

    def by_profile(
        self, table: str, sums: Mapping[str, Column], columns: Sequence[str],
        by: Sequence[str] = (), skip: Sequence[str] = (), how: str = "inner",
    ) -> DataFrame:
        """Sums by profile attributes, the selection applied to the same profile rows."""
        chosen = self.chosen(skip)
        # Unmatched rows of a left join must not bring back people who were not chosen.
        return self.sums(
            table, sums, by, ["age_bands", "sexes", *skip], match="dim_perfil", match_where=chosen,
            match_by=columns, how=how, within=chosen if how == "left" else None,
        )


def load_star(
    spark: SparkSession, base: str = "", schemas: Mapping[str, T.StructType] | None = None,
    database: str | None = None, **options,
) -> Survey:
    """Open a published star: its newest manifest if it has one, its folders, or the tables of a ``database``.

    What a manifest names is fixed when the star is opened; a later publication changes nothing in it.
    """
    names = [*V.BLOCK_TABLES, "dim_tempo", "dim_perfil", "dim_localizacao"]
    manifest = None if database else read_manifest(spark, base)

    def opener(name: str) -> Callable[[], DataFrame]:
        schema = (schemas or {}).get(name)
        if database:
            return lambda: spark.table(f"`{database}`.`{name}`")
        if manifest is not None:
            return lambda: read_versioned_table(spark, base, name, manifest.get(name, {}), schema)
        return lambda: read_star_table(spark, base, name, schema)

    return Survey(Tables({n: opener(n) for n in names}), **options)


def load_quarantine(spark: SparkSession, base: str = "", database: str | None = None) -> DataFrame:
    """(path, line, period) of the lines that a ``publish_star(malformed=)`` kept out of the star."""
    if database:
        return spark.table(f"`{database}`.`{QUARANTINE}`")
    manifest = read_manifest(spark, base)
    if manifest is not None:
        return read_versioned_table(spark, base, QUARANTINE, manifest.get(QUARANTINE, {}), QUARANTINE_SCHEMA)
    return read_star_table(spark, base, QUARANTINE, QUARANTINE_SCHEMA)
