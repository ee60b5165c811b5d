"""The two external dictionaries that drive renaming, typing, blocks and decoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyspark.functions.columns import to_int


@dataclass(frozen=True)
class Variable:
    code: str
    name: str
    block: str
    type: str
    domain: str = ""
    months: tuple[str, ...] = ()

    @property
    def is_coded(self) -> bool:
        """Whether values are category codes rather than quantities."""
        return self.type in ("integer", "string") and not self.domain.strip()


@dataclass(frozen=True)
class Dictionary:
    """Variables in file order and, per variable name, its ``{code: label}`` table."""

    variables: tuple[Variable, ...]
    categories: Mapping[str, Mapping[int, str]] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [v.name for v in self.variables]

    @property
    def code_to_name(self) -> dict[str, str]:
        return {v.code: v.name for v in self.variables}

    @property
    def types(self) -> dict[str, str]:
        return {v.name: v.type for v in self.variables}

    def block(self, *blocks: str) -> list[str]:
        """Column names of the blocks, in the order the blocks are given."""
        return [v.name for b in blocks for v in self.variables if v.block == b]

    def override_types(self, types: Mapping[str, str]) -> Dictionary:
        """Patch declared types; names that do not occur are ignored."""
        patched = tuple(replace(v, type=types.get(v.name, v.type)) for v in self.variables)
        return replace(self, variables=patched)

    def common(self, months: Mapping | set | list | tuple) -> list[str]:
        """Names of variables asked in every one of the months."""
        return [v.name for v in self.variables if set(months) <= set(v.months)]

    def with_categories(self, categories: Mapping[str, Mapping[int, str]]) -> Dictionary:
        return replace(self, categories=categories)


def read_dictionary_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Dictionary files as text columns; empty cells stay null."""
    return (
        spark.read.option("header", True)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", True)
        .csv(path if isinstance(path, str) else list(path))
    )


def variables_of(table: DataFrame) -> Dictionary:
    """Collect a variable table (metadata: one row per questionnaire variable)."""
    rows = table.select(
        "codigo_variavel", "nome_semantico", "bloco", "tipo", "dominio", "meses"
    ).collect()
    return Dictionary(
        tuple(
            Variable(
                code=r["codigo_variavel"],
                name=r["nome_semantico"],
                block=r["bloco"],
                type=r["tipo"],
                domain=r["dominio"] or "",
                months=tuple(m.strip() for m in (r["meses"] or "").split(",") if m.strip()),
            )
            for r in rows
        )
    )


def line_order() -> Column:
    """Place of a row in the files it was read from: by file name, then by line.

    A task reads a file (or a part of it) from its start to its end, so within one the row ids
    rise with the lines; between files they depend on how the scan was dealt.
    """
    return F.struct(
        "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()
    )


def category_codes(table: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(name, code, label) of :func:`read_dictionary_csv`, unreadable codes dropped.

    The last of a repeated code is kept: the last line of the file whose name comes last.

    Blank values mean "not applicable" and texts such as ``000 a 130`` describe a domain;
    neither is a code.
    """
    names = [(v.code, v.name) for v in dictionary.variables]
    known = table.sparkSession.createDataFrame(names, "codigo_variavel string, name string")
    return (
        table.withColumn("row", line_order())
        .withColumn("code", to_int(F.trim("valor")))
        .where(F.col("code").isNotNull())
        .join(known, "codigo_variavel", "left")
        .groupBy(F.coalesce("name", "codigo_variavel").alias("name"), "code")
        .agg(F.max_by("descricao_valor", "row").alias("label"))
    )


def read_variable_dictionary(spark: SparkSession, path: str | Sequence[str]) -> Dictionary:
    table = read_dictionary_csv(spark, path)
    return variables_of(table.withColumn("row", line_order()).orderBy("row"))


def read_category_dictionary(
    spark: SparkSession, path: str | Sequence[str], dictionary: Dictionary
) -> dict[str, dict[int, str]]:
    """``{name: {code: label}}`` for every coded variable."""
    return collect_categories(category_codes(read_dictionary_csv(spark, path), dictionary))


def collect_categories(codes: DataFrame) -> dict[str, dict[int, str]]:
    maps: dict[str, dict[int, str]] = {}
    for r in codes.orderBy("name", "code").collect():
        maps.setdefault(r["name"], {})[r["code"]] = r["label"]
    return maps


def read_dictionaries(
    spark: SparkSession,
    variables_path: str,
    categories_path: str,
    type_overrides: Mapping[str, str] | None = None,
) -> Dictionary:
    """Both dictionaries, types patched."""
    d = read_variable_dictionary(spark, variables_path)
    d = d.with_categories(read_category_dictionary(spark, categories_path, d))
    return d.override_types(type_overrides or {})
