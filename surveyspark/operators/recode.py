"""Dictionary-driven projection: rename, type, decode, split into blocks.

Each step is one ``select`` over all columns, so a 148-column questionnaire analyses as a
handful of projections that Catalyst collapses into one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surveyspark import fixed_values as V
from surveyspark.functions.columns import (
    band,
    literal_map,
    lookup,
    map_hierarchy,
    missing_codes_to_null,
    phase,
    to_int,
    to_type,
)
from surveyspark.sources.dictionary import Dictionary

# Larger code tables are joined instead of being compiled into the plan; labels are the same.
INLINE_CODES = 200


def _present(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Names that exist, first occurrence only, order kept."""
    have = set(df.columns)
    return [n for n in dict.fromkeys(names) if n in have]


# ---- C1, C2: rename, missing variables ------------------------------------------------


def rename_by_dictionary(
    df: DataFrame, dictionary: Dictionary, keep: Sequence[str] = (V.PERIOD,)
) -> DataFrame:
    """Documented columns under their semantic names, in dictionary order."""
    have = set(df.columns)
    renamed = [F.col(v.code).alias(v.name) for v in dictionary.variables if v.code in have]
    return df.select(*renamed, *_present(df, keep))


def missing_variables(df: DataFrame, dictionary: Dictionary) -> DataFrame:
    """(code, name) of dictionary variables the data does not have."""
    have = set(df.columns)
    missing = [(v.code, v.name) for v in dictionary.variables if v.code not in have]
    return df.sparkSession.createDataFrame(missing, "code string, name string")


# ---- C3, C5, C20: typing and decoding -------------------------------------------------


def _typed(name: str, dictionary: Dictionary) -> Column:
    return to_type(name, dictionary.types.get(name, "string"))


def _code_maps(dictionary: Dictionary) -> dict[str, Mapping[int, str]]:
    coded = {v.name for v in dictionary.variables if v.is_coded}
    documented = set(dictionary.names)
    return {
        name: codes
        for name, codes in dictionary.categories.items()
        # A category table for a column without a dictionary entry still applies.
        if codes and (name in coded or name not in documented)
    }


def cast_by_dictionary(df: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Declared types; unreadable text becomes null rather than failing the job."""
    return df.select(*[_typed(c, dictionary).alias(c) for c in df.columns])


def decode_categories(df: DataFrame, dictionary: Dictionary) -> DataFrame:
    """Codes replaced by labels; a code without a label becomes null.

    Doubles and columns with a declared domain are quantities and stay.
    """
    return _decode(df, dictionary, suffix="")


def dual_code_label(df: DataFrame, dictionary: Dictionary, suffix: str = "_label") -> DataFrame:
    """Keep each code column and add its label next to it."""
    return _decode(df, dictionary, suffix)


def _code_of(source: Column, kind: str) -> Column:
    return to_int(source) if kind == "string" else source


def _decode(df: DataFrame, dictionary: Dictionary, suffix: str) -> DataFrame:
    maps = _code_maps(dictionary)
    kinds = dict(df.dtypes)
    labels = _Labels(df)
    out = []
    for name in df.columns:
        codes = maps.get(name)
        if codes is None or suffix:
            out.append(F.col(name))
        if codes is not None:
            code = _code_of(F.col(name), kinds[name])
            out.append(labels.of(name, code, codes).alias(name + suffix))
    return labels.attach().select(*out)


class _Labels:
    """Label expressions: short code tables inline, long ones joined."""

    def __init__(self, df: DataFrame):
        self._df = df
        self._maps: dict[tuple, Column] = {}

    def of(self, name: str, code: Column, codes: Mapping[int, str]) -> Column:
        if len(codes) > INLINE_CODES:
            at, label = f"{name}__code", f"{name}__label"
            table = self._df.sparkSession.createDataFrame(
                list(codes.items()), f"`{at}` int, `{label}` string"
            )
            self._df = self._df.join(table, code == F.col(at), "left")
            return F.col(label)
        key = tuple(codes.items())
        if key not in self._maps:  # most questions share one answer list
            self._maps[key] = literal_map(codes)
        return self._maps[key][code]

    def attach(self) -> DataFrame:
        return self._df


def recode(
    raw: DataFrame, dictionary: Dictionary, keep: Sequence[str] = (V.PERIOD,)
) -> DataFrame:
    """Raw coded text to named, typed, labelled columns, in a single projection.

    The same as ``rename_by_dictionary``, ``cast_by_dictionary`` and ``decode_categories``
    one after the other.
    """
    have = set(raw.columns)
    maps = _code_maps(dictionary)
    labels = _Labels(raw)
    out = []
    for v in dictionary.variables:
        if v.code not in have:
            continue
        value = to_type(v.code, v.type)
        codes = maps.get(v.name)
        if codes is not None:
            value = labels.of(v.name, _code_of(value, v.type), codes)
        out.append(value.alias(v.name))
    return labels.attach().select(*out, *_present(raw, keep))


# ---- C21, C22 -------------------------------------------------------------------------


def common_variables(
    df: DataFrame, dictionary: Dictionary, months: Sequence[str], keep: Sequence[str] = (V.PERIOD,)
) -> DataFrame:
    """Only variables asked in all of the months."""
    return df.select(*_present(df, [*dictionary.common(months), *keep]))


def null_missing_codes(df: DataFrame, codes: Mapping[str, Sequence[Any]]) -> DataFrame:
    """Per column, the codes that mean "ignored" become null."""
    return df.select(
        *[missing_codes_to_null(c, codes.get(c, ())).alias(c) for c in df.columns]
    )


# ---- C6, C7, C10, C11: blocks and dimensions ------------------------------------------


def project_block(
    df: DataFrame, dictionary: Dictionary, block: str, extra: Sequence[str] = ()
) -> DataFrame:
    """Identification, weight and period, then the block's columns."""
    wanted = [*dictionary.block(*V.ID_BLOCKS), V.PERIOD, *dictionary.block(block), *extra]
    return df.select(*_present(df, wanted))


def dim_time(
    df: DataFrame,
    month: str = "mes_entrevista",
    interview: str = "num_entrevista",
    phases: Mapping[str, Sequence[int]] = V.PHASES,
    otherwise: str = V.PHASE_OTHERWISE,
) -> DataFrame:
    """Distinct interview months with their phase."""
    return (
        df.select(month, interview, V.PERIOD)
        .distinct()
        .withColumn("fase_pandemia", phase(month, phases, otherwise))
    )


def dim_profile(
    df: DataFrame,
    dictionary: Dictionary,
    cuts: Sequence[float] = V.AGE_CUTS,
    labels: Sequence[str] = V.AGE_BANDS,
    null_policy: str = "last",
    extra_key: Sequence[str] = ("upa",),
) -> DataFrame:
    """Panel key, profile block and age band."""
    wanted = [*V.PANEL_KEY, *extra_key, V.PERIOD, *dictionary.block(V.PROFILE_BLOCK)]
    return df.select(*_present(df, wanted)).withColumn(
        "faixa_etaria", band("idade", cuts, labels, null_policy)
    )


def dim_location(
    df: DataFrame,
    regions: Mapping[str, Sequence[str]] = V.REGIONS,
    columns: Sequence[str] = V.LOCATION_COLUMNS,
    extra_key: Sequence[str] = ("upa",),
) -> DataFrame:
    """Panel key, location columns and region."""
    wanted = [*V.PANEL_KEY, *extra_key, V.PERIOD, *columns]
    return df.select(*_present(df, wanted)).withColumn("regiao", map_hierarchy("uf", regions))


def dim_dictionary(
    table: DataFrame, type_overrides: Mapping[str, str] = V.TYPE_OVERRIDES
) -> DataFrame:
    """The published lineage columns of the variable dictionary, types patched."""
    patched = F.coalesce(lookup("nome_semantico", type_overrides), F.col("tipo"))
    return table.select(*V.PUBLISHED_DICTIONARY_COLUMNS).withColumn("tipo", patched)
