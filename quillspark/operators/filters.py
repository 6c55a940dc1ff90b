"""Metadata and emptiness filters; declarative predicates that reach the scan."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import Metadata, comparable


def filter_by_metadata(df: DataFrame, meta: Metadata, key: str, value: Any) -> DataFrame:
    """Rows whose ``key`` equals ``value`` as a Python value would; None matches an
    absent key, too.  Predicates over typed columns are plain and reach the scan."""
    return df.where(meta.equals(key, value, df.schema))


def filter_by_metadata_range(df: DataFrame, meta: Metadata, key: str, lower: Any = None, upper: Any = None, *, strict: bool = False) -> DataFrame:
    """Rows that have ``key`` with lower <= value <= upper, each bound optional."""
    return df.where(meta.between(key, lower, upper, strict=strict, schema=df.schema))


def filter_by_metadata_values(df: DataFrame, meta: Metadata, key: str, values: Iterable[Any] | DataFrame) -> DataFrame:
    """Rows whose ``key`` is one of ``values`` (none of an empty set).  A DataFrame
    of one column becomes a left semi join; its type must be able to equal the key's."""
    if isinstance(values, DataFrame):
        wanted = values.select(F.col(values.columns[0]).alias("_wanted"))
        kind = meta.type_of(key, df.schema)
        if kind is not None and not comparable(kind, wanted.schema["_wanted"].dataType):
            return df.where(F.lit(False))
        own, other = meta.value(key), F.col("_wanted")
        if kind is not None and "boolean" in (kind.typeName(), wanted.schema["_wanted"].dataType.typeName()):
            own, other = own.cast("double"), other.cast("double")
        return df.join(wanted, own == other, "left_semi")
    return df.where(meta.is_in(key, values, df.schema))


def find_empty_documents(df: DataFrame, *, treat_whitespace_as_empty: bool = False, content: str = "page_content") -> DataFrame:
    return df.where(text.is_empty(F.col(content), treat_whitespace_as_empty=treat_whitespace_as_empty))


def find_empty_document_ids(df: DataFrame, *, treat_whitespace_as_empty: bool = False, content: str = "page_content") -> DataFrame:
    return find_empty_documents(df, treat_whitespace_as_empty=treat_whitespace_as_empty, content=content).select("id")
