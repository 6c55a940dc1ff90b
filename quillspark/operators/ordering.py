"""Stable sorts, first and last rows, seeded shuffles, samples, extreme lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..model import ORD, Metadata


def sort_by_metadata(df: DataFrame, meta: Metadata, key: str, *, keep_missing: bool = True, reverse: bool = False, ddl: str | None = None) -> DataFrame:
    """Stable in both directions; rows without the key come last (or go)."""
    has, value = meta.has(key), meta.value(key, ddl)
    rows = df if keep_missing else df.where(has)
    return rows.orderBy(has.desc(), value.desc_nulls_last() if reverse else value.asc_nulls_last(), F.col(ORD).asc())


def sort_by_key(df: DataFrame, key: str, *, reverse: bool = False) -> DataFrame:
    """Stable sort by a column that must exist."""
    return df.orderBy(F.col(key).desc() if reverse else F.col(key).asc(), F.col(ORD).asc())


def _positive(n: int) -> None:
    if n < 1:
        raise ValueError(f"n must be at least 1, got {n}")


def first_n(df: DataFrame, n: int) -> DataFrame:
    _positive(n)
    return df.orderBy(F.col(ORD).asc()).limit(n)


def last_n(df: DataFrame, n: int) -> DataFrame:
    """The last ``n`` rows in their original order."""
    _positive(n)
    return df.orderBy(F.col(ORD).desc()).limit(n).orderBy(F.col(ORD).asc())


def shuffle(df: DataFrame, seed: int | None = None) -> DataFrame:
    """A permutation that depends on the seed and the rows' order only, not on
    partitions; without a seed it is a new one each time."""
    if seed is None:
        import random

        seed = random.getrandbits(62)
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(ORD)), F.col(ORD))


def sample_n(df: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """A uniform sample of at most ``n`` rows (what a reservoir would hold)."""
    _positive(n)
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(ORD)), F.col(ORD)).limit(n)


def _extreme(df: DataFrame, size: Column, ignore_empty: bool, blank: bool, content: str) -> DataFrame:
    rows = df.where(~text.is_empty(F.col(content), treat_whitespace_as_empty=blank)) if ignore_empty else df
    # as a column of its own, else each comparison counts both texts' characters again
    return rows.withColumn("_size", size).orderBy("_size", F.col(ORD).asc()).limit(1).drop("_size")


def shortest_document(df: DataFrame, *, ignore_empty: bool = False, treat_whitespace_as_empty: bool = False, content: str = "page_content") -> DataFrame:
    """The shortest row, the first of equals; no row if there is none."""
    return _extreme(df, text.length(F.col(content)), ignore_empty, treat_whitespace_as_empty, content)


def longest_document(df: DataFrame, *, ignore_empty: bool = False, treat_whitespace_as_empty: bool = False, content: str = "page_content") -> DataFrame:
    return _extreme(df, -text.length(F.col(content)), ignore_empty, treat_whitespace_as_empty, content)


def document_id_lengths(df: DataFrame, *, sort: bool = False, content: str = "page_content") -> DataFrame:
    rows = df.select("id", text.length(F.col(content)).alias("length"), ORD)
    return (rows.orderBy("length", ORD) if sort else rows.orderBy(ORD)).select("id", "length")
