"""Metadata profiles of documents and records.

Values are compared by their canonical text, so 1 and true are two values here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import ORD, Metadata
from ..session import materialize


def metadata_overview(df: DataFrame, meta: Metadata) -> DataFrame:
    """One row: count, missing_metadata_count, avg_keys, min_keys, max_keys, distinct_keys_seen."""
    rows = df.select(meta.n_keys().alias("k"))
    base = rows.agg(F.count("*").alias("count"), F.count_if(F.col("k") == 0).alias("missing_metadata_count"), F.coalesce(F.avg("k"), F.lit(0.0)).alias("avg_keys"), F.min("k").alias("min_keys"), F.max("k").alias("max_keys"))
    keys = meta.pairs(df).agg(F.count_distinct("key").alias("distinct_keys_seen"))
    return base.crossJoin(F.broadcast(keys))  # one row with one row


def metadata_profile(df: DataFrame, meta: Metadata, *, n_sample_values: int | None = 3, unit: str = "docs") -> DataFrame:
    """One row a key: present_in_<unit>, missing_in_<unit>, value_types,
    none_or_empty_count, unique_values_sample, unique_values_sample_truncated.

    The sample holds the first ``n_sample_values`` distinct plain values in the
    rows' order (all, if None), up to the first list or object; it is truncated
    if it lacks a value.  Values are reduced to their first place before they are
    ranked, and only the first places are ranked.
    """
    return profile_of(value_table(df, meta), df.agg(F.count("*").alias("_total")), n_sample_values=n_sample_values, unit=unit)


def value_table(df: DataFrame, meta: Metadata) -> DataFrame:
    """One row a key, type and value: n and first (its first place).  Adds up with others."""
    return meta.pairs(df).groupBy("key", "type", "is_complex", "value").agg(F.count("*").alias("n"), F.min(ORD).alias("first"))


def profile_of(values: DataFrame, total: DataFrame, *, n_sample_values: int | None = 3, unit: str = "docs") -> DataFrame:
    """The profile from a value table and the number of rows (one row, ``_total``)."""
    keys = values.groupBy("key").agg(
        F.sum("n").alias("present"),
        F.array_sort(F.collect_set("type")).alias("value_types"),
        F.coalesce(F.sum(F.when(F.col("value").isNull() | (F.col("value") == ""), F.col("n"))), F.lit(0)).alias("none_or_empty_count"),
        F.min(F.when(F.col("is_complex"), F.col("first"))).alias("_complex"),
        F.count_if(~F.col("is_complex")).alias("_distinct"),
    )
    plain = values.where(~F.col("is_complex"))
    if n_sample_values is not None:
        at = F.row_number().over(Window.partitionBy("key").orderBy("first"))
        plain = plain.withColumn("_at", at).where(F.col("_at") <= n_sample_values)
    shown = F.coalesce(F.col("value"), F.lit("None"))
    joined = plain.select("key", "value", "first").join(keys.select("key", "_complex"), "key").where("_complex is null or first < _complex")
    samples = joined.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct(shown.alias("s"), "value"))), lambda x: x["value"]).alias("sample"))
    out = keys.join(samples, "key", "left").crossJoin(F.broadcast(total))  # with one row
    more = F.col("_complex").isNotNull() if n_sample_values is None else F.col("_complex").isNotNull() | (F.col("_distinct") > n_sample_values)
    return out.select(
        "key",
        F.col("present").alias(f"present_in_{unit}"),
        (F.col("_total") - F.col("present")).alias(f"missing_in_{unit}"),
        "value_types",
        "none_or_empty_count",
        F.coalesce("sample", F.array().cast("array<string>")).alias("unique_values_sample"),
        more.alias("unique_values_sample_truncated"),
    )


class MetadataProfile:
    """Incremental profile of documents or records: ``update`` with one frame after
    another, ``result`` at any time.  The state is the value table, written to the shared folder."""

    def __init__(self, meta: Metadata, *, n_sample_values: int | None = 3, unit: str = "docs") -> None:
        self.meta, self.n_sample_values, self.unit = meta, n_sample_values, unit
        self._state: DataFrame | None = None
        self._total = self._rows = 0

    def update(self, df: DataFrame) -> MetadataProfile:
        new = value_table(df, self.meta).withColumn("first", F.col("first") + F.lit(self._rows))
        if self._state is not None:
            new = self._state.unionByName(new).groupBy("key", "type", "is_complex", "value").agg(F.sum("n").alias("n"), F.min("first").alias("first"))
        self._state = materialize(new)
        n, top = df.agg(F.count("*"), F.max(ORD)).first()
        self._total += n
        self._rows += 0 if top is None else top + 1
        return self

    def result(self) -> DataFrame:
        if self._state is None:
            raise ValueError("no rows yet; update with an empty frame for an empty profile")
        total = self._state.sparkSession.createDataFrame([(self._total,)], "_total long")
        return profile_of(self._state, total, n_sample_values=self.n_sample_values, unit=self.unit)


def profile_flags(profile: DataFrame, unit: str = "docs") -> DataFrame:
    """``profile`` with ``flags``: what a reader should look at."""
    flags = F.array_compact(
        F.array(
            F.when(F.col(f"missing_in_{unit}") > 0, "missing values"),
            F.when(F.size("value_types") > 1, "mixed types"),
            F.when(F.col("none_or_empty_count") > 0, "has None/empty"),
        )
    )
    return profile.withColumn("flags", flags)
