"""Content statistics, exact and approximate.

Exact statistics come from a histogram: one aggregation to (length, digest) with
counts, a second to lengths; that small table is kept, and all figures are taken
from it.  Texts are read once and never shuffled; copies are combined before the shuffle; percentiles need a sum
over the distinct lengths only, not a sort of the documents.  A histogram adds up
with another, which is what the incremental form keeps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import ORD, Metadata
from ..session import materialize

PERCENTILES = (50, 90, 99)
_FLAGS = ("empty_count", "whitespace_only_count", "none_or_non_str_content_count", "none_id_count", "missing_metadata_count")


def _flagged(df: DataFrame, meta: Metadata | None, content: str) -> list[Column]:
    c = F.col(content)
    body = F.coalesce(c, F.lit(""))
    flags = [body == "", text.is_whitespace_only(c), c.isNull(), F.col("id").isNull(), meta.is_empty() if meta else F.lit(False)]
    return [f.cast("long").alias(n) for f, n in zip(flags, _FLAGS, strict=True)]


def length_histogram(df: DataFrame, *, meta: Metadata | None = None, by: list[str] | None = None, content: str = "page_content") -> DataFrame:
    """One row a (group and) length: n, first (place of the first such row),
    n_distinct (contents) and the counts of flags."""
    by = by or []
    body = F.coalesce(F.col(content), F.lit(""))
    rows = df.select(*by, ORD, F.length(body).alias("len"), F.unhex(F.sha2(F.encode(body, "UTF-8"), 256)).alias("_sha"), *_flagged(df, meta, content))
    texts = rows.groupBy(*by, "len", "_sha").agg(F.count("*").alias("n"), F.min(ORD).alias("first"), *[F.sum(f).alias(f) for f in _FLAGS])
    return texts.groupBy(*by, "len").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.count("*").alias("n_distinct"), *[F.sum(f).alias(f) for f in _FLAGS])


def stats_of_histogram(hist: DataFrame, *, by: list[str] | None = None) -> DataFrame:
    """The statistics, with the places of the extreme rows instead of their ids."""
    by = by or []
    part = Window.partitionBy(*(by or [F.lit(0)]))
    n = F.sum("n").over(part)
    upto = F.sum("n").over(part.orderBy("len").rowsBetween(Window.unboundedPreceding, 0))
    ranked = hist.withColumn("_n", n).withColumn("_upto", upto)
    picks = []
    for p in PERCENTILES:
        rank = F.bround(F.lit(p / 100) * (F.col("_n") - 1))  # nearest rank, half to even
        picks.append(F.min(F.when(F.col("_upto") > rank, F.col("len"))).alias(f"p{p}_chars"))
    total = F.sum(F.col("n") * F.col("len"))
    count = F.coalesce(F.sum("n"), F.lit(0))
    # exact integer moments, so the deviation does not depend on the order of sums
    squares = F.sum(F.col("n").cast("decimal(38,0)") * F.col("len") * F.col("len"))
    spread = (F.col("_sq") * F.col("count") - F.col("total_chars").cast("decimal(38,0)") * F.col("total_chars")).cast("double")
    aggs = [
        count.alias("count"),
        F.coalesce(total, F.lit(0)).alias("total_chars"),
        squares.alias("_sq"),
        F.min("len").alias("min_chars"),
        F.max("len").alias("max_chars"),
        F.min_by("first", "len").alias("_min_ord"),
        F.max_by("first", "len").alias("_max_ord"),
        *picks,
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in _FLAGS],
        (count - F.coalesce(F.sum("n_distinct"), F.lit(0))).alias("duplicate_count"),
    ]
    out = (ranked.groupBy(*by) if by else ranked).agg(*aggs)
    average = F.when(F.col("count") > 0, F.col("total_chars") / F.col("count")).otherwise(F.lit(0.0))
    deviation = F.when(F.col("count") > 1, F.sqrt(F.greatest(spread, F.lit(0.0))) / F.col("count")).otherwise(F.lit(0.0))
    return out.select(
        *by,
        "count",
        "total_chars",
        average.alias("avg_chars"),
        deviation.alias("std_dev_chars"),
        "min_chars",
        "max_chars",
        "_min_ord",
        "_max_ord",
        *[F.coalesce(f"p{p}_chars", F.lit(0)).alias(f"p{p}_chars") for p in PERCENTILES],
        *_FLAGS,
        "duplicate_count",
        F.lit(True).alias("duplicate_count_exact"),
        F.lit(True).alias("percentiles_exact"),
    )


def _with_ids(stats: DataFrame, df: DataFrame) -> DataFrame:
    """Ids of the extreme rows: a scan of two columns against at most two rows a group."""
    ids = df.select("id", ORD)
    low = stats.select(F.col("_min_ord").alias("_o")).union(stats.select("_max_ord")).distinct()
    found = ids.join(low, ids[ORD] == low["_o"]).select(ORD, "id")
    names = stats.columns
    a = found.select(F.col(ORD).alias("_min_ord"), F.col("id").alias("min_doc_id"))
    b = found.select(F.col(ORD).alias("_max_ord"), F.col("id").alias("max_doc_id"))
    joined = stats.join(a, "_min_ord", "left").join(b, "_max_ord", "left")
    out = [{"_min_ord": "min_doc_id", "_max_ord": "max_doc_id"}.get(c, c) for c in names]
    return joined.select(*out)


def content_stats_exact(df: DataFrame, *, meta: Metadata | None = None, by: list[str] | None = None, content: str = "page_content") -> DataFrame:
    """One row (a group): the 19 exact statistics; ties of length go to the first row."""
    # the histogram is used for the figures and for the places of the extremes
    hist = materialize(length_histogram(df, meta=meta, by=by, content=content))
    return _with_ids(stats_of_histogram(hist, by=by), df)


def content_stats_approx(df: DataFrame, *, meta: Metadata | None = None, by: list[str] | None = None, content: str = "page_content", accuracy: int = 10_000, duplicate_error: float = 0.01) -> DataFrame:
    """One pass with sketches: quantile summaries for the percentiles (``accuracy``
    takes the place of a reservoir's size) and HyperLogLog for the distinct
    contents.  Counts, averages, deviation and extremes are exact.

    ``duplicate_error`` is the relative deviation of the number of distinct
    contents; unlike a Bloom filter it may err to both sides.
    """
    by = by or []
    body = F.coalesce(F.col(content), F.lit(""))
    rows = df.select(*by, ORD, "id", F.length(body).alias("len"), F.xxhash64(body).alias("_h"), *_flagged(df, meta, content))
    n = F.count("*")
    aggs = [
        n.alias("count"),
        F.coalesce(F.sum("len"), F.lit(0)).alias("total_chars"),
        F.coalesce(F.avg("len"), F.lit(0.0)).alias("avg_chars"),
        F.coalesce(F.stddev_pop("len"), F.lit(0.0)).alias("std_dev_chars"),
        F.min("len").alias("min_chars"),
        F.max("len").alias("max_chars"),
        F.min_by("id", F.struct("len", ORD)).alias("min_doc_id"),
        F.max_by("id", F.struct(F.col("len"), -F.col(ORD))).alias("max_doc_id"),
        *[F.coalesce(F.percentile_approx("len", p / 100, accuracy), F.lit(0)).alias(f"p{p}_chars_approx") for p in PERCENTILES],
        *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in _FLAGS],
        F.greatest(F.lit(0), n - F.approx_count_distinct("_h", duplicate_error)).alias("approx_duplicate_count"),
        F.lit(False).alias("duplicate_count_exact"),
        F.lit(False).alias("percentiles_exact"),
        F.lit(duplicate_error).alias("duplicate_error"),
    ]
    return (rows.groupBy(*by) if by else rows).agg(*aggs)


class ExactContentStats:
    """Incremental exact statistics: ``update`` with one frame after another (each
    is aggregated once and written to the shared folder), ``result`` at any time."""

    def __init__(self, *, meta: Metadata | None = None, content: str = "page_content") -> None:
        self.meta, self.content = meta, content
        self._state: DataFrame | None = None
        self._rows = 0

    def update(self, df: DataFrame) -> ExactContentStats:
        body = F.coalesce(F.col(self.content), F.lit(""))
        rows = df.select(F.col(ORD) + F.lit(self._rows), F.col("id"), F.length(body).alias("len"), F.unhex(F.sha2(F.encode(body, "UTF-8"), 256)).alias("_sha"), *_flagged(df, self.meta, self.content)).toDF("first", "id", "len", "_sha", *_FLAGS)
        new = rows.groupBy("len", "_sha").agg(F.count("*").alias("n"), F.min("first").alias("first"), F.min_by("id", "first").alias("id"), *[F.sum(f).alias(f) for f in _FLAGS])
        if self._state is not None:
            both = self._state.unionByName(new)
            new = both.groupBy("len", "_sha").agg(F.sum("n").alias("n"), F.min_by("id", "first").alias("id"), F.min("first").alias("first"), *[F.sum(f).alias(f) for f in _FLAGS])
        self._state = materialize(new)
        top = df.agg(F.max(ORD)).first()[0]
        self._rows += 0 if top is None else top + 1
        return self

    def result(self) -> DataFrame:
        if self._state is None:
            raise ValueError("no rows yet; update with an empty frame for empty statistics")
        hist = self._state.groupBy("len").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.count("*").alias("n_distinct"), *[F.sum(f).alias(f) for f in _FLAGS])
        return _with_ids(stats_of_histogram(hist), self._state.select("id", F.col("first").alias(ORD)))


class ApproxContentStats:
    """Incremental approximate statistics.  The state is one row of counts and sketches
    (KLL for the lengths, HyperLogLog for the distinct contents), whatever the number of
    rows; every update is one aggregation, merged into the state and written to the shared folder.

    Lengths' ranks are off by less than 1 % at the default ``k`` (99 % of the time); the number of distinct contents has a relative deviation of
    1.04 / sqrt(2^``lg_k``).  ``duplicate_error`` reports the latter.
    """

    def __init__(self, *, meta: Metadata | None = None, content: str = "page_content", k: int = 400, lg_k: int = 14) -> None:
        self.meta, self.content, self.k, self.lg_k = meta, content, k, lg_k
        self._state: DataFrame | None = None
        self._rows = 0

    def update(self, df: DataFrame) -> ApproxContentStats:
        body = F.coalesce(F.col(self.content), F.lit(""))
        place = F.col(ORD) + F.lit(self._rows)
        rows = df.select(place.alias("o"), "id", F.length(body).cast("long").alias("len"), F.xxhash64(body).alias("h"), *_flagged(df, self.meta, self.content))
        new = rows.agg(
            F.count("*").alias("count"),
            F.coalesce(F.sum("len"), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.col("len").cast("decimal(38,0)") * F.col("len")), F.lit(0)).cast("decimal(38,0)").alias("squares"),
            F.min(F.struct("len", "o", "id")).alias("low"),
            F.max(F.struct(F.col("len"), (-F.col("o")).alias("o"), F.col("id"))).alias("high"),
            *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in _FLAGS],
            F.kll_sketch_agg_bigint("len", self.k).alias("lengths"),
            F.hll_sketch_agg("h", self.lg_k).alias("contents"),
            F.max("o").alias("top"),
        )
        if self._state is not None:
            sums = [F.sum(c).alias(c) for c in ("count", "total")] + [F.sum("squares").cast("decimal(38,0)").alias("squares")]
            merged = [F.kll_merge_agg_bigint("lengths").alias("lengths"), F.hll_union_agg("contents").alias("contents"), F.max("top").alias("top")]
            new = self._state.unionByName(new).agg(*sums, F.min("low").alias("low"), F.max("high").alias("high"), *[F.sum(f).alias(f) for f in _FLAGS], *merged)
        self._state = materialize(new)
        top = self._state.first()["top"]
        self._rows = 0 if top is None else top + 1
        return self

    def result(self) -> DataFrame:
        """The columns of :func:`content_stats_approx`."""
        if self._state is None:
            raise ValueError("no rows yet; update with an empty frame for empty statistics")
        n, total = F.col("count"), F.col("total")
        spread = (F.col("squares") * n - total.cast("decimal(38,0)") * total).cast("double")
        some = n > 0
        quantiles = [F.when(some, F.kll_sketch_get_quantile_bigint("lengths", F.lit(p / 100))).otherwise(0).cast("int").alias(f"p{p}_chars_approx") for p in PERCENTILES]
        return self._state.select(
            n,
            total.alias("total_chars"),
            F.when(some, total / n).otherwise(F.lit(0.0)).alias("avg_chars"),
            F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0))) / n).otherwise(F.lit(0.0)).alias("std_dev_chars"),
            F.col("low.len").cast("int").alias("min_chars"),
            F.col("high.len").cast("int").alias("max_chars"),
            F.col("low.id").alias("min_doc_id"),
            F.col("high.id").alias("max_doc_id"),
            *quantiles,
            *_FLAGS,
            F.greatest(F.lit(0), n - F.hll_sketch_estimate("contents")).cast("long").alias("approx_duplicate_count"),
            F.lit(False).alias("duplicate_count_exact"),
            F.lit(False).alias("percentiles_exact"),
            F.lit(1.04 / 2 ** (self.lg_k / 2)).alias("duplicate_error"),
        )
