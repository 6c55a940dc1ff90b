"""Bloom filters, by Spark's own class."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class BloomFilter:
    """A set of fixed size on the driver, with false positives at about ``fp_rate`` once
    ``expected_items`` are in, and no false negatives.  Filters of equal sizes merge."""

    def __init__(self, expected_items: int = 1_000_000, fp_rate: float = 0.01, *, spark: SparkSession | None = None) -> None:
        if expected_items < 1 or not 0 < fp_rate < 1:
            raise ValueError("expected_items must be positive and fp_rate between 0 and 1")
        jvm = (spark or SparkSession.getActiveSession())._jvm
        self._filter = jvm.org.apache.spark.util.sketch.BloomFilter.create(expected_items, fp_rate)

    def _put(self, item: str | bytes) -> bool:
        return self._filter.putString(item) if isinstance(item, str) else self._filter.putBinary(bytearray(item))

    def add(self, item: str | bytes) -> None:
        self._put(item)

    def add_and_check(self, item: str | bytes) -> bool:
        """Add the item; whether it (probably) was there before."""
        return not self._put(item)  # Spark tells whether a bit changed

    def merge(self, other: BloomFilter) -> BloomFilter:
        self._filter.mergeInPlace(other._filter)
        return self

    def __contains__(self, item: str | bytes) -> bool:
        return self._filter.mightContainString(item) if isinstance(item, str) else self._filter.mightContainBinary(bytearray(item))

    @property
    def size(self) -> int:
        """Bits."""
        return self._filter.bitSize()


def spark_bloom_filter(df: DataFrame, column: str, expected_items: int = 1_000_000, fp_rate: float = 0.01):
    """A filter over a column, built by the executors; has ``mightContain``."""
    return df._jdf.stat().bloomFilter(column, expected_items, fp_rate)
