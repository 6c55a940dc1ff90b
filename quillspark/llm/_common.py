"""Helpers shared by the operators of this subpackage.

Their Python functions are marked as not deterministic, though they are: Catalyst
then never copies a call into a filter below it, so each text is processed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import materialize, ship_package

__all__ = ["materialize", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path may be in any store that Spark reads."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
