"""Small helpers on whole frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold only NULL; a frame without rows stays as it is."""
    counts = df.agg(F.count("*").alias("_n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    return df.drop(*[c for i, c in enumerate(df.columns) if counts["_n"] and not counts[f"c{i}"]])


def split_text(df: DataFrame, *, chunk_size: int, overlap: int = 0, content: str = "page_content") -> DataFrame:
    """One row a chunk of ``chunk_size`` characters, ``overlap`` of them shared
    with the one before, with its number in ``chunk``."""
    if chunk_size < 1 or not 0 <= overlap < chunk_size:
        raise ValueError("chunk_size must be positive and overlap less than it")
    step = chunk_size - overlap
    n = F.greatest(F.lit(1), F.ceil((F.length(content) - overlap) / step)).cast("int")
    starts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * step)
    rows = df.withColumn("_starts", starts).select(*df.columns, F.posexplode("_starts").alias("chunk", "_start"))
    return rows.withColumn(content, F.substring(F.col(content), F.col("_start") + 1, F.lit(chunk_size))).drop("_start")
