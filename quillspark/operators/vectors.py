"""Looking at embeddings: what is stored, and exact nearest rows by cosine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(df: DataFrame, query: Sequence[float], k: int, *, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest cosine with ``query``; ties by id; each task keeps ``k``."""
    score = cosine(F.col(vector_col), F.array(*[F.lit(float(x)) for x in query]))
    return df.withColumn("score", score).orderBy(F.col("score").desc(), F.col(id_col)).limit(k)


def inspect_embeddings(df: DataFrame, n: int = 2, *, id_col: str = "id", vector_col: str = "embedding", shown: int = 5) -> DataFrame:
    """The first ``n`` rows by id: id, dimension and the first components as text."""
    head = F.transform(F.slice(F.col(vector_col), 1, shown), lambda x: F.format_string("%.4f", x))
    dots = F.when(F.size(vector_col) > shown, F.lit(", …")).otherwise(F.lit(""))
    return df.orderBy(id_col).limit(n).select(F.col(id_col).alias("id"), F.size(vector_col).alias("dimension"), F.concat(F.lit("["), F.array_join(head, ", "), dots, F.lit("]")).alias("components"))
