"""Invented documents and records, made by the executors from row numbers."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import ORD

_WORDS = "river stone lantern market quiet signal garden winter engine letter bridge harbor copper field window mirror paper cloud forest road".split()
_NAMES = "Ada Bela Cora Dana Emil Fynn Gita Hugo Ines Juri".split()
_TOPICS = "history science travel cooking music sport finance health".split()


def _pick(values: list[str], *seed: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.xxhash64(*seed), F.lit(len(values))) + 1).cast("int"))


def _rows(spark: SparkSession, n: int, seed: int | None) -> DataFrame:
    if n < 0:
        raise ValueError(f"n must not be negative, got {n}")
    return spark.range(n).withColumnRenamed("id", ORD).withColumn("_s", F.lit(random.getrandbits(62) if seed is None else seed))


def fake_documents(spark: SparkSession, n: int = 5, seed: int | None = None, nb_sentences: int = 5) -> DataFrame:
    """id ``doc-<i>``, page_content of ``nb_sentences`` sentences, author, topic."""
    word = lambda s, w: _pick(_WORDS, F.col("_s"), F.col(ORD), s, w)
    sentence = lambda s: F.concat(F.initcap(word(s, F.lit(0))), F.lit(" "), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda w: word(s, w)), " "), F.lit("."))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(nb_sentences)), sentence), " ") if nb_sentences > 0 else F.lit("")
    return _rows(spark, n, seed).select(F.concat(F.lit("doc-"), F.col(ORD).cast("string")).alias("id"), body.alias("page_content"), _pick(_NAMES, F.col("_s"), F.col(ORD), F.lit("a")).alias("author"), _pick(_TOPICS, F.col("_s"), F.col(ORD), F.lit("t")).alias("topic"), ORD)


def fake_records(spark: SparkSession, n: int = 5, seed: int | None = None) -> DataFrame:
    return _rows(spark, n, seed).select(F.concat(F.lit("rec-"), F.col(ORD).cast("string")).alias("id"), _pick(_NAMES, F.col("_s"), F.col(ORD), F.lit("a")).alias("author"), _pick(_TOPICS, F.col("_s"), F.col(ORD), F.lit("t")).alias("topic"), ORD)
