"""The corpus pipeline: five stages over ``documents``, each by one operator of
``quillspark.llm``.  Every stage's result is written as Parquet and read again as
the next one's ``docs``; all but the last return the columns of ``documents``.

What each stage decides:

1. language ID: a document goes if it is undetermined (null, or no letter), or if
   its language has less than a quarter of its letters, as in texts of unknown
   scripts; texts of several known languages stay;
2. near-dedup: classes are made of texts, and of each class one row stays, that of
   the smallest doc_id.  So a row without an id stays if no row with an id has its
   text or a near duplicate of it, and an id keeps each of its different texts that
   is its class's choice.  Of several texts of that id the least hash decides, of
   rows of one id and text the least other columns.  A text without words, or null,
   is left alone, once for each id (a null id is one as well);
3. substring dedup: repeated passages are cut out of the texts; a document that
   lost all of its words goes; a text that lost none stays as it is;
4. decontamination: contaminated documents go;
5. packing: the documents are packed into sequences by their token counts, one row
   for each piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import decontaminate, lang_id, near_dup, packing, substring_dedup
from quillspark.llm._common import materialize, table
from quillspark.session import delete_tables, scratch_scope, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_SHARE = 0.25

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = lang_id.fit_and_identify(docs.select(*COLUMNS))
    kept = found.where((F.col("language.lang_pred") != lang_id.UND) & (F.col("language.score") >= LEAST_SHARE))
    return kept.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", "text").alias("key"))
    classes = near_dup.near_duplicates(rows.select("key", "text"), id_col="key").withColumnRenamed("doc_id", "key").distinct()
    ids = rows.select("key", "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key"))
    kept = classes.join(ids, "key").groupBy("class_id").agg(first.alias("kept")).select("kept.key")
    one = rows.join(kept, "key", "left_semi").groupBy("key").agg(F.min(F.struct(*COLUMNS)).alias("row"))
    return one.select("row.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = substring_dedup.remove_repeats(docs.select(*COLUMNS))
    kept = found.where("dedup.n_words > dedup.n_removed")
    cut = F.col("dedup.n_removed") > 0
    return kept.select(
        "doc_id",
        F.when(cut, F.col("dedup.kept")).otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        F.when(cut, F.length("dedup.kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    found = decontaminate.find_contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contamination.contaminated")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return packing.pack_documents(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can express neither the language model nor the near-duplicate classes.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order.  A stage's intermediate tables go when its result is
    written, and that result when the next one's is."""
    docs, written = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        with scratch_scope(spark) as tables:
            docs = materialize(stage(spark, docs, sf_dir))
            own = tables.pop()
        delete_tables(spark, written)
        written = [own]
    return STAGES[-1][1](spark, docs, sf_dir)
