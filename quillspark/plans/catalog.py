"""Queries over the driver's tables, each with the DuckDB SQL for the same rows."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chat, json_repair, text
from ..model import ORD, Metadata, as_documents
from ..operators import dedup, filters, formatting, frames, ordering, profile, stats, vectors
from ..session import materialize, scratch_dir, ship_package
from ..sources import ingest
from ..sources.store import StoreTable
from ..streaming import incremental
from . import pipeline, runs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DOC_META = Metadata.columns("lang", "source", "n_chars")
#: id, page_content and metadata of the documents table, in SQL.
_DOCS = "(SELECT CAST(doc_id AS VARCHAR) AS id, doc_id AS o, text AS page_content, lang, source, n_chars FROM documents)"
_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]*"
_LABELLED = f"(SELECT d.*, l.quality, l.toxic FROM {_DOCS} d LEFT JOIN labels l ON l.doc_id = d.o)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_documents(table(spark, sf_dir, "documents"), id_col="doc_id", content_col="text", order="doc_id")


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "labels")
    rows = docs(spark, sf_dir)
    return rows.join(marks, rows[ORD] == marks.doc_id, "left").drop("doc_id")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.select(F.col("event_id").cast("string").alias("id"), "event_type", "user_id", "value", "props", F.col("event_id").alias(ORD))


_MESSY = (("ok", "real content", "x"), ("empty", "", "x"), ("blank", "   \t\n", "x"), (None, "no id", "x"), ("bare", "content", None), ("null", None, "x"))


def messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and a few rows with gaps."""
    more = spark.createDataFrame([(i, c, None, s, None, -10 + k) for k, (i, c, s) in enumerate(_MESSY)], "id string, page_content string, lang string, source string, n_chars long, _ord long")
    return docs(spark, sf_dir).unionByName(more)


_MESSY_SQL = f"""(SELECT * FROM {_DOCS} UNION ALL SELECT * FROM (VALUES
  ('ok', -10, 'real content', NULL, 'x', NULL), ('empty', -9, '', NULL, 'x', NULL), ('blank', -8, '   ' || chr(9) || chr(10), NULL, 'x', NULL),
  (NULL, -7, 'no id', NULL, 'x', NULL), ('bare', -6, 'content', NULL, NULL, NULL), ('null', -5, NULL, NULL, 'x', NULL)))"""


# -- statistics ------------------------------------------------------------
def _stats_sql(source: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    pick = lambda p: f"min(len) FILTER (WHERE r - 1 = round_even({p} / 100.0 * (n - 1), 0))::INTEGER AS p{p}_chars"
    return f"""
WITH d AS (SELECT *, length(coalesce(page_content, '')) AS len FROM {source}),
r AS (SELECT *, row_number() OVER ({part} ORDER BY len, o) AS r, count(*) OVER ({part}) AS n FROM d)
SELECT {keys}count(*) AS count, sum(len)::BIGINT AS total_chars, round(avg(len), 6) AS avg_chars, round(stddev_pop(len), 6) AS std_dev_chars,
  min(len)::INTEGER AS min_chars, max(len)::INTEGER AS max_chars, arg_min(coalesce(id, 'none'), (len, o)) AS min_doc_id, arg_max(coalesce(id, 'none'), (len, -o)) AS max_doc_id,
  {pick(50)}, {pick(90)}, {pick(99)},
  count(*) FILTER (WHERE coalesce(page_content, '') = '') AS empty_count,
  count(*) FILTER (WHERE page_content <> '' AND regexp_full_match(page_content, '{_BLANK}')) AS whitespace_only_count,
  count(*) FILTER (WHERE page_content IS NULL) AS none_or_non_str_content_count,
  count(*) FILTER (WHERE id IS NULL) AS none_id_count,
  count(*) FILTER (WHERE lang IS NULL AND source IS NULL AND n_chars IS NULL) AS missing_metadata_count,
  count(*) - count(DISTINCT coalesce(page_content, '')) AS duplicate_count
FROM r {group}"""


def _stats(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    out = stats.content_stats_exact(df, meta=DOC_META, by=by).drop("duplicate_count_exact", "percentiles_exact")
    rounded = {c: F.round(c, 6) for c in ("avg_chars", "std_dev_chars")} | {c: F.coalesce(c, F.lit("none")) for c in ("min_doc_id", "max_doc_id")}
    return out.withColumns(rounded)


@query(_stats_sql(_DOCS))
def content_stats_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(docs(spark, sf_dir))


@query(_stats_sql(_MESSY_SQL))
def content_stats_messy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(messy(spark, sf_dir))


@query(_stats_sql(_DOCS, "lang"))
def content_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(docs(spark, sf_dir), ["lang"])


@query(_stats_sql(_DOCS, "source"))
def content_stats_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stats(docs(spark, sf_dir), ["source"])


@query(_stats_sql("(SELECT CAST(page_id AS VARCHAR) AS id, page_id AS o, html AS page_content, NULL AS lang, url AS source, NULL AS n_chars FROM pages)"))
def content_stats_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = as_documents(table(spark, sf_dir, "pages"), id_col="page_id", content_col="html", order="page_id")
    out = stats.content_stats_exact(pages, meta=Metadata.columns("url")).drop("duplicate_count_exact", "percentiles_exact")
    return out.withColumns({c: F.round(c, 6) for c in ("avg_chars", "std_dev_chars")})


@query()
def content_stats_approx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches; their exact fields are checked by content_stats_approx_exact_fields."""
    return stats.content_stats_approx(docs(spark, sf_dir), meta=DOC_META)


@query("SELECT count(*) AS count, sum(length(text))::BIGINT AS total_chars, round(avg(length(text)), 6) AS avg_chars, round(stddev_pop(length(text)), 6) AS std_dev_chars, min(length(text))::INTEGER AS min_chars, max(length(text))::INTEGER AS max_chars FROM documents")
def content_stats_approx_exact_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stats.content_stats_approx(docs(spark, sf_dir), meta=DOC_META)
    return out.select("count", "total_chars", F.round("avg_chars", 6).alias("avg_chars"), F.round("std_dev_chars", 6).alias("std_dev_chars"), "min_chars", "max_chars")


@query(ORACLE_SQL["content_stats_approx_exact_fields"])
def content_stats_approx_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three updates with the rows of the languages en, fr and the others."""
    state = stats.ApproxContentStats(meta=DOC_META)
    rows = docs(spark, sf_dir)
    for part in (F.col("lang") == "en", F.col("lang") == "fr", ~F.col("lang").isin("en", "fr")):
        state.update(rows.where(part))
    return state.result().select("count", "total_chars", F.round("avg_chars", 6).alias("avg_chars"), F.round("std_dev_chars", 6).alias("std_dev_chars"), "min_chars", "max_chars")


@query("SELECT length(text)::INTEGER AS len, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.length_histogram(docs(spark, sf_dir)).select("len", "n")


def _profile_sql(source: str, keys: dict[str, str], unit: str, n: int = 3) -> str:
    pairs = " UNION ALL ".join(f"SELECT o, '{k}' AS key, CAST({k} AS VARCHAR) AS value, '{t}' AS t FROM {source} WHERE {k} IS NOT NULL" for k, t in sorted(keys.items()))
    return f"""
WITH p AS ({pairs}), v AS (SELECT key, value, t, count(*) AS n, min(o) AS f FROM p GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY f) AS spot FROM v)
SELECT key, sum(n)::BIGINT AS present_in_{unit}, ((SELECT count(*) FROM {source}) - sum(n))::BIGINT AS missing_in_{unit}, min(t) AS value_types,
  (coalesce(sum(n) FILTER (WHERE value = ''), 0))::BIGINT AS none_or_empty_count,
  string_agg(value, '|' ORDER BY value) FILTER (WHERE spot <= {n}) AS unique_values_sample, count(*) > {n} AS unique_values_sample_truncated
FROM r GROUP BY key"""


def _profile(df: DataFrame, meta: Metadata, unit: str) -> DataFrame:
    return _profile_columns(profile.metadata_profile(df, meta, unit=unit))


def _profile_columns(out: DataFrame) -> DataFrame:
    return out.withColumns({"value_types": F.array_join("value_types", "/"), "unique_values_sample": F.array_join("unique_values_sample", "|", "None")})


@query(_profile_sql(_LABELLED, {"lang": "str", "source": "str", "n_chars": "int", "quality": "int", "toxic": "int"}, "docs"))
def metadata_profile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(labelled(spark, sf_dir), Metadata.columns("lang", "source", "n_chars", "quality", "toxic"), "docs")


@query(ORACLE_SQL["metadata_profile_documents"])
def metadata_profile_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same profile from four updates."""
    rows, meta = labelled(spark, sf_dir), Metadata.columns("lang", "source", "n_chars", "quality", "toxic")
    state = profile.MetadataProfile(meta)
    n = rows.agg(F.max(ORD)).first()[0] + 1
    for part in range(4):
        low, high = part * n // 4, (part + 1) * n // 4
        state.update(rows.where((F.col(ORD) >= low) & (F.col(ORD) < high)).withColumn(ORD, F.col(ORD) - low))
    return _profile_columns(state.result())


_EVENTS = "(SELECT CAST(event_id AS VARCHAR) AS id, event_id AS o, event_type, user_id, props, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


@query(_profile_sql(_EVENTS, {"event_type": "str", "user_id": "int"}, "records"))
def metadata_profile_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(records(spark, sf_dir), Metadata.columns("event_type", "user_id"), "records")


@query(_profile_sql(_EVENTS, {"k": "int"}, "records"))
def metadata_profile_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _profile(records(spark, sf_dir), Metadata.json("props"), "records")


@query(f"""WITH k AS (SELECT (lang IS NOT NULL)::INT + (source IS NOT NULL)::INT + (quality IS NOT NULL)::INT AS k FROM {_LABELLED})
SELECT count(*) AS count, count(*) FILTER (WHERE k = 0) AS missing_metadata_count, round(avg(k), 6) AS avg_keys, min(k)::INTEGER AS min_keys, max(k)::INTEGER AS max_keys, 3::BIGINT AS distinct_keys_seen FROM k""")
def metadata_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.metadata_overview(labelled(spark, sf_dir), Metadata.columns("lang", "source", "quality"))
    return out.withColumn("avg_keys", F.round("avg_keys", 6))


# -- lengths and emptiness -------------------------------------------------
@query("SELECT CAST(doc_id AS VARCHAR) AS id, length(text)::INTEGER AS length FROM documents")
def document_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select("id", text.length(F.col("page_content")).alias("length"))


def _place(df: DataFrame, *order: str) -> DataFrame:
    """The place of each row in its frame's order, as a column."""
    return df.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, length(text)::INTEGER AS length, row_number() OVER (ORDER BY length(text), doc_id) AS pos FROM documents")
def id_lengths_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in order."""
    return _sorted(ordering.document_id_lengths(docs(spark, sf_dir), sort=True), "length")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS length FROM documents ORDER BY length(text), doc_id LIMIT 1")
def shortest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.shortest_document(docs(spark, sf_dir)).select("id", F.length("page_content").cast("long").alias("length"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, length(text) AS length FROM documents ORDER BY length(text) DESC, doc_id LIMIT 1")
def longest_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.longest_document(docs(spark, sf_dir)).select("id", F.length("page_content").cast("long").alias("length"))


@query(f"SELECT id, length(page_content) AS length FROM {_MESSY_SQL} WHERE coalesce(page_content, '') <> '' AND NOT regexp_full_match(page_content, '{_BLANK}') ORDER BY length(page_content), o LIMIT 1")
def shortest_nonempty_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ordering.shortest_document(messy(spark, sf_dir), ignore_empty=True, treat_whitespace_as_empty=True)
    return rows.select("id", F.length("page_content").cast("long").alias("length"))


@query(f"SELECT id FROM {_MESSY_SQL} WHERE coalesce(page_content, '') = ''")
def empty_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.find_empty_document_ids(messy(spark, sf_dir))


@query(f"SELECT id FROM {_MESSY_SQL} WHERE coalesce(page_content, '') = '' OR regexp_full_match(page_content, '{_BLANK}')")
def empty_or_blank_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.find_empty_document_ids(messy(spark, sf_dir), treat_whitespace_as_empty=True)


@query(f"SELECT id FROM {_MESSY_SQL} WHERE page_content <> '' AND regexp_full_match(page_content, '{_BLANK}')")
def whitespace_only_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messy(spark, sf_dir).where(text.is_whitespace_only(F.col("page_content"))).select("id")


# -- filters ---------------------------------------------------------------
@query("SELECT CAST(doc_id AS VARCHAR) AS id, lang FROM documents WHERE lang = 'fr'")
def filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata(docs(spark, sf_dir), DOC_META, "lang", "fr").select("id", "lang")


@query(f"SELECT id FROM {_LABELLED} WHERE quality IS NULL")
def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata(labelled(spark, sf_dir), Metadata.columns("quality"), "quality", None).select("id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, n_chars FROM documents WHERE n_chars BETWEEN 500 AND 2000")
def filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata_range(docs(spark, sf_dir), DOC_META, "n_chars", 500, 2000).select("id", "n_chars")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, n_chars FROM documents WHERE n_chars >= 5000")
def filter_range_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata_range(docs(spark, sf_dir), DOC_META, "n_chars", lower=5000).select("id", "n_chars")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, n_chars FROM documents WHERE n_chars <= 300")
def filter_range_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata_range(docs(spark, sf_dir), DOC_META, "n_chars", upper=300).select("id", "n_chars")


@query(f"SELECT id FROM {_LABELLED} WHERE toxic IS NOT NULL")
def filter_range_unbounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata_range(labelled(spark, sf_dir), Metadata.columns("toxic"), "toxic").select("id")


@query(f"SELECT 'quality is True' AS filter, id FROM {_LABELLED} WHERE quality = 1 UNION ALL SELECT 'toxic in (''1'', 0.0)', id FROM {_LABELLED} WHERE toxic = 0")
def filter_by_python_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Booleans and numbers compare by value; strings equal no number, numbers no string."""
    rows, meta = labelled(spark, sf_dir), Metadata.columns("lang", "source", "n_chars", "quality", "toxic")
    found = {
        "quality is True": filters.filter_by_metadata(rows, meta, "quality", True),
        "toxic in ('1', 0.0)": filters.filter_by_metadata_values(rows, meta, "toxic", ["1", 0.0]),
        "source is 1": filters.filter_by_metadata(rows, meta, "source", 1),
        "n_chars is a string": filters.filter_by_metadata_range(rows, meta, "n_chars", "0"),
    }
    parts = [df.select(F.lit(k).alias("filter"), "id") for k, df in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT CAST(doc_id AS VARCHAR) AS id, source FROM documents WHERE source IN ('src1', 'src7', 'src19')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata_values(docs(spark, sf_dir), DOC_META, "source", {"src1", "src7", "src19"}).select("id", "source")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) = 7")
def record_filter_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata(records(spark, sf_dir), Metadata.json("props"), "k", 7).select("id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 10 AND 20")
def record_filter_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata_range(records(spark, sf_dir), Metadata.json("props"), "k", 10, 20).select("id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) IN (1, 50, 99)")
def record_filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filters.filter_by_metadata_values(records(spark, sf_dir), Metadata.json("props"), "k", {1, 50, 99}).select("id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_type = (SELECT min(event_type) FROM events)")
def record_filter_values_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted values come from a query: a semi join."""
    wanted = table(spark, sf_dir, "events").agg(F.min("event_type").alias("v"))
    return filters.filter_by_metadata_values(records(spark, sf_dir), Metadata.columns("event_type"), "event_type", wanted).select("id")


# -- order -----------------------------------------------------------------
def _sorted_sql(where: str, order: str) -> str:
    return f"SELECT id, row_number() OVER (ORDER BY {order}) AS pos FROM {_LABELLED} {where}"


def _sorted(df: DataFrame, *also: str) -> DataFrame:
    """A sorted frame with each row's place: its partition's offset and the row within it.
    It is sorted once and written: a second sort may be dealt over other partitions."""
    parts = materialize(df.select("id", *also, F.monotonically_increasing_id().alias("_m")))
    parts = parts.select("id", *also, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_r"))
    counts = parts.groupBy("_p").agg(F.count("*").alias("n"))

    offsets = counts.select("_p", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return parts.join(F.broadcast(offsets), "_p").select("id", *also, (F.col("_before") + F.col("_r") + 1).alias("pos"))  # one row a partition


@query(_sorted_sql("", "quality IS NULL, quality, o"))
def sort_by_metadata_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(ordering.sort_by_metadata(labelled(spark, sf_dir), Metadata.columns("quality"), "quality"))


@query(_sorted_sql("", "quality IS NULL, quality DESC, o"))
def sort_by_metadata_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(ordering.sort_by_metadata(labelled(spark, sf_dir), Metadata.columns("quality"), "quality", reverse=True))


@query(_sorted_sql("WHERE quality IS NOT NULL", "quality, o"))
def sort_by_metadata_drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sorted(ordering.sort_by_metadata(labelled(spark, sf_dir), Metadata.columns("quality"), "quality", keep_missing=False))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders")
def sort_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), "o_totalprice", F.col("o_orderkey").alias(ORD))
    return _sorted(ordering.sort_by_key(rows, "o_totalprice", reverse=True))


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents ORDER BY doc_id LIMIT 25")
def first_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.first_n(docs(spark, sf_dir), 25).select("id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents ORDER BY doc_id DESC LIMIT 25")
def last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.last_n(docs(spark, sf_dir), 25).select("id")


@query("SELECT CAST(doc_id AS VARCHAR) AS id FROM documents")
def shuffle_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows; the order is checked by tests."""
    return ordering.shuffle(docs(spark, sf_dir), 42).select("id")


@query("SELECT least(count(*), 100) AS n FROM documents")
def sample_n_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.sample_n(docs(spark, sf_dir), 100, seed=1).agg(F.count("*").alias("n"))


# -- duplicates, ids, hashes -----------------------------------------------
@query("SELECT min(doc_id) AS first, text, lang FROM documents GROUP BY text, lang, source, n_chars")
def dedup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without ids, so that equal documents meet."""
    rows = docs(spark, sf_dir).withColumn("id", F.lit(None).cast("string"))
    return dedup.deduplicate(rows, DOC_META).select(F.col(ORD).alias("first"), F.col("page_content").alias("text"), "lang")


@query("SELECT count(*) - count(DISTINCT (role, text)) AS removed FROM conversations")
def dedup_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.lit(None).cast("string").alias("id"), F.col("text").alias("page_content"), "role", (F.col("conv_id") * 1000 + F.col("turn")).alias(ORD))
    kept = dedup.deduplicate(rows, Metadata.columns("role")).agg(F.count("*").alias("k"))
    return rows.agg(F.count("*").alias("n")).crossJoin(kept).select((F.col("n") - F.col("k")).alias("removed"))  # one row with one row


@query("SELECT string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS ids, min(doc_id) AS first FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_content_groups(docs(spark, sf_dir)).select(F.array_join("ids", ",").alias("ids"), "first")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, first FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, count(*) OVER (PARTITION BY text) AS n FROM documents) WHERE n > 1")
def duplicate_content_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_content_members(docs(spark, sf_dir)).select("id", "first")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 2::BIGINT AS n_variants FROM documents WHERE doc_id % 50 = 3")
def consistency_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and a copy in which the ids 3, 53, ... have another content."""
    rows = docs(spark, sf_dir)
    copy = rows.withColumn("page_content", F.when(F.col(ORD) % 50 == 3, F.concat("page_content", F.lit("!"))).otherwise(F.col("page_content"))).withColumn(ORD, F.col(ORD) + 10**9)
    return dedup.consistency_violations(rows.unionByName(copy), DOC_META).select("id", "n_variants")


_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
_NS = text.ID_NAMESPACE.replace("-", "")


@query(f"""WITH x AS (SELECT doc_id, sha1(unhex('{_NS}') || encode(text || '{{"lang":"' || lang || '","n_chars":' || n_chars || ',"source":"' || source || '"}}')) AS h FROM documents)
SELECT doc_id, {_UUID} AS id FROM x""")
def uuid5_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("id", F.lit(None).cast("string"))
    return dedup.assign_ids(rows, DOC_META).select(F.col(ORD).alias("doc_id"), "id")


@query(f"""WITH x AS (SELECT doc_id, sha1(unhex('{_NS}') || encode(text || '{{"lang": "' || lang || '", "n_chars": ' || n_chars || ', "source": "' || source || '"}}')) AS h FROM documents)
SELECT doc_id, {_UUID} AS id FROM x""")
def uuid5_ids_byte_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids over the metadata as Python's json module writes it."""
    rows = docs(spark, sf_dir).withColumn("id", F.lit(None).cast("string"))
    return dedup.assign_ids(rows, DOC_META, byte_parity=True).select(F.col(ORD).alias("doc_id"), "id")


@query(f"""WITH x AS (SELECT event_id, sha1(unhex('{_NS}') || encode('{{"k": ' || json_extract_string(props, '$.k') || '}}')) AS h FROM events)
SELECT event_id, {_UUID} AS id FROM x""")
def record_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select(F.col(ORD).alias("event_id"), text.hash_dict_uuid(text.canonical_json(F.col("props"))).alias("id"))


@query("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docs(spark, sf_dir).select(F.col(ORD).alias("doc_id"), F.sha2(F.encode("page_content", "UTF-8"), 256).alias("digest"))


@query()
def collection_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One digest of the ordered collection (SHA-512, which the SQL engine lacks)."""
    return dedup.hash_documents(docs(spark, sf_dir), DOC_META)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, CAST(doc_id AS VARCHAR) AS source_id, lang FROM documents")
def copy_ids_to_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.copy_ids_to_metadata(docs(spark, sf_dir), DOC_META).select("id", "source_id", "lang")


# -- formatting ------------------------------------------------------------
#: All documents, a hundred ids to a text, numbered anew in each.
_PARTS = f"(SELECT *, o // 100 AS part, row_number() OVER (PARTITION BY o // 100 ORDER BY o) AS i FROM {_DOCS})"


def _in_parts(spark: SparkSession, sf_dir: str, output_format: str) -> DataFrame:
    rows = docs(spark, sf_dir).withColumn("part", F.expr(f"{ORD} div 100"))
    return formatting.format_documents(rows, Metadata.columns("lang", "source"), output_format, by=["part"])


@query(f"""SELECT part, string_agg('<document id="' || i || '">' || chr(10) || 'lang: ' || lang || chr(10) || 'source: ' || source || chr(10) || chr(10) || page_content || chr(10) || '</document>', chr(10) || chr(10) ORDER BY i) AS text FROM {_PARTS} GROUP BY part""")
def format_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_parts(spark, sf_dir, "xml")


@query(f"""SELECT part, string_agg('## Document ' || i || chr(10) || chr(10) || '- lang: ' || lang || chr(10) || '- source: ' || source || chr(10) || chr(10) || page_content, chr(10) || chr(10) ORDER BY i) AS text FROM {_PARTS} GROUP BY part""")
def format_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_parts(spark, sf_dir, "markdown")


@query(f"""SELECT part, '[' || chr(10) || string_agg('  {{' || chr(10) || '    "id": ' || i || ',' || chr(10) || '    "metadata": {{' || chr(10) || '      "lang": "' || lang || '",' || chr(10) || '      "source": "' || source || '"' || chr(10) || '    }},' || chr(10) || '    "content": ' || CAST(to_json(page_content) AS VARCHAR) || chr(10) || '  }}', ',' || chr(10) ORDER BY i) || chr(10) || ']' AS text FROM {_PARTS} GROUP BY part""")
def format_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _in_parts(spark, sf_dir, "json")


@query("""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations)
SELECT conv_id, string_agg('<document id="' || i || '">' || chr(10) || text || chr(10) || '</document>', chr(10) || chr(10) ORDER BY i) AS text FROM t GROUP BY conv_id""")
def format_by_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("page_content"), F.col("turn").alias(ORD))
    return formatting.format_documents_as_xml(rows, by=["conv_id"])


# -- stores ----------------------------------------------------------------
_TYPED = {"lang": "VARCHAR", "source": "VARCHAR"}


def _store(spark: SparkSession, sf_dir: str, **options: object) -> StoreTable:
    """A store with all documents and then, upserted, new contents for every 50th."""
    store = StoreTable.in_memory(spark, **options)
    rows = docs(spark, sf_dir)
    store.add(rows)
    store.add(rows.where(F.col(ORD) % 50 == 0).withColumn("page_content", F.concat(F.lit("new "), "page_content")))
    return store


_UPSERTED = f"(SELECT id, o, CASE WHEN o % 50 = 0 THEN 'new ' || page_content ELSE page_content END AS page_content, lang, source, n_chars FROM {_DOCS})"


@query(f"SELECT id, page_content, lang, source, '{{\"n_chars\":' || n_chars || '}}' AS extra FROM {_UPSERTED}")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, metadata_schema=_TYPED).all()


@query(f"SELECT count(*) AS n FROM {_UPSERTED}")
def store_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).all().agg(F.count("*").alias("n"))


@query(f"""WITH q(pos, id) AS (VALUES (0, '7'), (1, 'nowhere'), (2, '50'), (3, '7')) SELECT q.pos::BIGINT AS pos, q.id, d.page_content FROM q LEFT JOIN {_UPSERTED} d ON d.id = q.id""")
def store_get_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).get_many(["7", "nowhere", "50", "7"]).select("pos", "id", "page_content")


@query("""WITH q(pos, id) AS (VALUES (0, '7'), (1, 'nowhere'), (2, '50'), (3, '7'), (4, 'gone')) SELECT q.pos::BIGINT AS pos, q.id, q.id IN (SELECT CAST(doc_id AS VARCHAR) FROM documents) AS found FROM q""")
def store_check_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, missing = _store(spark, sf_dir).check_ids(["7", "nowhere", "50", "7", "gone"])
    return found.withColumn("found", F.lit(True)).unionByName(missing.withColumn("found", F.lit(False)))


@query(f"SELECT id FROM {_DOCS} WHERE o % 3 <> 0")
def store_delete_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark, sf_dir)
    store.delete_many(docs(spark, sf_dir).where(F.col(ORD) % 3 == 0).select("id"))
    return store.all().select("id")


@query(f"SELECT id FROM {_DOCS} WHERE lang = 'de' AND source = 'src3'")
def store_filter_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir, metadata_schema=_TYPED).filter(lang="de", source="src3").select("id")


@query(f"SELECT id FROM {_DOCS} WHERE lang = 'en' AND n_chars = (SELECT n_chars FROM documents WHERE doc_id = 1)")
def store_filter_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = docs(spark, sf_dir).where(F.col(ORD) == 1).first()["n_chars"]
    return _store(spark, sf_dir, metadata_schema=_TYPED).filter(lang="en", n_chars=n).select("id")


@query(f"SELECT id FROM {_DOCS} WHERE lang = 'es'")
def store_filter_untyped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _store(spark, sf_dir).filter(lang="es").select("id")


@query("SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE json_extract_string(props, '$.k') = '42'")
def record_store_filter_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = StoreTable.in_memory(spark, kind="record")
    store.add(records(spark, sf_dir).select("id", F.col("props").alias("metadata"), ORD))
    return store.filter(mode="text", k=42).select("id")


@query("SELECT * FROM (VALUES ('id', 'string'), ('page_content', 'string'), ('lang', 'string'), ('source', 'string'), ('extra', 'string')) t(name, type)")
def store_columns_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    info = StoreTable.in_memory(spark, metadata_schema=_TYPED).get_columns_info()
    return spark.createDataFrame(list(info.items()), "name string, type string")


@query("SELECT batch, count(*) AS n FROM (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 32 AS batch FROM documents) GROUP BY batch")
def iter_batches_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches are read on the driver, as the operator is meant."""
    sizes = [(i, len(b)) for i, b in enumerate(_store(spark, sf_dir).iter_batches(32))]
    return spark.createDataFrame(sizes, "batch long, n long")


# -- pipelines and runs ----------------------------------------------------
def _declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = {"_target_": "metadata.columns", "_args_": ["lang", "n_chars"]}
    steps = [
        {"_target_": "processor.filter_by_metadata", "meta": meta, "key": "lang", "value": "en"},
        {"_target_": "processor.filter_by_metadata_range", "meta": meta, "key": "n_chars", "lower": 1000},
        {"_target_": "processor.sort_by_key", "key": "n_chars", "reverse": True},
    ]
    config = {"_target_": "ingestor.processor", "source": {"_target_": "ingestor.table", "path": f"{sf_dir}/documents.parquet", "order": "doc_id"}, "processor": {"_target_": "processor.sequential", "_args_": steps}}
    rows = pipeline.default_registry(spark).resolve(config, ingest.Ingestor).ingest()
    return rows.select(F.col("doc_id").cast("string").alias("id"), "n_chars")


@query("SELECT CAST(doc_id AS VARCHAR) AS id, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE lang = 'en' AND n_chars >= 1000")
def declarative_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source and processors from one configuration; every row, with its place."""
    return _sorted(_declared(spark, sf_dir), "n_chars")


@query("SELECT doc_id, len(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '[ \\t\\n\\r]+')) AS n_words FROM documents WHERE lang <> 'de'")
def sequence_processor_skip_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Python function for each row; its errors (all of one language) skip rows."""

    def count(row: dict) -> dict:
        if row["lang"] == "de":
            raise ValueError("not this one")
        return {"doc_id": row["doc_id"], "n_words": len(row["text"].split())}

    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return pipeline.SequenceProcessor(count, "doc_id long, n_words long", raise_on_error=False).process(rows)


@query("SELECT conv_id, turn, '<' || text || '>' AS output FROM conversations")
def cache_hits_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the calls first, then all: the second run makes the missing ones only."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    cached = runs.CachingRun(runs.Run(lambda s: f"<{s}>"), runs.CacheTable(spark))
    cached.transform(rows.where("conv_id % 2 = 0"), "text")
    return cached.transform(rows, "text").select("conv_id", "turn", "output")


def _recorded(spark: SparkSession, rows: DataFrame) -> DataFrame:
    store = StoreTable.in_memory(spark, kind="record")
    run = runs.RecordingRun(runs.Run(lambda s: str(len(s))), store, extra={"checked": "yes"})
    run.transform(rows, "text")
    field = lambda k: F.get_json_object("metadata", f"$.{k}").alias(k)
    return store.all().select(field("input"), field("output"), field("checked"))


@query("SELECT text AS input, CAST(length(text) AS VARCHAR) AS output, 'yes' AS checked FROM conversations")
def recorded_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of all roles."""
    return _recorded(spark, table(spark, sf_dir, "conversations"))


@query("SELECT conv_id, turn, text AS input, length(text)::VARCHAR AS output FROM conversations")
def input_output_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return runs.InputOutputRun(runs.Run(lambda s: str(len(s)))).transform(rows, "text").select("conv_id", "turn", "pair.input", "pair.output")


# -- chat ------------------------------------------------------------------
@query("""WITH c AS (SELECT conv_id, bool_or(role = 'system') AS has, count(*) AS n, arg_min(role, turn) AS first_role FROM conversations GROUP BY conv_id)
SELECT conv_id, n + CASE WHEN has THEN 0 ELSE 1 END AS n_messages, CASE WHEN has THEN first_role ELSE 'system' END AS first_role FROM c""")
def chat_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    messages = F.transform(turns, lambda t: chat.message(t["role"], t["content"]))
    grouped = rows.groupBy("conv_id").agg(messages.alias("m"))
    out = grouped.withColumn("m", chat.coerce_messages(F.col("m"), "Answer briefly."))
    return out.select("conv_id", F.size("m").cast("long").alias("n_messages"), F.element_at("m", 1)["role"].alias("first_role"))


@query("SELECT conv_id, turn, 'Answer briefly.' AS system, text AS user FROM conversations WHERE role = 'user'")
def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    out = rows.withColumn("m", chat.build_messages("Answer briefly.", F.col("text")))
    return out.select("conv_id", "turn", F.col("m")[0]["content"].alias("system"), F.col("m")[1]["content"].alias("user"))


@query("SELECT conv_id, coalesce(sum(turn) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS input_tokens, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS output_tokens, coalesce(sum(turn + length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS total_tokens FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant') > 0")
def token_usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumns({"input_tokens": F.col("turn"), "output_tokens": F.length("text"), "total_tokens": F.col("turn") + F.length("text")})
    return chat.token_usage(rows, by=["conv_id"])


@query("SELECT '[tokens] in=' || format('{:,}', count(*)) || ' | out=' || format('{:,}', sum(length(text))::BIGINT) || ' | total=' || format('{:,}', (count(*) + sum(length(text)))::BIGINT) AS usage FROM documents")
def token_usage_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = table(spark, sf_dir, "documents").agg(F.count("*").alias("input_tokens"), F.sum(F.length("text")).alias("output_tokens"), (F.count("*") + F.sum(F.length("text"))).alias("total_tokens"))
    return totals.select(chat.format_usage(F.struct(*chat.USAGE)).alias("usage"))


# -- JSON, frames, vectors, streams ----------------------------------------
@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN 1 WHEN event_id % 3 = 1 THEN 2 ELSE 3 END AS attempt FROM events")
def json_repair_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean or fenced objects, trailing commas, and objects within prose."""
    props = F.col("props")
    comma = F.regexp_replace(props, r"\}$", ", }")
    said = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), props, F.lit("\n```"))).when(F.col("event_id") % 3 == 1, comma).otherwise(F.concat(F.lit("Here: "), comma, F.lit(" as wanted.")))
    rows = table(spark, sf_dir, "events").select("event_id", said.alias("said"))
    out = json_repair.parse_structured(rows, "said", "k bigint", out="p")
    return out.select("event_id", F.col("p.k").alias("k"), F.col("p_attempt").alias("attempt"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 2 = 1 AS used_fallback, event_id AS input_tokens FROM events")
def structured_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that gives a native value for even events and JSON within a fence for the others."""

    def model(messages: list[dict]) -> dict:
        event, props = messages[-1]["content"].split(" ", 1)
        native = {"parsed": json.loads(props)} if int(event) % 2 == 0 else {}
        return {"content": f"```json\n{props}\n```", "usage_metadata": {"input_tokens": int(event)}} | native

    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_id", "props").alias("said"))
    out = runs.structured_calls(rows, "said", model, "k bigint", system_prompt="Answer in JSON.")
    return out.select("event_id", F.col("parsed.k").alias("k"), "used_fallback", "input_tokens")


@query("SELECT doc_id, sum(length(text)) OVER (ORDER BY doc_id)::BIGINT AS total_input_tokens, count(*) OVER (ORDER BY doc_id) AS total_output_tokens FROM documents")
def accumulated_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("input_tokens"), F.lit(1).alias("output_tokens"), F.lit(None).cast("int").alias("total_tokens"))
    return runs.accumulated_usage(rows, "doc_id").select("doc_id", "total_input_tokens", "total_output_tokens")


@query("SELECT unnest(['doc_id', 'text', 'lang', 'source', 'n_chars']) AS col UNION ALL SELECT 'rare' WHERE EXISTS (FROM documents WHERE doc_id % 97 = 3) UNION ALL SELECT 'shorter' WHERE EXISTS (FROM documents WHERE length(text) < 0)")
def drop_null_cols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with three more columns, null everywhere, nearly everywhere and everywhere."""
    more = {"nothing": F.lit(None).cast("string"), "rare": F.when(F.col("doc_id") % 97 == 3, "x"), "shorter": F.when(F.length("text") < 0, 1)}
    rows = table(spark, sf_dir, "documents").withColumns(more)
    return spark.createDataFrame([(c,) for c in frames.drop_null_columns(rows).columns], "col string")


@query("SELECT vec_id AS id, len(embedding)::INTEGER AS dimension FROM embeddings ORDER BY vec_id LIMIT 5")
def embeddings_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.inspect_embeddings(table(spark, sf_dir, "embeddings"), 5, id_col="vec_id").select("id", "dimension")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]), 6) AS score FROM embeddings ORDER BY list_cosine_similarity(embedding::DOUBLE[], (SELECT e FROM q)::DOUBLE[]) DESC, vec_id LIMIT 10""")
def knn_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    query_vector = rows.where("vec_id = 0").first()["embedding"]
    return vectors.nearest(rows, query_vector, 10, id_col="vec_id").select(F.col("vec_id").alias("id"), F.round("score", 6).alias("score"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS chunk, substr(text, (s + 1)::INTEGER, 500) AS page_content FROM (SELECT doc_id, text, unnest(range(0, greatest(length(text) - 50, 1), 450)) AS s FROM documents)")
def split_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.split_text(docs(spark, sf_dir), chunk_size=500, overlap=50).select("id", "chunk", "page_content")


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    folder = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return spark.readStream.schema(rows.schema).parquet(folder).withColumnsRenamed({"text": "page_content"})


def _drain(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All rows of a stream that has come to its end, as a table in the shared folder."""
    base = f"{scratch_dir(spark)}/sink-{uuid.uuid4().hex}"

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{base}/rows")

    done = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


@query("SELECT count(DISTINCT text) AS n FROM documents")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drain(spark, incremental.stream_dedup(_stream(spark, sf_dir)), "append").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS count, sum(length(text))::BIGINT AS total_chars, min(length(text))::INTEGER AS min_chars, max(length(text))::INTEGER AS max_chars FROM documents GROUP BY lang")
def stream_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _drain(spark, incremental.stream_content_stats(_stream(spark, sf_dir), by=["lang"]), "complete")
    return rows.select("lang", "count", "total_chars", "min_chars", "max_chars")


@query("""WITH r AS (SELECT length(text) AS len, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS n FROM documents)
SELECT min(len) FILTER (WHERE r - 1 = round_even(0.5 * (n - 1), 0))::INTEGER AS p50_chars, min(len) FILTER (WHERE r - 1 = round_even(0.9 * (n - 1), 0))::INTEGER AS p90_chars, min(len) FILTER (WHERE r - 1 = round_even(0.99 * (n - 1), 0))::INTEGER AS p99_chars FROM r""")
def stream_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.percentiles_of(_drain(spark, incremental.stream_length_histogram(_stream(spark, sf_dir)), "complete"))


@query("SELECT conv_id, string_agg(coalesce(text, ''), '' ORDER BY turn) AS output, count(*) AS n_chunks FROM conversations GROUP BY conv_id")
def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's turns as chunks that come in three micro-batches."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "text")
    base = f"{scratch_dir(spark)}/chunks-{uuid.uuid4().hex}"
    for part in range(3):
        rows.where(F.col("turn") % 3 == part).coalesce(1).write.mode("append").parquet(f"{base}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{base}/out")

    incremental.stream_chunks(stream, put, f"{base}/checkpoint", run_id="conv_id", seq="turn", chunk="text").awaitTermination()
    seen = spark.read.schema("conv_id long, output string, n_chunks long, epoch int").parquet(f"{base}/out")
    latest = F.max_by(F.struct("output", "n_chunks"), "epoch").alias("r")  # the sink keeps a run's latest row
    return seen.groupBy("conv_id").agg(latest).select("conv_id", "r.*")


@query(f"SELECT id FROM {_DOCS}")
def stream_store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = StoreTable.in_memory(spark)
    rows = _stream(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), "page_content", "lang", F.col("doc_id").alias(ORD))
    incremental.stream_to_store(rows, store, f"{scratch_dir(spark)}/{uuid.uuid4().hex}").awaitTermination()
    return store.all().select("id")


@query("SELECT 'documents' AS source, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def mapping_ingestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, key: ingest.ProcessorIngestor(ingest.TableIngestor(spark, f"{sf_dir}/{name}.parquet"), lambda df: df.select(F.col(key).alias("id")))
    both = ingest.MappingIngestor({"documents": one("documents", "doc_id"), "pages": one("pages", "page_id")})
    return both.union().groupBy("source").agg(F.count("*").alias("n"))

