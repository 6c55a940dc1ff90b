"""Duplicates, consistency, ids and hashes of whole collections."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..model import ORD, Metadata

logger = logging.getLogger(__name__)


class DocumentConsistencyError(ValueError):
    """Two rows of one id differ in content or metadata."""


def _identity(meta: Metadata, content: str | None, *, with_id: bool) -> Column:
    """32 bytes instead of whole texts as the shuffle key; NULLs are equal."""
    parts = [F.col("id").isNull(), F.coalesce(F.col("id"), F.lit(""))] if with_id else []
    parts += [F.col(content).isNull(), F.coalesce(F.col(content), F.lit(""))] if content else []
    return F.unhex(F.sha2(F.to_json(F.struct(*[p.alias(f"c{i}") for i, p in enumerate([*parts, meta.canonical()])])), 256))


def deduplicate(df: DataFrame, meta: Metadata, *, content: str | None = "page_content", log: bool = False) -> DataFrame:
    """The first row of each (id, content, metadata).

    A grouped minimum, so duplicates are combined before the shuffle and a group
    that holds a third of all rows does not end up in one task.
    """
    cols = df.columns
    keyed = df.select(_identity(meta, content, with_id=True).alias("_key"), F.struct(*[F.col(c) for c in cols]).alias("_row"), F.col(ORD).alias("_o"))
    first = keyed.groupBy("_key").agg(F.min_by("_row", "_o").alias("_row")).select("_row.*")
    if log:
        n, k = df.count(), first.count()
        logger.info("removed %d duplicates of %d rows", n - k, n)
    return first


def duplicate_content_members(df: DataFrame, *, content: str = "page_content") -> DataFrame:
    """first (place of the group's first row), _ord, id: one row for each row whose
    content occurs more than once; nothing is gathered, so groups may be of any size."""
    keyed = df.select("id", ORD, F.unhex(F.sha2(F.encode(F.coalesce(F.col(content), F.lit("")), "UTF-8"), 256)).alias("_key"))
    groups = keyed.groupBy("_key").agg(F.count("*").alias("_n"), F.min(ORD).alias("first")).where("_n > 1")
    return keyed.join(groups, "_key").select("first", ORD, "id")


def duplicate_content_groups(df: DataFrame, *, content: str = "page_content") -> DataFrame:
    """ids (array, in order) and first (the group's first place) of each content
    that occurs more than once; NULL ids are kept.

    A group is one row by contract; :func:`duplicate_content_members` has no such
    bound.
    """
    rows = duplicate_content_members(df, content=content).groupBy("first").agg(F.array_sort(F.collect_list(F.struct(ORD, "id"))).alias("_rows"))
    return rows.select(F.transform("_rows", lambda r: r["id"]).alias("ids"), "first").orderBy("first")


def consistency_violations(df: DataFrame, meta: Metadata, *, content: str = "page_content") -> DataFrame:
    """id, n_variants, first_conflict (place of the first row that differs from its
    id's first row); rows without an id are left out."""
    keyed = df.where("id is not null").select("id", ORD, _identity(meta, content, with_id=False).alias("_key"))
    variants = keyed.groupBy("id", "_key").agg(F.min(ORD).alias("_first"))
    ranked = variants.withColumn("_at", F.row_number().over(Window.partitionBy("id").orderBy("_first")))
    return ranked.groupBy("id").agg(F.count("*").alias("n_variants"), F.min(F.when(F.col("_at") > 1, F.col("_first"))).alias("first_conflict")).where("n_variants > 1")


def check_consistency(df: DataFrame, meta: Metadata, *, content: str = "page_content", raise_error: bool = False) -> bool:
    """Whether all rows of each id agree.  Warns of each id that does not, or
    raises at the first."""
    bad = consistency_violations(df, meta, content=content).orderBy("first_conflict")
    if raise_error:
        first = bad.first()
        if first is not None:
            raise DocumentConsistencyError(f"rows with id {first.id!r} differ")
        return True
    ok = True
    for r in bad.toLocalIterator():
        ok = False
        logger.warning("rows with id %r differ (%d variants)", r.id, r.n_variants)
    return ok


def assign_ids(df: DataFrame, meta: Metadata, *, force: bool = False, content: str = "page_content", byte_parity: bool = False) -> DataFrame:
    """Content-derived ids where there is none (or everywhere).  With
    ``byte_parity`` the metadata is written as Python's json module does."""
    canonical = text.canonical_json(meta.canonical()) if byte_parity else meta.canonical()
    own = text.hash_document_uuid(F.col(content), canonical)
    return df.withColumn("id", own if force else F.coalesce(F.col("id"), own))


def copy_ids_to_metadata(df: DataFrame, meta: Metadata, key: str = "source_id") -> DataFrame:
    """Metadata ``key`` = id where there is one; replaces an old value."""
    if meta.kind == "columns":
        return df.withColumn(key, F.coalesce(F.col("id"), F.col(key)) if key in df.columns else F.col("id"))
    name = meta.names[0]
    if meta.kind == "map":
        rest = F.map_filter(F.coalesce(F.col(name), F.create_map().cast("map<string,string>")), lambda k, _: k != key)
        return df.withColumn(name, F.when(F.col("id").isNotNull(), F.map_concat(rest, F.create_map(F.lit(key), F.col("id")))).otherwise(F.col(name)))
    fields = F.from_json(F.coalesce(F.col(name), F.lit("{}")), "map<string,variant>")
    rest = F.map_filter(fields, lambda k, _: k != key)
    merged = F.to_json(F.map_concat(rest, F.create_map(F.lit(key), F.parse_json(F.to_json(F.col("id").cast("variant"))))))
    return df.withColumn(name, F.when(F.col("id").isNotNull(), merged).otherwise(F.col(name)))


def hash_documents(df: DataFrame, meta: Metadata, *, length: int = 64, content: str = "page_content") -> DataFrame:
    """One row ``digest``: of the rows' digests in order.  Digests are joined in
    ranges of the order first, so no task holds more than its range."""
    rows = df.select(ORD, text.hash_document(F.col(content), meta.canonical(), 128).alias("h"))
    blocks = rows.withColumn("_b", F.floor(F.col(ORD) / 10_000)).groupBy("_b").agg(F.array_sort(F.collect_list(F.struct(ORD, "h"))).alias("hs"))
    blocks = blocks.select("_b", F.sha2(F.encode(F.array_join(F.transform("hs", lambda x: x["h"]), ""), "UTF-8"), 512).alias("h"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_b", "h"))), lambda x: x["h"]), "")
    return blocks.agg(text.digest(joined, length).alias("digest"))
