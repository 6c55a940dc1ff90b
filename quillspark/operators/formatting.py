"""Documents joined into one XML, Markdown or JSON text (per collection or group)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..model import ORD, Metadata


def _lines(meta: Metadata, prefix: str) -> Column:
    """``key: value`` lines, keys sorted, absent keys left out."""
    if meta.kind == "columns":
        entries = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{prefix}{c}: "), F.col(c).cast("string"))) for c in sorted(meta.names)]
        return F.concat_ws("\n", *entries) if entries else F.lit("")
    own = F.col(meta.names[0]) if meta.kind == "map" else F.from_json(F.col(meta.names[0]), "map<string,string>")
    entries = F.array_sort(F.map_entries(own))
    return F.array_join(F.transform(entries, lambda e: F.concat(F.lit(prefix), e["key"], F.lit(": "), F.coalesce(e["value"].cast("string"), F.lit("None")))), "\n")


def _numbered(df: DataFrame, by: list[str]) -> DataFrame:
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy(ORD)))


def _joined(rows: DataFrame, by: list[str], block: Column) -> DataFrame:
    blocks = rows.select(*by, "_i", block.alias("_block"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_block"))), lambda x: x["_block"]), "\n\n")
    return blocks.groupBy(*by).agg(text.alias("text")) if by else blocks.agg(text.alias("text"))


def _body(df: DataFrame, meta: Metadata | None, content: str, prefix: str) -> Column:
    own = F.coalesce(F.col(content), F.lit(""))
    if meta is None:
        return own
    lines = _lines(meta, prefix)
    return F.when(F.coalesce(lines, F.lit("")) == "", own).otherwise(F.concat(lines, F.lit("\n\n"), own))


def format_documents_as_xml(df: DataFrame, meta: Metadata | None = None, *, by: list[str] | None = None, content: str = "page_content") -> DataFrame:
    """Blocks ``<document id="i">`` in order; metadata only if ``meta`` is given.
    The text is one value a group by contract."""
    by = by or []
    block = F.concat(F.lit('<document id="'), F.col("_i").cast("string"), F.lit('">\n'), _body(df, meta, content, ""), F.lit("\n</document>"))
    return _joined(_numbered(df, by), by, block)


def format_documents_as_markdown(df: DataFrame, meta: Metadata | None = None, *, by: list[str] | None = None, content: str = "page_content") -> DataFrame:
    by = by or []
    block = F.concat(F.lit("## Document "), F.col("_i").cast("string"), F.lit("\n\n"), _body(df, meta, content, "- "))
    return _joined(_numbered(df, by), by, block)


def _json_string(c: Column) -> Column:
    """A quoted JSON string (non-ASCII characters stay as they are)."""
    return F.to_json(F.array(F.coalesce(c, F.lit(""))))


def format_documents_as_json(df: DataFrame, meta: Metadata | None = None, *, by: list[str] | None = None, content: str = "page_content") -> DataFrame:
    """An array of objects with id, metadata (if given and not empty) and content,
    indented by two spaces; ``[]`` without documents."""
    by = by or []
    quoted = lambda c: F.regexp_replace(_json_string(c), r"^\[|\]$", "")
    parts = [F.concat(F.lit('    "id": '), F.col("_i").cast("string"))]
    if meta is not None:
        if meta.kind == "columns":
            kinds = dict(df.dtypes)
            one = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'      "{c}": '), quoted(F.col(c)) if kinds[c] == "string" else F.to_json(F.array(F.col(c))).substr(F.lit(2), F.length(F.to_json(F.array(F.col(c)))) - 2)))
            fields = F.concat_ws(",\n", *[one(c) for c in sorted(meta.names)])
        else:
            own = F.from_json(F.to_json(F.col(meta.names[0])) if meta.kind == "map" else F.col(meta.names[0]), "map<string,variant>")
            fields = F.array_join(F.transform(F.array_sort(F.map_keys(own)), lambda k: F.concat(F.lit("      "), quoted(k), F.lit(": "), F.to_json(F.element_at(own, k)))), ",\n")
        parts.append(F.when(F.coalesce(fields, F.lit("")) != "", F.concat(F.lit('    "metadata": {\n'), fields, F.lit("\n    }"))))
    parts.append(F.concat(F.lit('    "content": '), quoted(F.col(content))))
    block = F.concat(F.lit("  {\n"), F.concat_ws(",\n", *parts), F.lit("\n  }"))
    blocks = _numbered(df, by).select(*by, "_i", block.alias("_block"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_block"))), lambda x: x["_block"]), ",\n")
    text = F.when(listed == "", F.lit("[]")).otherwise(F.concat(F.lit("[\n"), listed, F.lit("\n]")))
    return blocks.groupBy(*by).agg(text.alias("text")) if by else blocks.agg(text.alias("text"))


def format_documents(df: DataFrame, meta: Metadata | None = None, output_format: str = "xml", *, by: list[str] | None = None, content: str = "page_content") -> DataFrame:
    formats = {"xml": format_documents_as_xml, "markdown": format_documents_as_markdown, "json": format_documents_as_json}
    if output_format not in formats:
        raise ValueError(f"unknown output format {output_format!r}; known: {sorted(formats)}")
    return formats[output_format](df, meta, by=by, content=content)
