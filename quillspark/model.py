"""Collections: rows with an order, and metadata behind one accessor.

A document has ``id``, ``page_content`` and metadata, a record ``id`` and metadata.
Results keep the order of the input, which lives in the column ``_ord``: taken
from a monotone key where there is one, else assigned once on reading.

Metadata comes in three layouts, told apart by :class:`Metadata`:

* ``Metadata.columns(...)``: typed columns; NULL counts as an absent key;
* ``Metadata.map(col)``: a MAP<STRING, T> column;
* ``Metadata.json(col)``: a STRING column with one JSON object; keeps the JSON
  types apart and an absent key from a null value.
"""

from __future__ import annotations

import datetime
import json
from collections.abc import Iterable
from dataclasses import dataclass
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ORD = "_ord"
_NUMBERS = r"^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL.*)$"


def with_order(df: DataFrame, key: str | Column | None = None) -> DataFrame:
    """``df`` with ``_ord``: a monotone ``key``, or the order of the partitions."""
    if ORD in df.columns:
        return df
    return df.withColumn(ORD, F.monotonically_increasing_id() if key is None else F.col(key) if isinstance(key, str) else key)


def as_documents(df: DataFrame, *, id_col: str, content_col: str, order: str | None = None) -> DataFrame:
    """Rename to ``id`` (string) and ``page_content``; other columns stay."""
    others = [c for c in df.columns if c not in (id_col, content_col)]
    out = df.select(F.col(id_col).cast("string").alias("id"), F.col(content_col).alias("page_content"), *others, *([F.col(order).alias(ORD)] if order else []))
    return with_order(out)


def json_path(key: str) -> str:
    """A JSON path to one literal key; dots are no separators."""
    return '$["' + key.replace("\\", "\\\\").replace('"', '\\"') + '"]'


def _class_of(kind: T.DataType) -> str:
    """Which Python values a column of this type can equal."""
    if isinstance(kind, T.BooleanType):
        return "truth"
    if isinstance(kind, T.NumericType):
        return "number"
    return "text" if isinstance(kind, T.StringType) else kind.typeName()


def _class_of_value(value: Any) -> str:
    if isinstance(value, bool):
        return "truth"
    if isinstance(value, int | float | Decimal):
        return "number"
    names = {str: "text", datetime.datetime: "timestamp", datetime.date: "date", bytes: "binary", bytearray: "binary", list: "array", tuple: "array"}
    return next((n for k, n in names.items() if isinstance(value, k)), "other")


def comparable(a: T.DataType, b: T.DataType) -> bool:
    """Whether values of two column types can be equal."""
    alike = {"truth": "number", "timestamp_ntz": "timestamp"}
    x, y = (alike.get(_class_of(k), _class_of(k)) for k in (a, b))
    return x == y


def as_literal(kind: T.DataType, value: Any) -> Any:
    """``value`` as a column of type ``kind`` holds it, or None if it can equal none of
    its values: booleans and numbers compare by value, other classes only with their own."""
    own, given = _class_of(kind), _class_of_value(value)
    if own == "number" and given in ("number", "truth"):
        return int(value) if given == "truth" else value
    if own == "truth" and given in ("number", "truth"):
        return bool(value) if value in (0, 1) else None
    if own == "timestamp_ntz" and given == "timestamp":
        return value
    return value if own == given else None


@dataclass(frozen=True)
class Metadata:
    kind: str
    names: tuple[str, ...]

    @staticmethod
    def columns(*names: str) -> Metadata:
        return Metadata("columns", tuple(names))

    @staticmethod
    def map(name: str = "metadata") -> Metadata:
        return Metadata("map", (name,))

    @staticmethod
    def json(name: str = "metadata") -> Metadata:
        return Metadata("json", (name,))

    # -- single keys -------------------------------------------------------
    def _variant(self, key: str) -> Column:
        return F.try_variant_get(F.try_parse_json(F.col(self.names[0])), json_path(key), "variant")

    def _kind_of(self, key: str) -> Column:
        return F.schema_of_variant(self._variant(key))

    def has(self, key: str) -> Column:
        """Whether the key is there (for columns: not NULL)."""
        if self.kind == "columns":
            return F.col(key).isNotNull() if key in self.names else F.lit(False)
        if self.kind == "map":
            return F.coalesce(F.map_contains_key(F.col(self.names[0]), key), F.lit(False))
        return self._variant(key).isNotNull()

    def value(self, key: str, ddl: str | None = None) -> Column:
        """The value; for JSON as ``ddl`` (string by default), NULL if it has another type."""
        if self.kind == "columns":
            return F.col(key) if key in self.names else F.lit(None)
        if self.kind == "map":
            return F.try_element_at(F.col(self.names[0]), F.lit(key))
        return F.try_variant_get(self._variant(key), "$", ddl or "string")

    def is_missing_or_null(self, key: str) -> Column:
        if self.kind == "json":
            v = self._variant(key)
            return v.isNull() | F.coalesce(F.is_variant_null(v), F.lit(True))
        return self.value(key).isNull()

    def type_of(self, key: str, schema: T.StructType | None) -> T.DataType | None:
        """The type of a typed value, as far as the schema tells; None for JSON."""
        name = key if self.kind == "columns" else self.names[0]
        if self.kind == "json" or schema is None or name not in schema.names:
            return None
        found = schema[name].dataType
        return found.valueType if self.kind == "map" else found

    def _comparable(self, key: str) -> Column:
        """One text for a JSON value, equal for values that are equal in Python; the
        JSON is parsed once."""

        def form(t: Column) -> Column:
            number = F.when(t.isin("true", "false"), (t == "true").cast("double")).otherwise(t.try_cast("double"))
            return F.when(t.rlike(r'^["{\[]'), t).otherwise(F.concat(F.lit("="), (number + 0.0).cast("string")))

        return F.element_at(F.transform(F.array(F.to_json(self._variant(key))), form), 1)

    @staticmethod
    def _comparable_literal(value: Any) -> Column:
        if isinstance(value, bool | int | float):
            return F.concat(F.lit("="), F.lit(float(value)).cast("string"))
        return F.to_json(F.parse_json(F.lit(json.dumps(value))))

    def equals(self, key: str, value: Any, schema: T.StructType | None = None) -> Column:
        """Equality as between Python values: numbers and booleans compare by
        value, never with strings; None equals an absent key.  ``schema`` is the
        rows' own, by which typed values are told apart."""
        return self.is_in(key, [value], schema)

    def is_in(self, key: str, values: Iterable[Any], schema: T.StructType | None = None) -> Column:
        values = list(values)
        plain = [v for v in values if v is not None]
        if self.kind == "json":
            found = F.coalesce(self._comparable(key).isin(*[self._comparable_literal(v) for v in plain]), F.lit(False)) if plain else F.lit(False)
        elif not (key in self.names or self.kind == "map"):
            found = F.lit(False)
        else:
            kind = self.type_of(key, schema)
            wanted = plain if kind is None else [w for w in (as_literal(kind, v) for v in plain) if w is not None]
            found = self.value(key) == F.lit(wanted[0]) if len(wanted) == 1 else self.value(key).isin(wanted) if wanted else F.lit(False)
            found = F.coalesce(found, F.lit(False)) if len(plain) < len(values) or self.kind == "map" else found
        return found | self.is_missing_or_null(key) if len(plain) < len(values) else found

    def between(self, key: str, lower: Any = None, upper: Any = None, *, strict: bool = False, schema: T.StructType | None = None) -> Column:
        """Inclusive bounds, each optional; the key must be there.  A null or
        incomparable value is outside; with ``strict`` it raises."""
        there = self.has(key)
        bounds = [b for b in (lower, upper) if b is not None]
        if not bounds:
            return there
        kind = self.type_of(key, schema)
        if self.kind == "json":
            text = isinstance(bounds[0], str)
            v = F.try_variant_get(self._variant(key), "$", "string" if text else "double")
            v = F.when(self._kind_of(key).rlike("^STRING$" if text else _NUMBERS), v)
        elif kind is None:
            v = self.value(key)
        else:
            own = _class_of(kind)
            alike = all({"truth": "number"}.get(_class_of_value(b), _class_of_value(b)) == ("number" if own == "truth" else own) for b in bounds)
            v = (self.value(key).cast("int") if own == "truth" else self.value(key)) if alike else F.lit(None)
            if not alike and not strict:
                return F.lit(False)
            lower, upper = (int(b) if isinstance(b, bool) else b for b in (lower, upper))
        inside = F.lit(True)
        if lower is not None:
            inside = inside & (v >= F.lit(lower))
        if upper is not None:
            inside = inside & (v <= F.lit(upper))
        if strict:
            inside = F.when(v.isNull(), F.raise_error(F.lit(f"metadata value of {key!r} cannot be compared"))).otherwise(inside)
            return there & F.coalesce(inside, F.lit(False))
        return there & (inside if kind is not None else F.coalesce(inside, F.lit(False)))

    # -- the whole ---------------------------------------------------------
    def canonical(self) -> Column:
        """A string that is equal for equal metadata; keys sorted, nulls kept for JSON."""
        if self.kind == "json":
            return F.coalesce(F.to_json(F.try_parse_json(F.col(self.names[0]))), F.lit("{}"))
        if self.kind == "map":
            return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(F.col(self.names[0]))))), F.lit("{}"))
        return F.to_json(F.struct(*[F.col(c) for c in sorted(self.names)])) if self.names else F.lit("{}")

    def is_empty(self) -> Column:
        if self.kind == "columns":
            return F.forall(F.array(*[F.col(c).isNull() for c in self.names]), lambda x: x) if self.names else F.lit(True)
        if self.kind == "map":
            return F.coalesce(F.size(F.col(self.names[0])) <= 0, F.lit(True))
        return self.n_keys() == 0

    def n_keys(self) -> Column:
        if self.kind == "columns":
            total = F.lit(0)
            for c in self.names:
                total = total + F.col(c).isNotNull().cast("int")
            return total
        if self.kind == "map":
            return F.greatest(F.coalesce(F.size(F.col(self.names[0])), F.lit(0)), F.lit(0))
        return F.coalesce(F.size(F.json_object_keys(F.col(self.names[0]))), F.lit(0))

    def pairs(self, df: DataFrame) -> DataFrame:
        """One row a row and present key: the input's ``_ord``, ``key``, ``value``
        (canonical text), ``type`` (Python's name of it) and ``is_complex``."""
        if self.kind == "json":
            df = df.withColumn("_v", F.try_parse_json(F.col(self.names[0])))
            spark = df.sparkSession
            rows = df.select(ORD, "_v").lateralJoin(spark.tvf.variant_explode(F.col("_v").outer()))
            rows = rows.select(ORD, "key", F.to_json("value").alias("value"), F.schema_of_variant("value").alias("t"))
            text = F.when(F.col("t") == "STRING", F.expr("from_json(concat('[', value, ']'), 'array<string>')[0]")).otherwise(F.col("value"))
            names = F.when(F.col("t") == "STRING", "str").when(F.col("t") == "BOOLEAN", "bool").when(F.col("t") == "VOID", "NoneType")
            names = names.when(F.col("t").rlike("^(BIGINT|INT|SMALLINT|TINYINT)$"), "int").when(F.col("t").rlike("^ARRAY"), "list").when(F.col("t").rlike("^OBJECT"), "dict").otherwise("float")
            out = rows.select(ORD, "key", F.when(names == "NoneType", F.lit(None)).otherwise(text).alias("value"), names.alias("type"))
        elif self.kind == "map":
            out = df.select(ORD, F.explode(F.col(self.names[0])).alias("key", "raw"))
            kind = python_type(out.schema["raw"].dataType.typeName())
            out = out.select(ORD, "key", _text_of(out, "raw"), F.when(F.col("raw").isNull(), "NoneType").otherwise(kind).alias("type"))
        else:
            entries = F.array(*[F.struct(F.lit(c).alias("key"), _text_of(df, c), F.lit(python_type(df.schema[c].dataType.typeName())).alias("type")) for c in self.names])
            out = df.select(ORD, F.explode(entries).alias("e")).select(ORD, "e.*").where("value is not null")
        return out.withColumn("is_complex", F.col("type").isin("list", "dict", "set"))


def _text_of(df: DataFrame, c: str) -> Column:
    kind = df.schema[c].dataType.typeName()
    text = F.to_json(F.col(c)) if kind in ("array", "map", "struct") else F.when(F.col(c), "True").otherwise("False") if kind == "boolean" else F.col(c).cast("string")
    return F.when(F.col(c).isNotNull(), text).alias("value")


def python_type(name: str) -> str:
    return {"string": "str", "boolean": "bool", "double": "float", "float": "float", "decimal": "float", "array": "list", "map": "dict", "struct": "dict", "void": "NoneType", "date": "date", "timestamp": "datetime"}.get(name, "int")
