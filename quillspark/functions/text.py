"""Scalar text expressions, JVM-side; and digests of Python values on the driver."""

from __future__ import annotations

import dataclasses
import functools
import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, Row
from pyspark.sql import functions as F

# Fixed value: matches what Python's str.strip() removes, and nothing else.
BLANKS = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Namespace of content-derived ids (fixed value).
ID_NAMESPACE = "21e6c43e-bc36-4f09-8e20-98201adab5df"


def length(content: Column) -> Column:
    """Code points; 0 for NULL."""
    return F.coalesce(F.length(content), F.lit(0))


def is_whitespace_only(content: Column) -> Column:
    return F.coalesce((content != "") & content.rlike(f"^{BLANKS}*$"), F.lit(False))


def is_empty(content: Column, *, treat_whitespace_as_empty: bool = False) -> Column:
    empty = content.isNull() | (content == "")
    return empty | is_whitespace_only(content) if treat_whitespace_as_empty else empty


def strip(content: Column) -> Column:
    return F.regexp_replace(content, f"^{BLANKS}+|{BLANKS}+$", "")


def truncate(content: Column, max_length: int) -> Column:
    """struct(content, truncated): cut at ``max_length``, at the last space if that
    lies beyond 80 % of it, and without blanks at the end."""
    cut = F.substring(content, 1, max_length)
    space = F.length(cut) - F.instr(F.reverse(cut), F.lit(" "))  # 0-based place of the last space
    snapped = F.when((F.instr(cut, F.lit(" ")) > 0) & (space > max_length * 0.8), F.substring(cut, F.lit(1), space)).otherwise(cut)
    short = F.length(content) <= max_length
    return F.struct(F.when(short, content).otherwise(F.regexp_replace(snapped, f"{BLANKS}+$", "")).alias("content"), (~short).alias("truncated"))


def uuid5(value: Column, namespace: str = ID_NAMESPACE) -> Column:
    """RFC 4122 version 5, as ``uuid.uuid5``."""
    h = F.sha1(F.concat(F.unhex(F.lit(uuid.UUID(namespace).hex)), F.encode(value, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def canonical_json(value: Column) -> Column:
    """Byte-equal to ``json.dumps(json.loads(value), sort_keys=True)``: spaces,
    escapes and number forms have no built-in expression, so this one is Python
    over Arrow batches.  NULL and empty count as ``{}``."""

    @F.arrow_udf("string")
    def dump(batch: pa.Array) -> pa.Array:
        import json

        return pa.array([json.dumps(json.loads(x), sort_keys=True) if x else "{}" for x in batch.to_pylist()], pa.string())

    return dump(value)


def digest(value: Column, length: int = 64) -> Column:
    """Hex digest of 1 to 128 digits."""
    if not 1 <= length <= 128:
        raise ValueError(f"length must be between 1 and 128, got {length}")
    return F.substring(F.sha2(F.encode(value, "UTF-8"), 512), 1, length)


def hash_document(content: Column, canonical: Column, length: int = 64) -> Column:
    return digest(F.concat(F.coalesce(content, F.lit("")), canonical), length)


def hash_document_uuid(content: Column, canonical: Column) -> Column:
    return uuid5(F.concat(F.coalesce(content, F.lit("")), canonical))


def hash_dict_uuid(canonical: Column) -> Column:
    return uuid5(canonical)


def hash_struct(*columns: str | Column, length: int = 64) -> Column:
    """Digest of any serialisable columns."""
    return digest(F.to_json(F.struct(*columns)), length)


def serialize(*columns: str | Column) -> Column:
    """JSON text of columns, nested ones included."""
    return F.to_json(F.struct(*columns))


Canonical = Callable[[Any], Any]


class HasherRegistry:
    """How Python values that JSON lacks are made canonical before they are hashed;
    the nearest registered class of a value counts."""

    def __init__(self) -> None:
        self._known: dict[type, Canonical] = {}

    def register(self, kind: type, canonical: Canonical, *, replace: bool = False) -> None:
        if kind in self._known and not replace:
            raise ValueError(f"{kind.__name__} is registered already")
        self._known[kind] = canonical

    def canonical(self, value: Any, *, ignore_unhashable: bool = False) -> Any:
        """JSON-able form; a TypeError for a value of an unknown class, or its class's
        name in place of it with ``ignore_unhashable``."""
        kind = next((k for k in type(value).__mro__ if k in self._known), None)
        again = functools.partial(self.canonical, ignore_unhashable=ignore_unhashable)
        if kind is not None:
            return again(self._known[kind](value))
        if value is None or isinstance(value, str | bool | int | float):
            return value
        if isinstance(value, Mapping):
            return {"map": sorted(([repr(k), again(v)] for k, v in value.items()), key=lambda pair: pair[0])}
        if isinstance(value, Row):
            return again(value.asDict())
        if isinstance(value, list | tuple):
            return [again(v) for v in value]
        if dataclasses.is_dataclass(value) and not isinstance(value, type):
            return again({"class": type(value).__name__, **{f.name: getattr(value, f.name) for f in dataclasses.fields(value)}})
        if ignore_unhashable:
            return {"unhashable": type(value).__name__}
        raise TypeError(f"{type(value).__name__} is not hashable; register it")


def hash_value(value: Any, registry: HasherRegistry | None = None, length: int = 64, *, ignore_unhashable: bool = False) -> str:
    """Hex digest of any Python value of known classes, equal for equal values."""
    if not 1 <= length <= 128:
        raise ValueError(f"length must be between 1 and 128, got {length}")
    plain = (registry or HasherRegistry()).canonical(value, ignore_unhashable=ignore_unhashable)
    return hashlib.sha512(json.dumps(plain, sort_keys=True).encode()).hexdigest()[:length]
