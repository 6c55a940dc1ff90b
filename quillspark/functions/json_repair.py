"""Reading JSON out of free text: fences off, repair, first balanced object."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import strip


class StructuredParseError(ValueError):
    """No JSON object of the schema could be read; ``raw`` is the whole text."""

    def __init__(self, message: str, raw: str) -> None:
        super().__init__(message)
        self.raw = raw


def strip_code_fences(text: Column) -> Column:
    inner = F.regexp_replace(strip(text), r"^```[A-Za-z0-9_-]*\s*\n?", "")
    return strip(F.regexp_replace(inner, r"\n?```\s*$", ""))


# a whole string, which is kept, or a comma with only blanks before a closing bracket
_STRING_OR_COMMA = r'("(?:[^"\\]|\\.)*")|,(?=\s*[}\]])'


def fix_common_issues(text: Column) -> Column:
    """Without commas in front of a closing bracket; strings stay as they are."""
    return F.regexp_replace(text, _STRING_OR_COMMA, "$1")


def first_object(text: str | None) -> str | None:
    """The first balanced ``{...}``, aware of strings and escapes."""
    start = text.find("{") if text else -1
    if start < 0:
        return None
    depth, quoted, at = 0, False, start
    while at < len(text):
        c = text[at]
        if quoted:
            if c == "\\":
                at += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if depth == 0:
                return text[start : at + 1]
        at += 1
    return None


def extract_object(text: Column) -> Column:
    """:func:`first_object` as a column; a state machine over characters, in Arrow batches."""

    @F.arrow_udf("string")
    def extract(batch: pa.Array) -> pa.Array:
        return pa.array([first_object(x) for x in batch.to_pylist()], pa.string())

    return extract(text)


def parse_structured(df: DataFrame, text_col: str, schema: str, *, valid: Callable[[Column], Column] | None = None, out: str = "parsed") -> DataFrame:
    """``df`` with ``out`` (a struct of ``schema`` or NULL), ``<out>_error`` and
    ``<out>_attempt`` (1 as it is, 2 repaired, 3 extracted and repaired).

    ``valid`` is a further condition on the struct.  All fields must be there.
    """
    names = [x.split()[0].split(":")[0].strip("`") for x in _fields(schema)]

    def checked(c: str, attempt: int) -> Column:
        """(value, attempt) of a text that can be read; its JSON is parsed once."""

        def good(v: Column) -> Column:
            whole = F.lit(True)
            for n in names:
                whole = whole & v[n].isNotNull()
            return F.when(F.coalesce(whole & (valid(v) if valid else F.lit(True)), F.lit(False)), F.struct(v.alias("value"), F.lit(attempt).alias("attempt")))

        value = F.when(F.col(c).startswith("{") & F.try_parse_json(F.col(c)).isNotNull(), F.from_json(F.col(c), schema, {"mode": "PERMISSIVE"}))
        return F.element_at(F.transform(F.array(value), good), 1)

    tries = df.withColumn("_t1", strip_code_fences(F.col(text_col)))
    tries = tries.withColumn("_t2", fix_common_issues(F.col("_t1"))).withColumn("_r", F.coalesce(checked("_t1", 1), checked("_t2", 2)))
    # Python runs only for the rows that neither attempt could read
    tries = tries.withColumn("_t3", fix_common_issues(extract_object(F.when(F.col("_r").isNull(), F.col("_t1")))))
    tries = tries.withColumn("_r", F.coalesce("_r", checked("_t3", 3)))
    error = F.when(F.col("_r").isNull(), F.concat(F.lit("no JSON object of the schema in: "), F.coalesce(F.col(text_col), F.lit("NULL"))))
    return tries.select(*df.columns, F.col("_r.value").alias(out), error.alias(f"{out}_error"), F.col("_r.attempt").alias(f"{out}_attempt"))


def _fields(schema: str) -> list[str]:
    out, depth, now = [], 0, ""
    for c in schema:
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out


def parse_text(text: str, required: dict[str, type], valid: Callable[[dict], bool] | None = None) -> dict:
    """One text on the driver; raises :class:`StructuredParseError`."""
    import json
    import re

    plain = re.sub(r"\n?```\s*$", "", re.sub(r"^```[A-Za-z0-9_-]*\s*\n?", "", text.strip())).strip()
    fix = lambda t: re.sub(_STRING_OR_COMMA, lambda m: m[1] or "", t)
    for attempt in (lambda: plain, lambda: fix(plain), lambda: fix(first_object(plain) or "")):
        try:
            value = json.loads(attempt())
        except ValueError:
            continue
        if isinstance(value, dict) and all(isinstance(value.get(k), t) for k, t in required.items()) and (valid is None or valid(value)):
            return value
    raise StructuredParseError("no JSON object of the schema", text)


def parse_text_with_retry(invoke: Callable[[], str], required: dict[str, type], *, max_attempts: int = 3, valid: Callable[[dict], bool] | None = None) -> dict:
    """Invoke again until the text can be read; the last error is raised."""
    if max_attempts < 1:
        raise ValueError(f"max_attempts must be at least 1, got {max_attempts}")
    for attempt in range(max_attempts):
        try:
            return parse_text(invoke(), required, valid)
        except StructuredParseError:
            if attempt + 1 == max_attempts:
                raise
    raise AssertionError
