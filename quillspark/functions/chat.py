"""Chat messages as ARRAY<STRUCT<role, content>> and their token usage."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"
USAGE = ("input_tokens", "output_tokens", "total_tokens")


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def build_messages(system_prompt: str, user_content: Column) -> Column:
    return F.array(message("system", F.lit(system_prompt)), message("user", user_content))


def coerce_messages(messages: Column, system_prompt: str | None = None) -> Column:
    """``messages`` with the system prompt in front, unless one is there."""
    if system_prompt is None:
        return messages
    has = F.exists(messages, lambda m: m["role"] == "system")
    return F.when(has, messages).otherwise(F.concat(F.array(message("system", F.lit(system_prompt))), messages))


def coerce_text(text: Column, system_prompt: str | None = None) -> Column:
    """A plain text is one user message."""
    return coerce_messages(F.array(message("user", text)), system_prompt)


def coerce_value(value: Any, system_prompt: str | None = None) -> list[dict]:
    """The same for one Python value: a str, a list of messages or texts, or a dict with ``messages``."""
    if isinstance(value, dict):
        if "messages" not in value:
            raise TypeError("a dict must hold 'messages'")
        value = value["messages"]
    if isinstance(value, str):
        value = [value]
    if not isinstance(value, list | tuple):
        raise TypeError(f"cannot make messages of {type(value).__name__}")
    out = [{"role": "user", "content": m} if isinstance(m, str) else dict(m) for m in value]
    if system_prompt is not None and not any(m["role"] == "system" for m in out):
        out.insert(0, {"role": "system", "content": system_prompt})
    return out


def as_text(blocks: Column) -> Column:
    """Text of an ARRAY<STRUCT<type, text>>: the text blocks joined, others dropped."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: F.coalesce(b["text"], F.lit(""))), "")


def token_usage(df: DataFrame, *, by: list[str] | None = None, role_col: str = "role") -> DataFrame:
    """Sums of the counters over the assistant's rows; missing counters are 0."""
    sums = [F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).cast("long").alias(c) for c in USAGE]
    rows = df.where(F.col(role_col) == "assistant")
    return rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)


def find_usage(result: Any) -> dict[str, int]:
    """Counters of all messages anywhere in a nested Python result."""
    total = dict.fromkeys(USAGE, 0)
    todo = [result]
    while todo:
        x = todo.pop()
        if isinstance(x, dict):
            if isinstance(x.get("usage_metadata"), dict):
                for k in USAGE:
                    total[k] += int(x["usage_metadata"].get(k) or 0)
            todo += [v for k, v in x.items() if k != "usage_metadata"]
        elif isinstance(x, list | tuple):
            todo += x
    return total


def accumulate_usage(usage: dict[str, int], result: Any) -> dict[str, int]:
    own = find_usage(result)
    return {k: usage.get(k, 0) + own[k] for k in USAGE}


def format_usage(usage: Column) -> Column:
    n = lambda k: F.format_number(F.coalesce(usage[k], F.lit(0)), 0)
    return F.concat(F.lit("[tokens] in="), n(USAGE[0]), F.lit(" | out="), n(USAGE[1]), F.lit(" | total="), n(USAGE[2]))


def generate_run_id(data: dict[str, Any]) -> str:
    """A run id that depends on the values alone."""
    import json
    import uuid

    from .text import ID_NAMESPACE

    return str(uuid.uuid5(uuid.UUID(ID_NAMESPACE), json.dumps(data, sort_keys=True)))


def run_ids(config: Any, n: int | None = None) -> Any:
    """The run id of a config dict; with ``n``, one for each of ``n`` calls."""
    if n is None:
        return (config or {}).get("run_id")
    if isinstance(config, list):
        if len(config) != n:
            raise ValueError(f"{len(config)} configs for {n} inputs")
        return [run_ids(c) for c in config]
    return [run_ids(config)] * n
