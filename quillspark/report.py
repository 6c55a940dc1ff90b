"""Plain-text reports of statistics and profiles."""

from __future__ import annotations

import pprint
import re
import sys
import time
from collections.abc import Iterable, Iterator
from typing import Any, TextIO, TypeVar

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.profile import profile_flags


V = TypeVar("V")


def _share(n: int, total: int) -> str:
    return f"{n:,} ({100 * n / total:.1f} %)" if total else f"{n:,}"


def content_stats_report(stats: DataFrame | dict, *, title: str = "Document content") -> str:
    """Works on exact and on approximate statistics."""
    row = stats.first().asDict() if isinstance(stats, DataFrame) else stats
    exact = row.get("duplicate_count_exact", True)
    count = row.get("count", 0)
    lines = [f"{title} ({'exact' if exact else 'approximate'})"]
    if not count:
        return "\n".join([*lines, "  no documents"])
    suffix = "" if row.get("percentiles_exact", True) else "_approx"
    duplicates = row.get("duplicate_count", row.get("approx_duplicate_count", 0))
    lines += [
        f"  documents            {count:,}",
        f"  characters           {row['total_chars']:,}",
        f"  average, deviation   {row['avg_chars']:.1f}, {row['std_dev_chars']:.1f}",
        f"  shortest             {row['min_chars']:,} ({row['min_doc_id']})",
        f"  longest              {row['max_chars']:,} ({row['max_doc_id']})",
        *[f"  {p}th percentile      {row[f'p{p}_chars{suffix}']:,}" for p in (50, 90, 99)],
        f"  empty                {_share(row['empty_count'], count)}",
        f"  blank                {_share(row['whitespace_only_count'], count)}",
        f"  without content      {_share(row['none_or_non_str_content_count'], count)}",
        f"  without id           {_share(row['none_id_count'], count)}",
        f"  without metadata     {_share(row['missing_metadata_count'], count)}",
        f"  duplicates           {_share(duplicates, count)}",
    ]
    issues = sum(row[k] for k in ("empty_count", "whitespace_only_count", "none_or_non_str_content_count", "none_id_count", "missing_metadata_count")) + duplicates
    lines.append("  issues found" if issues else "  no issues")
    if not exact:
        lines.append(f"  duplicates are estimated with a relative deviation of {row.get('duplicate_error', 0):.2%} of the distinct contents")
    return "\n".join(lines)


def metadata_report(profile: DataFrame, *, unit: str = "docs", title: str = "Metadata") -> str:
    rows = profile_flags(profile, unit).orderBy("key").toLocalIterator()
    lines = [title]
    for r in rows:
        sample = ", ".join("None" if v is None else v for v in r["unique_values_sample"]) + (", …" if r["unique_values_sample_truncated"] else "")
        lines.append(f"  {r['key']}: present {r[f'present_in_{unit}']:,}, missing {r[f'missing_in_{unit}']:,}; {'/'.join(r['value_types'])}; [{sample}]; {', '.join(r['flags']) or 'ok'}")
    return "\n".join(lines)


def document_report(df: DataFrame, n: int = 20, max_length: int = 300, content: str = "page_content") -> str:
    """The first ``n`` rows with their contents cut at a word's end."""
    from .functions.text import truncate

    rows = df.limit(n).withColumn("_cut", truncate(F.coalesce(F.col(content), F.lit("")), max_length))
    lines = []
    for r in rows.drop(content).collect():
        row = r.asDict()
        cut = row.pop("_cut")
        lines += [f"[{row.pop('id', None)}] " + ", ".join(f"{k}={v}" for k, v in row.items() if not k.startswith("_")), cut["content"] + (" …" if cut["truncated"] else ""), ""]
    return "\n".join(lines)


def markdown_report(text: str) -> str:
    """Markdown as plain text for a terminal: headings underlined, marks taken off."""
    lines = []
    for line in text.splitlines():
        head = re.match(r"(#{1,6})\s+(.*)", line)
        plain = re.sub(r"(\*\*|__|`)(.+?)\1", r"\2", head[2] if head else line)
        plain = re.sub(r"\[([^\]]*)\]\(([^)]*)\)", r"\1 (\2)", plain)
        lines += [plain, ("=" if head[1] == "#" else "-") * len(plain)] if head else [re.sub(r"^(\s*)[-*+] ", "\\1\N{BULLET} ", plain)]
    return "\n".join(lines)


def pretty_report(value: Any, width: int = 100) -> str:
    """Any value, nested ones indented."""
    return pprint.pformat(value, width=width, sort_dicts=False)


def progress(items: Iterable[V], *, total: int | None = None, label: str = "", every: float = 1.0, out: TextIO | None = None) -> Iterator[V]:
    """Passes ``items`` on and writes a line about them every ``every`` seconds and at the end."""
    out = out or sys.stderr
    began = last = time.monotonic()
    n = 0
    for n, item in enumerate(items, 1):
        yield item
        if time.monotonic() - last >= every:
            last = time.monotonic()
            out.write(f"{label or 'progress'}: {n}{f' of {total}' if total else ''}, {last - began:.0f} s\n")
    out.write(f"{label or 'progress'}: {n}{f' of {total}' if total else ''}, done in {time.monotonic() - began:.1f} s\n")
