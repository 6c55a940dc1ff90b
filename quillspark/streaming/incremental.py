"""The same operators over streams: statistics, duplicates, upserts, chunks."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import text


def stream_content_stats(stream: DataFrame, *, by: list[str] | None = None, content: str = "page_content") -> DataFrame:
    """Running counts for ``outputMode("complete")``: count, total, extremes, empties.
    State is one row a group; distinct contents are estimated by HyperLogLog."""
    c = F.col(content)
    n = F.coalesce(F.length(c), F.lit(0))
    aggs = [
        F.count("*").alias("count"),
        F.sum(n).alias("total_chars"),
        F.avg(n).alias("avg_chars"),
        F.coalesce(F.stddev_pop(n), F.lit(0.0)).alias("std_dev_chars"),
        F.min(n).alias("min_chars"),
        F.max(n).alias("max_chars"),
        F.sum(text.is_empty(c).cast("long")).alias("empty_count"),
        F.sum(text.is_whitespace_only(c).cast("long")).alias("whitespace_only_count"),
        F.approx_count_distinct(F.xxhash64(F.coalesce(c, F.lit("")))).alias("approx_distinct_count"),
    ]
    return (stream.groupBy(*by) if by else stream).agg(*aggs)


def stream_length_histogram(stream: DataFrame, content: str = "page_content") -> DataFrame:
    """len, n for ``outputMode("complete")``: the state from which exact percentiles follow."""
    return stream.groupBy(F.coalesce(F.length(content), F.lit(0)).alias("len")).agg(F.count("*").alias("n"))


def percentiles_of(hist: DataFrame, percentiles: tuple[int, ...] = (50, 90, 99)) -> DataFrame:
    from pyspark.sql import Window

    w = Window.orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    total = hist.agg(F.sum("n").alias("_n"))
    ranked = hist.withColumn("_upto", F.sum("n").over(w)).crossJoin(F.broadcast(total))
    return ranked.agg(*[F.min(F.when(F.col("_upto") > F.bround(F.lit(p / 100) * (F.col("_n") - 1)), F.col("len"))).alias(f"p{p}_chars") for p in percentiles])


def stream_dedup(stream: DataFrame, *, content: str = "page_content", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Each content once.  With ``event_time`` the state is dropped after ``delay``;
    without, it grows with the number of contents."""
    keyed = stream.withColumn("_sha", F.sha2(F.encode(F.coalesce(F.col(content), F.lit("")), "UTF-8"), 256))
    if event_time:
        return keyed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_sha"]).drop("_sha")
    return keyed.dropDuplicates(["_sha"]).drop("_sha")


def stream_to_store(stream: DataFrame, store: Any, checkpoint: str) -> StreamingQuery:
    """Upserts every micro-batch into the store; upserts are idempotent, so a
    repeated batch after a failure does no harm."""
    return stream.writeStream.foreachBatch(store.upsert_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def joined_chunks(stream: DataFrame, *, run_id: str = "run_id", seq: str = "seq", chunk: str = "chunk", end: str | None = None) -> DataFrame:
    """run_id, output, n_chunks of every run that got chunks, joined in order of ``seq``
    over all micro-batches so far; for ``outputMode("update")``.  A repeated ``seq`` replaces
    its chunk.  The state of a run is its chunks; it is dropped with a chunk whose column
    ``end`` is true, and kept if there is no such column."""
    kind = stream.schema[run_id].dataType.simpleString()

    def join(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = {int(k): v for k, v in json.loads(state.get[0]).items()} if state.exists else {}
        over = False
        for f in frames:
            parts |= {int(s): c or "" for s, c in zip(f[seq], f[chunk], strict=True)}
            over = over or bool(f["_end"].any())
        if over:
            state.remove()
        else:
            state.update((json.dumps(parts),))
        yield pd.DataFrame({run_id: [key[0]], "output": ["".join(parts[s] for s in sorted(parts))], "n_chunks": [len(parts)]})

    last = F.coalesce(F.col(end), F.lit(False)) if end else F.lit(False)
    rows = stream.select(run_id, F.col(seq).cast("long").alias(seq), F.col(chunk).cast("string").alias(chunk), last.alias("_end")).where(F.col(seq).isNotNull())
    return rows.groupBy(run_id).applyInPandasWithState(join, f"{run_id} {kind}, output string, n_chunks long", "parts string", "update", GroupStateTimeout.NoTimeout)


def stream_chunks(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, *, run_id: str = "run_id", seq: str = "seq", chunk: str = "chunk", end: str | None = None) -> StreamingQuery:
    """Chunks of runs: after every micro-batch ``sink`` gets one row for each run that it
    touched, with all chunks of the run so far; the sink keeps the latest row of a run."""
    rows = joined_chunks(stream, run_id=run_id, seq=seq, chunk=chunk, end=end)
    return rows.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
