"""Callables over rows: memoised, recorded, paired with their inputs, or read as JSON.

A callable takes one string and gives one (a model, a tool, a parser).  Calls run
on the executors, in batches of rows; cache and records are tables.
"""

from __future__ import annotations

import asyncio
import dataclasses
import functools
import hashlib
import json
import logging
import time
import uuid
from collections.abc import AsyncIterator, Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any, Generic, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chat, json_repair
from ..session import materialize, scratch_dir, ship_package

logger = logging.getLogger(__name__)
U = TypeVar("U")
V = TypeVar("V")
RESERVED = frozenset({"input", "output", "timestamp", "run_id", "error"})


@dataclass(frozen=True)
class InputOutputPair(Generic[U, V]):
    input: U
    output: V


class Run:
    """A function of one value: ``invoke``, ``batch`` and their async forms on the
    driver, ``transform`` over a column on the executors."""

    def __init__(self, fn: Callable[[Any], Any]) -> None:
        self.fn = fn

    def invoke(self, value: Any, config: dict | None = None) -> Any:
        return self.fn(value)

    def batch(self, values: Sequence[Any], config: Any = None, *, return_exceptions: bool = False) -> list[Any]:
        out = []
        for v in values:
            try:
                out.append(self.fn(v))
            except Exception as e:
                if not return_exceptions:
                    raise
                out.append(e)
        return out

    async def ainvoke(self, value: Any, config: dict | None = None) -> Any:
        return await asyncio.to_thread(self.invoke, value, config)

    async def abatch(self, values: Sequence[Any], config: Any = None, *, return_exceptions: bool = False) -> list[Any]:
        return await asyncio.to_thread(lambda: self.batch(values, config, return_exceptions=return_exceptions))

    def transform(self, df: DataFrame, input_col: str, *, output_col: str = "output") -> DataFrame:
        """``df`` with ``output_col`` and ``error`` (of a failed call, whose output is NULL)."""
        ship_package(df.sparkSession)
        fn = self.fn

        @F.pandas_udf("value string, error string")
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for values in batches:
                rows = []
                for v in values:
                    try:
                        rows.append((fn(v), None))
                    except Exception as e:
                        rows.append((None, f"{type(e).__name__}: {e}"))
                yield pd.DataFrame(rows, columns=["value", "error"])

        done = df.withColumn("_r", call.asNondeterministic()(F.col(input_col)))  # never evaluated twice
        return done.select(*df.columns, F.col("_r.value").alias(output_col), F.col("_r.error").alias("error"))


@functools.singledispatch
def default_serialize(value: Any) -> Any:
    """JSON-able form at any depth: what an object dumps itself as, or its fields if it is a
    dataclass; mappings and sequences by their members; other values as they are."""
    if isinstance(value, type):
        return value
    inner = value.model_dump() if hasattr(value, "model_dump") else dict(dataclasses.asdict(value)) if dataclasses.is_dataclass(value) else None
    return value if inner is None else default_serialize(inner)


@default_serialize.register(Mapping)
def _(value: Mapping) -> dict:
    return dict(zip(value, map(default_serialize, value.values()), strict=True))


@default_serialize.register(list)
@default_serialize.register(tuple)
def _(value: Sequence) -> list:
    return list(map(default_serialize, value))


def default_key(value: Any) -> str:
    """The same key as :func:`text_key` gives for a column of texts."""
    plain = f"s{value}" if isinstance(value, str) else f"j{json.dumps(value, sort_keys=True, default=repr)}"
    return hashlib.sha256(plain.encode("utf-8", "surrogatepass")).hexdigest()


def text_key(text: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(F.concat(F.lit("s"), text), F.lit("jnull")), "UTF-8"), 256)


class CacheTable:
    """key, value as append-only Parquet; the oldest entry of a key counts.  A value
    is a text, or JSON where ``is_json``."""

    schema = "key string, value string, is_json boolean, at timestamp"

    def __init__(self, spark: SparkSession, path: str | None = None) -> None:
        self.spark, self.path = spark, path or f"{scratch_dir(spark)}/cache-{uuid.uuid4().hex}"

    def _entries(self) -> DataFrame:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def rows(self, keys: Sequence[str] | None = None) -> DataFrame:
        """key, value, is_json: one row a key (of ``keys``, if given)."""
        found = self._entries()
        found = found if keys is None else found.where(F.col("key").isin(list(keys)))
        oldest = F.min_by(F.struct("value", "is_json"), F.struct("at", "value")).alias("v")
        return found.groupBy("key").agg(oldest).select("key", "v.*")

    def add(self, entries: DataFrame) -> None:
        """``entries``: key, value and, if not false, is_json."""
        kind = F.col("is_json") if "is_json" in entries.columns else F.lit(False)
        entries.select("key", "value", kind.alias("is_json"), F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)

    def look_up(self, keys: Sequence[str]) -> dict[str, Any]:
        return {r.key: json.loads(r.value) if r.is_json and r.value is not None else r.value for r in self.rows(keys).collect()} if keys else {}

    def put(self, values: dict[str, Any]) -> None:
        """Python values on the driver; those that JSON cannot hold raise a TypeError."""
        rows = [(k, v if isinstance(v, str) or v is None else json.dumps(default_serialize(v)), not (isinstance(v, str) or v is None)) for k, v in values.items()]
        if rows:
            self.add(self.spark.createDataFrame(rows, "key string, value string, is_json boolean"))


class CachingRun(Run):
    """Calls with a known key are not made again; a cached NULL is a hit.  Failed
    calls are not kept.  One table serves ``invoke``, ``batch`` and ``transform``; without
    one, ``invoke`` and ``batch`` keep the latest ``keep`` results in memory."""

    def __init__(self, run: Run, cache: CacheTable | None = None, key_fn: Callable[[Any], str] = default_key, *, keep: int = 10_000) -> None:
        super().__init__(run.fn)
        self.run, self.cache, self.key_fn, self.keep = run, cache, key_fn, keep
        self._local: dict[str, Any] = {}

    def _known(self, keys: Sequence[str]) -> dict[str, Any]:
        return self.cache.look_up(list(dict.fromkeys(keys))) if self.cache else {k: self._local[k] for k in keys if k in self._local}

    def _keep(self, made: dict[str, Any]) -> None:
        if self.cache:
            self.cache.put(made)
            return
        self._local |= made
        for k in list(self._local)[: max(0, len(self._local) - self.keep)]:
            del self._local[k]

    def invoke(self, value: Any, config: dict | None = None) -> Any:
        key = self.key_fn(value)
        known = self._known([key])
        if key not in known:
            known[key] = self.run.invoke(value, config)
            self._keep(known)
        return known[key]

    def batch(self, values: Sequence[Any], config: Any = None, *, return_exceptions: bool = False) -> list[Any]:
        """One batch for the inputs of unknown keys; equal ones are computed each."""
        keys = [self.key_fn(v) for v in values]
        known = self._known(keys)
        places = [i for i, k in enumerate(keys) if k not in known]
        configs = [config[i] for i in places] if isinstance(config, list) else config
        made = dict(zip(places, self.run.batch([values[i] for i in places], configs, return_exceptions=return_exceptions), strict=True))
        self._keep({keys[i]: m for i, m in made.items() if not isinstance(m, Exception)})
        return [made[i] if i in made else known[k] for i, k in enumerate(keys)]

    def transform(self, df: DataFrame, input_col: str, *, output_col: str = "output", key: Column | None = None) -> DataFrame:
        """Hits by a left join with the cache, one call for each distinct miss."""
        if self.cache is None:
            raise ValueError("a cache table is needed")
        keyed = df.withColumn("_key", text_key(F.col(input_col)) if key is None else key)
        known = self.cache.rows()
        misses = keyed.select("_key", F.col(input_col).alias("_in")).dropDuplicates(["_key"]).join(known, F.col("_key") == known["key"], "left_anti")
        made = self.run.transform(misses, "_in", output_col="value").where("error is null")
        self.cache.add(made.select(F.col("_key").alias("key"), "value"))
        now = self.cache.rows().select(F.col("key").alias("_k"), F.col("value").alias(output_col))
        return keyed.join(now, keyed["_key"] == now["_k"], "left").select(*df.columns, output_col)


class InputOutputRun(Run):
    """Outputs together with their inputs; exceptions pass through."""

    def __init__(self, run: Run) -> None:
        super().__init__(run.fn)
        self.run = run

    def invoke(self, value: Any, config: dict | None = None) -> InputOutputPair:
        return InputOutputPair(value, self.run.invoke(value, config))

    def batch(self, values: Sequence[Any], config: Any = None, *, return_exceptions: bool = False) -> list[Any]:
        made = self.run.batch(values, config, return_exceptions=return_exceptions)
        return [m if isinstance(m, Exception) else InputOutputPair(v, m) for v, m in zip(values, made, strict=True)]

    def transform(self, df: DataFrame, input_col: str, *, output_col: str = "pair") -> DataFrame:
        done = self.run.transform(df, input_col, output_col="_out")
        return done.select(*df.columns, F.struct(F.col(input_col).alias("input"), F.col("_out").alias("output")).alias(output_col), "error")


class RecordingRun(Run):
    """Every call becomes a record in a store: input, output, timestamp, run_id,
    error and extra fields; ids are random, so equal calls are all kept.

    A single failed call is raised and not recorded; with ``return_exceptions``
    failed calls of a batch are.
    """

    def __init__(self, run: Run, store: Any, *, extra: dict[str, Any] | None = None, serializer: Callable[[Any], Any] = default_serialize) -> None:
        clash = RESERVED & set(extra or ())
        if clash:
            raise ValueError(f"reserved keys: {sorted(clash)}")
        super().__init__(run.fn)
        self.run, self.store, self.extra, self.serializer = run, store, dict(extra or {}), serializer

    def _merged(self, config: dict | None) -> dict[str, Any]:
        own = (config or {}).get("metadata") or {}
        if RESERVED & set(own):
            raise ValueError(f"reserved keys: {sorted(RESERVED & set(own))}")
        return self.extra | own

    def _record(self, rows: list[tuple[Any, Any, str | None, dict | None]]) -> None:
        now = datetime.now(UTC).isoformat()
        records = []
        for i, (value, output, error, config) in enumerate(rows):
            meta = {"input": value, "output": output, "timestamp": now, "run_id": chat.run_ids(config), "error": error} | self._merged(config)
            records.append((str(uuid.uuid4()), json.dumps(self.serializer(meta), default=repr), i))
        if records:
            self.store.add(self.store.spark.createDataFrame(records, "id string, metadata string, _ord long"))

    def invoke(self, value: Any, config: dict | None = None) -> Any:
        self._merged(config)
        out = self.run.invoke(value, config)
        self._record([(value, out, None, config)])
        return out

    def batch(self, values: Sequence[Any], config: Any = None, *, return_exceptions: bool = False) -> list[Any]:
        configs = config if isinstance(config, list) else [config] * len(values)
        if len(configs) != len(values):
            raise ValueError(f"{len(configs)} configs for {len(values)} inputs")
        for c in configs:
            self._merged(c)
        out = self.run.batch(values, config, return_exceptions=return_exceptions)
        self._record([(v, None, f"{type(o).__name__}: {o}", c) if isinstance(o, Exception) else (v, o, None, c) for v, o, c in zip(values, out, configs, strict=True)])
        return out

    def stream(self, chunks: Callable[[Any], Iterator[str]], value: Any, config: dict | None = None) -> Iterator[str]:
        """Passes chunks on and records their sum at the end, also of a broken stream."""
        self._merged(config)
        parts: list[str] = []
        error = None
        try:
            for c in chunks(value):
                parts.append(c)
                yield c
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            self._record([(value, "".join(parts), error, config)])

    async def astream(self, chunks: Callable[[Any], AsyncIterator[str]], value: Any, config: dict | None = None) -> AsyncIterator[str]:
        """:meth:`stream` over an asynchronous iterator."""
        self._merged(config)
        parts: list[str] = []
        error = None
        try:
            async for c in chunks(value):
                parts.append(c)
                yield c
        except Exception as e:
            error = f"{type(e).__name__}: {e}"
            raise
        finally:
            await asyncio.to_thread(self._record, [(value, "".join(parts), error, config)])

    def transform(self, df: DataFrame, input_col: str, *, output_col: str = "output", run_id: str | None = None) -> DataFrame:
        """Calls over a column; one record a row is added to the store."""
        done = self.run.transform(df, input_col, output_col=output_col)
        done = materialize(done)  # calls are made once, though rows go to the store and to the caller
        fields = [F.col(input_col).alias("input"), F.col(output_col).alias("output"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("timestamp"), F.lit(run_id).alias("run_id"), F.col("error")]
        fields += [F.lit(v).alias(k) for k, v in self.extra.items()]
        self.store.add(done.select(F.uuid().alias("id"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("metadata")))
        return done


class StructuredOutputError(ValueError):
    """Neither the native nor the parsed output fits the schema."""


def structured_output(df: DataFrame, raw_col: str, schema: str, *, native_col: str | None = None, include_raw: bool = False) -> DataFrame:
    """``parsed`` of each row: the native struct where there is one, else read from
    the raw text; ``used_fallback`` tells, ``parsed_error`` is why there is none."""
    read = json_repair.parse_structured(df, raw_col, schema)
    native = F.col(native_col) if native_col else F.lit(None).cast(read.schema["parsed"].dataType)
    out = read.withColumn("used_fallback", native.isNull() & F.col("parsed").isNotNull())
    out = out.withColumn("parsed_error", F.when(native.isNull(), F.col("parsed_error"))).withColumn("parsed", F.coalesce(native, F.col("parsed")))
    drop = ["parsed_attempt"] + ([] if include_raw else [raw_col])
    return out.drop(*drop)


@dataclass(frozen=True)
class StructuredReply:
    """What a call for structured output gave."""

    parsed: dict[str, Any] | None
    raw: str
    seconds: float
    usage: dict[str, int]
    used_fallback: bool
    error: str | None


def _usage(reply: Any) -> dict[str, int]:
    found = (reply.get("usage_metadata") or {}) if isinstance(reply, Mapping) else {}
    return {k: int(found.get(k) or 0) for k in chat.USAGE}


def invoke_structured_llm(spark: SparkSession, llm: Callable[[list[dict]], Any], value: Any, schema: str, *, system_prompt: str | None = None, raise_error: bool = True) -> StructuredReply:
    """One call of ``llm`` for a value of ``schema`` (a struct's DDL).

    ``llm`` gets messages and gives a text, or a mapping with ``content``, maybe ``parsed`` (the native
    output) and ``usage_metadata``.  Without a native output the text is read as JSON,
    with the repairs of ``json_repair``.  Time and tokens are logged."""
    began = time.perf_counter()
    reply = llm(chat.coerce_value(value, system_prompt))
    seconds = time.perf_counter() - began
    raw = reply if isinstance(reply, str) else str(reply.get("content") or "")
    native = None if isinstance(reply, str) else reply.get("parsed")
    usage = _usage(reply)
    logger.info("structured call: %.2f s, tokens in %d, out %d, total %d", seconds, *usage.values())
    if native is not None:
        return StructuredReply(default_serialize(native), raw, seconds, usage, False, None)
    row = structured_output(spark.createDataFrame([(raw,)], "raw string"), "raw", schema).first()
    if row.parsed is None and raise_error:
        raise StructuredOutputError(row.parsed_error)
    return StructuredReply(row.parsed.asDict(True) if row.parsed is not None else None, raw, seconds, usage, row.used_fallback, row.parsed_error)


async def ainvoke_structured_llm(spark: SparkSession, llm: Callable[[list[dict]], Any], value: Any, schema: str, **options: Any) -> StructuredReply:
    """The same without holding up the event loop."""
    return await asyncio.to_thread(invoke_structured_llm, spark, llm, value, schema, **options)


def structured_calls(df: DataFrame, input_col: str, llm: Callable[[list[dict]], Any], schema: str, *, system_prompt: str | None = None) -> DataFrame:
    """A call a row, on the executors: ``df`` with raw, native and fallback read into ``parsed``,
    ``parsed_error``, ``used_fallback``, ``seconds`` and the token counters."""
    ship_package(df.sparkSession)

    @F.pandas_udf("raw string, native string, error string, seconds double, input_tokens long, output_tokens long, total_tokens long")
    def call(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for values in batches:
            rows = []
            for v in values:
                began, native, error, reply = time.perf_counter(), None, None, None
                try:
                    reply = llm(chat.coerce_value(v, system_prompt))
                    if isinstance(reply, Mapping) and reply.get("parsed") is not None:
                        native = json.dumps(default_serialize(reply["parsed"]))
                except Exception as e:
                    error = f"{type(e).__name__}: {e}"
                raw = reply if isinstance(reply, str) or reply is None else str(reply.get("content") or "")
                rows.append((raw, native, error, time.perf_counter() - began, *_usage(reply).values()))
            yield pd.DataFrame(rows, columns=["raw", "native", "error", "seconds", *chat.USAGE])

    done = materialize(df.withColumn("_c", call.asNondeterministic()(F.col(input_col))))  # calls are made once
    flat = done.select(*df.columns, "_c.*").withColumn("_native", F.from_json("native", schema))
    out = structured_output(flat, "raw", schema, native_col="_native", include_raw=True)
    return out.withColumn("parsed_error", F.coalesce("error", "parsed_error")).drop("native", "_native", "error")


class ChatRun(Run):
    """A model over message lists: coerces the input, calls ``fn`` with the
    messages, and gives them with the reply at the end; a reply's ``parsed`` value comes
    as ``structured_response``."""

    def __init__(self, fn: Callable[[list[dict]], str | dict], *, system_prompt: str | None = None, chunks: Callable[[list[dict]], Iterator[str]] | None = None) -> None:
        super().__init__(fn)
        self.system_prompt, self.chunks = system_prompt, chunks

    def invoke(self, value: Any, config: dict | None = None) -> dict:
        messages = chat.coerce_value(value, self.system_prompt)
        reply = self.fn(messages)
        said = {"content": reply} if isinstance(reply, str) else {k: v for k, v in reply.items() if k != "parsed"}
        out = {"messages": [*messages, {"role": "assistant"} | said]}
        return out | ({"structured_response": reply["parsed"]} if isinstance(reply, Mapping) and reply.get("parsed") is not None else {})

    def stream(self, value: Any, config: dict | None = None) -> Iterator[str]:
        """The reply's chunks as the model gives them; the whole reply at once if it has none."""
        messages = chat.coerce_value(value, self.system_prompt)
        if self.chunks is not None:
            yield from self.chunks(messages)
        else:
            reply = self.fn(messages)
            yield reply if isinstance(reply, str) else str(reply.get("content") or "")

    async def astream(self, value: Any, config: dict | None = None) -> AsyncIterator[str]:
        rest, end = self.stream(value, config), object()
        while (c := await asyncio.to_thread(next, rest, end)) is not end:
            yield c

    def batch(self, values: Sequence[Any], config: Any = None, *, return_exceptions: bool = False) -> list[Any]:
        out = []
        for v in values:
            try:
                out.append(self.invoke(v))
            except Exception as e:
                if not return_exceptions:
                    raise
                out.append(e)
        return out

    def transform(self, df: DataFrame, messages_col: str = "messages", *, output_col: str = "messages") -> DataFrame:
        """``messages_col`` is an ARRAY<STRUCT<role, content>>; the reply is appended."""
        ship_package(df.sparkSession)
        fn = self.fn

        @F.pandas_udf("string")
        def call(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for lists in batches:
                replies = [fn([dict(m) for m in ms]) for ms in lists]
                yield pd.Series([r if isinstance(r, str) else r.get("content") for r in replies])

        ready = df.withColumn("_m", chat.coerce_messages(F.col(messages_col), self.system_prompt))
        said = ready.withColumn("_reply", call.asNondeterministic()(F.col("_m")))
        out = F.concat(F.col("_m"), F.array(chat.message("assistant", F.col("_reply"))))
        return said.withColumn(output_col, out).drop("_m", "_reply")


def accumulated_usage(df: DataFrame, order: str, by: list[str] | None = None) -> DataFrame:
    """Running sums of the token counters, by groups or over all rows.

    Over all rows, the rows are dealt into ranges of ``order``; the sums of the ranges
    before it (one row a range) are added to each range's own running sums, so no
    task holds more than its range."""
    if by:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(w).alias(f"total_{c}") for c in chat.USAGE])
    ranges = materialize(df.repartitionByRange(order).withColumn("_range", F.spark_partition_id()))
    sums = ranges.groupBy("_range").agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(f"_{c}") for c in chat.USAGE])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = sums.select("_range", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in chat.USAGE])
    own = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = ranges.join(offsets, "_range")
    return rows.select(*df.columns, *[(F.sum(F.coalesce(F.col(c), F.lit(0))).over(own) + F.col(f"_{c}")).alias(f"total_{c}") for c in chat.USAGE])
