"""Sources: each ingestor gives a DataFrame (or a value) when asked, and nothing
is read before an action needs it."""

from __future__ import annotations

import copy
import dataclasses
import pickle
from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import with_order
from ..operators import ordering


class Ingestor(ABC):
    """A source; ``ingest`` may be called again and again."""

    @abstractmethod
    def ingest(self) -> Any: ...


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def _require(spark: SparkSession, path: str) -> None:
    if not _exists(spark, path):
        raise FileNotFoundError(path)


class TextIngestor(Ingestor):
    """Whole files, one row each: ``path``, ``value``."""

    def __init__(self, spark: SparkSession, path: str, encoding: str = "utf-8") -> None:
        self.spark, self.path, self.encoding = spark, path, encoding

    def ingest(self) -> DataFrame:
        _require(self.spark, self.path)
        if self.encoding.lower().replace("-", "") in ("utf8", "usascii", "ascii"):
            return self.spark.read.text(self.path, wholetext=True).select(F.input_file_name().alias("path"), "value")
        files = self.spark.read.format("binaryFile").load(self.path)
        return files.select("path", F.decode("content", self.encoding).alias("value"))

    def text(self) -> str:
        """The one file's text."""
        return self.ingest().first()["value"]


class PickleIngestor(Ingestor):
    """One pickled object.  Unpickling runs code of the file's author, so it must
    be allowed explicitly."""

    def __init__(self, spark: SparkSession, path: str, *, trusted: bool = False) -> None:
        self.spark, self.path, self.trusted = spark, path, trusted

    def ingest(self) -> Any:
        if not self.trusted:
            raise PermissionError("pickle files can run code; pass trusted=True for files of your own")
        _require(self.spark, self.path)
        return pickle.loads(bytes(self.spark.read.format("binaryFile").load(self.path).first()["content"]))  # noqa: S301


def spark_type(annotation: Any) -> T.DataType:
    """The Spark type of a dataclass field's annotation."""
    import types
    import typing

    simple = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType(), bytes: T.BinaryType()}
    if annotation in simple:
        return simple[annotation]
    origin, args = typing.get_origin(annotation), typing.get_args(annotation)
    if origin in (typing.Union, types.UnionType):
        rest = [a for a in args if a is not type(None)]
        if len(rest) == 1:
            return spark_type(rest[0])
    if origin in (list, tuple, Sequence) and args:
        return T.ArrayType(spark_type(args[0]))
    if origin in (dict, Mapping) and args:
        return T.MapType(spark_type(args[0]), spark_type(args[1]))
    if dataclasses.is_dataclass(annotation):
        return dataclass_schema(annotation)
    raise TypeError(f"no Spark type for {annotation!r}")


def dataclass_schema(cls: type) -> T.StructType:
    import typing

    hints = typing.get_type_hints(cls)
    return T.StructType([T.StructField(f.name, spark_type(hints[f.name])) for f in dataclasses.fields(cls)])


def load_dataclasses(spark: SparkSession, path: str, cls: type) -> DataFrame:
    """A JSON array of objects with the fields of ``cls``.  TypeError if it is no
    array; ValueError for unknown fields or a missing field without a default."""
    _require(spark, path)
    schema = dataclass_schema(cls)
    first = spark.read.text(path, wholetext=True).select(F.substring(F.trim("value"), 1, 1).alias("c")).first()
    if first is None or first.c != "[":
        raise TypeError(f"{path} holds no JSON array")
    rows = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    names = {f.name for f in schema.fields}
    needed = {f.name for f in dataclasses.fields(cls) if f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING}
    found = set(rows.columns)
    if found - names or (found and needed - found):
        raise ValueError(f"fields {sorted(found)} do not fit {cls.__name__}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def save_dataclasses(spark: SparkSession, items: Sequence[Any] | DataFrame, path: str, *, exist_ok: bool = False) -> None:
    """A JSON array file of dataclass objects; a DataFrame is written as JSON Lines
    by the executors."""
    if isinstance(items, DataFrame):
        items.write.mode("overwrite" if exist_ok else "errorifexists").json(path)
        return
    import json

    if any(not dataclasses.is_dataclass(i) or isinstance(i, type) for i in items):
        raise TypeError("all items must be dataclass objects")
    if not exist_ok and _exists(spark, path):
        raise FileExistsError(path)
    raw = json.dumps([dataclasses.asdict(i) for i in items], indent=2).encode()
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def dataclasses_to_dataframe(spark: SparkSession, items: Sequence[Any], cls: type | None = None) -> DataFrame:
    if any(not dataclasses.is_dataclass(i) or isinstance(i, type) for i in items):
        raise TypeError("all items must be dataclass objects")
    if not items and cls is None:
        return spark.createDataFrame([], T.StructType([]))
    return spark.createDataFrame([dataclasses.asdict(i) for i in items], dataclass_schema(cls or type(items[0])))


class DataclassIngestor(Ingestor):
    def __init__(self, spark: SparkSession, path: str, cls: type) -> None:
        self.spark, self.path, self.cls = spark, path, cls

    def ingest(self) -> DataFrame:
        return with_order(load_dataclasses(self.spark, self.path, self.cls))


class TableIngestor(Ingestor):
    """A Parquet, ORC, JSON or CSV path, or a table name."""

    def __init__(self, spark: SparkSession, path: str, *, format: str = "parquet", schema: str | None = None, order: str | None = None, **options: Any) -> None:
        self.spark, self.path, self.format, self.schema, self.order, self.options = spark, path, format, schema, order, options

    def ingest(self) -> DataFrame:
        if self.format == "table":
            return with_order(self.spark.table(self.path), self.order)
        reader = self.spark.read.format(self.format).options(**self.options)
        return with_order((reader.schema(self.schema) if self.schema else reader).load(self.path), self.order)


class InMemoryIngestor(Ingestor):
    """A DataFrame as it is; other data as a (deep) copy."""

    def __init__(self, data: Any, *, copy: bool = True) -> None:
        self.data, self.copy = data, copy

    def ingest(self) -> Any:
        return self.data if isinstance(self.data, DataFrame) or not self.copy else copy.deepcopy(self.data)


class MappingIngestor(Ingestor):
    """``{key: source.ingest()}``."""

    def __init__(self, sources: Mapping[str, Ingestor]) -> None:
        self.sources = dict(sources)

    def ingest(self) -> dict[str, Any]:
        return {k: s.ingest() for k, s in self.sources.items()}

    def union(self, key: str = "source") -> DataFrame:
        """All sources in one frame with their key in a column."""
        out = None
        for k, df in self.ingest().items():
            one = df.withColumn(key, F.lit(k))
            out = one if out is None else out.unionByName(one, allowMissingColumns=True)
        if out is None:
            raise ValueError("no sources")
        return out


class ProcessorIngestor(Ingestor):
    """A source, then a transform; one plan."""

    def __init__(self, source: Ingestor, processor: Any) -> None:
        self.source, self.processor = source, processor

    def ingest(self) -> Any:
        step: Callable = getattr(self.processor, "process", self.processor)
        return step(self.source.ingest())


class FirstNIngestor(Ingestor):
    def __init__(self, source: Ingestor, n: int) -> None:
        ordering._positive(n)
        self.source, self.n = source, n

    def ingest(self) -> Any:
        data = self.source.ingest()
        return ordering.first_n(with_order(data), self.n) if isinstance(data, DataFrame) else data[: self.n]


class LastNIngestor(Ingestor):
    def __init__(self, source: Ingestor, n: int) -> None:
        ordering._positive(n)
        self.source, self.n = source, n

    def ingest(self) -> Any:
        data = self.source.ingest()
        return ordering.last_n(with_order(data), self.n) if isinstance(data, DataFrame) else data[-self.n :]


class ShuffleIngestor(Ingestor):
    """A seeded permutation; each call takes the next one of the seed's series."""

    def __init__(self, source: Ingestor, *, seed: int | None = None) -> None:
        self.source, self.seed, self.calls = source, seed, 0

    def ingest(self) -> DataFrame:
        seed = None if self.seed is None else self.seed * 1_000_003 + self.calls
        self.calls += 1
        return ordering.shuffle(with_order(self.source.ingest()), seed)


class FrameLoader:
    """Rows of a frame (or of rows in a list), lazily one by one on the driver."""

    def __init__(self, data: DataFrame | Sequence[Any]) -> None:
        self.data = data

    def lazy_load(self):
        return self.data.toLocalIterator(prefetchPartitions=True) if isinstance(self.data, DataFrame) else iter(self.data)

    def load(self) -> list[Any]:
        return list(self.lazy_load())


class StoreLoader(FrameLoader):
    """Rows of a store."""

    def __init__(self, store: Any) -> None:
        self.store = store

    @property
    def data(self) -> DataFrame:
        return self.store.all()
