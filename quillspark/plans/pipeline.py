"""Processors, their composition, and objects from declarative configurations."""

from __future__ import annotations

import functools
import logging
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..model import Metadata
from ..operators import filters, ordering

logger = logging.getLogger(__name__)


class Processor(ABC):
    """DataFrame to DataFrame; also works with ``df.transform(processor)``."""

    @abstractmethod
    def process(self, data: Any) -> Any: ...

    def __call__(self, data: Any) -> Any:
        return self.process(data)


class LambdaProcessor(Processor):
    """Any function of the whole input."""

    def __init__(self, fn: Callable[[Any], Any]) -> None:
        self.fn = fn

    def process(self, data: Any) -> Any:
        return self.fn(data)


class SequentialProcessor(Processor):
    """One after the other; none is the identity."""

    def __init__(self, *processors: Processor | Callable[[Any], Any]) -> None:
        self.processors = processors

    def process(self, data: Any) -> Any:
        return functools.reduce(lambda d, p: p(d), self.processors, data)


class SequenceProcessor(Processor):
    """A Python function for each row, in Arrow batches on the executors.

    ``fn`` takes a row as a dict and gives a dict of ``out_ddl``.  Errors stop the
    job, or, with ``raise_on_error=False``, drop the row with a log entry; with
    ``errors`` they go to a column of that name instead.  Parallelism is that of
    the input's partitions (``partitions`` deals it anew).
    """

    def __init__(self, fn: Callable[[dict], dict], out_ddl: str, *, raise_on_error: bool = True, errors: str | None = None, partitions: int = 0) -> None:
        if partitions < 0:
            raise ValueError(f"partitions must not be negative, got {partitions}")
        self.fn, self.out_ddl, self.raise_on_error, self.errors, self.partitions = fn, out_ddl, raise_on_error, errors, partitions

    def process(self, data: DataFrame) -> DataFrame:
        from pyspark.sql import types as T

        from ..session import ship_package

        ship_package(data.sparkSession)
        fn, strict, errors = self.fn, self.raise_on_error, self.errors
        names = T.StructType.fromDDL(self.out_ddl).names

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                out, skipped = [], []
                for row in frame.to_dict("records"):
                    try:
                        out.append({n: None for n in names} | fn(row) | ({errors: None} if errors else {}))
                    except Exception as e:
                        if errors:
                            out.append({n: None for n in names} | {errors: f"{type(e).__name__}: {e}"})
                        elif strict:
                            raise
                        else:
                            skipped.append(e)
                if skipped:
                    logging.getLogger(__name__).warning("%d rows skipped, first for: %s", len(skipped), skipped[0])
                yield pd.DataFrame(out, columns=[*names, *([errors] if errors else [])])

        ddl = f"{self.out_ddl}, `{errors}` string" if errors else self.out_ddl
        rows = data.repartition(self.partitions) if self.partitions else data
        return rows.mapInPandas(run, ddl)


class FilterByMetadata(Processor):
    def __init__(self, meta: Metadata, key: str, value: Any) -> None:
        self.meta, self.key, self.value = meta, key, value

    def process(self, data: DataFrame) -> DataFrame:
        return filters.filter_by_metadata(data, self.meta, self.key, self.value)


class FilterByMetadataRange(Processor):
    def __init__(self, meta: Metadata, key: str, lower: Any = None, upper: Any = None) -> None:
        self.meta, self.key, self.lower, self.upper = meta, key, lower, upper

    def process(self, data: DataFrame) -> DataFrame:
        return filters.filter_by_metadata_range(data, self.meta, self.key, self.lower, self.upper)


class FilterByMetadataValues(Processor):
    def __init__(self, meta: Metadata, key: str, values: Any) -> None:
        self.meta, self.key, self.values = meta, key, values

    def process(self, data: DataFrame) -> DataFrame:
        return filters.filter_by_metadata_values(data, self.meta, self.key, self.values)


class SortByMetadata(Processor):
    def __init__(self, meta: Metadata, key: str, *, keep_missing: bool = True, reverse: bool = False) -> None:
        self.meta, self.key, self.keep_missing, self.reverse = meta, key, keep_missing, reverse

    def process(self, data: DataFrame) -> DataFrame:
        return ordering.sort_by_metadata(data, self.meta, self.key, keep_missing=self.keep_missing, reverse=self.reverse)


class SortByKey(Processor):
    def __init__(self, key: str, *, reverse: bool = False) -> None:
        self.key, self.reverse = key, reverse

    def process(self, data: DataFrame) -> DataFrame:
        return ordering.sort_by_key(data, self.key, reverse=self.reverse)


class FirstN(Processor):
    def __init__(self, n: int) -> None:
        ordering._positive(n)
        self.n = n

    def process(self, data: DataFrame) -> DataFrame:
        return ordering.first_n(data, self.n)


class LastN(Processor):
    def __init__(self, n: int) -> None:
        ordering._positive(n)
        self.n = n

    def process(self, data: DataFrame) -> DataFrame:
        return ordering.last_n(data, self.n)


class Shuffle(Processor):
    """Seeded; every call takes the next permutation of the seed's series."""

    def __init__(self, *, seed: int | None = None) -> None:
        self.seed, self.calls = seed, 0

    def process(self, data: DataFrame) -> DataFrame:
        seed = None if self.seed is None else self.seed * 1_000_003 + self.calls
        self.calls += 1
        return ordering.shuffle(data, seed)


# -- configuration ---------------------------------------------------------
class Registry:
    """Names that a configuration may use.  Nothing else is imported or called, so
    a configuration cannot run code of its own."""

    def __init__(self) -> None:
        self._known: dict[str, Callable[..., Any]] = {}

    def register(self, name: str, factory: Callable[..., Any]) -> None:
        if name in self._known:
            raise ValueError(f"{name!r} is registered already")
        self._known[name] = factory

    def names(self) -> list[str]:
        return sorted(self._known)

    def resolve(self, obj: Any, cls: type = object, **context: Any) -> Any:
        """An object as it is, or what a dict ``{"_target_": name, ...}`` (nested
        ones first) or a config object makes.  TypeError if it is no ``cls``."""
        made = self._make(obj, context)
        if not isinstance(made, cls):
            raise TypeError(f"expected {cls.__name__}, got {type(made).__name__}")
        return made

    def _make(self, obj: Any, context: Mapping[str, Any]) -> Any:
        from .config import Config

        if isinstance(obj, Config):
            obj = obj.to_kwargs()
        if isinstance(obj, Mapping):
            values = {k: self._make(v, context) for k, v in obj.items() if k != "_target_"}
            if "_target_" not in obj:
                return values
            name = obj["_target_"]
            if name not in self._known:
                raise ValueError(f"unknown target {name!r}; known: {self.names()}")
            return self._known[name](*values.pop("_args_", ()), **values)
        if isinstance(obj, list):
            return [self._make(v, context) for v in obj]
        return obj


class Factory:
    """Makes an object when asked: a given one, or one from a configuration."""

    def __init__(self, obj: Any, registry: Registry | None = None, cls: type = object) -> None:
        self.obj, self.registry, self.cls = obj, registry, cls

    def make(self) -> Any:
        return self.obj if self.registry is None else self.registry.resolve(self.obj, self.cls)


def default_registry(spark: Any) -> Registry:
    """All sources, processors and stores of this library; text splitters, models,
    embeddings and vector stores are registered by their users."""
    from ..operators import frames
    from ..sources import fake, ingest, store

    known = Registry()
    for name, cls in (("text", ingest.TextIngestor), ("pickle", ingest.PickleIngestor), ("dataclass", ingest.DataclassIngestor), ("table", ingest.TableIngestor)):
        known.register(f"ingestor.{name}", functools.partial(cls, spark))
    for name, cls in (
        ("in_memory", ingest.InMemoryIngestor),
        ("mapping", ingest.MappingIngestor),
        ("processor", ingest.ProcessorIngestor),
        ("first_n", ingest.FirstNIngestor),
        ("last_n", ingest.LastNIngestor),
        ("shuffle", ingest.ShuffleIngestor),
    ):
        known.register(f"ingestor.{name}", cls)
    known.register("ingestor.fake_documents", lambda **k: ingest.InMemoryIngestor(fake.fake_documents(spark, **k)))
    known.register("ingestor.fake_records", lambda **k: ingest.InMemoryIngestor(fake.fake_records(spark, **k)))
    for name, cls in (
        ("lambda", LambdaProcessor),
        ("sequential", SequentialProcessor),
        ("filter_by_metadata", FilterByMetadata),
        ("filter_by_metadata_range", FilterByMetadataRange),
        ("filter_by_metadata_values", FilterByMetadataValues),
        ("sort_by_metadata", SortByMetadata),
        ("sort_by_key", SortByKey),
        ("first_n", FirstN),
        ("last_n", LastN),
        ("shuffle", Shuffle),
    ):
        known.register(f"processor.{name}", cls)
    known.register("metadata.columns", Metadata.columns)
    known.register("metadata.map", Metadata.map)
    known.register("metadata.json", Metadata.json)
    known.register("store.in_memory", functools.partial(store.StoreTable.in_memory, spark))
    known.register("store.parquet", functools.partial(store.StoreTable.open, spark))
    known.register("loader.frame", ingest.FrameLoader)
    known.register("loader.store", ingest.StoreLoader)
    known.register("splitter.characters", lambda **k: LambdaProcessor(functools.partial(frames.split_text, **k)))
    return known


