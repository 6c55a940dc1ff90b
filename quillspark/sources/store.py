"""Keyed stores of documents or records over Parquet.

A store is a folder of immutable Parquet files and numbered manifests.  Rows are
dealt into buckets by a hash of their id; a manifest names one folder for each
bucket.  An upsert or a delete rewrites only the buckets that hold one of its
ids, then creates the next manifest; creating is atomic and fails if another
writer was faster, so readers see whole versions only.  A read of one id opens
one bucket.

Layouts: *untyped* keeps the metadata as one JSON text; *typed* has a column for
each declared key and a JSON text ``extra`` for the rest.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..model import ORD, Metadata
from ..session import scratch_dir

# Column type names of the declared schema and what they become.
COLUMN_TYPES = {
    "VARCHAR": "string",
    "TEXT": "string",
    "INTEGER": "int",
    "BIGINT": "bigint",
    "DOUBLE": "double",
    "REAL": "double",
    "BOOLEAN": "boolean",
    "DATE": "date",
    "TIMESTAMP": "timestamp",
    "JSON": "string",
}


class ReadOnlyError(RuntimeError):
    pass


def _ddl(kind: str) -> str:
    return COLUMN_TYPES.get(kind.upper(), kind)


class StoreTable:
    """Use :meth:`open` or :meth:`in_memory`; a context manager.  ``n_buckets`` holds
    for a store's life: choose it so that a bucket stays at about a GB."""

    def __init__(self, spark: SparkSession, path: str, *, kind: str = "document", metadata_schema: Mapping[str, str] | None = None, n_buckets: int = 16, read_only: bool = False) -> None:
        if kind not in ("document", "record"):
            raise ValueError(f"kind must be document or record, got {kind!r}")
        self.spark, self.path, self.kind, self.read_only = spark, path.rstrip("/"), kind, read_only
        self.metadata_schema = dict(metadata_schema) if metadata_schema is not None else None
        clash = {"id", "page_content", "extra", "metadata"} & set(self.metadata_schema or ())
        if clash:
            raise ValueError(f"reserved column names: {sorted(clash)}")
        self.n_buckets, self.closed, self._ephemeral = n_buckets, False, False
        fields = ["id string", *(["page_content string"] if kind == "document" else [])]
        fields += [f"`{k}` {_ddl(v)}" for k, v in self.metadata_schema.items()] + ["extra string"] if self.metadata_schema is not None else ["metadata string"]
        self.ddl = ", ".join(fields)
        self.columns = [f.split()[0].strip("`") for f in fields]
        self.schema = T.StructType.fromDDL(self.ddl)
        self._stored = T.StructType([*self.schema.fields, T.StructField("_version", T.LongType()), T.StructField("_place", T.LongType()), T.StructField("_bucket", T.IntegerType())])

    # -- opening -----------------------------------------------------------
    @classmethod
    def open(cls, spark: SparkSession, path: str, **options: Any) -> StoreTable:
        """A store at ``path``; its folder is made with the first write."""
        store = cls(spark, path, **options)
        if store.read_only and store._manifest() is None:
            raise FileNotFoundError(path)
        return store

    @classmethod
    def in_memory(cls, spark: SparkSession, **options: Any) -> StoreTable:
        """A store of its own in the shared scratch folder, cleared on close."""
        store = cls(spark, f"{scratch_dir(spark)}/store-{uuid.uuid4().hex}", **options)
        store._ephemeral = True
        return store

    def __enter__(self) -> StoreTable:
        self.closed = False
        return self

    def __exit__(self, *exc: object) -> None:
        self.close()

    def close(self) -> None:
        """May be called again; entering the store reopens it."""
        if self._ephemeral and not self.closed:
            fs, p = self._fs(self.path)
            fs.delete(p, True)
        self.closed = True

    # -- manifests ---------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifest(self) -> dict | None:
        fs, folder = self._fs(f"{self.path}/_manifests")
        if not fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        latest = max((n for n in names if n.endswith(".json")), default=None)
        if latest is None:
            return None
        stream = fs.open(self._fs(f"{self.path}/_manifests/{latest}")[1])
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        fs, p = self._fs(f"{self.path}/_manifests/{manifest['version']:012d}.json")
        out = fs.create(p, False)  # fails if another writer made this version
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()

    def _check_open(self, *, writing: bool = False) -> None:
        if self.closed:
            raise RuntimeError("the store is closed")
        if writing and self.read_only:
            raise ReadOnlyError(f"{self.path} was opened read-only")

    def _bucket(self, id_: Column) -> Column:
        n = (self._manifest() or {}).get("n_buckets", self.n_buckets)
        return F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")

    def _rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        manifest = self._manifest()
        known = manifest["buckets"] if manifest else {}
        wanted = [known[str(b)] for b in (known if buckets is None else buckets) if str(b) in known]
        if not wanted:
            return self.spark.createDataFrame([], self._stored)
        return self.spark.read.schema(self._stored).parquet(*[f"{self.path}/{d}" for d in wanted])

    def _ordered(self, rows: DataFrame) -> DataFrame:
        return rows.select(*self.columns)

    # -- rows --------------------------------------------------------------
    def _shape(self, df: DataFrame) -> DataFrame:
        """Input rows in the store's columns.  Untyped input may bring ``metadata``
        (JSON text) or plain columns; typed input plain columns, of which the
        undeclared ones go to ``extra``."""
        reserved = {"id", "page_content", "metadata", "extra", ORD}
        plain = [c for c in df.columns if c not in reserved]
        content = [F.col("page_content") if "page_content" in df.columns else F.lit(None).cast("string").alias("page_content")] if self.kind == "document" else []
        order = F.col(ORD) if ORD in df.columns else F.monotonically_increasing_id().alias(ORD)
        if self.metadata_schema is None:
            meta = F.col("metadata") if "metadata" in df.columns else F.to_json(F.struct(*plain)) if plain else F.lit("{}")
            return df.select(F.col("id").cast("string").alias("id"), *content, meta.alias("metadata"), order)
        typed = []
        given = F.try_parse_json(F.col("metadata")) if "metadata" in df.columns else None
        for k, v in self.metadata_schema.items():
            if k in df.columns:
                value = F.col(k).cast(_ddl(v))
            elif given is not None:
                value = F.try_variant_get(given, f'$["{k}"]', _ddl(v))
            else:
                value = F.lit(None).cast(_ddl(v))
            typed.append(value.alias(k))
        rest = [c for c in plain if c not in self.metadata_schema]
        if given is not None:
            fields = F.map_filter(F.from_json(F.col("metadata"), "map<string,variant>"), lambda k, _: ~k.isin(*self.metadata_schema) if self.metadata_schema else F.lit(True))
            extra = F.when(F.size(fields) > 0, F.to_json(fields))
        elif rest:
            text = F.to_json(F.struct(*rest))
            extra = F.when(text != "{}", text)
        else:
            extra = F.col("extra") if "extra" in df.columns else F.lit(None).cast("string")
        return df.select(F.col("id").cast("string").alias("id"), *content, *typed, extra.alias("extra"), order)

    # -- writing -----------------------------------------------------------
    def add(self, df: DataFrame) -> None:
        """Upsert; of equal ids in one batch the last row counts.  A replaced row
        keeps its place in the order."""
        self._check_open(writing=True)
        self._rewrite(self._shape(df), delete=False)

    add_documents = add_records = add

    def upsert_batch(self, df: DataFrame, epoch: int) -> None:
        """For ``writeStream.foreachBatch``."""
        self.add(df)

    def delete_many(self, ids: Sequence[str] | DataFrame) -> None:
        """Absent ids are no error."""
        self._check_open(writing=True)
        if not isinstance(ids, DataFrame):
            if not ids:
                return
            ids = self.spark.createDataFrame([(i,) for i in ids], "id string")
        self._rewrite(ids.select(F.col(ids.columns[0]).cast("string").alias("id")).distinct(), delete=True)

    def delete(self, id_: str) -> None:
        self.delete_many([id_])

    def _rewrite(self, batch: DataFrame, *, delete: bool) -> None:
        manifest = self._manifest() or {"version": 0, "n_buckets": self.n_buckets, "buckets": {}}
        version = manifest["version"] + 1
        batch = batch.withColumn("_bucket", F.pmod(F.xxhash64("id"), F.lit(manifest["n_buckets"])).cast("int"))
        folder = f"data/{version:012d}-{uuid.uuid4().hex[:8]}"
        staged = f"{self.path}/{folder}-batch"
        batch.write.parquet(staged)  # the batch is read twice: for its ids and buckets, and for its rows
        batch = self.spark.read.schema(batch.schema).parquet(staged)
        fs, staged_path = self._fs(staged)
        try:
            self._write_version(manifest, version, folder, batch, delete)
        finally:
            fs.delete(staged_path, True)

    def _write_version(self, manifest: dict, version: int, folder: str, batch: DataFrame, delete: bool) -> None:
        facts = [F.collect_set("_bucket").alias("touched")]
        if not delete:
            missing = F.col("id").isNull() | (F.col("id") == "")
            facts += [F.count_if(missing).alias("bad"), F.min(F.when(missing, F.col(ORD))).alias("first_bad")]
        facts = batch.agg(*facts).first()
        if not delete and facts["bad"]:
            raise ValueError(f"{facts['bad']} rows without an id, the first at {facts['first_bad']}")
        touched = sorted(facts["touched"])
        known = [b for b in touched if str(b) in manifest["buckets"]]
        old = self._rows(known) if known else None
        if delete:
            if old is None:
                return
            new = old.join(batch.select("id"), "id", "left_anti").select(*self._stored.names)
        else:
            latest = Window.partitionBy("id").orderBy(F.col(ORD).desc())
            batch = batch.withColumn("_at", F.row_number().over(latest)).where("_at = 1")
            if old is None:
                version_of, place_of = F.lit(version).cast("long"), F.col(ORD).cast("long")
                kept = None
            else:
                kept = old.join(batch.select("id"), "id", "left_anti").select(*self._stored.names)
                batch = batch.join(old.select("id", F.col("_version").alias("_v"), F.col("_place").alias("_p")), "id", "left")
                version_of, place_of = F.coalesce("_v", F.lit(version).cast("long")), F.coalesce("_p", F.col(ORD)).cast("long")
            new = batch.select(*self.columns, version_of.alias("_version"), place_of.alias("_place"), "_bucket")
            new = new if kept is None else kept.unionByName(new)
        # one file a bucket and task; rows of a bucket keep their order within it
        new.withColumn("_dir", F.col("_bucket")).repartition("_bucket").sortWithinPartitions("_bucket", "_version", "_place").write.partitionBy("_dir").parquet(f"{self.path}/{folder}")
        fs, p = self._fs(f"{self.path}/{folder}")
        made = {s.getPath().getName() for s in fs.listStatus(p)}
        for b in touched:
            manifest["buckets"].pop(str(b), None)
            if f"_dir={b}" in made:
                manifest["buckets"][str(b)] = f"{folder}/_dir={b}"
        self._commit(manifest | {"version": version})

    # -- reading -----------------------------------------------------------
    def all(self, *, ordered: bool = False) -> DataFrame:
        self._check_open()
        rows = self._rows()
        return self._ordered(rows.orderBy("_version", "_place") if ordered else rows)

    def get(self, id_: str) -> Row | None:
        """The row or None; reads one bucket."""
        self._check_open()
        bucket = self.spark.sql("SELECT 1").select(self._bucket(F.lit(id_))).first()[0]
        return self._ordered(self._rows([bucket]).where(F.col("id") == F.lit(id_))).first()

    def _requested(self, ids: Sequence[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
        """The ids with ``pos``, and the stored rows of these ids: only their buckets are
        read, and the rows are reduced to them before anything is joined."""
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame(list(enumerate(ids)), "pos long, id string")
        buckets = [r[0] for r in ids.where("id is not null").select(self._bucket(F.col("id"))).distinct().collect()]  # at most n_buckets
        return ids, self._rows(buckets).join(ids.select("id"), "id", "left_semi")

    def get_many(self, ids: Sequence[str] | DataFrame) -> DataFrame:
        """One row for each requested id, in order of ``pos``; NULLs where there is
        none, repeated ids repeated.  Take ``found`` to tell."""
        self._check_open()
        ids, own = self._requested(ids)
        rows = self._ordered(own).withColumn("found", F.lit(True)).withColumnRenamed("id", "_id")
        joined = ids.join(rows, ids.id == rows["_id"], "left")
        return joined.select("pos", "id", F.coalesce("found", F.lit(False)).alias("found"), *[c for c in self.columns if c != "id"]).orderBy("pos")

    def filter(self, *, mode: str = "typed", **metadata: Any) -> DataFrame:
        """Rows whose metadata equals all of ``metadata`` (all rows without any).

        ``mode="typed"``: values compare as in Python.  ``mode="text"``: their
        texts compare, and dots in a key lead into nested objects.
        """
        self._check_open()
        if mode not in ("typed", "text"):
            raise ValueError(f"mode must be typed or text, got {mode!r}")
        rows = self._rows()
        for key, value in metadata.items():
            if self.metadata_schema is not None and key in self.metadata_schema:
                rows = rows.where(Metadata.columns(key).equals(key, value, rows.schema))
                continue
            name = "extra" if self.metadata_schema is not None else "metadata"
            if mode == "text":
                text = str(value).lower() if isinstance(value, bool) else str(value)
                rows = rows.where(F.lit(False) if value is None else F.get_json_object(F.col(name), f"$.{key}") == F.lit(text))
            else:
                rows = rows.where(Metadata.json(name).equals(key, value))
        return self._ordered(rows)

    def check_ids(self, ids: Sequence[str] | DataFrame) -> tuple[DataFrame, DataFrame]:
        """(found, missing): the requested ids with ``pos``, in order, repeats kept."""
        self._check_open()
        ids, own = self._requested(ids)
        own = own.select("id")
        return ids.join(own, "id", "left_semi").select("pos", "id").orderBy("pos"), ids.join(own, "id", "left_anti").select("pos", "id").orderBy("pos")

    def lazy_all(self) -> Iterator[Row]:
        return self.all(ordered=True).toLocalIterator(prefetchPartitions=True)

    def iter_batches(self, batch_size: int = 32) -> Iterator[list[Row]]:
        if batch_size < 1:
            raise ValueError(f"batch_size must be at least 1, got {batch_size}")
        rows = self.lazy_all()
        while batch := list(itertools.islice(rows, batch_size)):
            yield batch

    def count(self) -> int:
        self._check_open()
        return self._rows().count()

    def get_columns_info(self) -> dict[str, str]:
        return {f.name: f.dataType.simpleString() for f in self.schema.fields}

    def show_columns_info(self) -> None:
        for name, kind in self.get_columns_info().items():
            print(f"{name}: {kind}")

    def metadata_of(self, row: Row) -> dict[str, Any]:
        """One row's metadata as a dict; typed NULLs are left out, ``extra`` is merged over."""
        if self.metadata_schema is None:
            return json.loads(row["metadata"] or "{}")
        typed = {k: row[k] for k in self.metadata_schema if row[k] is not None}
        return typed | json.loads(row["extra"] or "{}")

    def with_metadata(self, df: DataFrame) -> DataFrame:
        """Rows of this store with ``metadata`` as one JSON text."""
        if self.metadata_schema is None:
            return df
        typed = F.from_json(F.to_json(F.struct(*self.metadata_schema)), "map<string,variant>") if self.metadata_schema else F.from_json(F.lit("{}"), "map<string,variant>")
        extra = F.from_json(F.coalesce(F.col("extra"), F.lit("{}")), "map<string,variant>")
        rest = F.map_filter(typed, lambda k, _: ~F.map_contains_key(extra, k))
        return df.select("id", *(["page_content"] if self.kind == "document" else []), F.to_json(F.map_concat(rest, extra)).alias("metadata"))
