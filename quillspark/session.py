"""Sessions: making this package importable on the executors."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


# Spark's defaults, and what replaces them: texts of many kB make large batches, of
# which a Python worker holds several forms at once.
_BATCHES = (("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000, 1_000), ("spark.sql.execution.arrow.maxBytesPerBatch", 64 << 20, 4 << 20))


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, so that functions in
    it can be unpickled there however the driver found it; and bound the batches
    that Python workers get, where the session still has Spark's defaults."""
    sc = spark.sparkContext
    for key, default, own in _BATCHES:
        if spark.conf.get(key).rstrip("b") == str(default):
            spark.conf.set(key, str(own))
    if getattr(sc, "_quillspark_shipped", False):
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="quillspark-"), "quillspark_src.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(path)
    sc._quillspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.  Where the
    session has none, a temporary folder is set if all runs on this machine
    (a local master); a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """A folder of this session in the shared one, for intermediate tables; it is
    deleted when the driver's Python ends."""
    sc = spark.sparkContext
    found = getattr(sc, "_quillspark_scratch", None)
    if found is None:
        found = sc._quillspark_scratch = f"{shared_dir(spark)}/quillspark/{uuid.uuid4().hex}"

        def clear() -> None:
            with contextlib.suppress(Exception):  # the JVM may be gone
                path = sc._jvm.org.apache.hadoop.fs.Path(found)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

        atexit.register(clear)
    return found


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to the scratch folder and read it again: it is computed once
    however often it is used, the lineage is cut, and the rows survive the loss of
    executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    for tables in getattr(spark.sparkContext, "_quillspark_scopes", []):
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[list[str]]:
    """Within it intermediate tables are noted in a list; those that are still in the
    list at the end are deleted.  Take out the last one to keep a written result."""
    sc = spark.sparkContext
    if not hasattr(sc, "_quillspark_scopes"):
        sc._quillspark_scopes = []
    tables: list[str] = []
    sc._quillspark_scopes.append(tables)
    try:
        yield tables
    finally:
        sc._quillspark_scopes.remove(tables)
        delete_tables(spark, tables)


def delete_tables(spark: SparkSession, paths: Iterable[str]) -> None:
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
