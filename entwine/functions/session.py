"""Shared folder for intermediate tables, and shipping of this package to the executors."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parents[1]
#: Rows and bytes of the batches that go to Python workers, where the session doesn't say: texts can be long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "8388608"}
#: Rows up to which a table of a few numbers a row is broadcast.
BROADCAST_ROWS = 1_000_000
#: Share of the driver's heap beyond which a table that is stored is followed by a collection, and seconds between two such at least.
HEAP_SHARE, PAUSE = 0.5, 3.0
_SHIPPED: set[str] = set()
_FOLDERS: dict[str, str] = {}
_STORED: dict[int, tuple[weakref.ref, str]] = {}
_STEPS: list[list[DataFrame]] = []
_RELIEVED = [0.0]


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per application, and bound the batches that they get."""
    app = spark.sparkContext.applicationId
    for key, value in BATCHES.items():
        if spark.conf.get(key, "7") == "7":
            spark.conf.set(key, value)
    if app in _SHIPPED:
        return
    folder = tempfile.mkdtemp(prefix="entwine-code-")
    path = f"{folder}/entwine_code.zip"
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(PACKAGE.rglob("*.py")):
            out.write(file, str(file.relative_to(PACKAGE.parent)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_folder(spark: SparkSession) -> str:
    """The run's folder under spark.checkpoint.dir; where that is unset, under a folder of our own, on a local master only."""
    app = spark.sparkContext.applicationId
    if app not in _FOLDERS:
        top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not top:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir is not set: executors need a shared folder for intermediate tables")
            top = "file://" + tempfile.mkdtemp(prefix="entwine-shared-")
            spark.sparkContext.setCheckpointDir(top)
        folder = _FOLDERS[app] = f"{top.rstrip('/')}/entwine-{uuid.uuid4().hex[:12]}"
        atexit.register(remove, spark, folder)
    return _FOLDERS[app]


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables; a session that has ended leaves it to the cluster."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the JVM may be gone at exit
        return


def release(spark: SparkSession) -> None:
    """Let the driver drop what nothing refers to: shuffle files of such tables are deleted, and its heap shrinks."""
    gc.collect()
    spark._jvm.System.gc()


def relieve(spark: SparkSession) -> None:
    """release() if the heap has grown past HEAP_SHARE: what plans, tasks and shuffles of many steps leave is not collected until the heap is full."""
    runtime = spark._jvm.Runtime.getRuntime()
    if time.monotonic() - _RELIEVED[0] >= PAUSE and runtime.totalMemory() > HEAP_SHARE * runtime.maxMemory():
        release(spark)
        _RELIEVED[0] = time.monotonic()


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there, and a lost executor loses nothing.

    Zstandard, whose buffers Parquet pools; those of the default codec wait outside the heap for a collection.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    relieve(spark)
    out = spark.read.schema(df.schema).parquet(path)
    _STORED[id(out)] = (weakref.ref(out, lambda _, i=id(out): _STORED.pop(i, None)), path)
    for steps in _STEPS[-1:]:
        steps.append(out)
    return out


def settled(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """make(), stored; the tables that were stored to make it are deleted, and what is broadcast or shuffled for it can go."""
    _STEPS.append([])
    try:
        made = make()
        steps = _STEPS[-1]
        _STEPS[-1] = []
        out = stored(made, name)
    finally:
        _STEPS.pop()
    forget(*steps)
    spark = out.sparkSession
    del made, steps
    release(spark)
    for steps in _STEPS[-1:]:
        steps.append(out)
    return out


def located(uri: str) -> tuple[fs.FileSystem, str]:
    """A path of Spark's as Arrow's file system and the path there."""
    for other in ("s3a://", "s3n://"):
        uri = uri.replace(other, "s3://", 1) if uri.startswith(other) else uri
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def forget(*tables: DataFrame) -> None:
    """Delete stored() tables that nothing will read any more; others are left alone."""
    for df in tables:
        kept = _STORED.pop(id(df), None)
        if kept and kept[0]() is df:
            remove(df.sparkSession, kept[1])
