"""What the training-data operators share: the shared scratch folder, file access from tasks, Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import hashlib
import mmap
import os
import posixpath
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession


ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, where the Python path doesn't have it already.

    Rows of an Arrow batch are set to 2000, if they have Spark's default, as rows here hold whole texts.
    """
    if spark.conf.get(ROWS) == "10000":
        spark.conf.set(ROWS, "2000")
    root = Path(__file__).resolve().parents[2]
    context = spark.sparkContext
    if str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(context, "_relspark_shipped", False):
        return
    name = Path(tempfile.mkdtemp(prefix="relspark-")) / "relspark.zip"
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted((root / "relspark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    context.addPyFile(str(name))
    context._relspark_shipped = True


def arrow(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow``, for ``DataFrame.transform``, with the package shipped and memory given back after each task."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidied(function), schema)


def _tidied(function):
    def run(batches):
        begin_task()
        try:
            yield from function(batches)
        finally:
            end_task()

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where that setting is unset in local mode (tests) is a temporary folder made and set for this session; on a
    cluster it must be set, as executors don't see the driver's own folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="relspark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, df: DataFrame) -> None:
    """Remove a table made by :func:`stored` that nothing reads any more."""
    for f in df.inputFiles()[:1]:
        folder = posixpath.dirname(f)
        if folder.startswith(("file:", "hdfs:", "s3", "gs:", "abfs")) or folder.startswith("/"):
            delete(spark, folder)


def delete(spark: SparkSession, folder: str) -> None:
    """Remove a folder below the shared one that nothing reads any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str):
    """The file system of ``uri`` and the path in it, as tasks open them (local, HDFS, S3, GCS by Arrow)."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def share(spark: SparkSession, data: bytes) -> str:
    """Send ``data`` to every executor as a file, once, however many of its workers map it; its name for :func:`mapped`."""
    name = f"relspark-{hashlib.sha256(data).hexdigest()[:32]}.bin"
    context = spark.sparkContext
    known = context.__dict__.setdefault("_relspark_files", set())
    if name not in known:
        path = Path(tempfile.mkdtemp(prefix="relspark-")) / name
        path.write_bytes(data)
        context.addFile(str(path))
        known.add(name)
    return name


def mapped(name: str) -> mmap.mmap:
    """A shared file as a read-only memory map: an executor's workers have its pages in common, and they can be evicted."""
    with open(SparkFiles.get(name), "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)


_sole: dict = {}


def sole(key, make):
    """What ``make`` gives, kept in this worker under ``key`` in the place of what was kept before.

    Workers serve many operators; only the last one's memos stay, so their memory doesn't add up.
    """
    if key not in _sole:
        _sole.clear()
        gc.collect()
        _sole[key] = make()
    return _sole[key]


class _Idle:
    """Gives back what a worker doesn't use: free memory after each task, memos too when no task came for ``SECONDS``.

    Spark keeps workers of ended stages beside those of the running one; this keeps their memory from adding up.
    """

    SECONDS = 2

    def __init__(self) -> None:
        self.lock, self.tasks, self.timer = threading.Lock(), 0, None

    def begin(self) -> None:
        with self.lock:
            self.tasks += 1
            if self.timer is not None:
                self.timer.cancel()
                self.timer = None

    def end(self) -> None:
        self.give_back()
        with self.lock:
            self.tasks -= 1
            if not self.tasks and _sole:
                self.timer = threading.Timer(self.SECONDS, self.forget)
                self.timer.daemon = True
                self.timer.start()

    def forget(self) -> None:
        with self.lock:
            if self.tasks:
                return
            _sole.clear()
        gc.collect()
        self.give_back()

    @staticmethod
    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)


_idle = _Idle()


def begin_task() -> None:
    _idle.begin()


def end_task() -> None:
    _idle.end()


def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[list[list]]:
    """Each batch as one list per column."""
    for b in batches:
        if b.num_rows:
            yield [c.to_pylist() for c in b.columns]


def small_batches(schema: pa.Schema, rows: Iterable[tuple], size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``size`` rows."""
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) >= size:
            yield batch(schema, held)
            held = []
    if held:
        yield batch(schema, held)


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
