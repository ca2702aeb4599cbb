"""Shared helpers: durable intermediate tables, worker-wide state, text access."""

import atexit
import ctypes
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict = {}
#: Paths of the tables made in each open scratch block, the innermost last.
_OPEN: list = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where it is set; else, on one machine only, a
    folder of our own for the life of this process.  On a cluster without that
    setting this is an error: executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that driver and executors share")
        if "dir" not in _OWN:
            _OWN["dir"] = tempfile.mkdtemp(prefix="tessella-")
            atexit.register(_remove, _OWN["dir"])
        found = f"file://{_OWN['dir']}"
    return found.rstrip("/")


def _remove(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tessella/{name}-{uuid.uuid4().hex}"


def shared_uri(spark: SparkSession, path: str) -> str:
    """Make a folder of the shared store and give its full URI, as other libraries read it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(at)
    uri = store.makeQualified(at).toString()
    return uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri


def table(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and reread it.

    This cuts lineage as a checkpoint does, but columnar and compressed; the
    files outlive any executor.  Inside :func:`scratch` it goes when the block ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    if _OPEN:
        _OPEN[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession):
    """A block whose tables are deleted at its end.

    Gives ``keep(df, name)``, which writes a table that outlives the block (and
    goes with the block around it, if there is one).
    """
    made: list = []
    _OPEN.append(made)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = table(df, name)
        path = made.pop()
        if len(_OPEN) > 1:
            _OPEN[-2].append(path)
        return out

    try:
        yield keep
    finally:
        _OPEN.pop()
        delete(spark, *made)


def delete(spark: SparkSession, *paths: str) -> None:
    """Remove folders of any store that Spark reads."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def worker_state(name: str, make):
    """State that lives as long as the Python worker, made at its first use."""
    store = sys.modules.setdefault("_tessella_worker_state", types.ModuleType("_tessella_worker_state"))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def release() -> None:
    """Give memory that is no longer used back to the machine, as a worker lives on after its task."""
    pa.default_memory_pool().release_unused()
    trim = worker_state("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))
    if trim is not None:
        trim(0)


def utf8(column) -> list:
    """The values of a string column as UTF-8 bytes; null is empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def slices(batches, rows: int = 256):
    """Cut record batches into pieces of at most ``rows`` rows, so that only a few texts are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    release()
