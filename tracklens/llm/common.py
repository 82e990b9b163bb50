"""What the corpus operators share: the shared folder, fold columns and text helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np  # noqa: F401  its BLAS has to be loaded before its threads are set
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of applications without the setting.
_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where the setting is absent, as in tests."""
    set_to = spark.conf.get("spark.checkpoint.dir", None)
    if set_to:
        return set_to.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="tracklens-shared-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return _own_dirs[app]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tracklens/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd", paths: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors. ``paths`` collects the folders."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if paths is not None:
        paths.append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete shuffle files of plans that are no longer referenced, after their result was stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on any file system that Spark reaches."""
    with contextlib.suppress(Exception):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def some_of(key: Column, wanted: int, rows: int) -> Column:
    """A hash-chosen share of ``rows`` rows, somewhat more than ``wanted``: what a limit then cuts doesn't grow with the table."""
    most = 2**31 - 1
    return F.pmod(key, F.lit(most)) <= int(min(1.0, (1.2 * wanted + 100) / max(1, rows)) * most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of an Arrow batch in the actions within; the session's own setting holds again after."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def batch_rows(spark: SparkSession, rows: int) -> None:
    """Rows of an Arrow batch; bounds a worker's memory when rows are long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def one_blas_thread() -> None:
    """Matrix products of this process run on its own core, as tasks fill the others already; what earlier tasks held goes back to the system."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    with contextlib.suppress(OSError):
        with open("/proc/self/maps") as f:
            paths = {line.split()[-1] for line in f if "openblas" in line}
        for path in paths:
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
                if hasattr(lib, name):
                    getattr(lib, name)(1)


# A driver that forks may hang in a product of several threads, so this holds there too.
one_blas_thread()
