"""Shared plumbing: tables, the shared work folder, shipping the package, word splitting.

Intermediate tables are always written with Spark's own committer to the folder named by
``spark.checkpoint.dir``, so a lost executor or a retried task never leaves a partial table behind.
"""

from __future__ import annotations

import atexit
import gc
import os
import re
import shutil
import tempfile
import time
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.sources.scans import spread, table

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
"""A-Z to a-z on UTF-8 bytes; every other byte stays."""

SPACED = "[^\\x20\\x09-\\x0D]+"
"""A word between ASCII white space; ``bytes.split()`` cuts at the same six bytes."""

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: set[str] = set()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; texts are dealt to all cores where the table is small."""
    df = table(spark, sf_dir, name)
    return spread(df) if name == "documents" else df


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def ship(spark: SparkSession) -> None:
    """Make this package importable by Python workers wherever the driver was started from."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    if spark.conf.get(BATCH_BYTES, None) in (None, "64MB", "67108864", "67108864b"):
        spark.conf.set(BATCH_BYTES, str(16 << 20))  # the default bounds rows, not bytes
    _shipped.add(app)
    top = Path(__file__).resolve().parents[1]
    out = tempfile.mkdtemp(prefix="kinfold-ship-")
    atexit.register(shutil.rmtree, out, ignore_errors=True)
    target = os.path.abspath(os.path.join(out, "kinfold_pkg.zip"))
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path("kinfold") / p.relative_to(top))
    spark.sparkContext.addPyFile(target)


def runs(batch, column: int, limit: int):
    """Slices of a record batch, in order, with about ``limit`` bytes of text in ``column`` each."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit)))
        yield batch.slice(at, end - at)
        at = end


def released(run):
    """A batch function that gives freed memory back to the system at its end: workers are reused, and
    what one stage freed would otherwise stay with them through the next."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the session names. Where none is set, a session with all its threads in one
    machine (tests) gets a temporary one; on a cluster that is an error, for executors would not see it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="kinfold-work-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator call under the shared folder. Written once, dropped when consumed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/kinfold/{name}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def clear(self) -> None:
        """Delete all tables; at exit, or when their results are written elsewhere."""
        if self.spark.sparkContext._jsc is not None:
            self.drop("")
        elif self.root.startswith("file:"):
            shutil.rmtree("/" + self.root.removeprefix("file:").lstrip("/"), ignore_errors=True)

    def put(self, df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", compression).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Let Spark's cleaner delete the shuffle files of finished steps now: it acts when the driver's
        garbage is collected, which may be long after tables have taken the shuffles' place. A second round
        is for what the listeners of the step that just ended still held."""
        for _ in range(2):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(0.3)

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def repeated(rows: DataFrame, times: str, index: str, chunk: int = 10_000) -> DataFrame:
    """Every row ``times`` times, numbered from 0 in ``index``. Rows with more than ``chunk`` repeats are
    cut into chunks that are dealt to all tasks first, so no array is long and no task makes them all."""
    n, few = F.col(times), rows.where(F.col(times).between(1, chunk))
    small = few.withColumn(index, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    starts = rows.where(n > chunk).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), n - 1, F.lit(chunk).cast("long"))))
    large = starts.repartition(shuffle_width(session(rows))).withColumn(index, F.explode(F.sequence(F.col("_at"), F.least(F.col("_at") + chunk, n) - 1))).drop("_at")
    return small.unionByName(large)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def crc_of_text(col) -> Column:
    return F.crc32(F.coalesce(col, F.lit("")))


def word_count(col) -> Column:
    """Words between ASCII white space, by built-in functions; null text has none."""
    return F.regexp_count(F.coalesce(col, F.lit("")), F.lit(SPACED)).cast("long")
