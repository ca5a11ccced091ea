"""Intermediate tables below the folder that the cluster's executors share.

What is stored cuts the lineage: what a lost executor held is read again, not computed again.
A ``scratch`` block deletes the tables made within it, but for those it is told to keep.
"""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_OPEN: list[list[str]] = []
_TRIMMED = [0.0]


def shared_dir(spark: SparkSession) -> str:
    """A new folder, visible to all executors, below ``spark.checkpoint.dir``.

    Only a local session without that setting gets one below the temporary folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = made.get() if made.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(base)
    if "://" not in base and base.startswith("/"):
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/tessera-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def trim(spark: SparkSession) -> bool:
    """Collects the driver's garbage if its heap has grown over half of its limit, at most every two seconds.

    Programs of many small jobs leave plans behind, for which the JVM takes all the memory it may
    rather than collect them; Spark deletes shuffles and broadcasts of plans that are collected.
    """
    lang = spark._jvm.java.lang
    heap = lang.Runtime.getRuntime()
    if heap.totalMemory() <= heap.maxMemory() // 2 or time.monotonic() < _TRIMMED[0] + 2:
        return False
    lang.System.gc()
    _TRIMMED[0] = time.monotonic()
    return True


def stored(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    trim(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class scratch:
    """``with scratch(spark) as s``: tables stored inside go at its end, but for ``s.keep(...)``.

    What is kept, and all of a block that fails, belongs to the block around it, if there is one.
    A DataFrame that is returned unread must have each table it reads kept.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.kept = spark, set()

    def keep(self, *tables: DataFrame | str) -> None:
        self.kept |= {t if isinstance(t, str) else t.stored_at for t in tables}

    def __enter__(self) -> scratch:
        _OPEN.append([])
        return self

    def __exit__(self, kind, *_) -> None:
        made = _OPEN.pop()
        gone = [] if kind else [p for p in made if p not in self.kept]
        for path in gone:
            delete(self.spark, path)
        if _OPEN:
            _OPEN[-1] += [p for p in made if p not in gone]
