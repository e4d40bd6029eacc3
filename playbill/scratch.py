"""Written tables in the shared folder: what an operator keeps from one step to the next."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster sets it.

    Where it is unset, a session on one machine (tests) gets a folder that goes with the process; a cluster, whose executors
    could not read each other's local folders, gets an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="playbill_")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        root = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which `release` removes with the tables."""
    path = f"{folder(spark)}/playbill_{name}_{uuid.uuid4().hex}"
    _STORED.append(path)
    return path


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The frame, written and read back, and its path: its lineage ends there, and a lost executor costs no earlier work."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    return stored(df, name)[0]


def remove(spark: SparkSession, path: str) -> None:
    """Remove a table that nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    if path in _STORED:
        _STORED.remove(path)


def release(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Remove this process's tables, or those after the first `since`; to be called once results are stored elsewhere."""
    for path in [p for p in _STORED[since:] if p not in keep]:
        remove(spark, path)


@contextmanager
def step(spark: SparkSession) -> Iterator[list[str]]:
    """A step of a job: what it wrote goes at its end, but for the paths that it puts on the list. A failed step leaves all."""
    since, keep = len(_STORED), []
    yield keep
    release(spark, since, tuple(keep))
