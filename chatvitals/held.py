"""Frames that are computed once, and their release."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[DataFrame]] = []


def once(df: DataFrame) -> DataFrame:
    """df, computed once: as a checkpoint where spark.checkpoint.dir names a folder for them, else cached (on disk where memory is short)."""
    if df.is_cached or getattr(df, "_held", False):
        return df
    spark = df.sparkSession
    if spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir():
        out = df.checkpoint()
    else:
        out = df.persist()
        if _scopes:
            _scopes[-1].append(out)
    out._held = True
    return out


@contextmanager
def scope() -> Iterator[None]:
    """Frames cached inside are let go at its end; what is returned has to be written or collected inside."""
    frames: list[DataFrame] = []
    _scopes.append(frames)
    try:
        yield
    finally:
        _scopes.remove(frames)
        for f in frames:
            f.unpersist()


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or one of our own where it is unset and all run in one process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return f"{path.rstrip('/')}/held-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="chatvitals-")


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out if its files are too few for the cluster; tables of many files are not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
