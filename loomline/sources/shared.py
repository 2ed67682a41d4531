"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether the files that an action shuffled go when it ends, not when the driver happens to collect its garbage.
_CLEANED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_kept: dict[str, SparkSession] = {}
_stay: set[str] = set()


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where the session names none, a temporary folder serves a master in this process, and on a cluster it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = tempfile.mkdtemp(prefix="loomline-")
    _kept[found] = spark
    _stay.add(found)
    spark.sparkContext.setCheckpointDir(found)
    return found


def place(spark: SparkSession, name: str) -> str:
    """A path in the folder that nothing else has; what is written there goes as kept tables do."""
    path = os.path.join(folder(spark), f"{name}-{uuid.uuid4().hex}")
    _kept[path] = spark
    return path


@contextlib.contextmanager
def cleaned(spark: SparkSession):
    """The shuffles of DataFrames that are made and run within go with their action; then the session's own setting again."""
    before = spark.conf.get(_CLEANED, None)
    spark.conf.set(_CLEANED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANED)
        else:
            spark.conf.set(_CLEANED, before)


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a table and read back, which cuts its lineage; :func:`drop` removes it, else it goes when Python ends. What its making shuffled goes at once."""
    spark = df.sparkSession
    path = place(spark, name)
    with cleaned(spark):
        df.select("*").write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _delete(path: str) -> None:
    spark = _kept.pop(path, None)
    if spark is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes tables of :func:`kept` that nothing reads any more."""
    for t in tables:
        _delete(t._table)


@contextlib.contextmanager
def scratch():
    """Tables that are kept within go at the end, also after an error; those of :func:`result` stay."""
    before = set(_kept)
    try:
        yield
    finally:
        for path in set(_kept) - before - _stay:
            _delete(path)


def result(df: DataFrame, name: str) -> DataFrame:
    """A kept table that outlives the scratch it was made in."""
    out = kept(df, name)
    _stay.add(out._table)
    return out


@atexit.register
def _drop_all() -> None:
    for path in list(_kept):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)
