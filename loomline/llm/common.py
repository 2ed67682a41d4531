"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the word contracts define it: space and U+0009 to U+000D.
WS = " \t\n\x0b\x0c\r"
WS_RE = r"[\x20\x09-\x0D]+"
#: Tables of at most as many (narrow) rows are broadcast; larger ones meet in a shuffled join.
BROADCAST_ROWS = 10_000
#: Rows of a file of a narrow table whose number of rows is known to be bounded.
FILE_ROWS = 1_000_000
_ARROW = "spark.sql.execution.arrow.maxRecordsPerBatch"
_READ = "spark.sql.parquet.columnarReaderBatchSize"
_COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"
_left: dict[str, SparkSession] = {}
#: Tables that were written within the innermost :func:`passing` of this context.
_within: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("within", default=None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary one serves a master that runs in this process; on
    a cluster its absence is an error, for executors could not see a folder of the driver.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="loomline-")
        _left[found] = spark
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def gathered(df: DataFrame, a_core: int = 4) -> DataFrame:
    """``df`` from a shuffle, where the session does not coalesce small partitions by their size in ``a_core`` tasks a core; one is enough for narrow rows."""
    spark = df.sparkSession
    if "true" in (spark.conf.get(_COALESCE, "true") or "").lower():
        return df
    return df.coalesce(a_core * spark.sparkContext.defaultParallelism)


def materialise(df: DataFrame, name: str, dealt: bool = False, rows: int | None = None) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, which cuts its lineage.

    ``rows`` is a bound of the rows of a narrow table: it is written in files of about
    ``FILE_ROWS``, not in as many small ones as the shuffle before it has partitions. ``dealt`` is
    for other tables that come from a shuffle, which are :func:`gathered`.
    :func:`discard` or the end of a :func:`passing` removes the table when it is of no more use; else it goes when Python ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    elif dealt:
        df = gathered(df)
    _left[path] = spark
    if _within.get() is not None:
        _within.get().append(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


@contextlib.contextmanager
def passing():
    """Tables that are written within go when it ends, also by an error, but for those that are handed to what it yields.

    A table that is kept belongs to the scope around, if there is one.
    """
    around, kept = _within.get(), []
    token = _within.set([])
    try:
        yield lambda *tables: kept.extend(t._table for t in tables)
    except BaseException:
        kept = []
        raise
    finally:
        written = _within.get()
        _within.reset(token)
        for path in written:
            if path not in kept:
                _delete(path)
            elif around is not None:
                around.append(path)


def finished(spark: SparkSession, path: str) -> bool:
    """Whether a table at ``path`` was written to its end."""
    p = spark._jvm.org.apache.hadoop.fs.Path(os.path.join(path, "_SUCCESS"))
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(path: str) -> None:
    spark = _left.pop(path, None)
    if spark is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that :func:`materialise` wrote and nothing reads any more."""
    for t in tables:
        _delete(t._table)


@atexit.register
def _discard_all() -> None:
    for path in list(_left):
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(path)


@contextlib.contextmanager
def _rows(spark: SparkSession, key: str, rows: int):
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most ``rows`` rows for the actions within; then the session's own setting again."""
    return _rows(spark, _ARROW, rows)


def read_rows(spark: SparkSession, rows: int):
    """Tables are read ``rows`` rows at once by the actions within, for tables of very large rows; then the session's own setting again."""
    return _rows(spark, _READ, rows)


def if_small(table: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` to be broadcast if it has at most ``most`` rows, which are counted; else as it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts`` (n and more) with the largest ``n``, at most ``most``; a tie at the end is left out whole.

    The least ``n`` comes from a histogram of a few thousand bins, so no table is sorted for it.
    """
    shift = F.greatest(F.length(F.bin("n")) - 8, F.lit(0))
    bins = counts.groupBy(F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), shift), shift).alias("b")).agg(F.count(F.lit(1)).alias("m"))
    least, held = None, 0
    for r in sorted(bins.collect(), reverse=True):
        held += r["m"]
        if held > most:
            break
        least = r["b"]
    return counts.filter(F.lit(False) if least is None else F.col("n") >= least)


def groups(texts, most: int = 1_500_000):
    """Lists of texts of about ``most`` characters at most, or of one longer text; null counts as empty."""
    part, size = [], 0
    for t in texts:
        t = t or ""
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words between ASCII white space; null and empty texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(WS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WS_RE))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")
