"""Resumable runs: an append-only table of events, (file, status, elapsed, error, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loomline.functions import fixed

SCHEMA = "file string, status string, elapsed double, error string, ts timestamp"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The events at ``path``; none if nothing was written there yet."""
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def latest(events: DataFrame) -> DataFrame:
    """The last event of each file; of equal times the larger status by name."""
    best = F.max_by(F.struct("status", "elapsed", "error", "ts"), F.struct("ts", "status"))
    return events.groupBy("file").agg(best.alias("e")).select("file", "e.*").withColumn("error", F.substring("error", 1, fixed.ERROR_CHARS))


def pending(docs: DataFrame, events: DataFrame, force: bool = False) -> DataFrame:
    """Documents whose last event is not a completion; with ``force`` all of them."""
    if force:
        return docs
    done = latest(events).filter(F.col("status") == "completed").select(F.col("file").alias("filename"))
    return docs.join(done, "filename", "left_anti")


def present(docs: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with a file of their name, and those without."""
    names = files.select(F.col("name").alias("filename")).distinct()
    return docs.join(names, "filename", "left_semi"), docs.join(names, "filename", "left_anti")


def summary(events: DataFrame) -> DataFrame:
    """Files by last status, and the session's seconds."""
    last = latest(events)
    return last.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "skipped")], F.coalesce(F.sum("elapsed"), F.lit(0.0)).alias("elapsed"))


def dry_run(docs: DataFrame, events: DataFrame, cached: DataFrame) -> DataFrame:
    """(filename, state): DONE, CACHED or PENDING; ``cached`` has the names that stored output exists for."""
    done = latest(events).filter(F.col("status") == "completed").select(F.col("file").alias("filename"), F.lit(True).alias("__done"))
    kept = cached.select("filename").distinct().withColumn("__cached", F.lit(True))
    state = F.when(F.col("__done"), "DONE").when(F.col("__cached"), "CACHED").otherwise("PENDING")
    return docs.join(done, "filename", "left").join(kept, "filename", "left").select("filename", state.alias("state"))


def session(events: DataFrame, since) -> DataFrame:
    """One row: what the events from ``since`` on did, in numbers of events and in minutes."""
    own = events.filter(F.col("ts") >= since)
    counts = [F.count_if(F.col("status") == s).alias(n) for s, n in (("completed", "done"), ("skipped", "skip"), ("failed", "fail"))]
    return own.agg(*counts, F.round(F.coalesce(F.sum("elapsed"), F.lit(0.0)) / 60, 1).alias("minutes"))


def report(events: DataFrame, since) -> DataFrame:
    """(line_no, line): the summary of a session, and the files whose last event is a failure with their errors."""
    s = session(events, since).crossJoin(F.broadcast(summary(events)))  # one row each
    head = F.array(
        F.concat(F.lit("Session complete: "), F.col("minutes").cast("string"), F.lit(" min")),
        *[F.concat(F.lit(f"  {title}: "), F.col(c).cast("string")) for title, c in (("Processed", "done"), ("Skipped", "skip"), ("Failed", "fail"))],
        F.concat(F.lit("  Overall: completed="), F.col("completed").cast("string"), F.lit(" failed="), F.col("failed").cast("string"), F.lit(" skipped="), F.col("skipped").cast("string")),
    )
    lines = s.select(F.posexplode(head).alias("line_no", "line")).select("line_no", "line")
    failed = latest(events).filter(F.col("status") == "failed")
    return lines.unionByName(failed.select(F.lit(5).alias("line_no"), F.concat(F.lit("  "), "file", F.lit(": "), F.substring(F.coalesce("error", F.lit("")), 1, fixed.REPORT_CHARS)).alias("line")))
