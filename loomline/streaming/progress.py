"""Progress that is kept as it goes: a stream of events, a state of each file, and snapshots of the states.

The state is a streaming aggregation, so it stays in Spark's state store on the executors and in the
checkpoint: the last event by time, whatever order events arrive in, the last error, and counts.
Each batch of changed states is a run of the snapshots under the batch's number; a batch that is
repeated after a loss replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import fixed
from loomline.sources.snapshots import Snapshots

STATE = "file string, status string, elapsed double, error string, ts timestamp, last_error string, n_events long, n_completed long"


def states(events: DataFrame) -> DataFrame:
    """The state of each file of ``events`` (file, status, elapsed, error, ts), a stream or a table.

    Of equal times the larger status by name is the last one, as in a batch. A late event counts,
    and changes the status only if none is later.
    """
    when = F.struct("ts", "status")
    last = F.max_by(F.struct("status", "elapsed", "error", "ts"), when)
    error = F.max_by(F.substring("error", 1, fixed.ERROR_CHARS), F.when(F.col("status") == "failed", when))
    out = events.groupBy("file").agg(last.alias("e"), error.alias("last_error"), F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("status") == "completed").alias("n_completed"))
    return out.select("file", "e.status", "e.elapsed", F.substring("e.error", 1, fixed.ERROR_CHARS).alias("error"), "e.ts", "last_error", "n_events", "n_completed")


def store(spark: SparkSession, path: str, parts: int = 32) -> Snapshots:
    """The states at ``path``; the one of most events is a file's last."""
    return Snapshots(spark, path, STATE, ["file"], ["n_events"], parts)


def follow(events: DataFrame, path: str, checkpoint: str, compact_every: int = 10, parts: int = 32):
    """Takes in what has arrived of the stream ``events`` and ends; a later call with the same checkpoint goes on."""
    kept = store(events.sparkSession, path, parts)

    def write(batch: DataFrame, number: int) -> None:
        kept.append(batch, f"{number:012d}")
        if (number + 1) % compact_every == 0:
            kept.compact()

    q = states(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    return q.trigger(availableNow=True).start()
