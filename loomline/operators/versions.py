"""Chains of supersession: for every document what replaces it and the newest version of it.

Each document points to the one that supersedes it. Pointers are doubled: after k rounds one leads
over 2**k versions, so a chain of any length is followed in the logarithm of its length. Documents
that have reached an end leave the rounds; those that are still under way when pointers lead over
more versions than any chain has go round a circle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.sources.shared import kept, result, scratch


def superseded_by(docs: DataFrame) -> DataFrame:
    """(filename, next): the document that supersedes each one of ``docs`` (filename, supersedes); of several the last by name.

    Documents that are superseded but are not in ``docs`` are no rows; one that names itself says nothing.
    """
    newer = docs.filter((F.col("supersedes") != F.col("filename"))).groupBy(F.col("supersedes").alias("__old")).agg(F.max("filename").alias("next"))
    return docs.select("filename").distinct().join(newer, F.col("filename") == F.col("__old"), "left").select("filename", "next")


def newest(docs: DataFrame) -> DataFrame:
    """(filename, superseded_by, newest, n_newer, in_circle) of the distinct, not null filenames of ``docs`` (filename, supersedes).

    ``newest`` is the end of the chain, the document itself if nothing supersedes it, and
    ``n_newer`` how many steps away that is. Documents whose chain goes into a circle have the last
    of the circle by name as the newest and no number.
    """
    with scratch():
        links = kept(superseded_by(docs.filter(F.col("filename").isNotNull())), "links")
        ended = kept(links.filter("next IS NULL").select("filename", F.col("filename").alias("newest"), F.lit(0).cast("long").alias("n_newer")), "ended")
        done = [ended]
        # best: the last by name of the 2**k documents from this one on.
        open_ = kept(links.filter("next IS NOT NULL").select("filename", F.col("next").alias("to"), F.col("filename").alias("best")), "open")
        longest, rounds = open_.count(), 0
        while 2**rounds <= longest and (rounds == 0 or open_.limit(1).count() > 0):
            steps = F.lit(2**rounds).cast("long")
            ends = _all(done).select(F.col("filename").alias("__f"), "newest", "n_newer")
            done.append(kept(open_.join(ends, F.col("to") == F.col("__f")).select("filename", "newest", (F.col("n_newer") + steps).alias("n_newer")), "ended"))
            on = open_.select(F.col("filename").alias("__f"), F.col("to").alias("__to"), F.col("best").alias("__best"))
            open_ = kept(open_.join(on, F.col("to") == F.col("__f")).select("filename", F.col("__to").alias("to"), F.greatest("best", "__best").alias("best")), "open")
            rounds += 1
        # From where a pointer leads now, as many documents again are the whole circle.
        circle = open_.select(F.col("filename").alias("__f"), F.col("best").alias("newest"))
        circles = open_.join(circle, F.col("to") == F.col("__f")).select("filename", "newest", F.lit(None).cast("long").alias("n_newer"))
        out = _all([*done, circles]).withColumnRenamed("filename", "__n")
        both = links.join(out, F.col("filename") == F.col("__n"))
        return result(both.select("filename", F.col("next").alias("superseded_by"), "newest", "n_newer", F.col("n_newer").isNull().alias("in_circle")), "newest")


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
