"""What a search may return, and in which order: the index flag, supersession, and weights by priority."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def current(docs: DataFrame) -> DataFrame:
    """Documents (filename, index, supersedes and more) that are to be indexed and that none supersedes.

    A missing flag means true. A document that is not to be indexed still supersedes another.
    """
    old = docs.select(F.col("supersedes").alias("filename")).filter(F.col("filename").isNotNull()).distinct()
    return docs.filter(F.coalesce("index", F.lit(True))).join(old, "filename", "left_anti")


def weighted(hits: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, filename, score): the k best of ``hits`` (query_id, filename, score) by score times rag_weight.

    Hits of documents that are not :func:`current` go; ties go to the smaller filename.
    """
    kept = current(docs).select("filename", "rag_weight")
    scored = hits.join(kept, "filename").select("query_id", "filename", (F.col("score") * F.col("rag_weight")).alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "filename"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "filename", "score")
