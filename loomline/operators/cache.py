"""Stored extractions as a cache: what is there is not converted again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions.text import slug_key


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with doc_slug: the slug of the file name with a hash of the whole name, so that no two files share one."""
    return docs.withColumn("doc_slug", slug_key(F.col("filename")))


def last_runs(stored: DataFrame) -> DataFrame:
    """The row of the last ``run`` of each doc_slug; a document that was stored again counts once."""
    order = W.partitionBy("doc_slug").orderBy(F.col("run").desc_nulls_last())
    return stored.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")


def split(docs: DataFrame, stored: DataFrame, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """Documents (filename and more) that stored output serves, and those that are to be converted.

    Stored rows with an error serve none. ``force`` has everything converted, whatever is stored.
    """
    own = keyed(docs)
    if force:
        return own.limit(0), own
    good = stored.filter(F.col("error").isNull()).select("doc_slug").distinct()
    return own.join(good, "doc_slug", "left_semi"), own.join(good, "doc_slug", "left_anti")
