"""Reading-order items to text blocks with heading paths, and tables with ids and captions.

Items are rows (doc_slug, pos, label, level, page_number, text, columns, rows). A heading cuts the
path to its level and adds itself. The path's depth after the i-th heading is the least of its
level and the depth before it plus one, which unrolls to i plus the least of 0 and (level - place)
over the headings so far; the k-th part of a path is the last heading of depth k. So paths,
captions and numbers are all windows over one order of a document: one shuffle, no fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions import fixed
from loomline.functions.text import heading_level, mentions_any, strip, table_id, text_or_empty
from loomline.functions.text import label as normal_label

TEXT_LABELS = ("section_header", "text", "list_item", "caption")
TABLE_LABEL = "table"
#: The deepest heading level.
LEVELS = 6


def with_headings(items: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    """Items with ``heading_path`` and ``skipped``; a heading belongs to the section it opens.

    ``skips`` gives skip_sections by doc_slug. Headings without text open no section. Labels are
    lower-cased, missing ones are ``unknown``; missing texts are empty.
    """
    clean = items.withColumns({"label": normal_label(F.col("label")), "text": strip(text_or_empty(F.col("text")))})
    is_heading = (F.col("label") == "section_header") & (F.col("text") != "")
    upto = W.partitionBy("doc_slug").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    place = F.count_if(is_heading).over(upto).cast("int")
    staged = clean.withColumns({"__place": place, "__level": F.when(is_heading, heading_level(F.col("level"), F.col("label")))})
    lowest = F.min(F.col("__level") - F.col("__place")).over(upto)
    staged = staged.withColumn("__depth", F.col("__place") + F.least(F.lit(0), F.coalesce(lowest, F.lit(0))))
    of = lambda k: F.last(F.when(F.col("__level").isNotNull() & (F.col("__depth") == k), F.col("text")), ignorenulls=True).over(upto)
    parts = F.array(*[of(k) for k in range(1, LEVELS + 1)])
    out = staged.withColumn("heading_path", F.slice(parts, F.lit(1), F.col("__depth"))).drop("__place", "__level", "__depth")
    if skips is None:
        return out.withColumn("skipped", F.lit(False))
    out = out.join(skips.select("doc_slug", "skip_sections"), "doc_slug", "left")
    hit = mentions_any(F.col("heading_path"), F.coalesce("skip_sections", F.array().cast("array<string>")))
    return out.withColumn("skipped", hit).drop("skip_sections")


def _is_block() -> Column:
    return F.col("label").isin(*TEXT_LABELS) & ~F.col("skipped") & (F.col("text") != "")


def _kind() -> Column:
    return F.when(F.col("label") == "section_header", "heading").when(F.col("label") == "text", "paragraph").otherwise(F.col("label"))


def blocks(items: DataFrame) -> DataFrame:
    """Text blocks of ``with_headings`` items, numbered from 0 within a document; other labels and empty texts go."""
    kept, kind = items.filter(_is_block()), _kind()
    order = W.partitionBy("doc_slug").orderBy("pos")
    return kept.select(
        "doc_slug", "pos", (F.row_number().over(order) - 1).alias("block_index"), kind.alias("block_type"), "text", "heading_path",
        F.coalesce("page_number", F.lit(0)).alias("page_number"), F.lit(None).cast("string").alias("table_ref"),
    )


def with_caption(items: DataFrame) -> DataFrame:
    """The last block before an item as its caption, if that is short; an earlier short one does not stand in."""
    before = W.partitionBy("doc_slug").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    last = F.last(F.when(_is_block(), F.col("text")), ignorenulls=True).over(before)
    return items.withColumn("caption", F.when(F.length(last) < fixed.CAPTION_BELOW, last).otherwise(""))


def tables(items: DataFrame) -> DataFrame:
    """Tables outside skipped sections. Their numbers count empty ones too, which then go."""
    own = with_caption(items).filter((F.col("label") == TABLE_LABEL) & ~F.col("skipped"))
    index = F.row_number().over(W.partitionBy("doc_slug").orderBy("pos")) - 1
    out = own.withColumn("table_index", index)
    out = out.filter((F.coalesce(F.size("rows"), F.lit(0)) > 0) & (F.coalesce(F.size("columns"), F.lit(0)) > 0))
    return out.select("doc_slug", "table_index", table_id(F.col("doc_slug"), F.col("table_index")).alias("table_id"), "caption", "heading_path",
                      F.coalesce("page_number", F.lit(0)).alias("page_number"), "columns", "rows")


def by_document(items: DataFrame, *more: Column) -> DataFrame:
    """(doc_slug, blocks, tables) and the aggregates ``more`` of ``with_headings`` items: :func:`blocks` and :func:`tables` as arrays in their order.

    Both are numbered by windows over the order that headings come from, so the items meet in no shuffle after that one.
    """
    upto = W.partitionBy("doc_slug").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    is_table = (F.col("label") == TABLE_LABEL) & ~F.col("skipped")
    numbered = with_caption(items).withColumns({"__block": F.count_if(_is_block()).over(upto), "__table": F.count_if(is_table).over(upto)})
    index = lambda c: (F.col(c) - 1).cast("int")
    page = F.coalesce("page_number", F.lit(0)).alias("page_number")
    block = F.struct(index("__block").alias("block_index"), "text", _kind().alias("block_type"), "heading_path", page, F.lit(None).cast("string").alias("table_ref"))
    table = F.struct(index("__table").alias("table_index"), table_id(F.col("doc_slug"), index("__table")).alias("table_id"), "caption", "heading_path", page, "columns", "rows")
    full = is_table & (F.coalesce(F.size("rows"), F.lit(0)) > 0) & (F.coalesce(F.size("columns"), F.lit(0)) > 0)
    of = lambda when, value: F.array_sort(F.collect_list(F.when(when, value)))
    return numbered.groupBy("doc_slug").agg(of(_is_block(), block).alias("blocks"), of(full, table).alias("tables"), *more)
