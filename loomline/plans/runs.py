"""The runs: a configuration from file names and texts, and an extraction from files or items."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import fixed
from loomline.operators import blocks as B
from loomline.operators import cache, cascade, chunking, lookup, tables, versions
from loomline.operators.progress import pending
from loomline.sources import files as sources
from loomline.sources import sinks
from loomline.sources.shared import kept, scratch
from loomline.sources.snapshots import Snapshots


def configuration(docs: DataFrame, overrides: DataFrame | None = None, text: str | None = "text") -> DataFrame:
    """Documents (filename, text) with everything a configuration entry holds."""
    known = lookup.override_table(docs.sparkSession) if overrides is None else overrides
    return lookup.enrich(cascade.detect(docs, known, text).withColumnRenamed("type", "document_type"))


def superseding(config: DataFrame, revisions: DataFrame) -> DataFrame:
    """``config`` with supersedes, superseded_by and the newest version of each document; ``revisions`` (filename, supersedes) has what is known.

    Of several documents that one supersedes the last by name is written. See ``versions.newest``.
    """
    own = revisions.groupBy(F.col("filename").alias("__own")).agg(F.max("supersedes").alias("supersedes"))
    after = versions.newest(config.select("filename").join(own, F.col("filename") == F.col("__own"), "left").select("filename", "supersedes"))
    after = after.select(F.col("filename").alias("__after"), "superseded_by", "newest")
    return config.join(own, F.col("filename") == F.col("__own"), "left").join(after, F.col("filename") == F.col("__after"), "left").drop("__own", "__after")


def extraction(items: DataFrame, skips: DataFrame | None = None, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """Items with headings, and of these blocks with markers, tables, and table chunks.

    All four read the items with their headings. ``keep(df, name)``, where it is given, writes
    these and reads them again, so that they are made once.
    """
    headed = B.with_headings(items, skips)
    if keep is not None:
        headed = keep(headed, "headed")
    found = B.tables(headed)
    text = B.blocks(headed)
    return {"headed": headed, "blocks": text, "tables": found, "chunks": tables.chunks(found), "woven": tables.interleave(text, found)}


def chunked(extracted: dict[str, DataFrame], config: DataFrame) -> DataFrame:
    """The chunks of an extraction by the strategy, unit, size and overlap that ``config`` has for its doc_slug."""
    woven = tables.interleave(extracted["blocks"], extracted["tables"], carry=("heading_path",))
    return chunking.section_chunks(woven, extracted["chunks"], config)


def preview(extracted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The first few rows of an extraction's parts, in order, for display."""
    order = {"blocks": ["doc_slug", "block_index"], "tables": ["doc_slug", "table_index"], "chunks": ["doc_slug", "table_index"]}
    out = {k: extracted[k].orderBy(*by).limit(fixed.PREVIEW[k]) for k, by in order.items()}
    return out | {"markers": extracted["woven"].filter("block_type = 'table_ref'").orderBy("doc_slug", "seq").limit(fixed.PREVIEW["markers"])}


def resumed(config: DataFrame, events: DataFrame, files: DataFrame, force: bool = False) -> DataFrame:
    """What a run still has to do, in order of work: known, present and not yet completed."""
    names = files.select(F.col("name").alias("filename")).distinct()
    return lookup.in_work_order(pending(config, events, force).join(names, "filename", "left_semi"))


def extract(config: DataFrame, files: DataFrame, make_standard: Callable, make_ocr: Callable, path: str | Snapshots, force: bool = False, run: int = 0) -> DataFrame:
    """Stored extractions of the documents of ``config`` (filename, is_scanned, skip_sections) that have a file.

    What is stored at ``path`` is read; the rest, with ``force`` all, is converted once and
    appended as ``run``, a file that fails with its error. A later run tries such a file again.
    ``path`` is a folder of JSON or snapshots (``sources.stored_snapshots``), which are compacted then.
    """
    spark = config.sparkSession
    stored = (lambda: sources.read_snapshots(path)) if isinstance(path, Snapshots) else (lambda: sources.read_stored(spark, path))
    here = config.join(files.select(F.col("name").alias("filename")).distinct(), "filename", "left_semi")
    with scratch():
        todo = kept(cache.split(here, stored(), force)[1], "todo")
        given = todo.join(files.select(F.col("name").alias("filename"), "content"), "filename")
        both = sources.converted(given.select("doc_slug", "content", "is_scanned"), make_standard, make_ocr)
        # A file that failed is a row of no label, so neither a block nor a table.
        headed = B.with_headings(both, todo.select("doc_slug", "skip_sections"))
        made = sinks.with_full_tables(B.by_document(headed, sources.last_page().alias("total_pages"), F.max("error").alias("error")))
        docs = todo.select("doc_slug", F.col("filename").alias("source_file"), "is_scanned").join(made, "doc_slug", "left")
        if isinstance(path, Snapshots):
            path.append(docs.withColumn("run", F.lit(run)), f"{run:012d}-{uuid.uuid4().hex[:8]}")
            path.compact()
        else:
            sinks.store(docs, path, run)
    return stored().join(cache.keyed(here).select("doc_slug"), "doc_slug", "left_semi")


def extract_single(spark: SparkSession, path: str, convert: Callable, is_scanned: bool = False) -> dict[str, DataFrame]:
    """The extraction of one file without a configuration: nothing is skipped, nothing stored."""
    one = sources.list_files(spark, path, suffix="")
    given = cache.keyed(one.withColumnRenamed("name", "filename")).select("doc_slug", "content", F.lit(is_scanned).alias("is_scanned"))
    items, errors = sources.convert(given, convert, convert)
    return extraction(items) | {"pages": sources.page_counts(items), "errors": errors}
