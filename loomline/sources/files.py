"""Sources: directories of files, page text, converted items, configuration, and stored output."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from loomline.functions import fixed
from loomline.functions.text import base_name, first_page, label, strip, text_or_empty
from loomline.operators.cache import last_runs
from loomline.sources.snapshots import Snapshots

ITEMS = "doc_slug string, pos int, label string, level int, page_number int, text string, columns array<string>, rows array<array<string>>"
BLOCK = "text string, block_type string, heading_path array<string>, page_number int, block_index int, table_ref string"
TABLE = "table_id string, caption string, heading_path array<string>, page_number int, table_index int, markdown string, columns array<string>, rows array<array<string>>, records array<map<string,string>>, cells variant"
_fields = lambda schema: schema.replace(" ", ":").replace(",:", ",")
STORED = f"run long, source_file string, doc_slug string, is_scanned boolean, total_pages int, error string, blocks array<struct<{_fields(BLOCK)}>>, tables array<struct<{_fields(TABLE)}>>"


def list_files(spark: SparkSession, directory: str, suffix: str = ".pdf", recursive: bool = False, required: bool = True) -> DataFrame:
    """(path, name, length, content). The bytes are only read by plans that use them, so they are in no order.

    :func:`by_path` sorts the names. Files of no bytes are not listed. ``recursive`` looks below the directory; ``required`` raises if there is no file at all.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", str(recursive).lower()).load(directory)
    out = files.select("path", base_name(F.col("path")).alias("name"), "length", "content")
    if required and out.select("path").limit(1).count() == 0:
        raise FileNotFoundError(f"no *{suffix} in {directory}")
    return out


def by_path(files: DataFrame) -> DataFrame:
    """(path, name, length) in path order; the bytes do not move."""
    return files.select("path", "name", "length").orderBy("path")


def first_directory(files: DataFrame) -> DataFrame:
    """The files of the first directory, in path order, that holds any."""
    parent = F.regexp_replace("path", "/[^/]*$", "")
    at = files.select(F.min(parent).alias("first"))
    return files.join(F.broadcast(at), parent == F.col("first"), "left_semi")


def page_text(files: DataFrame, reader: Callable[[bytes], Iterable[str]], start: int, end: int) -> DataFrame:
    """(name, text, is_scanned): characters ``start`` to ``end`` of each file's pages.

    Pages are read until ``end`` characters are there; a file that cannot be read gives "" and
    is not called scanned.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for name, content in zip(b["name"], b["content"]):
                try:
                    text = ""
                    for page in reader(content):
                        text += page
                        if len(text) >= end:
                            break
                    text = text[start:end]
                    out.append((name, text, len(text.strip()) < fixed.SCANNED_BELOW))
                except Exception:  # one file's fault stays its own
                    out.append((name, "", False))
            yield pd.DataFrame(out, columns=["name", "text", "is_scanned"])

    return files.select("name", "content").mapInPandas(run, "name string, text string, is_scanned boolean")


#: Rows and characters of texts of a frame of items, about.
FRAME_ROWS, FRAME_CHARS = 5_000, 4_000_000


def in_frames(items: Iterable[dict], error: bool = False) -> Iterator[pd.DataFrame]:
    """Items as frames of many documents each, as a frame costs as much as a page; an item that is large by itself ends its frame."""

    def frame() -> pd.DataFrame:
        return pd.DataFrame({n: pd.Series([r.get(n) for r in held], dtype="Int32" if n in ("pos", "level", "page_number") else object) for n in names})

    names = ["doc_slug", "pos", "label", "level", "page_number", "text", "columns", "rows", *(["error"] if error else [])]
    held, chars = [], 0
    for r in items:
        held.append(r)
        chars += len(r.get("text") or "") + sum(len(c or "") for line in r.get("rows") or () for c in line)
        if len(held) >= FRAME_ROWS or chars > FRAME_CHARS:
            yield frame()
            held, chars = [], 0
    if held:
        yield frame()


def converted(files: DataFrame, make_standard: Callable, make_ocr: Callable) -> DataFrame:
    """Items, each with a null error, and errors of files (doc_slug, content, is_scanned) by a pluggable layout converter.

    A ``make`` function is called once per task and returns ``bytes -> iterable of item dicts``.
    Scanned files go to the OCR one: rows are split before Python, so neither is started in vain.
    Items are made once: what fails is a row with an error in place of items.
    """
    schema = ITEMS + ", error string"

    def runner(make: Callable):
        def of(converter: Callable, slug: str, content: bytes) -> list[dict]:
            try:
                return [{"doc_slug": slug, "pos": i, **item, "error": None} for i, item in enumerate(converter(content))]
            except Exception as e:
                return [{"doc_slug": slug, "error": str(e)[: fixed.ERROR_CHARS]}]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            converter = make()
            for b in batches:
                yield from in_frames((r for slug, content in zip(b["doc_slug"], b["content"]) for r in of(converter, slug, content)), error=True)

        return run

    source = files.select("doc_slug", "content", "is_scanned")
    scanned = F.coalesce("is_scanned", F.lit(False))
    return source.filter(~scanned).mapInPandas(runner(make_standard), schema).unionByName(source.filter(scanned).mapInPandas(runner(make_ocr), schema))


def convert(files: DataFrame, make_standard: Callable, make_ocr: Callable) -> tuple[DataFrame, DataFrame]:
    """(items, errors) of files; see :func:`converted`, which a caller of both keeps."""
    return split_converted(converted(files, make_standard, make_ocr))


def split_converted(both: DataFrame) -> tuple[DataFrame, DataFrame]:
    return both.filter("error IS NULL").drop("error"), both.filter("error IS NOT NULL").select("doc_slug", "error")


RAW = "doc_slug string, pos int, label string, level int, prov array<struct<page_no:int>>, text string, columns array<string>, rows array<array<string>>"


def normal_items(raw: DataFrame) -> DataFrame:
    """Items of a converter's raw rows: lower-case labels, ``unknown`` for none, "" for no text, the first known page or 0."""
    return raw.select("doc_slug", "pos", label(F.col("label")).alias("label"), "level", first_page(F.col("prov")).alias("page_number"), text_or_empty(F.col("text")).alias("text"), "columns", "rows")


def page_counts(items: DataFrame) -> DataFrame:
    """(doc_slug, total_pages): the last page seen, 0 if none is known."""
    return items.groupBy("doc_slug").agg(last_page().alias("total_pages"))


def last_page() -> Column:
    return F.coalesce(F.max("page_number"), F.lit(0))


def read_config(spark: SparkSession, text: str) -> DataFrame:
    """Documents of a configuration in YAML, all values but the list of sections as strings; [] without any."""
    import yaml  # only here: not every installation has it

    rows = (yaml.load(text, Loader=yaml.BaseLoader) or {}).get("documents") or []
    names = ["filename", "document_type", "fiscal_year", "report_period", "domain", "priority", "rag_weight", "category", "chunking_strategy", "chunk_by",
             "chunk_size", "chunk_overlap", "index", "has_tables", "is_scanned", "language", "supersedes", "superseded_by"]
    schema = ", ".join(f"{n} string" for n in names) + ", skip_sections array<string>"
    return spark.createDataFrame([(*[r.get(n) for n in names], list(r.get("skip_sections") or [])) for r in rows], schema)


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """The last stored extraction of each document, with the defaults of missing fields; none if nothing was stored yet."""
    try:
        d = last_runs(spark.read.schema(STORED).json(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        d = spark.createDataFrame([], STORED)
    return _defaults(d)


def stored_snapshots(spark: SparkSession, path: str, parts: int = 32) -> Snapshots:
    """Stored extractions at ``path`` as compacted runs; the last run of a document counts."""
    return Snapshots(spark, path, STORED, ["doc_slug"], ["run"], parts)


def read_snapshots(stored: Snapshots) -> DataFrame:
    """The last stored extraction of each document, as :func:`read_stored` gives it."""
    return _defaults(stored.read())


def _defaults(d: DataFrame) -> DataFrame:
    return d.withColumns({
        "is_scanned": F.coalesce("is_scanned", F.lit(False)),
        "total_pages": F.coalesce("total_pages", F.lit(0)),
        "blocks": F.coalesce("blocks", F.array().cast(d.schema["blocks"].dataType)),
        "tables": F.coalesce("tables", F.array().cast(d.schema["tables"].dataType)),
    })


def scanned(text):
    return F.length(strip(F.coalesce(text, F.lit("")))) < fixed.SCANNED_BELOW
