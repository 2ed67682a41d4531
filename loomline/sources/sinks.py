"""Sinks: annotated configuration text, stored extractions, progress events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.functions import fixed
from loomline.operators.tables import markdown, typed


def yaml_string(c: Column) -> Column:
    """A YAML scalar; strings are single-quoted with quotes doubled, null is the word null."""
    return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("'"), F.replace(c, F.lit("'"), F.lit("''")), F.lit("'")))


def _flag(cases: list[tuple[Column, str]]) -> Column:
    out = F.lit("")
    for when, text in reversed(cases):
        out = F.when(when, f"  # {text}").otherwise(out)
    return out


def config_lines(docs: DataFrame) -> DataFrame:
    """(filename, entry): each document's entry in a fixed order of keys, with comments on what needs review.

    ``supersedes`` and ``superseded_by`` are written where ``docs`` has them, else null.
    """
    c = F.col
    year_flag = _flag([
        (c("fy") == "na", "timeless: no fiscal year applies"),
        (c("fy") == "unknown", "HARD: no fiscal year found"),
        (c("fy_source").isin("cover", "deep"), "SOFT: found in the text"),
        ((c("fy_source") == "filename") & (c("fy_review") == "soft"), "SOFT: inferred from a single year"),
    ])
    revises = c("document_type") == "budget_review_outlook"
    revision = _flag([(revises & c("supersedes_hint"), "SOFT: hints at a revision, check which"), (revises, "HARD: name what this revises")])
    line = lambda key, value, flag=None: F.concat(F.lit(f"    {key}: "), value, flag if flag is not None else F.lit(""))
    sections = F.when(F.size("skip_sections") > 0, F.concat(F.lit("    skip_sections:\n"), F.array_join(F.transform("skip_sections", lambda s: F.concat(F.lit("      - "), yaml_string(s))), "\n"))).otherwise("    skip_sections: []")
    plain = lambda key: line(key, c(key).cast("string"))
    quoted = lambda key: line(key, yaml_string(c(key)))
    named = lambda key: yaml_string(c(key)) if key in docs.columns else F.lit("null")
    head = F.when(c("review_level") == "hard", "  # HARD: fix by hand\n").when(c("review_level") == "soft", "  # SOFT: spot-check\n").otherwise("")
    entry = F.concat(head, F.concat_ws(
        "\n",
        F.concat(F.lit("  - filename: "), yaml_string(c("filename"))),
        line("document_type", yaml_string(c("document_type")), _flag([(c("document_type") == "unknown", "HARD: unknown type")])),
        line("fiscal_year", yaml_string(c("fy")), year_flag),
        line("report_period", yaml_string(c("period")), _flag([(c("period_source") == "cover", "SOFT: found in the text")])),
        *map(quoted, ("domain", "priority")), *map(plain, ("rag_weight", "category")), *map(quoted, ("chunking_strategy", "chunk_by")),
        *map(plain, ("chunk_size", "chunk_overlap")), F.lit("    index: true"), *map(plain, ("has_tables", "is_scanned")), F.lit("    language: 'english'"),
        sections, line("supersedes", named("supersedes"), revision), line("superseded_by", named("superseded_by")),
        F.concat(F.lit("    # resolved: type="), c("type_source"), F.lit(" fy="), c("fy_source"), F.lit(" period="), c("period_source")),
    ))
    return docs.select("filename", entry.alias("entry"))


def config_header(collection: str, agent: str) -> str:
    """The header's lines: names and limits of the run that reads the configuration."""
    return "\n".join(["pipeline:", f"  agent: '{agent}'", f"  chunk_min_tokens: {fixed.CHUNK_MIN_TOKENS}", f"  chunk_max_tokens: {fixed.CHUNK_MAX_TOKENS}",
                      f"  dedup_threshold: {fixed.DEDUP_THRESHOLD}", f"  collection: '{collection}'", "", "documents:"])


def write_config(docs: DataFrame, path: str, collection: str = "documents", agent: str = "corpus") -> None:
    """Text parts whose names are in the order of the entries, the header first: read in that order they are one configuration."""
    spark = docs.sparkSession
    head = spark.createDataFrame([(0, "", config_header(collection, agent))], "part int, filename string, entry string")
    rows = head.unionByName(config_lines(docs).withColumn("part", F.lit(1)))
    rows.orderBy("part", "filename").select(F.col("entry").alias("value")).write.mode("overwrite").text(path)


def records(columns: Column, rows: Column) -> Column:
    """A table's rows as maps by column name; of columns that share a name the last one counts."""
    names = F.transform(columns, lambda c: F.coalesce(c, F.lit("")))

    def of(row: Column) -> Column:
        pairs = F.transform(names, lambda n, i: F.struct(n.alias("key"), F.get(row, i).alias("value")))
        last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(names, i + 2, F.size(names)), lambda n: n == p["key"]))
        return F.map_from_entries(last)

    return F.transform(rows, of)


def documents(info: DataFrame, blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """One row a document with its blocks and tables in order, for storing; documents without either have empty arrays.

    Tables have their markdown, and their rows as text by place, as records by column name, and typed as one VARIANT.
    """
    b = blocks.groupBy("doc_slug").agg(F.array_sort(F.collect_list(F.struct("block_index", "text", "block_type", "heading_path", "page_number", "table_ref"))).alias("blocks"))
    t = tables.groupBy("doc_slug").agg(F.array_sort(F.collect_list(F.struct("table_index", "table_id", "caption", "heading_path", "page_number", "columns", "rows"))).alias("tables"))
    return info.join(b, "doc_slug", "left").join(with_full_tables(t), "doc_slug", "left")


def with_full_tables(docs: DataFrame) -> DataFrame:
    """``docs`` whose tables also have their markdown, records and typed cells, as they are stored."""
    full = F.transform("tables", lambda x: x.withField("markdown", markdown(x["columns"], x["rows"])).withField("records", records(x["columns"], x["rows"])).withField("cells", typed(x["rows"])))
    return docs.withColumn("tables", full)


def store(docs: DataFrame, path: str, run: int = 0) -> None:
    """Appends; a document that is stored again counts by its largest ``run``."""
    docs.withColumn("run", F.lit(run).cast("long")).write.mode("append").option("ignoreNullFields", "false").json(path)


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)
