"""Table rendering, typing, filtering, and references woven into the text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.functions import fixed
from loomline.functions.text import chunk_text, table_marker


def markdown(columns: Column, rows: Column, most: int = fixed.TABLE_ROWS) -> Column:
    """A pipe table of the first ``most`` rows: no padding, one blank beside each bar, null cells empty."""
    line = lambda cells: F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.coalesce(c, F.lit(""))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(columns, lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(columns), rule), F.transform(F.slice(rows, 1, most), line)), "\n")


#: A cell that is a number as a whole, without leading zeros or more digits than a decimal holds.
NUMBER = r"^-?(0|[1-9][0-9]{0,18})([.][0-9]{1,19})?$"


def typed(rows: Column) -> Column:
    """A table's rows as one VARIANT, an array of rows of cells: numbers, objects and arrays by their JSON text, null as null, all else as text.

    Cells are by place, so columns may share a name. A text that is no JSON though it begins as an object stays text.
    """
    text = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    nested = lambda c: c.rlike(r"^[\[{]") & F.try_parse_json(c).isNotNull()
    cell = lambda c: F.when(c.isNull(), "null").when(c.rlike(NUMBER) | nested(c), c).otherwise(text(c))
    line = lambda r: F.concat(F.lit("["), F.array_join(F.transform(r, cell), ","), F.lit("]"))
    return F.parse_json(F.concat(F.lit("["), F.array_join(F.transform(rows, line), ","), F.lit("]")))


def data_type(header: Column) -> Column:
    """actual, projection or mixed by the words of a table's header; actual without any."""
    actual, projected = header.rlike(f"(?idU){fixed.ACTUAL_WORDS}"), header.rlike(f"(?idU){fixed.PROJECTION_WORDS}")
    return F.when(actual & projected, "mixed").when(projected & ~actual, "projection").otherwise("actual")


def chunks(tables: DataFrame) -> DataFrame:
    """Tables of two rows and columns or more as text chunks with shape and data type."""
    shaped = tables.withColumn("shape", F.struct(F.size("rows").alias("rows"), F.size("columns").alias("cols")))
    # Markdown is never blank, as its rule has no blank cell: no filter makes it a second time.
    shaped = shaped.filter("shape.rows >= 2 AND shape.cols >= 2").withColumn("markdown", markdown(F.col("columns"), F.col("rows")))
    return shaped.withColumns({
        "data_type_hint": data_type(F.array_join("columns", " ")),
        "chunk": chunk_text(F.col("table_id"), F.col("caption"), F.col("heading_path"), F.col("markdown")),
    })


def interleave(blocks: DataFrame, tables: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Blocks and a marker for each table, in order, each tagged with the table that follows it.

    ``blocks`` (doc_slug, block_index, page_number, block_type, text, table_ref), ``tables``
    (doc_slug, table_index, table_id, page_number). A marker stands after the last block whose
    page is not beyond its own; a block is tagged with the first marker after it, a marker with
    the next one of its place if that is a later table, else with itself. The place comes from a
    running maximum over pages, so blocks and tables are never paired. With ``carry``, columns of
    ``blocks``, rows have these too, null for markers, and ``table_id``, a marker's own table.
    """
    doc = W.partitionBy("doc_slug")
    b = blocks.select("doc_slug", F.col("block_index").alias("i"), "page_number", "block_type", "text", "table_ref", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("table_id"), *carry)
    t = tables.select("doc_slug", F.col("table_index").alias("i"), "page_number", F.lit("table_ref").alias("block_type"), table_marker(F.col("table_id")).alias("text"),
                      F.lit(None).cast("string").alias("table_ref"), F.lit(1).alias("kind"), "table_id")
    both = b.unionByName(t, allowMissingColumns=bool(carry))
    upto = doc.orderBy("page_number").rangeBetween(W.unboundedPreceding, W.currentRow)
    last = F.coalesce(F.max(F.when(F.col("kind") == 0, F.col("i"))).over(upto), F.lit(-1))
    placed = both.withColumn("__last", last).withColumn("anchor", F.when(F.col("kind") == 0, F.col("i")).otherwise(F.col("__last")))
    page = F.when(F.col("kind") == 0, F.lit(0)).otherwise(F.col("page_number"))
    order = doc.orderBy("anchor", "kind", page, "i")
    nxt = F.lead(F.struct("kind", "anchor", "i", "table_id")).over(order)
    placed = placed.withColumns({"__n": nxt, "seq": F.row_number().over(order) - 1})
    follows = (F.col("__n.kind") == 1) & (F.col("__n.anchor") == F.col("anchor"))
    later = F.when(follows & (F.col("__n.i") > F.col("i")), F.col("__n.table_id"))
    ref = F.when(F.col("kind") == 0, F.coalesce(F.when(follows, F.col("__n.table_id")), F.col("table_ref"))).otherwise(F.coalesce(later, F.col("table_id")))
    return placed.select("doc_slug", "seq", F.when(F.col("kind") == 0, F.col("i")).otherwise(-1).alias("block_index"), "block_type", "text", "page_number", ref.alias("table_ref"), *(["table_id", *carry] if carry else []))
