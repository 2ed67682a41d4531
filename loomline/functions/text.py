"""Text, number and array functions as plain Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(c: Column) -> Column:
    """Lower case; blanks, dashes and underscores become dots."""
    return F.translate(F.lower(c), " -_", "...")


def slug(stem: Column) -> Column:
    """Lower case; runs of other characters become one underscore; stripped, then 40 characters."""
    return F.substring(F.btrim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), F.lit("_")), 1, 40)


def slug_key(name: Column) -> Column:
    """A slug made unique by eight digits of the name's hash; names that share a slug stay apart."""
    return F.concat(slug(stem(name)), F.lit("_"), F.substring(F.sha2(name, 256), 1, 8))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """The name without its last suffix; a leading dot is no suffix."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def strip(c: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def cut(c: Column, start: int, end: int) -> Column:
    """Characters ``start`` to ``end``, from 0."""
    return F.substring(c, start + 1, end - start)


def table_id(slug_column: Column, index: Column) -> Column:
    return F.format_string("%s_table_%03d", slug_column, index)


def breadcrumb(path: Column) -> Column:
    return F.array_join(path, " > ")


def table_marker(identifier: Column) -> Column:
    return F.concat(F.lit("[TABLE_REF: "), identifier, F.lit("]"))


def chunk_text(identifier: Column, caption: Column, path: Column, body: Column) -> Column:
    """Section, caption and reference lines, a blank line, the body; empty parts have no line."""
    head = F.concat_ws(
        "\n",
        F.when(F.size(path) > 0, F.concat(F.lit("Section: "), breadcrumb(path))),
        F.when(F.coalesce(caption, F.lit("")) != "", F.concat(F.lit("Table: "), caption)),
        F.concat(F.lit("Reference: "), identifier),
    )
    return F.concat(head, F.lit("\n\n"), body)


def fiscal_range(first: Column, second: Column) -> Column:
    """``YYYY_YY`` of two years, the second of two, three or four digits; null if over two years apart."""
    full = F.when(F.length(second) == 4, second).otherwise(F.concat(F.lit("20"), second)).cast("int")
    near = (first != "") & (second != "") & (F.abs(first.cast("int") - full) <= 2)
    return F.when(near, F.concat(first, F.lit("_"), F.right(second, F.lit(2))))


def fiscal_ending(year: Column) -> Column:
    """The fiscal year that ends in ``year``."""
    y = year.cast("int")
    return F.concat((y - 1).cast("string"), F.lit("_"), F.right(y.cast("string"), F.lit(2)))


def fiscal_starting(year: Column) -> Column:
    y = year.cast("int")
    return F.concat(y.cast("string"), F.lit("_"), F.right((y + 1).cast("string"), F.lit(2)))


def ordinal_half(c: Column) -> Column:
    """h1 for the first even ordinal in the text, h2 for an odd one, null without."""
    n = F.regexp_extract(c, r"(\d+)(?:st|nd|rd|th)", 1)
    return F.when(n != "", F.when(F.try_to_number(F.right(n, F.lit(1)), F.lit("9")).cast("int") % 2 == 0, "h1").otherwise("h2"))


def heading_level(level: Column, label: Column) -> Column:
    """1 to 6: the given level, else the label's trailing digits, else 1."""
    digits = F.regexp_extract(label, r"(\d+)$", 1).try_cast("int")
    return F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, digits, F.lit(1))))


def tenth(x: Column) -> Column:
    return F.bround(x, 1)


def mentions_any(path: Column, skips: Column) -> Column:
    """Whether the joined lower-case path holds any of the lower-case phrases literally."""
    joined = F.lower(F.array_join(path, " "))
    return F.exists(F.transform(skips, F.lower), lambda s: F.contains(joined, s))


def label(c: Column) -> Column:
    return F.lower(F.coalesce(c, F.lit("unknown")))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def first_page(provenance: Column) -> Column:
    """The page of the first of an array of provenance structs, else 0."""
    return F.coalesce(F.get(provenance, F.lit(0)).getField("page_no"), F.lit(0))
