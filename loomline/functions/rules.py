"""Ordered rules: the first pattern that is found gives the value."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomline.functions.text import fiscal_ending, fiscal_range

#: Unicode classes, and a dot that only a newline stops.
FLAGS = "(?dU)"


def merged(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str]]:
    """Neighbouring rules of one label as one pattern: the first label found stays the same, with fewer branches."""
    return [("|".join(f"(?:{p})" for p, _ in group), value) for value, group in ((v, list(g)) for v, g in groupby(rules, key=lambda r: r[1]))]


def first_match(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The label of the first rule whose pattern occurs; null if none does."""
    if not rules:
        return F.lit(None).cast("string")
    out = None
    for pattern, value in merged(rules):
        hit = text.rlike(FLAGS + pattern)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def any_match(text: Column, patterns: Sequence[str]) -> Column:
    return F.coalesce(text.rlike(FLAGS + "|".join(f"(?:{p})" for p in patterns)), F.lit(False))


def fiscal_year(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The first rule that gives a valid fiscal year; one that is found but not valid is passed over."""
    low = F.lower(text)

    def year(pattern: str, mode: str) -> Column:
        # One pass over the text; the groups come from the short passage that it finds.
        def of(hit: Column) -> Column:
            one = F.regexp_extract(hit, FLAGS + pattern, 1)
            return F.when(hit != "", fiscal_ending(one) if mode == "end_year" else fiscal_range(one, F.regexp_extract(hit, FLAGS + pattern, 2)))

        return F.element_at(F.transform(F.array(F.regexp_extract(low, FLAGS + pattern, 0)), of), 1)

    return F.when(low.rlike(FLAGS + r"\d{4}"), F.coalesce(*[year(p, m) for p, m in rules]))  # most texts name no year at all


def sql_case(text: str, rules: Sequence[tuple[str, str]], default: str = "NULL") -> str:
    """The same chain as an SQL expression."""
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}') THEN '{v}'" for p, v in rules) + f" ELSE {default} END"
