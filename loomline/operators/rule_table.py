"""Ordered rules as rows: an inverted table of what a pattern needs says which rules a text has to meet.

Of every pattern the letters are taken that any text it finds must hold, one run of them for each
of its alternatives. A rule stands in the inverted table under three letters of each run. A text is
joined to the rules under its own letters, those whose run it holds are tried, and the rule of the
least priority that is found gives the label. Patterns of which nothing is certain are tried on every text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions.rules import FLAGS
from loomline.operators.lookup import if_small

GRAM = 3
#: Grams of rules that a text's own are compared with before the join; more only make the join larger.
MOST_GRAMS = 10_000


def table(spark: SparkSession, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(priority, pattern, label) of ordered rules."""
    return spark.createDataFrame([(i, p, v) for i, (p, v) in enumerate(rules)], "priority int, pattern string, label string")


def needed(pattern: str) -> list[str]:
    """Runs of letters of which a text must hold one for ``pattern`` to be found; none if that cannot be told."""
    from re import _constants as c
    from re import _parser

    try:
        tree = _parser.parse(pattern)
    except Exception:  # what Java's dialect alone knows
        return []
    if tree.state.flags & c.SRE_FLAG_IGNORECASE:
        return []

    def runs(items) -> list[list[str]]:
        """Sets of which one run each is certain, in a sequence that is matched as a whole."""
        out, own = [], ""
        for op, arg in items:
            if op is c.LITERAL:
                own += chr(arg)
                continue
            inner: list[list[str]] = []
            if op is c.SUBPATTERN and not arg[1] and not arg[2]:
                inner = runs(arg[3])
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT) and arg[0] > 0:
                inner = runs(arg[2])
            elif op is c.BRANCH:
                each = [best(runs(b)) for b in arg[1]]
                inner = [[x for e in each for x in e]] if all(each) else []
            elif op is c.AT:
                continue
            out += ([[own]] if own else []) + inner
            own = ""
        return out + ([[own]] if own else [])

    def best(sets: list[list[str]]) -> list[str]:
        """The set whose shortest run is the longest."""
        usable = [s for s in sets if s and min(map(len, s)) >= GRAM]
        return max(usable, key=lambda s: min(map(len, s)), default=[])

    return best(runs(tree))


def inverted(rules: DataFrame) -> DataFrame:
    """(gram, run, priority, pattern, label) of ``rules``; a rule that is tried on every text has empty ones.

    Each run stands under the one of its grams that the fewest runs have.
    """
    own = [(r["priority"], r["pattern"], r["label"], run) for r in rules.collect() for run in (sorted(set(needed(r["pattern"]))) or [""])]
    grams = lambda run: [run[i : i + GRAM] for i in range(len(run) - GRAM + 1)]
    many = Counter(g for *_, run in own for g in set(grams(run)))
    rows = [(min(grams(run), key=lambda g: (many[g], g)) if run else "", run, p, pattern, label) for p, pattern, label, run in own]
    return rules.sparkSession.createDataFrame(rows, "gram string, run string, priority int, pattern string, label string")


def tried(texts: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, text, priority, pattern, label): the rules that a text has to meet, each once."""
    held = inverted(rules)
    grams = [r[0] for r in held.select("gram").distinct().limit(MOST_GRAMS + 1).collect()]
    # Every place of the text gives a gram; a look-ahead lets them overlap.
    own = F.concat(F.array(F.lit("")), F.regexp_extract_all(text, F.lit("(?s)(?=(" + "." * GRAM + "))"), F.lit(1)))
    own = F.array_intersect(own, F.lit(grams)) if 0 < len(grams) <= MOST_GRAMS else F.array_distinct(own)
    each = texts.select(F.col(key).alias("__key"), F.col(text).alias("__text"), F.explode(own).alias("gram"))
    met = each.join(if_small(held), "gram").filter(F.contains("__text", "run"))
    # Alternatives of one pattern that a text both holds are one trial.
    first = F.min("run").alias("run")
    return met.groupBy("__key", "__text", "priority", "pattern", "label").agg(first).drop("run").select(F.col("__key").alias(key), F.col("__text").alias(text), "priority", "pattern", "label")


def first_of(texts: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """(key, label) of ``texts``, whose keys are unique and not null: the label of the rule of least priority whose pattern is found, else null.

    ``rules`` (priority, pattern, label) has unique priorities; it is a table of rules, which the
    driver reads to make the inverted one. Null texts have no label.
    """
    found = tried(texts, rules, key, text).filter(F.expr(f"`{text}` rlike concat('{FLAGS}', pattern)"))
    label = found.groupBy(F.col(key).alias("__k")).agg(F.min_by("label", "priority").alias("label"))
    return texts.select(key).join(label, F.col(key) == F.col("__k"), "left").select(key, "label")
