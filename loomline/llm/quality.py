"""Quality rules: adaptive thresholds from mergeable quantile sketches, DataFrame functions only.

Each document gets integer counts and ratios. For every (language, source) group a quantile
sketch of each ratio is kept as a high-dynamic-range histogram: a ratio becomes an integer
number of 2^-16 steps, whose highest six bits name its bin, so a bin is at most 1/32 wide
relative to its values. Bins are counts, hence sketches merge by addition: sources merge into
their language and languages into the whole. A group's quantiles are blended with those of its
language, and these with those of all rows, by row counts: the coarser sketch counts as
``prior`` rows at every size, so nothing switches when a group grows.

A threshold is ``median + spread * unit``, all of it from the sketches. The unit is the largest of
the distance from the median to the upper quartile (for lower thresholds, the lower one), a
sixteenth of the median (two bins, the sketch's own resolution), and a few occurrences in the
group's typical document: ``few`` over the median of the ratio's denominator, which is sketched
too. So where most rows of a group have none of a thing, the limit follows the length of the
group's documents, and where many have it, its own quartile raises the limit. The quantiles stay
put while fewer than a quarter of a group's rows are junk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import WS, if_small, let, materialise, words

#: Steps of a ratio's unit.
UNIT = 1 << 16
SYMBOLS = "#*$%&|<>"
#: ratio -> (numerator, denominator, few occurrences (of repeated words: a sentence), whether it has a lower threshold)
RATIOS = {
    "symbols": ("n_symbols", "word_chars", 4, False),
    "dup_lines": ("n_dup_lines", "n_lines", 1, False),
    "repeats": ("n_repeat_words", "n_words", 24, False),
    "exclaims": ("n_exclaims", "n_words", 4, False),
    "word_len": ("word_chars", "n_words", 0, True),
}
#: Denominators, sketched as they are.
SIZES = sorted({den for _, den, _, _ in RATIOS.values()})


def _repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window found twice or more in the array ``w``.

    Windows are compared by 64-bit hashes. Sorting longs that carry the top of a hash above a
    window's position puts equal windows side by side in n log n time, however repetitive a text is.
    """

    def covered(h: Column) -> Column:
        bits = F.length(F.bin(F.size(h)))
        low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1

        def from_sorted(s: Column) -> Column:
            def same(x: Column, y: Column) -> Column:
                return F.coalesce(F.get(h, x.bitwiseAND(low).cast("int")) == F.get(h, y.bitwiseAND(low).cast("int")), F.lit(False))

            hits = F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | (F.when(i > 0, same(x, F.get(s, i - 1))).otherwise(False)))
            return let(
                F.sort_array(F.transform(hits, lambda x: x.bitwiseAND(low))),
                lambda p: F.aggregate(
                    F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))),
                    F.lit(0).cast("long"),
                    lambda a, x: a + x,
                ),
            )

        packed = F.transform(h, lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, bits), bits).bitwiseOR(i.cast("long")))
        return let(F.sort_array(packed), from_sorted)

    hashes = F.transform(F.slice(w, 1, F.size(w) - 2), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(
        let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    )


def features(text: Column) -> Column:
    """A struct of integer counts of one text; a null text counts as empty."""
    t = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: F.btrim(x, F.lit(WS)) != "")
    length = lambda c: F.length(c).cast("long")
    return F.struct(
        let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words"))).alias("w"),
        let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
        length(F.translate(t, WS, "")).alias("word_chars"),
        (length(t) - length(F.translate(t, SYMBOLS, ""))).alias("n_symbols"),
        (length(t) - length(F.translate(t, "!", ""))).alias("n_exclaims"),
    )


FEATURES = ("n_words", "n_repeat_words", "n_lines", "n_dup_lines", "word_chars", "n_symbols", "n_exclaims")


def counts(f: Column) -> dict[str, Column]:
    """The counts of a :func:`features` struct by name."""
    at = {"n_words": f["w"]["n_words"], "n_repeat_words": f["w"]["n_repeat_words"], "n_lines": f["l"]["n_lines"], "n_dup_lines": f["l"]["n_dup_lines"]}
    return {k: at.get(k, f[k]) for k in FEATURES}


def _counted(docs: DataFrame, *more: Column) -> DataFrame:
    """(lang, source, the counts, and ``more``) of every row as a written table: counts are made once."""
    f = docs.select("lang", "source", *more, features(F.col("text")).alias("f"))
    kept = [c for c in f.columns if c != "f"]
    return materialise(f.select(*kept, *[c.alias(k) for k, c in counts(F.col("f")).items()]), "quality")


def base_failed(n: Column, repeats: Column) -> Column:
    return (n < 50) | (100 * repeats > 50 * n)


def _step(num: Column, den: Column) -> Column:
    """A ratio in steps of 1/UNIT, whole numbers only."""
    return F.call_function("div", num * UNIT, F.greatest(den, F.lit(1)))


def _bin(step: Column) -> Column:
    """The least value of a step's bin: the six highest bits stay."""
    shift = F.greatest(F.length(F.bin(step)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", step, shift), shift)


def sketches(feats: DataFrame) -> DataFrame:
    """Histogram sketches of ratios and of their denominators: (lang, source, ratio, bin, n)."""
    of = {k: _step(F.col(a), F.col(b)) for k, (a, b, _, _) in RATIOS.items()} | {k: F.col(k) for k in SIZES}
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("ratio"), _bin(c).alias("bin")) for k, c in of.items()]))
    return feats.select("lang", "source", each.alias("e")).groupBy("lang", "source", F.col("e.ratio").alias("ratio"), F.col("e.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _quantiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Size, median and upper quartile of each group's sketch, as bins."""
    by = [*keys, "ratio"]
    merged = sketch.groupBy(*by, "bin").agg(F.sum("n").alias("n"))
    part = W.partitionBy(*by)
    run = merged.select(*by, "bin", F.sum("n").over(part.orderBy("bin")).alias("upto"), F.sum("n").over(part).alias("total"))
    at = lambda num, den: F.min(F.when(F.col("upto") * den >= F.col("total") * num, F.col("bin")))
    return run.groupBy(*by).agg(F.max("total").alias("total"), at(1, 2).alias("mid"), at(1, 4).alias("q25"), at(3, 4).alias("q75"))


def thresholds(sketch: DataFrame, prior: int = 200, spread: int = 4) -> DataFrame:
    """Per (lang, source): ``hi_<ratio>`` and ``lo_<ratio>`` in steps.

    Sketches of the language and of all rows are merged from those of the groups. A group of n
    rows has n / (n + ``prior``) of its own quantiles, the rest is of its language's, which are
    blended with those of all rows in the same way.
    """
    names = ("mid", "q25", "q75")
    g, lang, every = (_quantiles(sketch, by) for by in (["lang", "source"], ["lang"], []))
    lang = lang.select(F.col("lang").alias("l_lang"), F.col("ratio").alias("l_ratio"), F.col("total").alias("l_total"), *[F.col(c).alias(f"l_{c}") for c in names])
    every = every.select(F.col("ratio").alias("a_ratio"), *[F.col(c).alias(f"a_{c}") for c in names])
    q = g.join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("ratio") == F.col("l_ratio"))).join(every, F.col("ratio") == F.col("a_ratio"))
    blend = lambda n, own, coarse: (n * own + prior * coarse) / (n + prior)
    pick = lambda c: blend(F.col("total"), F.col(c), blend(F.col("l_total"), F.col(f"l_{c}"), F.col(f"a_{c}")))
    q = q.select("lang", "source", "ratio", *[pick(c).alias(c) for c in names])
    of = lambda k, c: F.max(F.when(F.col("ratio") == k, F.col(c)))
    wide = q.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(
        *[of(k, c).alias(f"{k}_{c}") for k in RATIOS for c in names], *[of(k, "mid").alias(f"{k}_mid") for k in SIZES]
    )
    one = []
    for k, (_, den, few, down) in RATIOS.items():
        mid, q25, q75 = (F.col(f"{k}_{c}") for c in names)
        least = F.greatest(mid / 16, F.lit(few * UNIT) / F.greatest(F.col(f"{den}_mid"), F.lit(1.0)))
        one.append(F.floor(mid + spread * F.greatest(q75 - mid, least)).alias(f"hi_{k}"))
        if down:
            one.append(F.ceil(mid - spread * F.greatest(mid - q25, least)).alias(f"lo_{k}"))
    return wide.select("t_lang", "t_source", *one)


def verdict() -> Column:
    """True where every ratio lies within its thresholds."""
    ok = F.lit(True)
    for k, (a, b, _, down) in RATIOS.items():
        step = _step(F.col(a), F.col(b))
        ok = ok & (step <= F.col(f"hi_{k}"))
        if down:
            ok = ok & (step >= F.col(f"lo_{k}"))
    return ok


def _judged(rows: DataFrame, prior: int, spread: int) -> DataFrame:
    """Counted rows with base_failed and kept; the table of thresholds, one row a group, is broadcast if it is small."""
    limits = if_small(materialise(thresholds(sketches(rows), prior, spread), "thresholds", dealt=True))
    both = rows.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return both.withColumns({"base_failed": failed, "kept": ~failed & F.coalesce(verdict(), F.lit(True))})


def judge(docs: DataFrame, prior: int = 200, spread: int = 4) -> DataFrame:
    """(doc_id, counts, base_failed, kept) of every row of ``docs``.

    Null languages and sources are groups of their own. A null or empty text has no words and
    fails the base rule; a very long one is one row like others. Repeated rows each count and
    each get a verdict; an empty table gives none. Other columns of ``docs`` are ignored.
    """
    return _judged(_counted(docs, F.col("doc_id")), prior, spread).select("doc_id", *FEATURES, "base_failed", "kept")


def keep(docs: DataFrame, prior: int = 200, spread: int = 4) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns, also where these have names of the counts.

    Null, empty and long texts, null groups and repeated rows are treated as by :func:`judge`; an
    empty table gives none. Rows are written once with their counts, so texts are neither counted
    twice nor shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    out = _judged(_counted(docs, row), prior, spread).filter("kept")
    return out.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
