"""Mixing sources to target weights: capped water-filling and seeded repetitions.

A source's target is ``weight * level`` unless that exceeds ``max_epochs`` times its size; such
sources are clamped and what they cannot take goes to the others by weight. With sources sorted
by cap per weight the clamped ones are a prefix, so one ordered pass finds the level that the
loop "clamp, redistribute, repeat" ends with. The table of sources, one row each, is all that
meets in one task.

A target of ``e`` epochs takes every document floor(e) times whole. The rest goes to documents
in the seeded order of their md5 until it is used up; the last document of a source is planned in
part, so a plan meets its target to the word. That order is cut with 4,096 counts a source, and
only the documents of the one slice where it ends are ever sorted; what the others take follows
from a table of one row a source, so texts meet no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import if_small, materialise, n_words

WEIGHTS = (3, 1, 2)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size) sums; one row a source."""
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    s = by_source.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_epochs).alias("cap"))
    every = W.partitionBy(F.lit(1))
    fill = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    after = fill.rowsBetween(0, W.unboundedFollowing)
    s = s.withColumns({
        "budget": F.sum("source_size").over(every) * share_pct / 100.0,
        "clamped": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "open": F.sum("weight").over(after),
    })
    s = s.withColumn("level", (F.col("budget") - F.col("clamped")) / F.col("open"))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every))
    capped = F.col("cap").cast("double")
    target = F.least(capped, F.coalesce(F.col("level") * F.col("weight"), capped))
    return s.select("source", "source_size", target.alias("target"))


def ends(narrow: DataFrame, seed: int, weights: tuple[int, ...], share_pct: int, max_epochs: int) -> DataFrame:
    """One row a source: its target, the whole repetitions of each document, and where the rest of it ends.

    Slices before ``cut`` are taken once more, those after it are not; ``left`` words go to the
    documents of ``cut`` itself. ``cut`` is past all slices where nothing is left over.
    """
    t = targets(narrow, weights, share_pct, max_epochs)
    t = t.withColumn("wanted", F.floor(F.col("target") + 0.5))
    t = t.withColumn("whole", F.when(F.col("source_size") > 0, F.call_function("div", F.col("wanted"), F.col("source_size"))).otherwise(F.lit(0)))
    t = t.withColumn("rest", F.col("wanted") - F.col("whole") * F.col("source_size"))
    slices = narrow.groupBy("source", _slice(seed).alias("slice")).agg(F.sum("size").alias("n"))
    run = W.partitionBy("source").orderBy("slice")
    slices = slices.withColumn("upto", F.sum("n").over(run)).withColumnRenamed("source", "s_source")
    both = t.join(slices, F.col("source").eqNullSafe(F.col("s_source")))
    # The first slice that the rest does not fill.
    short = F.col("upto") >= F.col("rest")
    out = both.groupBy("source", "source_size", "target", "whole", "rest").agg(F.min(F.when(short, F.struct("slice", "upto", "n"))).alias("c"))
    cut = {"cut": F.coalesce("c.slice", F.lit("~")), "left": F.col("rest") - F.coalesce(F.col("c.upto") - F.col("c.n"), F.lit(0))}
    return out.withColumns(cut).select(F.col("source").alias("s_source"), "source_size", "target", "whole", "cut", "left")


def _key(seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _slice(seed: int) -> Column:
    return F.substring(_key(seed), 1, 3)


def plan(docs: DataFrame, narrow: DataFrame, size: Column | None = None, seed: int = 7, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, max_epochs: int = 2) -> DataFrame:
    """``docs`` (doc_id, source and more) with size, source_size, target and taken.

    ``narrow`` has the (doc_id, source, size) of the same rows without wide columns; ``size`` is
    the words of a row of ``docs`` where it has no such column. ``taken`` is how many of a row's
    words the mix takes, repeats counted. Null sources are one source, sorted last. Rows without
    words take none. Rows that repeat a doc_id are ordered by size after the shared hash, and
    equal ones share what is left to them in any order of the same numbers. An empty table gives
    no rows.
    """
    s = if_small(materialise(ends(narrow, seed, weights, share_pct, max_epochs), "ends", dealt=True))
    both = docs.join(s, F.col("source").eqNullSafe(F.col("s_source")))
    own = F.col("size") if size is None else size
    here = _slice(seed)
    names = [F.col(f"`{c}`") for c in docs.columns if c != "size"]
    plain = both.filter(here != F.col("cut")).select(*names, own.alias("size"), "source_size", "target", (here < F.col("cut")).alias("more"), "whole")
    plain = plain.select(*names, "size", "source_size", "target", (F.col("whole") * F.col("size") + F.when(F.col("more"), F.col("size")).otherwise(0)).cast("long").alias("taken"))
    inside = W.partitionBy("source").orderBy("__key", "size").rowsBetween(W.unboundedPreceding, -1)
    split = both.filter(here == F.col("cut")).select(*names, own.alias("size"), "source_size", "target", "whole", "left", _key(seed).alias("__key"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("left") - F.coalesce(F.sum("size").over(inside), F.lit(0))))
    split = split.select(*names, "size", "source_size", "target", (F.col("whole") * F.col("size") + part).cast("long").alias("taken"))
    return plain.unionByName(split)


def mix(docs: DataFrame, seed: int = 7) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every document; see :func:`plan`. No rows give none."""
    narrow = sized(docs)
    return plan(narrow, narrow, seed=seed)


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size) as a written table: texts are read once, however often sizes are."""
    return materialise(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")


def repeat(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mixed rows themselves, with the columns of ``docs``, whole documents only.

    A row comes as often as the words that the plan takes of it hold its text, to the nearest
    number: a source's one document that is planned in part comes whole or not. So a source is
    off its target by less than half of that document. Rows without words come not at all, as
    they are no part of a mix; null sources are one source; an empty table gives none.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    planned = plan(docs.select("doc_id", "source", "text", row), sized(docs), n_words(F.col("text")), seed)
    copies = F.when(F.col("size") > 0, F.call_function("div", 2 * F.col("taken") + F.col("size"), 2 * F.col("size"))).otherwise(F.lit(0))
    out = planned.select("__row", F.explode(F.array_repeat(F.lit(0), copies.cast("int"))).alias("__copy"))
    return out.select(*[F.col("__row").getField(c).alias(c) for c in docs.columns])
