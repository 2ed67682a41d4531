"""A Merkle manifest of a table: a digest of every row, a tree of each language over them, and a tree over those.

Rows are placed by a range partitioned sort: a row's place is its place in its partition and what
earlier partitions hold of its group, so no group is ever in one task. ``WIDTH`` to the power of
``levels`` neighbouring nodes are an aligned block. One task walks a block in postorder and returns
the digest of each subtree; block roots are the nodes of another distributed walk, until each group
has one. Going down again, a walk appends to all leaves of a subtree the siblings that it meets
while it unwinds, and behind them those of the block itself, which the walk above has found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import if_small, materialise

#: Nodes that become one, and levels that one walk goes over.
WIDTH, LEVELS = 8, 3
STEPS = "array<struct<left:string,right:string>>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf(*values: Column) -> Column:
    """The digest of a row's values: each null as ``-``, others as their number of UTF-8 bytes, a colon and the value."""
    part = lambda v: F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))
    return F.sha2(F.concat(*[part(v.cast("string")) for v in values]), 256)


def fold(digest: Column, proof: Column) -> Column:
    """The root that a leaf's digest and its proof lead to."""
    return F.aggregate(proof, digest, lambda own, s: F.sha2(F.concat(s["left"], own, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the lowest level up, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def _hash(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _walk(digests: list[str], levels: int, steps: list[list] | None = None) -> str:
    """The root of a block of ``levels`` levels; ``steps`` gets, leaf by leaf, the siblings to the left and right of each level."""

    def visit(first: int, end: int, level: int) -> str:
        if level == 0:
            return digests[first]
        width = WIDTH ** (level - 1)
        starts = range(first, end, width)
        kids = [visit(a, min(a + width, end), level - 1) for a in starts]
        if steps is not None:
            for k, a in enumerate(starts):
                sides = {"left": "".join(kids[:k]), "right": "".join(kids[k + 1 :])}
                for i in range(a, min(a + width, end)):
                    steps[i].append(sides)
        return _hash(kids)

    return visit(0, len(digests), levels)


def _nodes(table: pa.Table, levels: int) -> tuple[pa.Table, list[str], int]:
    """A block in order, its digests, and the levels of its walk: fewer where its group ends below."""
    table = table.take(pc.sort_indices(table.column("pos")))
    total, own = table.column("total")[0].as_py(), 0
    while WIDTH**own < total and own < levels:
        own += 1
    return table, [d.hex() for d in table.column("digest").to_pylist()], own


def _block(levels: int) -> Column:
    return F.call_function("div", F.col("pos"), F.lit(WIDTH**levels))


def _up(nodes: DataFrame, levels: int) -> DataFrame:
    """(g, pos, total, digest) of the blocks of ``nodes``."""

    def root(table: pa.Table) -> pa.Table:
        table, digests, own = _nodes(table, levels)
        size = WIDTH**levels
        at, total = table.column("pos")[0].as_py() // size, -(-table.column("total")[0].as_py() // size)
        return pa.table({"g": table.column("g")[:1], "pos": pa.array([at], pa.int64()), "total": pa.array([total], pa.int64()), "digest": pa.array([bytes.fromhex(_walk(digests, own))], pa.binary())})

    own = nodes.select("g", "pos", "total", "digest", _block(levels).alias("block"))
    return own.groupBy("g", "block").applyInArrow(root, "g string, pos long, total long, digest binary")


def _down(nodes: DataFrame, above: DataFrame, levels: int) -> DataFrame:
    """``nodes`` with ``steps``; ``above`` (g, pos, steps) has those of their blocks."""

    def unwind(own: pa.Table, upper: pa.Table) -> pa.Table:
        if own.num_rows == 0:
            return own.append_column("steps", pa.array([], _STEPS)).drop_columns("block")
        own, digests, height = _nodes(own, levels)
        steps: list[list] = [[] for _ in digests]
        _walk(digests, height, steps)
        last = upper.column("steps")[0].as_py()
        return own.drop_columns("block").append_column("steps", pa.array([[*s, *last] for s in steps], _STEPS))

    left = nodes.withColumn("block", _block(levels))
    right = above.select("g", F.col("pos").alias("block"), "steps")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema)
    return left.groupBy("g", "block").cogroup(right.groupBy("g", "block")).applyInArrow(unwind, f"{fields}, steps {STEPS}")


def _placed(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` with ``pos``, from 0, in the order of ``order`` within ``g``, and ``total``, the rows of ``g``.

    ``rows`` is a written table. Rows that are alike in ``order`` are told apart by their place in it, so that no range of many equal ones stays whole.
    """
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    keys = [F.col("g").asc(), *order, F.col("__tie").asc()]
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    t = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "ranged", dealt=True)
    part = F.shiftright("__at", 33)
    counts = t.groupBy(F.col("g").alias("__g"), part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    group = W.partitionBy("__g")
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("__g", "__part", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(group).alias("total"))
    counts = if_small(materialise(counts, "places", dealt=True))
    both = t.join(counts, (F.col("g") == F.col("__g")) & (part == F.col("__part")))
    return both.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__g", "__part", "__shift")


def _climbed(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round from ``nodes`` on, and the (g, digest) that every group ends with."""
    rounds = [nodes]
    while True:
        roots = materialise(_up(rounds[-1], levels), "roots", dealt=True)
        if (roots.agg(F.max("total")).first()[0] or 1) == 1:
            return rounds, roots.select("g", "digest")
        rounds.append(roots)


def _descended(rounds: list[DataFrame], steps: DataFrame, levels: int) -> DataFrame:
    for nodes in reversed(rounds):
        steps = _down(nodes, steps, levels)
    return steps


def manifest(docs: DataFrame, carry: dict[str, Column] | None = None, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof) of every row of ``docs`` (doc_id, source, lang, n_chars, text), and columns of ``carry``.

    Leaves of a language ascend by doc_id, nulls first, then by their digest; every eight
    neighbouring nodes become one. ``proof`` has the siblings to the left and right of a leaf's way
    to ``root``, level by level; :func:`fold` follows it. ``carry`` are expressions over ``docs``.
    Nulls of any column are part of a leaf; null languages are a group, the first; empty and very
    long texts are hashed where they are; equal rows are leaves of their own, any of them at either
    place. An empty table has no rows. Other columns are ignored.
    """
    carry = carry or {}
    spark = docs.sparkSession
    digest = leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")])
    group = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    own = docs.select("doc_id", group.alias("g"), F.unhex(digest).alias("digest"), *[c.alias(f"__c{i}") for i, c in enumerate(carry.values())])
    leaves = _placed(materialise(own, "leaves"), F.col("doc_id").asc_nulls_first(), F.col("digest").asc())
    rounds, subroots = _climbed(leaves, levels)
    tops = _placed(materialise(subroots.select(F.lit("").alias("g"), F.col("g").alias("member"), "digest"), "subroots", dealt=True), F.col("member").asc())
    top_rounds, top = _climbed(tops, levels)
    ends = spark.createDataFrame([("", 0, [])], f"g string, pos long, steps {STEPS}")
    above = _descended(top_rounds, ends, levels).select(F.col("member").alias("g"), F.lit(0).cast("long").alias("pos"), "steps")
    above = materialise(above, "above", dealt=True)
    found = top.select("digest").first()
    root = F.lit(found[0].hex() if found else None).cast("string")
    named = if_small(subroots.select(F.col("g").alias("__g"), F.lower(F.hex("digest")).alias("subroot")))
    out = _descended(rounds, above, levels).join(named, F.col("g") == F.col("__g"))
    return out.select("doc_id", F.lower(F.hex("digest")).alias("leaf"), "subroot", root.alias("root"), F.col("steps").alias("proof"), *[F.col(f"__c{i}").alias(c) for i, c in enumerate(carry)])


def verified(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified): the manifest held against texts that were tampered with.

    Where three divides the crc32 of the decimal doc_id, the text's A-Z are lower-cased before its
    leaf is made again; a null doc_id has no such text. See :func:`manifest`.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    text = F.translate("text", upper, upper.lower())
    changed = F.when(touched & F.col("text").rlike("[A-Z]"), F.unhex(leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)))
    m = manifest(docs, {"changed": changed}, levels)
    own = F.coalesce(F.lower(F.hex("changed")), F.col("leaf"))
    m = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), fold(own, F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))
