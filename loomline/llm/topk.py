"""Exact top-k search by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors become integers and are packed into blocks, a table in which every block has its rows'
order in each dimension; it is sorted once. Queries come in waves of bounded size, which every
task gets; candidates are never shuffled again. A query reads a block's lists from the end where
its own component is positive, from the start where it is negative, and every row met is scored
in full. The bound is the sum, over dimensions, of the query's component times the last value
read: no unseen row can score more. A query stops when the bound is below its kth best score so
far, which a task carries on from block to block; at a tie it reads on, for a smaller id wins.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import arrow_rows, discard, materialise

SCALE = 256
#: Rows of a block, and queries of a wave, about.
BLOCK, WAVE = 4096, 4096
#: Depths to which lists are read before a block is read whole.
DEPTHS = (24, 96, 384)
_NONE = -np.inf


def usable(v: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(False))


def integers(v: Column, scale: int = SCALE) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale))


def _pack(batches):
    for b in batches:
        out = []
        for ids, rows in zip(b["ids"], b["rows"]):
            x = np.array([np.asarray(r, np.int64) for r in rows], np.int64).reshape(len(rows), -1)
            order = np.argsort(x, axis=0, kind="stable").astype(np.int32)
            out.append((np.asarray(ids, np.int64).tobytes(), x.tobytes(), order.tobytes(), x.shape[1]))
        yield pd.DataFrame(out, columns=["ids", "x", "sorted", "dims"])


def packed(rows: DataFrame, block: int) -> DataFrame:
    """Blocks of rows (vec_id, v) of one length each, dealt by position, so that no id fills one."""
    n = rows.count()
    part = F.pmod(F.monotonically_increasing_id(), F.lit(max(1, -(-n // block))))
    lists = rows.select(part.alias("part"), F.size("v").alias("dims"), "vec_id", "v").groupBy("part", "dims").agg(F.collect_list("vec_id").alias("ids"), F.collect_list("v").alias("rows"))
    with arrow_rows(rows.sparkSession, 4):
        return materialise(lists.select("ids", "rows").mapInPandas(_pack, "ids binary, x binary, sorted binary, dims int"), "blocks", dealt=True)


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.least = np.full(n, _NONE)

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        near = np.flatnonzero(score >= self.least[q])
        if not len(near):
            return
        if len(near) > 4 * self.k:  # ties of the kth best all stay
            cut = np.partition(score[near], len(near) - self.k)[len(near) - self.k]
            near = near[score[near] >= cut]
        # Negated ids, so that a tie goes to the smaller one.
        both = self.rows[q] + [(int(s), -int(i)) for s, i in zip(score[near], ids[near])]
        self.rows[q] = sorted(both, reverse=True)[: self.k]
        if len(self.rows[q]) == self.k:
            self.least[q] = self.rows[q][-1][0]


def scan_block(x: np.ndarray, order: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, best: Best, at: np.ndarray) -> int:
    """Puts the block's best rows for each of ``queries`` into ``best`` at places ``at``; how many scores were made."""
    n, dims = x.shape
    if dims and float(np.abs(x).max()) * float(np.abs(queries).max()) * dims < 2**53:  # exact, and faster
        x, queries = x.astype(np.float64), queries.astype(np.float64)
    up, down, columns, scored = np.maximum(queries, 0), np.minimum(queries, 0), np.arange(dims), 0
    depths = [d for d in DEPTHS if d < n]

    def met(j: int, d: int) -> np.ndarray:
        seen = np.zeros(n, bool)
        seen[order[n - d :, queries[j] > 0]] = True
        seen[order[:d, queries[j] < 0]] = True
        return np.flatnonzero(seen & (ids != own[j]))

    least = best.least[at].astype(np.float64)
    if depths:  # what is met first gives a query a kth best to stop at
        for j in np.flatnonzero(least == _NONE):
            rows = met(j, depths[0])
            scored += len(rows)
            if len(rows) >= best.k:
                least[j] = np.partition(x[rows] @ queries[j], len(rows) - best.k)[len(rows) - best.k]
    whole = np.ones(len(queries), bool)
    for d in depths:
        bound = up @ x[order[n - d], columns] + down @ x[order[d - 1], columns]
        done = whole & (bound < least)
        whole &= ~done
        for j in np.flatnonzero(done):
            rows = met(j, d)
            best.add(at[j], x[rows] @ queries[j], ids[rows])
            scored += len(rows)
    rest = np.flatnonzero(whole)
    for k in range(0, len(rest), 256):
        part = rest[k : k + 256]
        score = queries[part] @ x.T
        for c, j in enumerate(part):
            other = ids != own[j]
            best.add(at[j], score[c, other], ids[other])
            scored += int(other.sum())
    return scored


def _search(asked: list, k: int):
    """The k best of a task's blocks for each of ``asked``, rows (vec_id, v, n); a query that occurs n times finds each row n times."""
    by_dims: dict[int, list[int]] = {}
    for i, (_, v, _) in enumerate(asked):
        by_dims.setdefault(len(v), []).append(i)
    vectors = {d: np.array([asked[i][1] for i in at], np.int64).reshape(len(at), d) for d, at in by_dims.items()}
    own = np.array([a[0] for a in asked], np.int64)
    times = [min(a[2], k) for a in asked]

    def run(batches):
        best = Best(len(asked), k)
        for b in batches:
            for ids, x, order, d in zip(b["ids"], b["x"], b["sorted"], b["dims"]):
                if d in by_dims:
                    at = np.array(by_dims[d])
                    x, order = np.frombuffer(x, np.int64).reshape(-1, d), np.frombuffer(order, np.int32).reshape(-1, d)
                    scan_block(x, order, np.frombuffer(ids, np.int64), vectors[d], own[at], best, at)
        found = [(int(own[q]), -i, s) for q, rows in enumerate(best.rows) for s, i in rows for _ in range(times[q])]
        for p in range(0, len(found), 50_000):
            yield pd.DataFrame(found[p : p + 50_000], columns=["query_id", "vec_id", "score"])

    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= k)


def search(vectors: DataFrame, queries: Column, k: int = 5, block: int = BLOCK, wave: int = WAVE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows that ``queries`` selects against all others.

    Ties go to the smaller vec_id. Vectors that are null or hold a null or non-finite component
    take no part; vectors of other lengths than a query's are no candidates of it. Rows that
    repeat a vec_id are candidates each, but never of a query with that id; as queries each is
    asked, and the k best pairs of the id are kept. Null ids take no part. An empty table gives
    no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    usable_rows = vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    rows = usable_rows.select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v"))
    asked = materialise(usable_rows.filter(queries).select(F.col("vec_id").cast("long").alias("vec_id"), integers(F.col("embedding")).alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("n")), "queries", dealt=True)
    waves = max(1, -(-asked.count() // wave))
    blocks, found = packed(rows, block), []
    for w in range(waves):  # each wave is one job over all blocks; its result has k rows a query
        part = asked.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(waves)) == w).collect()
        hits = blocks.mapInPandas(_search([(r["vec_id"], r["v"], r["n"]) for r in part], k), "query_id long, vec_id long, score long")
        with arrow_rows(spark, 8):
            found.append(materialise(_ranked(hits, k).drop("rank"), "wave", dealt=True))
        if len(found) == 32:  # plans stay small however many waves there are
            merged = materialise(_union(found), "waves", dealt=True)
            discard(*found)
            found = [merged]
    discard(blocks, asked)
    return _ranked(_union(found), k).select("query_id", "rank", "vec_id", "score")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out
