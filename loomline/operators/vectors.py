"""A vector index: an inverted file of cells, probed by bound, exact where the bound asks for it.

Cell centres are fitted on a sample of bounded size; every row is in the cell of its nearest centre.
A cell's radius bounds what a query can score in it: with unit vectors a row of it is at least the
centre's distance less the radius away. A search first probes the cells whose centres score best. Then no
cell whose bound is below the k-th score found can hold a better row; the exact mode reads the others
too, so its result does not depend on the cells. Cells are cut into blocks of rows, and a block meets
the queries that probe it as two matrices.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.sources.shared import kept, result, scratch

#: Rows that centres are fitted on, cells at most, and rows of a block.
SAMPLE, MAX_CELLS, BLOCK = 20_000, 4096, 1000
#: Digits of a score; what differs less is a tie.
DIGITS = 6


@dataclass
class Index:
    """``rows`` (id, v, weight, cell, block) is a written table; the arrays have an entry a cell."""

    rows: DataFrame
    centres: np.ndarray
    radius: np.ndarray
    heaviest: np.ndarray
    lightest: np.ndarray
    blocks: np.ndarray


def usable(v: Column, dims: int | None = None) -> Column:
    """Whether a vector takes part: no nulls, all finite, not zero, of ``dims`` numbers if that is given."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    some = finite & F.exists(v, lambda x: x != 0)
    return F.coalesce(some if dims is None else some & (F.size(v) == dims), F.lit(False))


def _unit(vectors) -> np.ndarray:
    m = np.stack([np.asarray(x, np.float64) for x in vectors])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _distances(unit: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (unit**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * unit @ centres.T))


def _centres(rows: DataFrame, cells: int, sample: int, seed: int) -> np.ndarray:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    unit = F.transform("v", lambda x: x.cast("double") / norm)
    some = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select(array_to_vector(unit).alias("features"))
    model = KMeans(k=cells, seed=seed, maxIter=10, initMode="random").fit(some)
    return np.array(model.clusterCenters())


def build(vectors: DataFrame, key: str, vector: str, weight: Column | None = None, dims: int | None = None, cells: int | None = None, sample: int = SAMPLE, block: int = BLOCK, seed: int = 7) -> Index:
    """An index of all rows of ``vectors`` whose vector is :func:`usable` and has ``dims`` numbers, by default as many as the longest usable one.

    ``weight`` multiplies the cosine of a row and is above 0. There are as many cells as the root of
    the number of rows, ``MAX_CELLS`` at most. Ids may repeat; every row is a hit of its own.
    """
    own = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("weight")).filter(usable(F.col("v")) & F.col("id").isNotNull())
    if dims is None:
        dims = own.agg(F.max(F.size("v"))).first()[0] or 0
    own = kept(own.filter(F.size("v") == dims), "vectors")
    n = own.count()
    if n == 0:
        none = np.zeros(0)
        return Index(own.select("*", F.lit(0).alias("cell"), F.lit(0).alias("block")), np.zeros((0, dims)), none, none, none, np.zeros(0, np.int64))
    many = min(MAX_CELLS, n, cells or int(n**0.5))
    centres = _centres(own, many, sample, seed) if many > 1 else np.zeros((1, dims))

    @F.pandas_udf("cell int, distance double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        d = _distances(_unit(v), centres)
        cell = d.argmin(1)
        return pd.DataFrame({"cell": cell.astype(np.int32), "distance": d[np.arange(len(d)), cell]})

    placed = kept(own.withColumn("p", nearest("v")).select("id", "v", "weight", F.col("p.cell").alias("cell"), F.col("p.distance").alias("distance")), "placed")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("r"), F.max("weight").alias("w1"), F.min("weight").alias("w0")).collect()
    size = len(centres)
    radius, heaviest, lightest, blocks = np.zeros(size), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
    for s in stats:
        radius[s["cell"]], heaviest[s["cell"]], lightest[s["cell"]], blocks[s["cell"]] = s["r"], s["w1"], s["w0"], -(-s["n"] // block)
    number = F.pmod(F.xxhash64("id"), F.get(F.lit(blocks.tolist()), F.col("cell"))).cast("int")
    return Index(placed.select("id", "v", "weight", "cell", number.alias("block")), centres, radius, heaviest, lightest, blocks)


def _bounds(index: Index, unit: np.ndarray) -> np.ndarray:
    """What each query can score at most in each cell; empty cells have the least bound."""
    away = np.maximum(0.0, _distances(unit, index.centres) - index.radius[None, :] - 1e-9)
    cosine = 1 - away**2 / 2
    bound = np.where(cosine >= 0, cosine * index.heaviest[None, :], cosine * index.lightest[None, :])
    return np.where(index.blocks[None, :] > 0, bound, -np.inf)


def _met(index: Index, probes: DataFrame, k: int, skip_own: bool) -> DataFrame:
    """(query_id, id, score): the k best of each block for each query that probes it; ``probes`` has (query_id, q, cell, block)."""
    key = probes.schema["query_id"].dataType.simpleString(), index.rows.schema["id"].dataType.simpleString()

    def score(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if rows.num_rows and queries.num_rows:
            ids = np.array(rows.column("id").to_pylist(), dtype=object)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _unit(rows.column("v").to_pylist())[order]
            w = rows.column("weight").to_numpy()[order]
            names = queries.column("query_id").to_pylist()
            scores = np.round((_unit(queries.column("q").to_pylist()) @ x.T) * w[None, :], DIGITS) + 0.0
            for name, s in zip(names, scores):
                if skip_own:
                    s = np.where(ids == name, -np.inf, s)
                # Ids ascend, so a stable order has ties by id.
                for i in np.argsort(-s, kind="stable")[:k]:
                    if s[i] > -np.inf:
                        out["query_id"].append(name), out["id"].append(ids[i]), out["score"].append(float(s[i]))
        return pa.table({"query_id": pa.array(out["query_id"], queries.schema.field("query_id").type), "id": pa.array(out["id"], rows.schema.field("id").type), "score": pa.array(out["score"], pa.float64())})

    return index.rows.groupBy("cell", "block").cogroup(probes.groupBy("cell", "block")).applyInArrow(score, f"query_id {key[0]}, id {key[1]}, score double")


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, key: str, vector: str, k: int = 10, probes: int | None = None, exact: bool = True, skip_own: bool = False) -> DataFrame:
    """(query_id, rank, id, score): the k rows of the largest cosine times weight, rounded, ties to the smaller id.

    ``probes`` cells whose centres score best are read for each query, by default 4; with ``exact``
    also those that these leave open, which gives what reading all rows gives. Without it the default
    is six cells in ten, as vectors without clusters need: 0.93 of the ten best on such ones. Queries whose vector is not usable or
    has another length have no hits; keys of ``queries`` are unique. ``skip_own`` leaves a row with
    the query's own id out.
    """
    dims = index.centres.shape[1]
    own = queries.select(F.col(key).alias("query_id"), F.col(vector).alias("q")).filter(usable(F.col("q"), dims) & F.col("query_id").isNotNull())
    cells = len(index.centres)
    first = min(cells, probes or (4 if exact else -(-cells * 6 // 10)))

    def chosen(unit: np.ndarray, least: np.ndarray | None) -> list[list[dict]]:
        bounds = _bounds(bare, unit)
        likely = unit @ bare.centres.T * bare.heaviest[None, :]
        order = np.argsort(np.where(bounds > -np.inf, -likely, np.inf), axis=1, kind="stable")
        out = []
        for row, b in enumerate(bounds):
            mine = order[row, :first] if least is None else [c for c in order[row, first:] if b[c] >= least[row] - 10.0**-DIGITS]
            out.append([{"cell": int(c), "block": i} for c in mine if b[c] > -np.inf for i in range(index_blocks[c])])
        return out

    index_blocks = index.blocks.tolist()
    bare = Index(None, index.centres, index.radius, index.heaviest, index.lightest, index.blocks)

    @F.pandas_udf("array<struct<cell:int,block:int>>")
    def nearest(q: pd.Series) -> pd.Series:
        return pd.Series(chosen(_unit(q), None))

    @F.pandas_udf("array<struct<cell:int,block:int>>")
    def still_open(q: pd.Series, least: pd.Series) -> pd.Series:
        return pd.Series(chosen(_unit(q), least.to_numpy()))

    def probing(asked: DataFrame, of: Column) -> DataFrame:
        return asked.select("query_id", "q", F.explode(of).alias("c")).select("query_id", "q", F.col("c.cell").alias("cell"), F.col("c.block").alias("block"))

    with scratch():
        found = kept(_best(_met(index, probing(own, nearest("q")), k, skip_own), k), "found") if cells else None
        if found is not None and exact:
            # The k-th score, or less than any if there are not as many.
            least = found.groupBy(F.col("query_id").alias("__q")).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("s"))
            asked = own.join(least, F.col("query_id") == F.col("__q"), "left").withColumn("least", F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(float("-inf"))))
            more = _met(index, probing(asked, still_open("q", "least")), k, skip_own)
            out = _best(found.select("query_id", "id", "score").unionByName(more), k)
        elif found is not None:
            out = found
        else:
            out = own.select("query_id", F.lit(0).alias("rank"), F.col("query_id").alias("id"), F.lit(0.0).alias("score")).limit(0)
        return result(out.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score"), "hits")
