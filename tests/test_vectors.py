"""The vector index against all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.operators import vectors


def made(seed, n, dims=8):
    """Clustered vectors with weights, ties and repeated ids, and rows that take no part."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(7)]
    rows = [(i, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)], rng.choice([0.5, 1.0, 2.0])) for i in range(n)]
    rows += [(i, list(rows[5][1]), 1.0) for i in (3, 900, 901)]
    return rows + [(910, None, 1.0), (911, [0.0] * dims, 1.0), (912, [math.nan] * dims, 1.0), (913, [1.0, None] * (dims // 2), 1.0), (914, [1.0] * (dims - 1), 1.0), (None, [1.0] * dims, 2.0), (915, [math.inf] * dims, 1.0), (916, [], 1.0)]


def good(v, dims):
    return v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v) and any(v)


def model(rows, queries, k, dims, skip_own=False):
    out = []
    for q, v in queries:
        if q is None or not good(v, dims):
            continue
        unit = lambda x: np.array(x) / np.linalg.norm(x)
        scored = sorted((-round(float(unit(v) @ unit(x)) * w, 6), i) for i, x, w in rows if i is not None and good(x, dims) and not (skip_own and i == q))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


SCHEMA = "id long, v array<double>, weight double, cell int, q string"


@pytest.mark.parametrize(("cells", "block", "probes", "skip"), [(None, 1000, 2, False), (12, 5, 1, True), (1, 1000, 1, False), (300, 2, 3, True)])
def test_exact_search_does_not_depend_on_cells(spark, cells, block, probes, skip):
    rows = made(4, 250)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    queries = [(i, v) for i, v, _ in rows if i is None or i % 25 == 0 or i >= 900]
    queries = list({q: v for q, v in queries}.items())
    index = vectors.build(df, "id", "v", F.col("weight"), dims=8, cells=cells, block=block, sample=100)
    got = vectors.search(index, spark.createDataFrame([(*q, 1) for q in queries], "id long, v array<double>, cell int"), "id", "v", 7, probes, skip_own=skip).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == model(rows, queries, 7, 8, skip)


def test_fewer_rows_than_asked_for_and_none(spark):
    rows = made(5, 9)[:3]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    index = vectors.build(df, "id", "v")
    got = vectors.search(index, df, "id", "v", 10, 1).collect()
    assert sorted((r["query_id"], r["rank"], r["id"], r["score"]) for r in got) == model([(i, v, 1.0) for i, v, _ in rows], [(i, v) for i, v, _ in rows], 10, 8)
    assert vectors.search(vectors.build(df.limit(0), "id", "v"), df, "id", "v").collect() == []
    assert vectors.search(index, df.limit(0), "id", "v").collect() == []


def test_probing_finds_nearly_all(spark):
    """The mode that reads few cells, on the given vectors."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    index = vectors.build(e, "vec_id", "embedding")
    queries = e.filter(F.col("vec_id") % 100 == 0)
    exact = {(r["query_id"], r["id"]) for r in vectors.search(index, queries, "vec_id", "embedding", 10).collect()}
    near = {(r["query_id"], r["id"]) for r in vectors.search(index, queries, "vec_id", "embedding", 10, exact=False).collect()}
    assert len(exact) == 10 * queries.count() and len(near & exact) >= 0.9 * len(exact)

