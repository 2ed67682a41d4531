"""No training-data query depends on how its tables are dealt over files."""

import pytest

from loomline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    to = tmp_path_factory.mktemp("dealt")
    for t, by in (("documents", "lang"), ("labels", "toxic"), ("embeddings", "label")):
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.repartition(5, by).sortWithinPartitions(df.columns[0], ascending=False).write.parquet(f"{to}/{t}.parquet")
    return str(to)


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op2_lm_score", "op11_packing")])
def test_same_rows(spark, dealt, name):
    rows = lambda sf: sorted(map(str, queries.queries()[name](spark, sf).collect()))
    assert rows(dealt) == rows(SF)


def test_same_scores(spark, dealt):
    rows = lambda sf: {r["doc_id"]: r for r in queries.op2_lm_score(spark, sf).collect()}
    a, b = rows(dealt), rows(SF)
    assert a.keys() == b.keys()
    for i, r in a.items():
        assert (r["n_tokens"], r["n_unseen"]) == (b[i]["n_tokens"], b[i]["n_unseen"]) and abs(r["pll"] - b[i]["pll"]) <= 1e-5 * abs(r["pll"])


def test_same_pieces(spark, dealt):
    """Which sequence a piece is in may change with the files; the pieces do not, and sequences stay few."""
    a, b = (queries.op11_packing(spark, sf).collect() for sf in (dealt, SF))
    assert sorted(r[:5] for r in a) == sorted(r[:5] for r in b)
    n = [len({r["sequence_id"] for r in x}) for x in (a, b)]
    assert abs(n[0] - n[1]) <= 2
