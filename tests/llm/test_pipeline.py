"""The pipeline's stages, each held against its operator's own verdicts."""

from pyspark.sql import functions as F

import corpus_pipeline
from loomline.llm import mixing, near_dup

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert after.columns == names
        if name in ("toxicity", "quality", "near_dup"):
            assert 0 < after.count() < docs.count() or name == "near_dup"
            assert after.join(docs, names, "left_anti").count() == 0
        if name == "near_dup":
            classes = near_dup.classes(docs)
            assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in classes.select("class_id").distinct().collect()}
        if name == "mixing":
            size = mixing.n_words(F.col("text"))
            got = {r[0]: r[1] for r in after.groupBy("source").agg(F.sum(size)).collect()}
            want = {r[0]: (r[1], r[2]) for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken"), F.max("size")).collect()}
            assert all(abs(got.get(k, 0) - n) <= m / 2 for k, (n, m) in want.items())
            assert after.join(docs, names, "left_anti").count() == 0  # whole documents only
            assert after.groupBy("doc_id").count().filter("count > 2").count() == 0
        if k == 4:
            assert after.count() == docs.count() and after.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        docs = after


def test_hard_rows_and_empty_tables(spark, tmp_path):
    from tests.llm import conftest

    plain = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("1000 + doc_id AS doc_id", "text", "lang", "source", "n_chars", "'s' AS size", "1 AS taken", "'q' AS score")
    docs = spark.createDataFrame(conftest.rows(), conftest.DOCS).unionByName(plain)
    labels = spark.createDataFrame([(i, None, None if i == 2 else int(i in (1, 8))) for i in range(12)], "doc_id long, quality int, toxic int")
    for name, rows in (("hard", docs), ("none", docs.limit(0))):
        sf = str(tmp_path / name)
        rows.write.parquet(f"{sf}/documents.parquet")
        labels.write.parquet(f"{sf}/labels.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        got = out.collect()
        if name == "none":
            assert got == []
        else:
            ids = {r["doc_id"] for r in got}
            assert len(ids) > 100 and not ids & {None, 0, 1, 2, 3, 4, 5, 7, 8}  # the hard rows but the long one are short or empty
            assert all(r["n_tokens"] > 0 for r in got)


def test_a_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    import uuid

    name, calls = f"run-{uuid.uuid4().hex}", []
    counted = [(n, lambda s, d, sf, n=n, f=f: calls.append(n) or f(s, d, sf)) for n, f in corpus_pipeline.STAGES]
    broken = [*counted[:3], ("mixing", lambda s, d, sf: 1 / 0), counted[4]]
    monkeypatch.setattr(corpus_pipeline, "STAGES", broken)
    try:
        corpus_pipeline.run(spark, SF, name)
    except ZeroDivisionError:
        pass
    monkeypatch.setattr(corpus_pipeline, "STAGES", counted)
    first = sorted(map(str, corpus_pipeline.run(spark, SF, name).collect()))
    assert calls == ["toxicity", "quality", "near_dup", "mixing", "bpe"]
    assert first == sorted(map(str, corpus_pipeline.run(spark, SF, name).collect())) and len(calls) == 5


def test_a_name_serves_one_input(spark, tmp_path, monkeypatch):
    """Other files under the same path, or at another one, are another run of the name."""
    import uuid

    name, sf = f"run-{uuid.uuid4().hex}", str(tmp_path / "sf")
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, lambda s, d, sf: d) for n, _ in corpus_pipeline.STAGES])
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for n, d in ((5, sf), (7, sf), (docs.count(), SF), (7, sf)):
        if d == sf:
            docs.filter(F.col("doc_id").isNotNull()).orderBy("doc_id").limit(n).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
        assert corpus_pipeline.run(spark, d, name).count() == n


def test_tables_go(spark, tmp_path, monkeypatch):
    """A run leaves what its last stage reads, and nothing if a stage fails; classes leave the two tables that they read."""
    from loomline.llm import common

    before = set(common._left)
    left = lambda: sorted(p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in set(common._left) - before)
    assert corpus_pipeline.run(spark, SF).count() > 0 and left() == ["stage-mixing"]
    before = set(common._left)
    assert near_dup.classes(spark.read.parquet(f"{SF}/documents.parquet")).count() > 0 and left() == ["classes", "signed"]
    before = set(common._left)

    def broken(s, d, sf):
        near_dup.classes(d)
        raise ZeroDivisionError

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[1], ("broken", broken), corpus_pipeline.STAGES[4]])
    try:
        corpus_pipeline.run(spark, SF)
    except ZeroDivisionError:
        pass
    assert left() == []


def test_blocks_of_bounded_bytes(spark, monkeypatch):
    """Classes of a group that no star connects are the same where a block holds a text or two."""
    import random

    rng = random.Random(9)
    base = [f"v{rng.randrange(4000)}" for _ in range(150)]
    texts = []
    for i in range(60):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append((i, " ".join(copy)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = sorted(map(str, near_dup.classes(docs).collect()))
    monkeypatch.setattr(near_dup, "BLOCK_BYTES", 2000)
    assert sorted(map(str, near_dup.classes(docs).collect())) == want
