"""Every operator on hard rows and on no rows."""

import pytest

from loomline.llm import bpe, language, licenses, lm, mixing, near_dup, quality, token_counts, topk, toxicity
from tests.llm.conftest import rows

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
RUNS = {
    "mix": lambda d, l: mixing.mix(d),
    "lm": lambda d, l: lm.score(d),
    "tokens": lambda d, l: token_counts.count_tokens(d, WORD),
    "toxicity": lambda d, l: toxicity.classify(d, l),
    "bpe": lambda d, l: bpe.encode_digests(d, BYTE),
    "near_dup": lambda d, l: near_dup.classes(d),
    "licenses": lambda d, l: licenses.scan_documents(d),
    "language": lambda d, l: language.identify(d),
    "quality": lambda d, l: quality.judge(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_hard_rows(docs, no_docs, labels, name):
    assert len(RUNS[name](docs, labels).collect()) == len(rows())
    assert RUNS[name](no_docs, labels.limit(0)).collect() == []


def test_filters_keep_columns(docs, no_docs, labels):
    for f in (lambda d: toxicity.reject(d, d, labels), quality.keep, near_dup.keep_one, mixing.repeat):
        assert f(docs).columns == docs.columns and f(no_docs).count() == 0


def test_results_of_hard_rows(docs, labels):
    m = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    assert m[3]["size"] == m[4]["size"] == m[5]["size"] == 0 and m[3]["taken"] == 0 and m[6]["size"] == 40_000
    near = {r["doc_id"]: r["class_id"] for r in near_dup.classes(docs).collect()}
    assert near[0] == near[1] == near[2] == 0 and near[3] == near[4] == 3 and near[7] == 7 and near[None] == 0
    lang = {r["doc_id"]: r for r in language.identify(docs).collect()}
    assert lang[3]["lang_pred"] == lang[5]["lang_pred"] == "und" and lang[3]["score"] == 0
    lic = {r["doc_id"]: r for r in licenses.scan_documents(docs).collect()}
    assert (lic[9]["n_base"], lic[9]["first_word"], lic[9]["labels"]) == (1, 1, "mit") and (lic[3]["n_words"], lic[3]["first_word"], lic[3]["labels"], lic[3]["score"]) == (0, None, "", 0)
    q = {r["doc_id"]: r for r in quality.judge(docs).collect()}
    assert q[3]["base_failed"] and not q[3]["kept"] and q[6]["n_words"] == 40_000


def test_vectors(spark):
    v = [(0, [1.0, -0.5]), (0, [2.0, 2.0]), (1, [1.0, -0.5]), (2, [1.0, -0.5]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (7, []), (None, [1.0, 1.0]), (100, [-1.0, 0.25])]
    df = spark.createDataFrame([(a, b, 9) for a, b in v], "vec_id long, embedding array<double>, rank int")
    from pyspark.sql import functions as F

    got = [tuple(r) for r in topk.search(df, F.col("vec_id") % 50 == 0, k=2).orderBy("query_id", "rank").collect()]
    assert [g[1:] for g in got if g[0] == 100] == [(1, 0, -73728), (2, 1, -73728)]
    assert {g[0] for g in got} == {0, 100} and all(g[0] != g[2] for g in got)
    assert topk.search(df.limit(0), F.col("vec_id") % 50 == 0).collect() == []


def test_keep_one_loses_no_class_to_its_ids(spark):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(100)) for x in "abcd")
    rows = [(None, a), (None, b), (None, a + " end"), (3, c), (3, d), (3, c), (8, d), (None, c)]
    got = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    texts = [r["text"] for r in got]
    assert len(texts) == 4 and {b, c, d} < set(texts) and (a in texts or a + " end" in texts)
    assert all(r["doc_id"] == 3 for r in got if r["text"] in (c, d))


def test_clashing_names(spark, labels):
    """Columns that have the names operators work with."""
    names = ["_key", "row", "text_a", "n_words", "kept", "t_lang", "cut", "s_source", "__row", "__copy", "__toxic", "lexicon", "node", "f"]
    word = " ".join(f"w{i}" for i in range(80))
    rows = [(i, f"{word} {i // 2 * 'x y z ' }", "en", "s", *range(len(names))) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} long" for n in names))
    for f in (lambda d: toxicity.reject(d, d, labels), quality.keep, near_dup.keep_one, mixing.repeat):
        out = f(df)
        assert out.columns == df.columns and all(r["_key"] == 0 and r["f"] == len(names) - 1 for r in out.collect())
    for name in RUNS:
        assert len(RUNS[name](df, labels).collect()) == 6
