"""Places and spans of license scans over a whole table, and in texts with very many of them."""

import re
import time

from loomline.llm import licenses, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def test_query_against_a_plain_search(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op7_licenses(spark, SF).collect()
    assert len(got) == len(texts)
    found = 0
    for r in got:
        w = words(texts[r["doc_id"]])
        hits = sorted((i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
        base = sorted({x for _, x in hits})
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(hits), ",".join(base))
        assert (r["first_word"], r["last_word"]) == ((hits[0][0], hits[-1][0]) if hits else (None, None))
        assert set(base) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 and (not hits or r["score"] == 1)
        found += len(hits)
    assert found > 0


def test_spans_are_where_their_words_stand():
    text = "Préface: one two. Licenced under the Apache Lisense, Version 2! GNU lesser genral public license; under the MIT license " * 3
    w = words(text)
    *_, spans = licenses.scan(text)
    assert len(spans) >= 6
    for s in spans:
        assert " ".join(w[s["first_word"] : s["first_word"] + s["n_words"]]) == s["matched"] and s["edits"] <= 5


def test_time_is_linear_in_the_number_of_hits():
    took = []
    for n in (20_000, 80_000):
        began = time.process_time()
        out = licenses.scan("under the mit license or " * n)
        took.append(time.process_time() - began)
        assert out[1] == n and out[2:4] == (0, 5 * (n - 1))
    assert took[1] < 8 * took[0] + 1
    began = time.process_time()
    assert licenses.scan("cc by nc " * 1_000_000)[1] == 1_000_000
    assert time.process_time() - began < 60
