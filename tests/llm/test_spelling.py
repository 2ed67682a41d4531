"""Spelling variants against pairs compared one by one."""

import collections
import random
import re
import zlib

import pytest

from loomline.llm import queries, spelling

SF = "/root/testdata/sf0.001"


def near(a, b):
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain(rows):
    n = collections.Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    by = collections.defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    of = {w: [x for size in (len(w) - 1, len(w), len(w) + 1) for x in by[size] if near(w, x)] for w in n}
    form = {}
    for w, xs in of.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(of[w]), form.get(w), n[form[w]] if w in form else None, root))
    return collections.Counter(out)


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_spelling(spark, SF)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    rows = collections.Counter(map(tuple, got.collect()))
    assert rows == plain(docs) and sum(r[2] for r in rows) > 20 and sum(r[3] is not None for r in rows) > 5


def words(seed, n):
    """Words of few letters, so that many are near, of families that lead from form to form, and long ones."""
    rng = random.Random(seed)
    out = ["".join(rng.choice("abÀé") for _ in range(rng.randint(5, 9))) for _ in range(n)]
    out += [w for k in range(5) for w in ["steps" + "xyz"[: k % 3] + "q" * (k // 3)] * 3 * 2 ** (2 * k)]
    return out + ["y" * 5000, "y" * 4999, "y" * 4999 + "z"] * 4 + ["aaaaa", "aaaaaa", "aaaaaaa"] * 5


@pytest.mark.parametrize(("shard", "wave"), [(spelling.SHARD_BYTES, spelling.WAVE_BYTES), (300, 900), (1, 1)])
def test_shards_and_waves_of_any_size(spark, shard, wave):
    rng = random.Random(shard)
    pool = words(3, 400 if shard > 1 else 60)
    rows = [(i, " ".join(rng.sample(pool, 40)) + "; " + "Ab-CDEFG ×÷×÷× straße_STRAßE 漢字abcde") for i in range(25)] + [(None, "Abcde fghij " * 7), (7, None), (8, ""), (9, " ".join(pool)), (9, " ".join(pool)), (9, " ".join(pool))]
    df = spark.createDataFrame([(*r, 1, "w", "s") for r in rows], "doc_id long, text string, n int, word string, part string").repartition(4)
    got = spelling.variants(df, shard_bytes=shard, wave_bytes=wave).collect()
    assert collections.Counter(map(tuple, got)) == plain(rows)


def test_walk_meets_each_neighbour_once():
    rng = random.Random(1)
    for letters, n in (("ab", 60), ("abcdef", 300)):
        vocabulary = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(n)})
        t = spelling.trie(*spelling.front_coded(vocabulary, list(range(1, len(vocabulary) + 1))))
        for w in [*vocabulary, "zz", "a" * 9]:
            got = list(spelling.neighbours(t, w))
            assert sorted(x for _, x in got) == [x for x in vocabulary if near(w, x)]
            assert all(vocabulary[m - 1] == x for m, x in got)


def test_hard_rows(spark, docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert collections.Counter(map(tuple, spelling.variants(docs).collect())) == plain(rows)
    assert spelling.variants(no_docs).collect() == []


def test_few_files(spark, monkeypatch):
    """Where small partitions are not coalesced, no table of words has more files than cores, nor the result more parts."""
    files, was = [], spelling.materialise
    monkeypatch.setattr(spelling, "materialise", lambda *a, **k: files.append((a[1], len((out := was(*a, **k)).inputFiles()))) or out)
    asked = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "60"}
    before = {k: spark.conf.get(k, None) for k in asked}
    try:
        for k, v in asked.items():
            spark.conf.set(k, v)
        parts = queries.op13_spelling(spark, SF).rdd.getNumPartitions()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    cores = spark.sparkContext.defaultParallelism
    assert parts <= cores and all(n <= cores for _, n in files)
    assert {name for name, _ in files} >= {"words", "vocabulary", "shards", "met", "near", "formed"}
