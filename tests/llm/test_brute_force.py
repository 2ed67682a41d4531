"""Operators against plain models, the library's own tokenizers, and held-out accuracy."""

import collections
import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import bpe, language, licenses, lm, near_dup, pretokens, queries, quality, token_counts, topk, toxicity

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    r = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(map(str, (x[names.index(c)] for c in df.columns))) for x in r.fetchall()) == sorted(tuple(map(str, x)) for x in df.collect())


def test_mix_against_the_loop(spark, texts):
    got = queries.op1_mix_sources(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source"), "doc_id").collect()
    size = collections.Counter()
    for r in got:
        assert r["size"] == len(split(texts[r["doc_id"]])) and 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] += r["size"]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(size))}
    left, capped = set(size), {}
    while True:
        level = (1.5 * sum(size.values()) - sum(capped.values())) / sum(weight[s] for s in left)
        over = [s for s in left if level * weight[s] > 2 * size[s]]
        if not over:
            break
        capped |= {s: 2.0 * size[s] for s in over}
        left -= set(over)
    taken = collections.Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        want = capped.get(r["source"], level * weight[r["source"]])
        assert abs(r["target"] - want) < 1e-6
    assert all(abs(taken[s] - capped.get(s, level * weight[s])) <= 1 for s in size)


def fuzz(n, seed):
    rng = random.Random(seed)
    pool = [chr(i) for i in range(32, 127)] + list("  \n\t\r\x0b\x1c\x85\xa0'sStTéÉüßİıª²½漢字あЌΣςÅ…“”’—€　😀👍🏽\x00À̀­​ ") + ["<|endoftext|>", "<|startoftext|>", "'ll", " don't"]
    return ["".join(rng.choice(pool) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_tokenizers(texts):
    counter, enc = token_counts.TokenCounter(public_tokenizers.path("word_bpe_49k.json")), bpe.FragmentEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    count = lambda texts: [sum(counter.sizes(counter.split(t))) for t in texts]
    each = [f for a, b in pretokens.SAFE for p in range(a, b + 1) for f in (f"a{chr(p)}b", f"1{chr(p)}2 {chr(p)} {chr(p)}{chr(p)}")]
    sample = list(texts.values())[:25] + fuzz(1500, 1) + each
    assert count(sample) == [len(counter.splitter.library.encode(t, add_special_tokens=False).ids) for t in sample]
    lib = enc.splitter.library
    for t, (n, ids, data) in zip(sample, enc.run(sample)):
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)) and n == len(want) and data.decode() == lib.decode(want, skip_special_tokens=False)
    assert enc.decode(enc.encode("Hello <|endoftext|> wörld")) == "Hello <|endoftext|> wörld"


def test_forced_cuts_never_change_ids():
    enc = bpe.FragmentEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert enc.certain.any() and [b"".join(c) for c in enc.cut(["qzx", "abc", "一\x00"])] == [b"qzx", b"abc", "一\x00".encode()]
    assert any(len(c) > 1 for c in enc.cut(["\x00一zq", "qzj!a"]))


def test_store_stays_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STORE", 50)
    enc = bpe.FragmentEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(5):
        t = " ".join(f"word{k}{i}" for i in range(30))
        assert enc.encode(t) == enc.splitter.library.encode(t).ids
        assert len(enc.store) <= 60


@pytest.mark.parametrize("lexicon", [token_counts.LEXICON, 40, 0])
def test_token_counts_against_the_library(spark, texts, monkeypatch, lexicon):
    """All columns of the query, with pre-tokens from the tasks' lexicon, from the join, and from both."""
    monkeypatch.setattr(token_counts, "LEXICON", lexicon)
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = token_counts.TokenCounter(path).splitter.library
    rows = [*texts.items(), *enumerate(fuzz(200, 9), 10**6), (7, None), (None, "once more"), (7, "word " * 2100)]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), path).collect()
    want = [(i, len((t or "").encode()), n := len(lib.encode(t or "", add_special_tokens=False).ids), n > 2048) for i, t in rows]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_bpe_query_digests(spark, texts):
    lib = bpe.FragmentEncoder(public_tokenizers.path("byte_bpe_50k.json")).splitter.library
    for r in queries.op5_bpe(spark, SF).collect():
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_quality_counts(spark, texts):
    rep = ["a b c a b c a b c", "x y z " * 40 + "\nq\nq\n \n", "a a a a", "a b c d", "p q r s p q r"]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate([*rep, *texts.values()])], "doc_id long, text string, lang string, source string")
    by_id = dict(enumerate([*rep, *texts.values()]))
    for r in quality.judge(df).collect():
        t = by_id[r["doc_id"]]
        w = split(t)
        grams = list(zip(w, w[1:], w[2:]))
        n, cov, seen, dup = collections.Counter(grams), set(), set(), 0
        for i, g in enumerate(grams):
            if n[g] > 1:
                cov |= {i, i + 1, i + 2}
        for line in t.split("\n"):
            if split(line):
                dup += line in seen
                seen.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cov))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cov) > 50 * len(w))


def test_quality_keeps_clean_documents(spark):
    lab = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = queries.op10_quality(spark, "/root/testdata/sf0.01").filter("n_words >= 50").join(lab, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {r["quality"]: r["k"] for r in got}
    assert kept[1] > 0.98 and kept[0] < 0.05


def model_classes(texts, threshold=0.8):
    sets = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w := split(t)) >= 5 else collections.Counter([tuple(w)]) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for a in ids:
        for b in ids:
            if a < b:
                both = sum((sets[a] & sets[b]).values())
                if both / (sum(sets[a].values()) + sum(sets[b].values()) - both) >= threshold:
                    x, y = sorted((root(a), root(b)))
                    parent[y] = x
    return {i: root(i) for i in ids}


def test_near_duplicates(spark):
    rng = random.Random(3)
    base = [[f"v{rng.randrange(4000)}" for _ in range(rng.randint(60, 200))] for _ in range(12)]
    texts, i = {}, 0
    for b, w in enumerate(base):
        for _ in range(40 if b == 0 else rng.randint(1, 6)):
            copy = list(w)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts[i] = " ".join(copy)
            i += 1
    texts |= {i: "say it again and " * 200, i + 1: "say it again and " * 190, i + 2: "say it again and " * 100}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()}
    assert got == model_classes(texts)


def test_near_duplicates_about_the_threshold(spark):
    """A group whose pairs lie on either side of the threshold: no star finds all of its links."""
    rng = random.Random(4)
    base = [f"v{rng.randrange(4000)}" for _ in range(150)]
    texts = {}
    for i in range(320):
        copy = list(base)
        for _ in range(rng.randint(1, 5)):
            copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
        texts[i] = " ".join(copy)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.classes(df).collect()}
    assert got == model_classes(texts)


def test_signatures_estimate_the_weighted_jaccard():
    rng = random.Random(8)
    a = [f"t{rng.randrange(60)}" for _ in range(400)]
    for change in (20, 60):
        b = a[: 400 - change] + [f"u{k}" for k in range(change)]
        d, s, c = near_dup.shingles([" ".join(a), " ".join(b)])
        sig = near_dup.signatures(2, d, s, c)
        cut = np.searchsorted(d, 1)
        true = near_dup.similarity((s[:cut], c[:cut]), (s[cut:], c[cut:]))
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / near_dup.SLOTS) ** 0.5 + 0.01


def test_licenses():
    def plain(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        found = [(i, lab) for p, lab in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        return len(w), len(found), min((i for i, _ in found), default=None), max((i for i, _ in found), default=None), ",".join(sorted({x for _, x in found}))

    cases = ["Under the MIT-License; under the mit license", "the Apache License, Version 2.0 CC BY-NC cc by nc", "İ under the mit licenses", "", "ÀÉ under  the\nmit license", "cc by ncc"]
    for t in cases:
        assert licenses.scan(t)[:5] == plain(t), t
    typo = licenses.scan("This work is licenced under the Apache Lisense, Version 2.0.")
    assert typo[5] == "apache-2" and typo[1] == 0 and 0.8 < typo[6] < 1 and typo[7][0]["edits"] == 2
    assert licenses.scan("GNU General Public License, version 3.")[5] == "gpl-3"
    assert licenses.scan("the weather is fine and no notice stands here")[5] == ""


def test_language_accuracy(spark):
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = queries.op8_language(spark, "/root/testdata/sf0.01").filter("held_out").join(lang, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert got > 0.98


def test_toxicity_accuracy_and_groups(spark):
    d, l = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(d, l, max_rows=4000)
    got = d.filter(toxicity.held_out(F.col("doc_id"))).join(l, "doc_id").withColumn("p", (toxicity.score(F.col("text"), model) >= 0.5).cast("int"))
    r = got.agg(F.avg((F.col("p") == F.col("toxic")).cast("int")).alias("acc"), F.avg(F.when(F.col("toxic") == 1, F.col("p"))).alias("rec"), F.avg(F.when(F.col("toxic") == 0, F.col("p"))).alias("fp")).first()
    assert r["acc"] > 0.97 and r["rec"] > 0.85 and r["fp"] < 0.01
    assert model.pairs > 1000


def plain_score(text, model):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    terms = words | {"^" + w[:k] for w in words if w not in model.names.swaps for k in (4, 5, 6) if len(w) > k}
    z = model.bias + sum(model.weights.get(t, 0) for t in terms)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def test_toxicity_query_against_the_formula(spark, texts):
    sf = "/root/testdata/sf0.01"
    d, l = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model, by_id = toxicity.train(d, l), {r["doc_id"]: r["text"] for r in d.collect()}
    got = queries.op4_toxicity(spark, sf).collect()
    assert len(got) == len(by_id)
    import zlib

    for r in got:
        assert abs(r["score"] - plain_score(by_id[r["doc_id"]], model)) < 1e-9
        assert r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_neutral_mentions_stay_neutral(spark):
    """Where mentions of groups go with the label, the penalty keeps neutral mentions from being called toxic."""
    rng = random.Random(1)
    plain = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(300)]
    groups = ["muslims", "women", "refugees", "gay", "juden", "femmes"]
    rows = []
    for i in range(2500):
        w, toxic = [rng.choice(plain) for _ in range(20)], int(rng.random() < 0.3)
        if toxic and rng.random() < 0.85:
            w.append(rng.choice(["vile", "scum"]))
        if rng.random() < (0.7 if toxic else 0.05):
            w.append(rng.choice(groups))
        rows.append((i, " ".join(w), toxic))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    neutral = [" ".join(rng.choice(plain) for _ in range(20)) + " " + g for g in groups for _ in range(10)]
    bad = [t + " vile" for t in neutral]
    rate = lambda m, ts: np.mean([plain_score(t, m) >= 0.5 for t in ts])
    free, held = (toxicity.train(df, df.select("doc_id", "toxic"), counterfactual=c) for c in (0.0, 20.0))
    assert held.pairs > 5000 and rate(free, neutral) > 0.3 and rate(held, neutral) == 0 and rate(held, bad) > 0.95


def test_counterfactual_texts():
    n = toxicity.Names((("cats", "dogs", "birds"),))
    assert all(x - {"we", "like"} < {"cats", "dogs", "birds"} and len(x) == 3 for x in n.counterfactuals({"we", "like"}, 4))
    one = n.counterfactuals({"we", "like", "cats"}, 4)
    assert len(one) == 1 and "cats" not in one[0] and one[0] == n.counterfactuals({"we", "cats", "like"}, 1)[0]
    assert one[0] - {"we", "like"} == n.counterfactuals({"they", "cats"}, 2)[0] - {"they"}  # other words do not change the partner
    assert n.counterfactuals(set(), 4) == []
    with pytest.raises(ValueError):
        toxicity.train(None, None, identity=())


def plain_lm(text, model, counts):
    """A document's summed log-probability, token by token."""
    ids, net, w = lm.Ids(model.words), lm.Network(model.weights), (text or "").lower().split()
    own, total = collections.Counter(w), 0.0
    cls = [int(ids.cls[ids[x]]) for x in w]
    at = [0, 0, *[int(ids.context[ids[x]]) for x in w], 0, 0]
    for k, x in enumerate(w):
        h = np.tanh(net.b + sum(t[at[k + 2 + d]] for t, d in zip(net.tables, (-2, -1, 1, 2))))
        z = (h @ net.o + net.c).astype(np.float64)
        of_class = z[cls[k]] - np.log(np.exp(z - z.max()).sum()) - z.max()
        rest = model.tokens[cls[k]] - cls.count(cls[k]) + lm.SMOOTH * model.kinds[cls[k]]
        total += of_class + np.log((counts[x] - own[x] + lm.SMOOTH) / rest)
    return total


@pytest.mark.parametrize("lexicon", [lm.LEXICON, 300, 0])
def test_lm_against_a_sum_over_tokens(spark, texts, monkeypatch, lexicon):
    """Words whose counts the tasks hold, and words whose counts come by the join."""
    monkeypatch.setattr(lm, "LEXICON", lexicon)
    df = spark.createDataFrame([*list(texts.items())[:80], (900, None), (901, "  "), (902, "one"), (903, "one")], "doc_id long, text string")
    by_id = {r["doc_id"]: r["text"] for r in df.collect()}
    counts = collections.Counter(w for t in by_id.values() for w in (t or "").lower().split())
    model, _, _ = lm.train(df)
    for r in lm.score(df).collect():
        w = (by_id[r["doc_id"]] or "").lower().split()
        own = collections.Counter(w)
        assert r["n_tokens"] == len(w) and r["n_unseen"] == sum(n for x, n in own.items() if counts[x] == n)
        assert abs(r["pll"] - plain_lm(by_id[r["doc_id"]], model, counts)) < 1e-3 * max(1, len(w))
        assert r["mean_pll"] == (r["pll"] / len(w) if w else None)


def test_lm_probabilities_of_all_words_sum_to_one(spark):
    """At one place of a text: over all words of the corpus, as they are in all other rows."""
    df = spark.createDataFrame([*enumerate(f"w{i}ab w{i * 7 % 300}cd w{i % 9}" for i in range(300))], "doc_id long, text string")
    model, table, _ = lm.train(df)
    counts = {r["word"]: r["n"] for r in table.collect()}
    ids, net = lm.Ids(model.words), lm.Network(model.weights)
    own, own_class = collections.Counter(["w5ab", "w3", "w3"]), collections.Counter(int(ids.cls[ids[x]]) for x in ["w5ab", "w3", "w3"])
    every = sorted(counts)
    of_class = net.log_p([np.full(len(every), 3), np.full(len(every), 9), np.full(len(every), 0), np.full(len(every), 0)], np.array([ids.cls[ids[w]] for w in every]))
    p = [np.exp(c) * (counts[w] - own[w] + lm.SMOOTH) / (model.tokens[k] - own_class[k] + lm.SMOOTH * model.kinds[k]) for w, c in zip(every, of_class) for k in [int(ids.cls[ids[w]])]]
    # The classes that hold no word have the rest.
    assert 0.95 < sum(p) < 1.0001


def test_lm_prefers_its_own_language_and_knows_repeats(spark):
    rng = random.Random(2)
    kinds = [["the", "old", "cat", "sat", "down"], ["a", "young", "dog", "ran", "off"]]
    good = [" ".join(rng.choice(kinds)[i % 5] for i in range(40)) for _ in range(300)]
    shuffled = [" ".join(rng.sample(t.split(), 40)) for t in good[:20]]
    twice = "some words of which none is anywhere else"
    df = spark.createDataFrame([*enumerate(good), *enumerate(shuffled, 900), (990, twice), (991, twice), (992, "and others that only this text holds")], "doc_id long, text string")
    r = {x["doc_id"]: x for x in lm.score(df).collect()}
    assert np.mean([r[i]["mean_pll"] for i in range(900, 920)]) < np.mean([r[i]["mean_pll"] for i in range(20)]) - 0.3
    assert r[990]["n_unseen"] == r[991]["n_unseen"] == 0 < r[992]["n_unseen"] and r[990]["mean_pll"] > r[992]["mean_pll"]


def test_lm_trains_by_shards(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 200)
    rng = random.Random(4)
    df = spark.createDataFrame([(i, " ".join(rng.choice(["x y z", "u v w"]) for _ in range(60))) for i in range(200)], "doc_id long, text string")
    model, _, _ = lm.train(df)
    ids, net = lm.Ids(model.words), lm.Network(model.weights)
    at = lambda *w: [np.array([ids.context[ids[x]]]) for x in w]
    assert net.log_p(at("z", "x", "z", "x"), np.array([ids.cls[ids["y"]]]))[0] > net.log_p(at("z", "x", "z", "x"), np.array([ids.cls[ids["v"]]]))[0] + 1


def test_lm_trains_on_every_window(spark, monkeypatch):
    """Each token of each text is a window of exactly one shard and round, with its own four neighbours."""
    monkeypatch.setattr(lm, "PIECE", 7)
    monkeypatch.setattr(lm, "SHARD", 40)
    rows = ["a b c d e f g h i j k l m n o p", "one", "a b c d e f g h", "a b c d e f g h", "  ", None]
    df = spark.createDataFrame([*enumerate(rows)], "doc_id long, text string")
    model, _, texts = lm.train(df)
    ids, got = lm.Ids(model.words), collections.Counter()
    for r in lm.pieces(texts, model.context).collect():
        c = np.frombuffer(r["piece"], np.uint16).tolist()
        got.update({tuple(c[k - 2 : k + 3]): 0 for k in range(2, len(c) - 2)})
        for k in range(2, len(c) - 2):
            got[tuple(c[k - 2 : k + 3])] += r["n"]
    want = collections.Counter()
    for t in rows:
        c = [0, 0, *[int(ids.context[ids[w]]) for w in (t or "").split()], 0, 0]
        want.update(tuple(c[k - 2 : k + 3]) for k in range(2, len(c) - 2))
    assert got == want and sum(got.values()) == 33
    trained, was = [], lm.train_shard
    monkeypatch.setattr(lm, "train_shard", lambda flat, near, at, n, cls, seed: trained.append(sum(n)) or was(flat, near, at, n, cls, seed))
    frame = lm.pieces(texts, model.context).toPandas()
    lm._trained(lm.initial(model.tokens), lm.classes(ids), 0)(frame)
    assert trained == [33]


def test_top_k_with_many_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(np.round(v, 1))], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in topk.search(df, F.col("vec_id") % 50 == 0, k=5, block=100, wave=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    x = np.floor(256 * np.round(v, 1)).astype(np.int64)
    for q in range(0, 900, 50):
        s = x @ x[q]
        want = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:5]
        assert got[q] == [(i, int(s[i])) for i in want]


def near_texts():
    """A text, a near copy of it and another text, of words of their own."""
    a = [f"k{i}" for i in range(100)]
    return " ".join(a), " ".join([*a[:99], "other"]), " ".join(f"z{i}" for i in range(100))


def test_near_duplicates_with_null_and_repeated_ids(spark):
    a, near_a, b = near_texts()
    c, near_c = (t.replace("k", "c") for t in (a, near_a))
    rows = [(None, a), (5, near_a), (7, b), (7, c), (9, near_c), (None, "alone " * 9), (None, b)]
    got = near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(f"Row(doc_id={i}, class_id={k})" for i, k in [(None, 5), (5, 5), (7, 7), (7, 7), (9, 7), (None, None), (None, 7)])


def test_top_k_asks_every_row_of_a_repeated_id(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = [(int(i), np.round(rng.normal(size=4), 1).tolist()) for i in [*range(60), 0, 50, 50, 7]]
    spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = queries.op9_topk(spark, str(tmp_path)).select("query_id", "rank", "score").collect()
    want = con.execute(f"SELECT query_id, rank, score FROM ({queries.oracle_sql()['op9_topk']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_stops_early_and_stays_exact():
    """Rows of which few can win: lists are not read to their ends, and the best are those of a full comparison."""
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 40, (3000, 6))
    x[:20] *= 50
    ids, q, own = np.arange(3000), x[[5, 100, 2000]], np.array([5, 100, 2000])
    best, order = topk.Best(3, 5), np.argsort(x, axis=0, kind="stable").astype(np.int32)
    scored = topk.scan_block(x, order, ids, q, own, best, np.arange(3))
    for j in range(3):
        s = x @ q[j]
        want = sorted((i for i in range(3000) if i != own[j]), key=lambda i: (-s[i], i))[:5]
        assert best.rows[j] == [(int(s[i]), -i) for i in want]
    assert scored < 3000


def test_long_texts_are_read_in_pieces(monkeypatch):
    rng = random.Random(5)
    texts = [" ".join(f"v{rng.randrange(50)}" for _ in range(500)), "x" * 5000 + " y", "", "\t one  two\n", "p q r s t u"]
    whole = near_dup.shingles(texts)
    monkeypatch.setattr(near_dup, "PIECE", 64)
    assert all((a == b).all() for a, b in zip(whole, near_dup.shingles(texts)))


def plain_bin(x):
    shift = max(x.bit_length() - 6, 0) if x else 0
    return x >> shift << shift


def test_quality_thresholds_against_a_plain_model(spark):
    rng = random.Random(6)
    rows = []
    for i in range(700):
        lang, source = rng.choice([("en", "a"), ("en", "b"), ("en", "b"), ("de", "a"), (None, None)])
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6 + 4 * (lang == "de")))) for _ in range(rng.randint(40, 120))]
        words += ["#%&!"] * (rng.random() < 0.1) * rng.randint(5, 60)
        rows.append((i, "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)), lang, source))
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)).collect()}
    ratios = {i: {k: (r[a] << 16) // max(r[b], 1) for k, (a, b, _, _) in quality.RATIOS.items()} for i, r in got.items()}

    def quantiles(ids, k):
        bins = sorted(plain_bin(ratios[i][k]) for i in ids)
        at = lambda num, den: next(b for j, b in enumerate(bins, 1) if j * den >= len(bins) * num)
        return at(1, 2), at(1, 4), at(3, 4)

    for k in {den for _, den, _, _ in quality.RATIOS.values()}:
        for i, r in got.items():
            ratios[i][k] = r[k]
    blend = lambda n, own, coarse: [(n * x + 200 * y) / (n + 200) for x, y in zip(own, coarse)]
    every = [r[0] for r in rows]
    kept = {}
    for group in {(r[2], r[3]) for r in rows}:
        mine, lang = [r[0] for r in rows if (r[2], r[3]) == group], [r[0] for r in rows if r[2] == group[0]]
        for i in mine:
            ok = not got[i]["base_failed"]
            of = lambda k: blend(len(mine), quantiles(mine, k), blend(len(lang), quantiles(lang, k), quantiles(every, k)))
            for k, (_, den, few, down) in quality.RATIOS.items():
                mid, q25, q75 = of(k)
                least = max(mid / 16, few * 65536 / max(of(den)[0], 1))
                ok &= ratios[i][k] <= int(np.floor(mid + 4 * max(q75 - mid, least)))
                if down:
                    ok &= ratios[i][k] >= int(np.ceil(mid - 4 * max(mid - q25, least)))
            kept[i] = ok
    assert {i: r["kept"] for i, r in got.items()} == kept and 20 < sum(not k for k in kept.values()) < 400


def test_quality_thresholds_follow_a_source(spark):
    """A source of code keeps its symbols, exclamation marks and long words, that of prose does not; longer documents have lower limits."""
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))

    def text(n, marks, length=5):
        w = [word(rng.randint(length - 2, length + 2)) for _ in range(n)]
        for _ in range(marks):
            w[rng.randrange(n)] += rng.choice("#$%&|<>") + "!"
        return " ".join(w)

    rows = [(i, text(120, rng.randint(10, 40), 7), "en", "code") for i in range(1500)]
    rows += [(i, text(120, 0), "en", "prose") for i in range(1500, 3000)]
    rows += [(i, text(1200, 0), "en", "books") for i in range(3000, 3400)]
    rows += [(9001, text(120, 30), "en", "prose"), (9002, text(120, 30, 7), "en", "code"), (9003, text(120, 2), "en", "prose"), (9004, text(1200, 3), "en", "books")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert (got[9001], got[9002], got[9003], got[9004]) == (False, True, True, True)
    assert sum(not got[i] for i in range(3400)) < 34
    rows = df.select("lang", "source", quality.features(F.col("text")).alias("f"))
    limits = quality.thresholds(quality.sketches(rows.select("lang", "source", *[c.alias(k) for k, c in quality.counts(F.col("f")).items()])))
    hi = {r["t_source"]: r.asDict() for r in limits.collect()}
    for k in ("symbols", "exclaims", "word_len"):
        assert hi["code"][f"hi_{k}"] > 1.2 * hi["prose"][f"hi_{k}"]
    assert hi["books"]["hi_repeats"] < hi["prose"]["hi_repeats"]


def test_language_against_plain_vectors(spark):
    """Trigrams one by one: bound by products of rolled letter vectors, bundled by sums, compared by cosine."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    protos, letters = language.prototypes(docs), language._space()[2].astype(np.float64)
    got = {r["doc_id"]: r for r in language.identify(docs).collect()}
    for r in docs.filter("length(text) < 2500").limit(25).collect():
        s = [0, *map(int, language.symbols(r["text"])), 0]
        v = sum((np.roll(letters[a], 2) * np.roll(letters[b], 1) * letters[c] for a, b, c in zip(s, s[1:], s[2:]) if b), np.zeros(language.DIM))
        if not v.any():
            continue
        cos = {k: float(p @ v / np.linalg.norm(v)) for k, p in protos.items()}
        assert got[r["doc_id"]]["lang_pred"] == max(cos, key=cos.get) and abs(got[r["doc_id"]]["score"] - (1 + max(cos.values())) / 2) < 1e-4


def test_licenses_against_a_search_of_the_whole_text():
    """Windows about exact seeds find what the notices' patterns find without windows."""
    rng = random.Random(7)
    notices = [c[1].decode().strip() for c in licenses._compiled()]
    for _ in range(400):
        w = list(rng.choice(notices))
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [rng.choice("abcxyz")], [w[k], rng.choice("abc")]])
        seen, _ = licenses.normal("some words before " + "".join(w) + " and after")
        want = {c[0] for c in licenses._compiled() if c[4].search(seen)}
        assert {x[0] for x in licenses.fuzzy(seen)} == want
