"""Words are coded once, in blocks; the training step's memory and result."""

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa

from loomline.llm import lm


def shard(n, seed=0):
    rng = np.random.default_rng(seed)
    near = np.minimum(rng.zipf(1.3, n + 4), 4095).astype(np.uint16)
    return near, np.arange(2, n + 2), rng.integers(1, 4, n).astype(np.float32), rng.integers(0, lm.CLASSES, 4096)


def plain_steps(flat, near, at, n, cls, seed, batch, rate=0.1):
    """Batches of gradients in double precision, as the formula has them."""
    order, p = np.random.default_rng(seed).permutation(len(at)), {k: v.copy() for k, v in lm._parts(flat.copy()).items()}
    sums = {k: np.full(v.shape, 1e-6) for k, v in p.items()}
    for k in range(0, len(at), batch):
        own = order[k : k + batch]
        ids, y = near[at[own][:, None] + (-2, -1, 1, 2)].astype(int), cls[near[at[own]]]
        x = p["e"][ids].reshape(len(own), -1)
        h = np.tanh(x @ p["w"] + p["b"])
        z = np.exp(h @ p["o"] + p["c"])
        d = z / z.sum(axis=1, keepdims=True)
        d[np.arange(len(own)), y] -= 1
        d *= (n[own] / n[own].sum())[:, None]
        a = (d @ p["o"].T) * (1 - h * h)
        e = np.zeros_like(p["e"])
        np.add.at(e, ids, (a @ p["w"].T).reshape(len(own), 4, -1))
        for name, v in {"e": e, "w": x.T @ a, "b": a.sum(axis=0), "o": h.T @ d, "c": d.sum(axis=0)}.items():
            sums[name] += v * v
            p[name] -= rate * v / np.sqrt(sums[name])
    return np.concatenate([v.ravel() for v in p.values()])


def test_training_equals_its_formula():
    near, at, n, cls = shard(3000)
    flat = lm.initial(np.bincount(cls[near], minlength=lm.CLASSES))
    got = lm.train_shard(flat, near, at, n, cls, 3, batch=1100)
    assert np.abs(got - plain_steps(flat, near, at, n, cls, 3, 1100)).max() < 2e-3 and np.abs(got - flat).max() > 0.1


def test_a_batch_is_not_held_at_once():
    """The logits of a batch alone are 3.7 MB, the cells of its embeddings 3.1 MB more."""
    near, at, n, cls = shard(4096)
    flat = lm.initial(np.ones(lm.CLASSES))
    lm.train_shard(flat, near, at, n, cls, 0)
    tracemalloc.start()
    lm.train_shard(flat, near, at, n, cls, 0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 7_000_000


def test_each_text_is_split_once(spark, monkeypatch):
    """Counts and places come from blocks, which alone see a text, whatever the texts' sizes."""
    monkeypatch.setattr(lm, "BLOCK", 5)
    texts = ["a b a", None, "", "c İx a b c d e f g h i", "   ", "a", "ΑΣ z"]
    seen, was = [], lm.split
    monkeypatch.setattr(lm, "split", lambda text: seen.append(text) or was(text))
    batch = pa.RecordBatch.from_arrays([pa.array([None, 2**60 + 1, 1, 1, 5, 6, 7]), pa.array(texts)], ["doc_id", "text"])
    found = list(lm._blocks(iter([batch])))
    assert seen == texts and len(found) == 2
    counts = Counter()
    for b in found:
        counts.update({w["word"]: 0 for w in b["words"][0].as_py()})
        for w in b["words"][0].as_py():
            counts[w["word"]] += w["n"]
    assert counts == Counter(w for t in texts for w in was(t))
    words = ["a", "b"]
    rows = [r for b in lm._coded(words)(iter(found)) for r in b.to_pylist()]
    assert seen == texts and [r["doc_id"] for r in rows] == [None, 2**60 + 1, 1, 1, 5, 6, 7]
    for r, t in zip(rows, texts):
        assert lm.places(r["ids"]).tolist() == [lm.Ids(words)[w] for w in was(t)]
        assert dict(zip(r["words"], r["ns"])) == Counter(w for w in was(t) if w not in words)


def test_doc_ids_of_any_type(spark):
    df = spark.createDataFrame([("x", "some words here"), (None, "some words"), ("y", None)], "doc_id string, text string")
    assert sorted((r["doc_id"] or "", r["n_tokens"], r["n_unseen"]) for r in lm.score(df).collect()) == [("", 2, 0), ("x", 3, 1), ("y", 0, 0)]


def test_blocks_do_not_depend_on_batches(monkeypatch):
    """Texts come in small batches; a block goes on over them and ends by its tokens or texts alone."""
    monkeypatch.setattr(lm, "BLOCK", 40)
    monkeypatch.setattr(lm, "TEXTS", 30)
    texts = [*(" ".join(f"w{k % 7}" for _ in range(k % 9)) or None for k in range(200)), *[""] * 100]
    rows = pa.RecordBatch.from_arrays([pa.array([*range(299), None]), pa.array(texts)], ["doc_id", "text"])
    each = [[b.to_pylist() for b in lm._blocks(rows.slice(k, n) for k in range(0, 300, n))] for n in (300, 7, 1)]
    assert each[0] == each[1] == each[2]
    sizes = [b[0]["sizes"] for b in each[0]]
    assert sum(map(len, sizes)) == 300 and max(map(len, sizes)) == 30 and max(map(sum, sizes)) < 49 and min(map(sum, sizes[:15])) >= 40
    assert [d for b in each[0] for d in b[0]["doc_ids"]] == [*range(299), None] and list(lm._blocks(iter([]))) == []


def test_few_texts_and_blocks_are_held_at_once(spark, monkeypatch):
    """A block is megabytes: with 4,096 of them a whole file is in an executor's memory."""
    seen, was = {}, lm.materialise
    get = lambda: tuple(int(spark.conf.get(k)) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize"))
    monkeypatch.setattr(lm, "materialise", lambda df, name, **more: seen.setdefault(name, get()) and was(df, name, **more))
    before = get()
    assert lm.score(spark.createDataFrame([(1, "a b c"), (2, "b c d")], "doc_id long, text string")).count() == 2
    assert seen["blocks"][0] <= 500 and seen["words"][1] <= 4 and seen["coded"][0] == 1 and seen["coded"][1] <= 4 and get() == before
