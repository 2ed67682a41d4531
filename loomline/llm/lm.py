"""LM scoring by masked pseudo-likelihood.

A bidirectional window network predicts every token from two tokens on either side: embeddings
of the four neighbours, a tanh layer, a softmax over classes of words. Within its class a word
has its share of the class's words in all other rows, so every word of any corpus has a
probability of its own, and no row votes for itself. A document's score is the sum of its
tokens' conditional log-probabilities.

Words are counted exactly over all documents, a table that grows with them. The ``CONTEXT`` most
frequent ones are neighbours by themselves, all others by a class of their last letters. The
network trains in numpy on the window of every token of every document, once. Texts are cut into
pieces of ``PIECE`` tokens with the two on either side; equal pieces are counted, and dealt by hash
to shards of about ``SHARD`` windows. Every shard trains from the same weights, their mean is what
the next round starts from. Neither counts, pieces nor shards depend on how files or partitions are
laid out, so a score does not either, to rounding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.llm.common import arrow_rows, discard, frequent, materialise, read_rows

#: Most frequent words that are classes by themselves, and classes of all other words.
OWN, SUFFIX = 128, 96
CLASSES = OWN + SUFFIX
#: Neighbours are 12 bits: the end mark, as many words, and the classes of the others.
CONTEXT = 4095 - SUFFIX
#: Windows of a piece of a text at most: what is dealt to shards and rounds.
PIECE = 512
#: Windows of a shard, about, and how often the shards' weights are averaged.
SHARD, ROUNDS = 4_000_000, 3
#: Logits up to this bound need no scaling before their exponential in single precision.
SAFE = 60.0
#: Windows whose logits are held at once: they stay in a core's cache.
STEP = 512
#: The tasks get the counts of at most as many words; those of all others come by a join.
LEXICON = 250_000
#: Tokens of a block of texts, about; a longer text is a block.
BLOCK = 500_000
#: Texts of a block at most, texts that a task gets at once, and blocks that are read at once.
TEXTS, TAKEN, READ = 10_000, 500, 2
#: Added to every word's count, also to those of words that no other row holds.
SMOOTH = 0.1
WIDTH, HIDDEN = 24, 32


def split(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _row(*columns: pa.Array | bytes) -> list[pa.Array]:
    """Columns of one row: an array is one list."""
    return [pa.array([c], pa.binary()) if isinstance(c, bytes) else pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]


def _block(doc_ids: pa.Array, tokens: list[str], sizes: list[int]) -> pa.RecordBatch:
    coded = pa.array(tokens, pa.string()).dictionary_encode()
    ids = coded.indices.to_numpy()
    n = np.bincount(ids, minlength=len(coded.dictionary)).astype(np.int32)
    words = pa.StructArray.from_arrays([coded.dictionary, pa.array(n)], ["word", "n"])
    return pa.RecordBatch.from_arrays(_row(doc_ids, pa.array(sizes, pa.int32()), words, ids.tobytes()), ["doc_ids", "sizes", "words", "ids"])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, tokens, sizes = [], [], []
    for b in batches:
        at = 0
        for k, text in enumerate(b.column(1), 1):
            found = split(text.as_py())
            tokens += found
            sizes.append(len(found))
            if len(tokens) >= BLOCK or len(sizes) >= TEXTS:
                yield _block(pa.concat_arrays([*held, b.column(0).slice(at, k - at)]), tokens, sizes)
                held, tokens, sizes, at = [], [], [], k
        if at < b.num_rows:
            # Taken out of its batch, whose texts would stay with it.
            held.append(b.column(0).slice(at).take(pa.array(range(b.num_rows - at))))
    if sizes:
        yield _block(pa.concat_arrays(held), tokens, sizes)


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_ids, sizes, words, ids): texts of about ``BLOCK`` tokens a row, with their distinct words, the counts of these and every token's place among them."""
    schema = T.StructType([
        T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)),
        T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("words", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("n", T.IntegerType())]))),
        T.StructField("ids", T.BinaryType()),
    ])
    return docs.select("doc_id", "text").mapInArrow(_blocks, schema)


def word_counts(found: DataFrame) -> DataFrame:
    """(word, n) of every lower-case word of all :func:`blocks`."""
    return found.select(F.inline("words")).groupBy("word").agg(F.sum("n").alias("n"))


def _suffix(word: str) -> int:
    return zlib.crc32(word[-2:].encode("utf-8", "surrogatepass")) % SUFFIX


class Ids(dict):
    """Word -> its place by frequency; a word outside the lexicon gets ``-1 - class of its last letters``, which is not stored."""

    def __init__(self, words: list[str]):
        super().__init__((w, i) for i, w in enumerate(words))
        known = {e: _suffix(e) for e in {w[-2:] for w in words}}
        at, ends = np.arange(len(words)), np.array([known[w[-2:]] for w in words], np.int64)
        # Indexed by place, and from the end by the classes of other words.
        tail = np.arange(SUFFIX - 1, -1, -1)
        self.context = 1 + np.concatenate([np.where(at < CONTEXT, at, CONTEXT + ends), CONTEXT + tail])
        self.cls = np.concatenate([np.where(at < OWN, at, OWN + ends), OWN + tail])
        self.ends: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        end = word[-2:]
        found = self.ends.get(end)
        if found is None:
            if len(self.ends) > 100_000:
                self.ends.clear()
            found = self.ends[end] = -1 - _suffix(word)
        return found

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def _coded(words: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Ids(words)
        for b in batches:
            for k in range(b.num_rows):
                doc_ids, sizes, own, ids = (c.slice(k, 1) for c in b.columns)
                own, size, local = own.flatten().field(0), sizes.flatten().to_numpy(), np.frombuffer(ids[0].as_py(), np.int32)
                at = places.of(own.to_numpy(zero_copy_only=False).tolist()).astype(np.int32)[local]
                ends = np.concatenate([[0], np.cumsum(size)])
                rare = np.flatnonzero(at < 0)
                # A text's words outside the lexicon, each once, with their counts.
                key, n = np.unique((np.searchsorted(ends, rare, "right") - 1) * len(own) + local[rare], return_counts=True)
                lists = pa.array(np.searchsorted(key, np.arange(len(size) + 1) * len(own)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids.flatten(),
                        pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(at)]),
                        pa.ListArray.from_arrays(lists, own.take(pa.array(key % max(len(own), 1)))),
                        pa.ListArray.from_arrays(lists, pa.array(n.astype(np.int32))),
                    ],
                    ["doc_id", "ids", "words", "ns"],
                )

    return run


def coded(found: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, row, ids, words, ns) of every row of all :func:`blocks` as a written table: its tokens' places, and its words outside the lexicon."""
    schema = T.StructType([
        T.StructField("doc_id", found.schema["doc_ids"].dataType.elementType),
        T.StructField("ids", T.BinaryType()),
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("ns", T.ArrayType(T.IntegerType())),
    ])
    with arrow_rows(found.sparkSession, 1), read_rows(found.sparkSession, READ):
        rows = found.mapInArrow(_coded(words), schema)
        return materialise(rows.select("doc_id", F.monotonically_increasing_id().alias("row"), "ids", "words", "ns"), "coded")


def places(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, np.int32)


def _pieces(context: np.ndarray):
    def run(batches):
        for b in batches:
            out = []
            for raw in b["ids"]:
                at = places(raw)
                c = np.zeros(len(at) + 4, np.uint16)
                c[2:-2] = context[at]
                out += [c[k : k + PIECE + 4].tobytes() for k in range(0, len(at), PIECE)]
            yield pd.DataFrame({"piece": out})

    return run


def pieces(texts: DataFrame, context: np.ndarray) -> DataFrame:
    """(piece, n): all windows of every :func:`coded` text as runs of neighbours, two more on either side; equal ones are counted."""
    return texts.select("ids").mapInPandas(_pieces(context), "piece binary").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def classes(ids: Ids) -> np.ndarray:
    """The class of each neighbour; a neighbour has one."""
    out = np.zeros(4096, np.int64)
    out[ids.context] = ids.cls
    return out


_SHAPES = {"e": (4096, WIDTH), "w": (4 * WIDTH, HIDDEN), "b": (HIDDEN,), "o": (HIDDEN, CLASSES), "c": (CLASSES,)}


def _parts(flat: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in _SHAPES.items():
        out[k] = flat[at : at + int(np.prod(s))].reshape(s)
        at += int(np.prod(s))
    return out


def initial(totals: np.ndarray, seed: int = 5) -> np.ndarray:
    """Weights that predict the classes' shares of the corpus (``totals``) whatever the neighbours."""
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.2, s).ravel() if len(s) > 1 else np.zeros(s) for k, s in _SHAPES.items()}
    p["c"] = np.log((totals + 1) / (totals.sum() + CLASSES))
    return np.concatenate(list(p.values()))


def _bounded(o: np.ndarray, c: np.ndarray) -> bool:
    return max(np.abs(o).sum(axis=0).max(), np.abs(c).max()) < SAFE


def train_shard(flat: np.ndarray, near: np.ndarray, at: np.ndarray, n: np.ndarray, cls: np.ndarray, seed: int, batch: int = 4096, rate: float = 0.1) -> np.ndarray:
    """The weights after one pass over the windows at the places ``at`` of ``near``, ``n`` times each, in a seeded order; Adagrad.

    A batch's gradient is summed over steps of ``STEP`` windows, whose arrays are used again and stay in a core's cache.
    """
    order = np.random.default_rng(seed).permutation(len(at))
    p = {k: np.ascontiguousarray(v, np.float32) for k, v in _parts(flat).items()}
    sums = {k: np.full(v.shape, 1e-6, np.float32) for k, v in p.items()}
    g = {k: np.zeros_like(v) for k, v in p.items()}
    windows = np.lib.stride_tricks.sliding_window_view(near, 5) if len(near) > 4 else None
    # Two numbers of an embedding are added at once, as one complex number.
    pairs, cells = g["e"].reshape(-1).view(np.complex64), np.arange(p["e"].size // 2).reshape(-1, WIDTH // 2)
    logits, ones = np.empty((STEP, CLASSES), np.float32), np.ones(STEP, np.float32)
    for k in range(0, len(at), batch):
        own = order[k : k + batch]
        found, share = windows[at[own] - 2], n[own] / n[own].sum()
        near4, y = found[:, [0, 1, 3, 4]].astype(np.int64), cls[found[:, 2]]
        bounded, q = _bounded(p["o"], p["c"]), np.exp(p["c"])
        if not bounded:
            q = np.ones_like(q)
        back = (p["o"] * q).T
        for v in g.values():
            v.fill(0)
        for s in range(0, len(own), STEP):
            ids, to = near4[s : s + STEP].ravel(), y[s : s + STEP]
            m = len(to)
            x = p["e"].take(ids, axis=0).reshape(m, -1)
            h = x @ p["w"]
            h += p["b"]
            np.tanh(h, out=h)
            z = np.matmul(h, p["o"], out=logits[:m])
            if not bounded:
                z += p["c"]
                z -= z.max(axis=1, keepdims=True)
            # A class's probability is z * q / total; what follows is the gradient without the factors q and scale, which come in where arrays are small.
            np.exp(z, out=z)
            total = z @ q
            z[np.arange(m), to] -= total / q[to]
            scale = share[s : s + STEP] / total
            a = z @ back
            a *= scale[:, None]
            a *= 1 - h * h
            h *= scale[:, None]
            g["w"] += x.T @ a
            g["b"] += ones[:m] @ a
            g["o"] += (z.T @ h).T
            g["c"] += scale @ z
            np.add.at(pairs, cells.take(ids, axis=0).ravel(), (a @ p["w"].T).reshape(-1).view(np.complex64))
        g["o"] *= q
        g["c"] *= q
        for name, v in g.items():
            sums[name] += v * v
            v *= rate
            v /= np.sqrt(sums[name])
            p[name] -= v
    return np.concatenate([v.ravel() for v in p.values()]).astype(np.float64)


def _trained(flat: np.ndarray, cls: np.ndarray, seed: int):
    """Weights as whole numbers, whose sum over shards does not depend on their order."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        each = sorted(zip(frame["piece"], frame["n"]))
        near = np.frombuffer(b"".join(p for p, _ in each), np.uint16)
        size = np.array([len(p) // 2 for p, _ in each])
        at = np.arange(len(near))
        k = at - np.repeat(np.cumsum(size) - size, size)
        at = at[(k >= 2) & (k < np.repeat(size, size) - 2)]
        n = np.repeat(np.array([m for _, m in each], np.float32), size - 4)
        w = train_shard(flat, near, at, n, cls, seed)
        return pd.DataFrame({"pos": np.arange(len(w), dtype=np.int32), "v": np.round(w * 2.0**32).astype(np.int64), "one": 1})

    return run


def fit(found: DataFrame, flat: np.ndarray, cls: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """The weights after ``rounds`` rounds, each over its part of the :func:`pieces` of every shard."""
    n = found.agg(F.sum(F.octet_length("piece") / 2 - 4)).first()[0]
    if not n:
        return flat
    shards = -(-int(n) // SHARD)
    dealt = found.select("piece", "n", F.pmod(F.xxhash64("piece"), F.lit(shards)).cast("int").alias("shard"), F.pmod(F.xxhash64("piece", F.lit(1)), F.lit(rounds)).cast("int").alias("turn"))
    for k in range(rounds):
        each = dealt.filter(F.col("turn") == k).groupBy("shard").applyInPandas(_trained(flat, cls, k), "pos int, v long, one int")
        got = each.groupBy("pos").agg(F.sum("v").alias("v"), F.sum("one").alias("m")).toArrow()
        if got.num_rows:
            flat = np.zeros_like(flat)
            flat[got.column("pos").to_numpy()] = got.column("v").to_numpy() / 2.0**32 / got.column("m").to_numpy()
    return flat


class Network:
    """log P(class | neighbours) of given weights."""

    def __init__(self, flat: np.ndarray):
        p = {k: v.astype(np.float32) for k, v in _parts(flat).items()}
        self.tables = [p["e"] @ p["w"][k * WIDTH : (k + 1) * WIDTH] for k in range(4)]
        self.b, self.o, self.c = p["b"], p["o"], p["c"]

    def log_p(self, ids: list[np.ndarray], y: np.ndarray) -> np.ndarray:
        out, bounded, q = np.empty(len(y), np.float64), _bounded(self.o, self.c), np.exp(self.c)
        logits = np.empty((STEP, CLASSES), np.float32)
        for at in range(0, len(y), STEP):
            cut = slice(at, at + STEP)
            h = self.tables[0].take(ids[0][cut], axis=0)
            h += self.b
            for t, i in zip(self.tables[1:], ids[1:]):
                h += t.take(i[cut], axis=0)
            z = np.matmul(np.tanh(h, out=h), self.o, out=logits[: len(h)])
            if not bounded:
                z += self.c
                z -= z.max(axis=1, keepdims=True)
            own = z[np.arange(len(h)), y[cut]]
            np.exp(z, out=z)
            out[cut] = own + self.c[y[cut]] - np.log(z @ q) if bounded else own - np.log(z.sum(axis=1))
        return out


@dataclass
class Model:
    """Words by frequency with their counts, neighbour and class by place, the network's weights, and each class's tokens and distinct words."""

    words: list[str]
    counts: np.ndarray
    context: np.ndarray
    cls: np.ndarray
    weights: np.ndarray
    tokens: np.ndarray
    kinds: np.ndarray


def train(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """A model of all texts, the table (word, n) of all of their words, and the :func:`coded` texts."""
    spark = docs.sparkSession
    with arrow_rows(spark, TAKEN):
        found = materialise(blocks(docs), "blocks")
    with read_rows(spark, READ):
        counts = materialise(word_counts(found), "words", dealt=True)
    known = sorted(((-r["n"], r["word"]) for r in frequent(counts, LEXICON).collect()))
    words = [w for _, w in known]
    ids, texts = Ids(words), coded(found, words)
    discard(found)
    ending = OWN + F.pmod(F.crc32(F.right("word", F.lit(2)).cast("binary")), F.lit(SUFFIX)).cast("int")
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in counts.groupBy(ending.alias("cls")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():
        tokens[r["cls"]], kinds[r["cls"]] = r["n"], r["kinds"]
    for i, (n, w) in enumerate(known[:OWN]):  # these left the class of their ending
        tokens[i], kinds[i] = -n, 1
        tokens[OWN + _suffix(w)] += n
        kinds[OWN + _suffix(w)] -= 1
    windows = materialise(pieces(texts, ids.context), "windows", dealt=True)
    weights = fit(windows, initial(tokens), classes(ids))
    discard(windows)
    model = Model(words, np.array([-n for n, _ in known], np.float64), ids.context, ids.cls, weights, tokens, kinds)
    return model, counts, texts


def log_likelihood(ids: Column, model: Model) -> Column:
    """struct<pll, n_unseen> of the places of a text's tokens, without the counts of its words outside the lexicon."""
    n, context, cls, count, weights, total = len(model.words), model.context, model.cls, model.counts, model.weights, model.tokens + SMOOTH * model.kinds

    @F.pandas_udf("pll double, n_unseen long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = Network(weights)
        for s in batches:
            out = [np.zeros((0, 2))]
            for part in np.array_split(np.arange(len(s)), max(1, s.str.len().sum() // 400_000)):
                each = [places(x) for x in s.iloc[part]]
                at, doc = np.concatenate([np.zeros(0, np.int32), *each]), np.repeat(np.arange(len(part)), [len(a) for a in each])
                place = np.arange(len(at)) + 2 + 4 * doc  # two end marks on either side of a text
                c = np.zeros(len(at) + 4 * len(part), np.int64)
                c[place] = context[at]
                y = cls[at]
                pll = np.bincount(doc, net.log_p([c[place + k] for k in (-2, -1, 1, 2)], y), len(part)).astype(np.float64)  # whole numbers where no text has a token
                # Less the classes' tokens in other rows, plus the words' own.
                m = np.bincount(doc * CLASSES + y, minlength=len(part) * CLASSES).reshape(-1, CLASSES)
                pll -= (m * np.log(np.maximum(total - m, SMOOTH / 2))).sum(axis=1)
                key, m = np.unique(doc[at >= 0] * n + at[at >= 0], return_counts=True)
                others = count[key % max(n, 1)] - m if len(key) else np.zeros(0)
                pll += np.bincount(key // max(n, 1), m * np.log(others + SMOOTH), len(part))
                out.append(np.stack([pll, np.bincount(key // max(n, 1), m * (others == 0), len(part))], axis=1))
            both = np.concatenate(out)
            yield pd.DataFrame({"pll": both[:, 0], "n_unseen": both[:, 1].astype(np.int64)})

    return of(ids)


def score(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, pll, mean_pll, n_unseen) of every row, scored by a model of all of them.

    ``n_unseen`` counts the tokens whose word no other row holds. Null and empty texts have no
    tokens, pll 0 and a null mean. A very long text is one document like others. Rows that repeat
    a text count and are scored each, as other rows of one another; doc_ids may be null or
    repeat; an empty table gives none; other columns are ignored.
    """
    model, counts, texts = train(docs)
    rest = texts.select("row", F.explode(F.arrays_zip("words", "ns")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.ns").alias("m"))
    # Whole numbers, whose sum does not depend on the order.
    logs = F.round(F.col("m") * F.log(F.col("n") - F.col("m") + SMOOTH) * 2.0**32).cast("long")
    more = rest.join(counts, "word").groupBy("row").agg(F.sum(logs).alias("more"), F.sum(F.when(F.col("n") == F.col("m"), F.col("m")).otherwise(0)).alias("alone"))
    scored = texts.select("doc_id", "row", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), log_likelihood(F.col("ids"), model).alias("s"))
    out = scored.join(more, "row", "left")
    out = out.select("doc_id", "n_tokens", (F.col("s.pll") + F.coalesce("more", F.lit(0)) / 2.0**32).alias("pll"), (F.col("s.n_unseen") + F.coalesce("alone", F.lit(0))).alias("n_unseen"))
    return out.withColumn("mean_pll", F.when(F.col("n_tokens") > 0, F.col("pll") / F.col("n_tokens"))).select("doc_id", "n_tokens", "pll", "mean_pll", "n_unseen")
