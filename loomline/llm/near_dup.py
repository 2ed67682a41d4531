"""MinHash near-duplicates of multisets: BagMinHash signatures, banding, exact verification.

A document is the multiset of its five-word shingles. A shingle of count w owns the levels 0 to
w; they are split into dyadic blocks [0,1) [1,2) [2,4) [4,8) ..., each with a Poisson process of
its size as rate, and of the block that w ends in only the points below w are kept. Every point
has a slot; a slot's value is its earliest point, so two documents agree in a slot with
probability equal to their weighted Jaccard similarity. Only points before a time by which all
slots are full are made: about one per shingle and m ln m a document, not m per shingle.

Exact copies are one node, named by a hash of their text; ids only name the classes. Nodes meet
in buckets of bands. Every node is compared with its bucket's most central node (that with the
largest buckets altogether), which connects a group of copies without a square of pairs. Nodes of one bucket that are still in different components are
then all compared where blocks of bounded size meet, so that nothing that shares a band is lost
to the short cut; such pairs never are rows. Pairs pass an estimate by signatures, then the exact
weighted Jaccard of the texts. Classes are the connected components of what is left.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import arrow_rows, discard, groups, if_small, materialise, passing

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
SLOTS = BANDS * ROWS
#: About as many nodes of a bucket are compared with as many others at a time.
BLOCK = 128
#: Bytes of the texts of a block, about; two blocks and the largest of their texts are in memory at once.
BLOCK_BYTES = 8_000_000
#: Pairs whose signatures agree in fewer slots are below the threshold by more than 4.5 standard errors.
ESTIMATE = THRESHOLD - 4.5 * (THRESHOLD * (1 - THRESHOLD) / SLOTS) ** 0.5

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)


def _inverse(x: int) -> int:
    return pow(x, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def salt(k: int) -> np.uint64:
    """The k-th multiple of the base."""
    return _U(k * int(_BASE) % (1 << 64))


def factor(k: int) -> np.uint64:
    return mix(np.array([salt(k)]))[0]


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANK = re.compile(rb"[\t-\r ]")
PIECE = 1 << 20


def _short(word: np.ndarray) -> np.uint64:
    """The shingle of a text of fewer than five words."""
    total = (word * mix(np.arange(1, len(word) + 1).astype(np.uint64) * _BASE)).sum(keepdims=True)
    return mix(total + _U(len(word)))[0]


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The start and the hash of each word of ``data``, which ends with a blank."""
    b = np.frombuffer(data, np.uint8)
    blank = _SPACE[b]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    if not len(starts):
        return starts, np.zeros(0, np.uint64)
    # A word's hash: the difference of a running polynomial at its ends, brought back to its start.
    power = np.full(len(b), _BASE, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[b] * power)])
    back = np.full(len(b), _inverse(int(_BASE)), np.uint64)
    back[0] = 1
    np.cumprod(back, out=back)
    return starts, mix((run[ends] - run[starts]) * back[starts])


def _all_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_words` of pieces of about ``PIECE`` bytes, so that a long text takes memory by its words and not by its bytes."""
    found, at = [], 0
    while at < len(data):
        cut = _BLANK.search(data, min(at + PIECE, len(data) - 1))
        end = cut.end() if cut else len(data)
        starts, word = _words(data[at:end])
        found.append((starts + at, word))
        at = end
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def shingles(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle, count) of all documents, by document.

    A text of fewer than five words has one shingle, of all its words; one without words none.
    """
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    ends_of = np.cumsum([len(r) + 1 for r in raw])
    starts, word = _all_words(b" ".join(raw) + b" ")
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    doc = np.searchsorted(ends_of, starts, side="right")
    n = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(n) - n
    value = np.zeros(len(word), np.uint64)
    for k in range(SHINGLE):
        value[: len(word) - k] += word[k:] * factor(k + 1)
    whole = np.arange(len(word)) - first[doc] <= n[doc] - SHINGLE
    short = np.flatnonzero((n > 0) & (n < SHINGLE))
    extra = [(d, _short(word[first[d] : first[d] + n[d]])) for d in short]
    doc = np.concatenate([doc[whole], np.array([d for d, _ in extra], np.int64)])
    value = np.concatenate([mix(value[whole]), np.array([v for _, v in extra], np.uint64)])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])])
    at = np.flatnonzero(new)
    return doc[at], value[at], np.diff(np.concatenate([at, [len(doc)]]))


def signatures(n_docs: int, doc: np.ndarray, shingle: np.ndarray, count: np.ndarray) -> np.ndarray:
    """uint64[n_docs, SLOTS]: the identity of each slot's earliest point; 0 where a document has no shingle."""
    best = np.full(n_docs * SLOTS, np.inf)
    ident = np.zeros(n_docs * SLOTS, np.uint64)
    # Dyadic blocks: number j covers the levels from 2^(j-1) to 2^j, number 0 the first.
    d, s, w, j = [doc], [shingle], [count], [np.zeros(len(doc), np.int64)]
    block, left = 1, count > 1
    while left.any():
        d.append(doc[left]), s.append(shingle[left]), w.append(count[left]), j.append(np.full(int(left.sum()), block))
        left = count > (1 << block)
        block += 1
    d, s, w, j = map(np.concatenate, (d, s, w, j))
    size = np.where(j > 0, 2.0 ** np.maximum(j - 1, 0), 1.0)
    start = np.where(j > 0, size, 0.0)
    seed = mix(s + mix(j.astype(np.uint64) + _U(77)))
    total = np.bincount(doc, count, n_docs)
    until = SLOTS * (np.log(SLOTS) + 6) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        live = np.flatnonzero(todo[d])
        t, k = np.zeros(len(live)), 0
        while len(live):
            k += 1
            r = mix(seed[live] + salt(k))
            t = t - np.log(((r >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / size[live]
            on = t < until[d[live]]
            live, t, r = live[on], t[on], r[on]
            if not len(live):
                break
            r2 = mix(r ^ _U(0xA5A5A5A5A5A5A5A5))
            level = start[live] + size[live] * ((r2 >> _U(40)).astype(np.float64) * 2.0**-24)
            ok = level < w[live]
            slot = d[live[ok]] * SLOTS + (r2[ok] & _U(0xFFFFFF)).astype(np.int64) % SLOTS
            np.minimum.at(best, slot, t[ok])
            won = best[slot] == t[ok]
            ident[slot[won]] = mix(r[ok][won] + _U(1))
        todo = (total > 0) & np.isinf(best.reshape(n_docs, SLOTS)).any(axis=1)
        until = until * 2
    return ident.reshape(n_docs, SLOTS)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64[n, BANDS]."""
    parts = sig.reshape(len(sig), BANDS, ROWS) * mix(np.arange(1, ROWS + 1).astype(np.uint64) * _BASE)
    return mix(parts.sum(axis=2, dtype=np.uint64) + np.arange(BANDS).astype(np.uint64) * _BASE).astype(np.int64)


def _signed(text: Column) -> Column:
    """struct<keys, sig> of a text column, null where it has no words; sig has a byte a slot."""

    @F.pandas_udf("keys array<long>, sig binary")
    def of(s: pd.Series) -> pd.DataFrame:
        keys, sigs = [], []
        for texts in groups(s, 400_000):
            doc, value, count = shingles(texts)
            has = np.bincount(doc, minlength=len(texts)) > 0
            sig = signatures(len(texts), doc, value, count)
            low = (sig & _U(255)).astype(np.uint8)
            for h, b, l in zip(has, band_keys(sig), low):
                keys.append(b if h else None)
                sigs.append(l.tobytes() if h else None)
        return pd.DataFrame({"keys": keys, "sig": sigs})

    return of(text)


def similarity(a: tuple, b: tuple) -> float:
    """Weighted Jaccard of two (sorted shingles, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    every = a[1].sum() + b[1].sum() - both
    return float(both / every) if every else 1.0


def jaccard(left: Column, right: Column) -> Column:
    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        out, texts, size = [], [], 0
        for k, (p, q) in enumerate(zip(x, y), 1):
            texts += [p, q]
            size += len(p) + len(q)
            if size > 1_000_000 or k == len(x):
                doc, value, count = shingles(texts)
                at = np.searchsorted(doc, np.arange(len(texts) + 1))
                each = [(value[i:j], count[i:j]) for i, j in zip(at, at[1:])]
                out += [similarity(*z) for z in zip(each[::2], each[1::2])]
                texts, size = [], 0
        return pd.Series(out, dtype="float64")

    return of(left, right)


def agreement(left: Column, right: Column) -> Column:
    """The share of slots in which two signatures agree."""

    @F.pandas_udf("double")
    def of(x: pd.Series, y: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype="float64")
        a = np.frombuffer(b"".join(x), np.uint8).reshape(-1, SLOTS)
        b = np.frombuffer(b"".join(y), np.uint8).reshape(-1, SLOTS)
        return pd.Series((a == b).mean(axis=1))

    return of(left, right)


def _node(text: Column) -> Column:
    """The node of a text: 64 bits of its hash; null counts as the empty text."""
    return F.xxhash64(F.md5(F.coalesce(text, F.lit(""))))


def _buckets(keys: DataFrame, n: int) -> DataFrame:
    """(key, node, n) of the keys that two nodes or more share; ``n`` bounds the rows.

    The counts are a table of their own here, as are the leaders and the labels below: a join of
    two plain shuffles can be split where one key holds a large part of all rows, a join with an
    aggregate of the same shuffle cannot.
    """
    shared = materialise(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "shared", rows=n)
    return keys.join(shared, "key")


def _star(rows: DataFrame, n: int) -> DataFrame:
    """Pairs of each bucket's leader, the node of the largest weight, and its other nodes."""
    led = rows.groupBy("key").agg(F.max(F.struct("weight", "node")).alias("l")).select(F.col("key").alias("k"), F.col("l.node").alias("other"))
    led = materialise(led, "led", rows=n)
    both = rows.join(led, (F.col("key") == F.col("k")) & (F.col("node") != F.col("other")))
    return both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _blocks(rows: DataFrame, n: int) -> DataFrame:
    """(key, i, j, node, label, side) of rows (key, node, size, label): every pair of blocks of a bucket that holds two labels.

    A block is of about ``BLOCK`` nodes and ``BLOCK_BYTES`` bytes of text, whichever makes more blocks.

    The nodes of a bucket's most frequent label have blocks of their own, which never meet each
    other; so the work of a bucket is its other nodes times all of them.
    """
    each = rows.groupBy("key", "label").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes"))
    top = each.groupBy("key").agg(F.sum("m").alias("n"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("labels"), F.max(F.struct("m", "label", "bytes")).alias("top")).filter("labels > 1")
    parts = lambda m, size: F.ceil(F.greatest(m / BLOCK, size / BLOCK_BYTES))
    m, size = F.col("top.m"), F.col("top.bytes")
    top = top.select(F.col("key").alias("k"), F.col("top.label").alias("most"), parts(F.col("n") - m, F.col("bytes") - size).alias("rest"), parts(m, size).alias("all_of"))
    top = if_small(materialise(top, "open", rows=n))
    full = rows.join(top, F.col("key") == F.col("k")).drop("k")
    major = F.col("label") == F.col("most")
    rest, all_of = F.col("rest"), F.col("all_of")
    draw = F.xxhash64("node")
    own = F.when(major, rest + F.pmod(draw, all_of)).otherwise(F.pmod(draw, rest))
    full = full.withColumns({"own": own, "with": F.sequence(F.lit(0).cast("long"), F.when(major, rest).otherwise(rest + all_of) - 1)})
    met = full.select("key", "node", "label", "own", F.explode("with").alias("with"))
    return met.select("key", "node", "label", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), (F.col("own") <= F.col("with")).alias("left"), (F.col("own") >= F.col("with")).alias("right"))


def _pairs(members: list, key: int, same: bool, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of a pair of blocks that are to be verified there, the likeliest first.

    They have different labels, one node on either side (``same``: both sides are one block), this
    bucket as that of their first common band, and signatures that allow the threshold.
    """
    label = np.array([x["label"] for x in members], np.int64)
    keys = np.array([x["keys"] for x in members], np.int64)
    sig = np.frombuffer(b"".join(x["sig"] for x in members), np.uint8).reshape(-1, SLOTS)
    left = np.flatnonzero([x["left"] for x in members])
    right = np.flatnonzero([x["right"] for x in members])
    xs, ys, agree = [], [], []
    for x in left:
        y = right[(label[right] != label[x]) & ((right > x) if same else True)]
        equal = (sig[y] == sig[x]).sum(axis=1)
        y, equal = y[equal >= least * SLOTS], equal[equal >= least * SLOTS]
        first = (keys[y] == keys[x]).argmax(axis=1)
        here = keys[x][first] == key
        ys.append(y[here])
        xs.append(np.full(len(ys[-1]), x))
        agree.append(equal[here])
    if not xs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(-np.concatenate(agree), kind="stable")
    return np.concatenate(xs)[order], np.concatenate(ys)[order]


def _nodes_with_pairs(least: float):
    """(key, i, j, node, label, left, right) of the nodes that some pair of their blocks needs."""

    def run(batches):
        for frame in batches:
            found = []
            for key, i, j, members in frame[["key", "i", "j", "members"]].itertuples(index=False):
                for p in np.unique(np.concatenate(_pairs(members, key, i == j, least))):
                    x = members[p]
                    found.append((key, i, j, x["node"], x["label"], x["left"], x["right"]))
            yield pd.DataFrame(found, columns=["key", "i", "j", "node", "label", "left", "right"])

    return run


def _linked_in_blocks(least: float, threshold: float):
    """(a, b) of links that connect the labels of each pair of blocks; a text's shingles are made once there."""

    def run(batches):
        for frame in batches:
            found = []
            for key, i, j, members in frame[["key", "i", "j", "members"]].itertuples(index=False):
                doc, value, count = shingles([x["text"] for x in members])
                cut = np.searchsorted(doc, np.arange(len(members) + 1))
                each = [(value[p:q], count[p:q]) for p, q in zip(cut, cut[1:])]
                size = [int(c.sum()) for _, c in each]
                root: dict = {}

                def find(v):
                    while root.get(v, v) != v:
                        v = root[v]
                    return v

                for p, q in zip(*_pairs(members, key, i == j, least)):
                    u, v = find(members[p]["label"]), find(members[q]["label"])
                    if u == v or min(size[p], size[q]) < threshold * max(size[p], size[q]):
                        continue
                    if similarity(each[p], each[q]) >= threshold:
                        root[u] = v
                        found.append((members[p]["node"], members[q]["node"]))
            yield pd.DataFrame(found, columns=["a", "b"])

    return run


def _remaining(rows: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float, n: int) -> DataFrame:
    """Links (a, b) that connect all nodes of different labels that share a bucket and reach the threshold.

    Blocks meet twice: with signatures, to find the nodes that some pair needs, then with the texts
    of those. Pairs are compared where the blocks meet and never are rows.
    """
    spark, least = rows.sparkSession, ESTIMATE - (THRESHOLD - threshold)
    at = ["key", "i", "j"]
    nodes = nodes.drop("size")
    met = _blocks(rows, n).join(nodes, "node").groupBy(*at).agg(F.collect_list(F.struct("node", "label", "left", "right", "keys", "sig")).alias("members"))
    with arrow_rows(spark, 64):
        need = materialise(met.mapInPandas(_nodes_with_pairs(least), "key long, i long, j long, node long, label long, left boolean, right boolean"), "near", dealt=True)
    full = need.join(nodes, "node").join(texts.hint("merge"), "node")
    full = full.groupBy(*at).agg(F.collect_list(F.struct("node", "label", "left", "right", "keys", "sig", "text")).alias("members"))
    with arrow_rows(spark, 4):
        found = materialise(full.mapInPandas(_linked_in_blocks(least, threshold), "a long, b long"), "links", dealt=True)
    discard(need)
    return found


def _verified(pairs: DataFrame, sigs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose signatures allow the threshold and whose texts reach it."""
    near = pairs.join(sigs.toDF("a", "sig_a"), "a").join(sigs.toDF("b", "sig_b"), "b")
    near = near.filter(agreement(F.col("sig_a"), F.col("sig_b")) >= ESTIMATE - (THRESHOLD - threshold)).select("a", "b")
    both = near.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    return both.filter(jaccard(F.col("text_a"), F.col("text_b")) >= threshold).select("a", "b")


def links(docs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """Verified pairs (a, b) that connect every class of ``nodes`` (node, keys, sig).

    First each bucket's most central node is compared with the rest; what that connects needs no
    further pairs. Then all nodes of a bucket that are still in different components are compared.
    """
    n_nodes = nodes.count()
    n = n_nodes * BANDS
    coarse = materialise(_buckets(nodes.select("node", "size", F.explode("keys").alias("key")), n), "buckets", rows=n)
    weight = materialise(coarse.groupBy("node").agg(F.sum("n").alias("weight")), "weights", rows=n_nodes)
    # Copies are dropped before the texts move; a semi join would be pushed below that. A merge join
    # at every size: what is compared may be a fixed share of all documents.
    texts = docs.select(_node(F.col("text")).alias("node"), "text").groupBy("node").agg(F.max("text").alias("text"))
    texts = materialise(texts.join(weight.select("node").hint("merge"), "node"), "texts", dealt=True)
    sigs = nodes.select("node", "sig")
    with arrow_rows(docs.sparkSession, 512):
        central = materialise(_verified(_star(coarse.join(weight, "node"), n), sigs, texts, threshold), "links", dealt=True)
    label = components(central)
    labelled = coarse.select("key", "node", "size").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = materialise(labelled, "buckets", rows=n)
    more = _remaining(labelled, nodes, texts, threshold, n)
    out = materialise(central.unionByName(more), "links", rows=central.count() + more.count())
    discard(coarse, weight, texts, central, label, labelled, more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each node's component; edges are a written table (a, b).

    Each round takes the least label among a node and its neighbours, then the label of that
    label; rounds grow with the logarithm of a component's diameter. Each is a written table.
    """
    n = 2 * edges.count()
    both = materialise(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", rows=n)
    now = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels", rows=n)
    while True:
        near = both.join(now.select("node", "label"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("m"))
        step = now.select("node", "label").join(near, F.col("node") == F.col("a")).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = step.select(F.col("node").alias("via"), F.col("label").alias("end"))
        after = materialise(step.join(jump, F.col("label") == F.col("via")).select("node", "old", F.least("label", "end").alias("label")), "labels", rows=n)
        discard(now)
        now = after
        if not now.filter(F.col("old") != F.col("label")).limit(1).count():
            discard(both)
            out = now.select("node", "label")
            out._table = now._table
            return out


def _labelled(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, node) of every row, and (node, doc_id, label) of every text: its least id and its class.

    Both read written tables, the only ones that stay.
    """
    with passing() as keep:
        signed, texts = _classed(docs, threshold)
        keep(signed, texts)
    return signed.select("doc_id", "node"), texts


def _classed(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size")
    signed = docs.select("doc_id", _node(F.col("text")).alias("node"), size, _signed(F.coalesce("text", F.lit(""))).alias("s"))
    with arrow_rows(docs.sparkSession, 512):
        signed = materialise(signed.select("doc_id", "node", "size", "s.keys", "s.sig"), "signed")
    nodes = materialise(signed.filter(F.col("keys").isNotNull()).select("node", "size", "keys", "sig").dropDuplicates(["node"]), "nodes", dealt=True)
    edges = links(docs, nodes, threshold)
    label = components(edges)
    discard(edges, nodes)
    texts = signed.groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = texts.join(label, "node", "left").select("node", "doc_id", F.coalesce("label", "node").alias("label"))
    return signed, materialise(texts, "classes", dealt=True)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id) of every row: the least doc_id of its class of near-duplicates.

    Equal texts are one class; null counts as the empty text. Texts of fewer than five words are
    near only to texts of the same words; very long ones are read in pieces and compared whole. Every row has the class of its own text, also where rows
    share a doc_id. Rows whose doc_id is null are compared like others; their class is null only
    if no row of it has an id. An empty table gives none; other columns are ignored.
    """
    rows, texts = _labelled(docs, threshold)
    least = texts.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return rows.join(texts.join(least, "label").select("node", "class_id"), "node").select("doc_id", "class_id")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all columns of ``docs``: that of its least doc_id, null last, then of its least text hash.

    Classes are of texts, so no text is lost to a null or repeated doc_id. Of rows that repeat
    both doc_id and text one stays. Null texts count as empty, which is a class; an empty table
    gives none; columns of any name are kept.
    """
    key = lambda node: F.concat_ws(":", node.cast("string"), F.col("doc_id").cast("string")).alias("_key")
    _, texts = _labelled(docs, threshold)
    first = texts.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("f"))
    kept = first.select("f.doc_id", "f.node").select(key(F.col("node")))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    one = docs.select(row, key(_node(F.col("text")))).join(kept, "_key", "left_semi").dropDuplicates(["_key"])
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
