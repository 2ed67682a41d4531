"""Toxicity: a counterfactually regularised logistic classifier.

Features are the distinct lower-case words of a text and their prefixes of four to six letters.
A seeded sample of at most ``max_rows`` labelled rows chooses the terms that speak most for or
against the label and fits the weights in numpy. Every sampled text gets counterfactual texts:
one that names other groups in place of those that it names, or, if it names none, some that
name a group besides. The squared difference of both scores is added to the loss, so the names
of groups come to carry no weight by themselves, and a neutral mention stays neutral.
"""

from __future__ import annotations

import hashlib
import logging
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomline.llm.common import materialise

#: Names of groups by language and kind; a name is swapped for another of its kind. A parameter of :func:`train`.
IDENTITY = (
    # English
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european", "mexican"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("disabled", "elderly", "young", "deaf", "blind"),
    # German
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten", "katholiken"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "europäer", "türken"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle", "transsexuelle"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("behinderte", "alte", "junge", "gehörlose", "blinde"),
    # French
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées", "catholiques"),
    ("noirs", "blancs", "asiatiques", "africains", "européens", "arabes"),
    ("homosexuels", "lesbiennes", "hétérosexuels", "bisexuels", "transgenres"),
    ("femmes", "hommes", "filles", "garçons"),
    ("immigrés", "réfugiés", "étrangers", "autochtones"),
    ("handicapés", "âgés", "jeunes", "sourds", "aveugles"),
    # Spanish
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos", "católicos"),
    ("negros", "blancos", "asiáticos", "africanos", "europeos", "gitanos"),
    ("homosexuales", "lesbianas", "heterosexuales", "bisexuales", "transexuales"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("inmigrantes", "refugiados", "extranjeros", "lugareños"),
    ("discapacitados", "ancianos", "jóvenes", "sordos", "ciegos"),
)
_WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (4, 5, 6)


def _draw(word: str, seed: int) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}:{word}".encode("utf-8", "surrogatepass")).digest()[:8], "big")


@dataclass
class Names:
    """The names of groups; ``swaps`` has the others of a name's kinds."""

    identity: tuple = IDENTITY
    seed: int = 3
    swaps: dict[str, list[str]] = field(init=False)

    def __post_init__(self):
        self.swaps = {}
        for kind in self.identity:
            for w in kind:
                self.swaps.setdefault(w, []).extend(x for x in kind if x != w)

    def counterfactuals(self, words: set[str], inserted: int) -> list[set[str]]:
        """The words of the texts that a text of ``words`` is compared with.

        A name's partner is drawn by the name, so other edits of a text leave it; names to insert
        are drawn by all words of a text, so each is put into about as many texts.
        """
        named = words & self.swaps.keys()
        if named:
            return [(words - named) | {self.swaps[w][_draw(w, self.seed) % len(self.swaps[w])] for w in named if self.swaps[w]}]
        every = sorted(self.swaps)
        if not words or not every:
            return []
        whole = " ".join(sorted(words))
        return [words | {every[_draw(whole, self.seed + k) % len(every)]} for k in range(inserted)]


@dataclass
class Model:
    """Weights by term, the bias, the names, and how many counterfactual pairs the fit had."""

    weights: dict[str, float]
    bias: float
    names: Names
    pairs: int


def terms(words: set[str], names: Names) -> set[str]:
    """Words, and prefixes marked by ``^``; names of groups have no prefixes."""
    out = set(words)
    for w in words:
        if w not in names.swaps:
            for k in PREFIXES:
                if len(w) > k:
                    out.add("^" + w[:k])
    return out


def text_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(text, toxic) of up to ``max_rows`` labelled rows outside the held-out fifth, in the order of a hash."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"))
    return materialise(rows.select("text", F.col("toxic").cast("int").alias("toxic")), "toxic", dealt=True)


def _term_counts(names: Names):
    def run(batches):
        pos, neg = Counter(), Counter()
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"]):
                (pos if toxic else neg).update(terms(text_words(text), names))
        keys = list(pos.keys() | neg.keys())
        yield pd.DataFrame({"term": keys, "pos": [pos[k] for k in keys], "neg": [neg[k] for k in keys]})

    return run


def vocabulary(rows: DataFrame, names: Names, n_pos: int, n_neg: int, size: int, min_df: int) -> list[str]:
    """The terms whose shares of toxic and other texts differ most, by the two-sample z score."""
    c = rows.mapInPandas(_term_counts(names), "term string, pos long, neg long").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    n = n_pos + n_neg
    share = (F.col("pos") + F.col("neg") + 1.0) / (n + 2.0)
    z = F.abs(F.col("pos") / max(n_pos, 1) - F.col("neg") / max(n_neg, 1)) / F.sqrt(share * (1 - share) * (1 / max(n_pos, 1) + 1 / max(n_neg, 1)))
    top = c.filter(F.col("pos") + F.col("neg") >= min_df).withColumn("z", F.round(z, 6)).filter("z >= 4").orderBy(F.desc("z"), "term").limit(size)
    return [r["term"] for r in top.select("term").collect()]


def _indices(index: dict[str, int], names: Names, inserted: int):
    """own: the terms of a text; others: those of its counterfactuals."""
    of = lambda words: sorted(index[t] for t in terms(words, names) if t in index)

    def rows(batches):
        for b in batches:
            words = [text_words(t) for t in b["text"]]
            others = [[of(x) for x in names.counterfactuals(w, inserted)] for w in words]
            yield pd.DataFrame({"own": [of(w) for w in words], "others": others, "toxic": b["toxic"]})

    return rows


def _fit(own: list, others: list, y: np.ndarray, width: int, l2: float, counterfactual: float, steps: int) -> np.ndarray:
    """Weights and, last, the bias; full-batch Adam. ``others`` has the counterfactuals of each text."""

    def sparse(lists):
        lens = np.array([len(x) for x in lists], dtype=np.int64)
        return np.repeat(np.arange(len(lists)), lens), np.concatenate([np.asarray(x, np.int64) for x in lists]) if lens.sum() else np.zeros(0, np.int64)

    r, c = sparse(own)
    pairs = [(a, b) for a, each in zip(own, others) for b in each]
    pr, pc = sparse([a for a, _ in pairs])
    qr, qc = sparse([b for _, b in pairs])
    n, m = len(y), max(len(pairs), 1)
    w, mean, var = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)) ** 0.5
    for step in range(1, steps + 1):
        z = np.bincount(r, w[c], n) + w[-1]
        err = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
        g = l2 * w
        g[:-1] += np.bincount(c, err[r], width)
        g[-1] = err.sum()
        if pairs:
            d = np.bincount(pr, w[pc], len(pairs)) - np.bincount(qr, w[qc], len(pairs))
            g[:-1] += 2 * counterfactual / m * (np.bincount(pc, d[pr], width) - np.bincount(qc, d[qr], width))
        mean, var = 0.9 * mean + 0.1 * g, 0.999 * var + 0.001 * g * g
        w -= 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.999**step)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 8000, size: int = 2048, min_df: int = 8, l2: float = 1e-4, counterfactual: float = 20.0, inserted: int = 4, steps: int = 400, identity: tuple = IDENTITY) -> Model:
    """The classifier of the labelled rows outside the held-out fifth.

    ``max_rows`` bounds the labelled rows that are learnt from, ``size`` the terms, each of which
    is in ``min_df`` texts (fewer where few are toxic) with a z score of 4 or more. ``inserted``
    names are put into a text that names no group. With no labelled row of either kind every
    score is the share of toxic rows, or 0 without rows. Null labels, null ids and repeated rows
    of one id count once or not at all; null texts count as empty.
    """
    names = Names(identity)
    if counterfactual and not names.swaps:
        raise ValueError("a counterfactual classifier needs names of groups")
    rows = sample(docs, labels, max_rows)
    count = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sum(n for t, n in count.items() if t), count.get(0, 0)
    if not n_pos or not n_neg:
        return Model({}, 30.0 if n_pos else -30.0, names, 0)
    least = max(2, min(min_df, math.ceil(n_pos / 20)))
    vocab = vocabulary(rows, names, n_pos, n_neg, size, least)
    vocab += sorted(names.swaps.keys() - set(vocab))
    index = {t: i for i, t in enumerate(vocab)}
    got = rows.mapInPandas(_indices(index, names, inserted), "own array<int>, others array<array<int>>, toxic int").collect()
    got.sort(key=lambda r: (r["toxic"], r["own"], r["others"]))
    pairs = sum(len(r["others"]) for r in got)
    logging.getLogger(__name__).info("%d labelled texts, %d counterfactual pairs", len(got), pairs)
    w = _fit([r["own"] for r in got], [r["others"] for r in got], np.array([float(bool(r["toxic"])) for r in got]), len(vocab), l2, counterfactual, steps)
    return Model({t: float(w[i]) for t, i in index.items() if abs(w[i]) > 1e-9}, float(w[-1]), names, pairs)


def score(text: Column, model: Model) -> Column:
    """The probability of label 1, 0 to 1; null and empty texts get the bias alone."""
    bias, names = model.bias, model.names.swaps.keys()
    whole = {t: w for t, w in model.weights.items() if t[0] != "^"}
    by_len = [(k, {t[1:]: w for t, w in model.weights.items() if t[0] == "^" and len(t) == k + 1}) for k in PREFIXES]
    swaps = set(names)

    @F.pandas_udf("double")
    def of(s: pd.Series) -> pd.Series:
        out = []
        for text in s:
            words = text_words(text)
            hit = words & whole.keys()
            z = [whole[w] for w in hit]
            for k, weights in by_len:
                z += [weights[p] for p in {w[:k] for w in words if len(w) > k and w not in swaps} & weights.keys()]
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, bias + math.fsum(z))))))
        return pd.Series(out, dtype="float64")

    return of(text)


def classify(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Labels are never inputs of a score. Repeated rows get equal scores; null texts count as
    empty; a very long text is one set of words; a null doc_id is not held out; an empty table
    of documents gives none, one of labels scores of 0; other columns are ignored.
    """
    model = train(docs, labels, **params)
    s = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(F.col("text"), model).alias("score"))
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, all_docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Nulls, empty and long texts are treated as by :func:`classify`; rows that repeat stay or go
    together; an empty table gives none; columns of any name are kept, also one named ``__toxic``.
    """
    model = train(all_docs, labels, **params)
    return docs.filter(score(F.col("text"), model) < 0.5)
