"""Language ID by hyperdimensional profiles.

Every letter symbol has a random vector of +1 and -1. A trigram's vector binds its letters'
vectors, permuted by position (rolled twice, once, not at all), by multiplication; a document
bundles its trigrams' vectors by addition. A language's prototype bundles the unit vectors of
its documents, less the mean over languages, and a document goes to the prototype with the
largest cosine. Bundles add up, so prototypes come from partial sums of the tasks.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


DIM = 512
#: Symbols: 0 for all that is no letter, a to z, and the rest of the letters in a few classes.
SYMBOLS, _REST = 40, 13


@cache
def _space(seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letter vectors rolled twice, once and not at all."""
    v = np.random.default_rng(seed).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
    return np.roll(v, 2, axis=1), np.roll(v, 1, axis=1), v


@cache
def _table() -> np.ndarray:
    """Code point -> symbol for the basic plane."""
    out = np.zeros(65536, np.uint8)
    for p in range(65536):
        c = chr(p)
        if "a" <= c <= "z":
            out[p] = p - 96
        elif c.isalpha():
            out[p] = 27 + p % _REST
    return out


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _table()
    if len(points) and points.max() > 65535:
        high = np.where([chr(p).isalpha() for p in points[points > 65535]], 27 + points[points > 65535] % _REST, 0)
        out = table[np.minimum(points, 65535)]
        out[points > 65535] = high
        return out
    return table[points]


def bundle(text: str | None) -> np.ndarray | None:
    """A document's vector; None if it has no letter."""
    s = symbols(text or "").astype(np.int32)
    if not s.any():
        return None
    s = np.concatenate([[0], s, [0]])
    if len(s) < 3:
        return None
    t = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
    t = t[s[1:-1] > 0]
    n = np.bincount(t, minlength=SYMBOLS**3) if len(t) > 6000 else None
    ids, counts = np.unique(t, return_counts=True) if n is None else (np.flatnonzero(n), n[n > 0])
    a, b, c = _space()
    vectors = a[ids // (SYMBOLS * SYMBOLS)] * b[ids // SYMBOLS % SYMBOLS] * c[ids % SYMBOLS]
    return counts.astype(np.float32) @ vectors.astype(np.float32)


def _sums(batches):
    sums: dict[str, np.ndarray] = {}
    for frame in batches:
        for text, lang in zip(frame["text"], frame["lang"]):
            v = bundle(text)
            if v is not None:
                sums[lang] = sums.get(lang, 0) + (v / np.linalg.norm(v)).astype(np.float64)
    yield pd.DataFrame({"lang": pd.Series(list(sums), dtype=object), "sums": pd.Series([x.tolist() for x in sums.values()], dtype=object)})


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def prototypes(docs: DataFrame) -> dict[str, np.ndarray]:
    """A unit vector for each language of the documents that are not held out."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("text", "lang")
    each = rows.mapInPandas(_sums, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("dim", "x"))
    total = each.groupBy("lang", "dim").agg(F.sum("x").alias("x")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "x"))).alias("v"))
    found = {r["lang"]: np.array([d["x"] for d in r["v"]]) for r in total.collect()}
    unit = {k: v / max(np.linalg.norm(v), 1e-12) for k, v in sorted(found.items())}
    if len(unit) > 1:
        mean = np.mean(list(unit.values()), axis=0)
        unit = {k: (v - mean) / max(np.linalg.norm(v - mean), 1e-12) for k, v in unit.items()}
    return unit


def predict(text: Column, protos: dict[str, np.ndarray]) -> Column:
    """struct<lang_pred, score>: the nearest prototype, and half of one plus its cosine."""
    names = sorted(protos)
    matrix = np.array([protos[k] for k in names]).astype(np.float32) if names else None

    @F.pandas_udf("lang_pred string, score double")
    def of(s: pd.Series) -> pd.DataFrame:
        out = []
        for text in s:
            v = bundle(text)
            if v is None or matrix is None:
                out.append(("und", 0.0))
                continue
            cos = matrix @ v / max(float(np.linalg.norm(v)), 1e-12)
            k = int(np.argmax(cos))
            out.append((names[k], float(min(1.0, max(0.0, (1 + cos[k]) / 2)))))
        return pd.DataFrame(out, columns=["lang_pred", "score"])

    return of(text)


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row.

    Texts that are null or have no letter are ``und`` with score 0, and so are all if nothing
    could be learnt. Equal cosines go to the first language by name. A very long text is
    one bundle, whose size is fixed. Repeated rows get equal predictions; doc_ids may be null; an empty table gives none; other columns are ignored.
    """
    protos = prototypes(docs)
    out = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict(F.col("text"), protos).alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")
