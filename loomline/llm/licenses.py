"""License scans: exact phrases, and short notices with a bounded number of edits.

A text becomes lower-case words joined by blanks. A notice that may differ by k edits is split
into k + 1 pieces; by the pigeonhole principle one of them stands unchanged in every match, so
exact search for pieces locates all candidates. Around each hit the regex library's bounded-error
matching, best match first, verifies the edits and reports the span.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Phrases that are searched word for word, and their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
#: Short notices: label, then parts as (words, edits they may have); no edit where names or versions stand.
NOTICES = (
    ("mit", (("released under the ", 2), ("mit", 0), (" license", 1))),
    ("mit", (("licensed under the ", 2), ("mit", 0), (" license", 1))),
    ("mit", (("permission is hereby granted free of charge to any person obtaining a copy", 5),)),
    ("apache-2", (("licensed under the apache license ", 3), ("version 2", 1))),
    ("cc-by-nc", (("licensed under ", 1), ("cc by nc", 0))),
    ("cc-by-nc", (("creative commons attribution noncommercial", 3),)),
    ("cc-by", (("creative commons attribution ", 3), ("4 0 international", 1))),
    ("gpl-2", (("gnu general public license version ", 3), ("2", 0))),
    ("gpl-3", (("gnu general public license version ", 3), ("3", 0))),
    ("lgpl", (("gnu lesser general public license", 2),)),
    ("bsd", (("redistribution and use in source and binary forms with or without modification", 5),)),
    ("mpl-2", (("mozilla public license version ", 2), ("2", 0))),
    ("unlicense", (("free and unencumbered software released into the public domain", 4),)),
)
#: Bytes to what the scan sees: word bytes stay, capitals fall, all else parts words.
_SEEN = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def normal(text: str | None) -> tuple[bytes, int]:
    """Words joined by single blanks with a blank at either end, and their number."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_SEEN).split()
    return b" " + b" ".join(words) + b" ", len(words)


@cache
def _compiled():
    out = []
    for label, parts in NOTICES:
        whole = "".join(p for p, _ in parts)
        k = sum(e for _, e in parts)
        cuts = [len(whole) * i // (k + 1) for i in range(k + 2)]
        seeds = [(whole[a:b].encode(), a) for a, b in zip(cuts, cuts[1:])]
        body = "".join(f"(?:{regex.escape(p, literal_spaces=True)})" + (f"{{e<={e}}}" if e else "") for p, e in parts)
        out.append((label, whole.encode(), k, seeds, regex.compile(f"(?b)(?<= )(?:{body})(?= )".encode())))
    return out


def fuzzy(seen: bytes) -> list[tuple[str, int, int, int, int]]:
    """(label, start, end, edits, length of the notice) in ``seen``, one for each notice and place."""
    found = []
    for label, whole, k, seeds, pattern in _compiled():
        windows = []
        for seed, offset in seeds:
            at = seen.find(seed)
            while at >= 0:
                windows.append((max(0, at - offset - k - 1), at - offset + len(whole) + k + 1))
                at = seen.find(seed, at + 1)
        upto = -1
        for a, b in sorted(windows):
            if a < upto:  # its part before upto was searched
                a = max(a, last_end)
            last_end = a
            if b <= upto:
                continue
            for m in pattern.finditer(seen, a, b):
                edits = sum(m.fuzzy_counts)
                found.append((label, m.start(), m.end(), edits, len(whole)))
                last_end = max(last_end, m.end())
            upto = b
    return sorted(set(found), key=lambda x: x[1:])


def scan(text: str | None) -> tuple:
    """What :func:`scans` returns of one text, as a tuple."""
    seen, n = normal(text)
    hits = []
    for phrase, label in PHRASES:
        needle = f" {phrase} ".encode()
        at = seen.find(needle)
        while at >= 0:
            hits.append((at, label))
            at = seen.find(needle, at + 1)
    near = fuzzy(seen)
    # A word's number is the number of blanks before the one that it stands behind; all places are looked up in one array.
    blanks = np.flatnonzero(np.frombuffer(seen, np.uint8) == 32) if hits or near else np.zeros(0, np.int64)
    word = lambda at: np.searchsorted(blanks, at).tolist()
    places = list(zip(word([at for at, _ in hits]), [label for _, label in hits]))
    base = sorted({x for _, x in places})
    labels = sorted(set(base) | {x[0] for x in near})
    starts = [p for p, _ in places]
    score = 1.0 if places else max((1 - e / size for _, _, _, e, size in near), default=0.0)
    firsts = word([a - 1 for _, a, *_ in near])
    spans = [{"label": x, "first_word": first, "n_words": len(seen[a:b].split()), "edits": e, "matched": seen[a:b].decode("utf-8", "replace")} for first, (x, a, b, e, _) in zip(firsts, near)]
    return n, len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, spans


_NAMES = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")
_TYPE = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:int,n_words:int,edits:int,matched:string>>"


def scans(text: Column) -> Column:
    """A struct of the counts, labels, score and edited spans of a text column."""

    @F.pandas_udf(_TYPE)
    def of(s: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan(t) for t in s], columns=_NAMES)
        for c in ("first_word", "last_word"):
            out[c] = out[c].astype("Int64")
        return out

    return of(text)


def scan_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of every row.

    Null and empty texts have no words, labels "" and score 0. A very long text is scanned whole, in
    windows about exact seeds. Repeated rows are scanned each; doc_ids may be null; an empty table gives none; other columns are ignored.
    """
    return docs.select("doc_id", scans(F.col("text")).alias("s")).select("doc_id", "s.*")
