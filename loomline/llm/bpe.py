"""BPE encoding and decoding with forced-boundary splitting.

Two bytes that stand side by side in no token of the vocabulary can never be joined by a merge,
so a cut between them is certain. Pre-tokens are cut at all such places, each distinct fragment
is encoded once by the merge rules alone, and the ids are put together again. Texts longer than
memory allows for ids are no trouble: per pre-token only its ids' decimal form, their number and
their bytes are kept, in a store of bounded size per worker.
"""

from __future__ import annotations

import hashlib
import os
from functools import cache
from operator import itemgetter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from loomline.llm.common import groups
from loomline.llm.pretokens import BYTE_LEVEL, Splitter, from_mapped, pieces, to_mapped

#: Pre-tokens that a worker keeps, in two halves.
MAX_STORE = 300_000
_IDS, _N, _DATA = itemgetter(0), itemgetter(1), itemgetter(2)


class FragmentEncoder:
    """Encodes and decodes as the library does for a byte-level BPE vocabulary."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.splitter = Splitter(path, BYTE_LEVEL, lower=False)
        library = self.splitter.library
        self.specials = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
        vocab = {t: i for t, i in library.get_vocab(with_added_tokens=False).items()}
        self.bytes_of = {i: from_mapped(t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.specials.items()}
        joined = np.zeros(65536, bool)
        for i in vocab.values():
            b = np.frombuffer(self.bytes_of[i], np.uint8).astype(np.int64)
            joined[b[:-1] * 256 + b[1:]] = True
        self.certain = ~joined
        self.merger = Tokenizer(library.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.digits = {i: str(i) for i in self.bytes_of}
        self.store: dict[str, tuple[str, int, bytes]] = {}
        self.old: dict[str, tuple[str, int, bytes]] = {}

    def _spans(self, tokens: list[str]) -> tuple[bytes, list[int], list[int]]:
        """The bytes of all pre-tokens, the end of each fragment in them, and each pre-token's last fragment."""
        raw = [t.encode("utf-8") for t in tokens]
        data = b"".join(raw)
        b = np.frombuffer(data, np.uint8).astype(np.int64)
        ends = np.cumsum([len(x) for x in raw])
        inner = np.flatnonzero(self.certain[b[:-1] * 256 + b[1:]]) + 1 if len(b) > 1 else np.zeros(0, np.int64)
        places = np.sort(np.concatenate([inner, ends]))
        places = places[np.concatenate([[True], places[1:] != places[:-1]])] if len(places) else places
        return data, places.tolist(), np.searchsorted(places, ends).tolist()

    def cut(self, tokens: list[str]) -> list[list[bytes]]:
        """Fragments of each pre-token."""
        data, places, lasts = self._spans(tokens)
        own = [data[p:q] for p, q in zip([0, *places], places)]
        return [own[p:q] for p, q in zip([0, *[k + 1 for k in lasts]], [k + 1 for k in lasts])]

    def learn(self, tokens: list[str]) -> None:
        """Puts pre-tokens into the store; each distinct fragment meets the merge rules once."""
        data, places, lasts = self._spans(tokens)
        chars = to_mapped(data)
        own = [chars[p:q] for p, q in zip([0, *places], places)]
        known: dict[str, tuple[str, int, bytes]] = {}
        for part, ids, starts in pieces(self.merger, list(dict.fromkeys(own))):
            texts, data_of = [self.digits[i] for i in ids], [self.bytes_of[i] for i in ids]
            at = starts.tolist()
            for x, p, q in zip(part, at, at[1:]):
                known[x] = (",".join(texts[p:q]), q - p, b"".join(data_of[p:q]))
        first = 0
        for t, last in zip(tokens, lasts):
            if first == last:
                self.store[t] = known[own[first]]
            else:
                texts, ns, parts = zip(*[known[x] for x in own[first : last + 1]])
                self.store[t] = (",".join(texts), sum(ns), b"".join(parts))
            first = last + 1

    def need(self, tokens: set) -> None:
        """Has the store hold ``tokens``. A full store becomes the old one, which what is still in use comes back from."""
        if len(self.store) + len(tokens.difference(self.store)) > MAX_STORE // 2:
            self.store, self.old = {}, self.store
        new = tokens.difference(self.store)
        back = new.intersection(self.old)
        self.store.update((x, self.old[x]) for x in back)
        new -= back
        marks = {x for x in new if isinstance(x, tuple)}
        for m in marks:
            i = self.specials[m[0]]
            self.store[m] = (str(i), 1, self.bytes_of[i])
        if len(new) > len(marks):
            self.learn(list(new - marks))

    def _tokens(self, text: str) -> list:
        """Pre-tokens as strings, and special tokens as tuples of one."""
        parts = [text]
        for mark in self.specials:
            parts = [y for x in parts for y in ([x] if isinstance(x, tuple) else _between(x, mark))]
        out: list = []
        for x in parts:
            out.extend([x] if isinstance(x, tuple) else self.splitter.split(x))
        return out

    def run(self, texts: list[str]) -> list[tuple[int, str, bytes]]:
        """(number of ids, ids in decimal joined by commas, decoded UTF-8) of each text."""
        lists = [self._tokens(t) for t in texts]
        self.need(set().union(*lists))
        out, of = [], self.store.__getitem__
        for tokens in lists:
            rows = list(map(of, tokens))
            out.append((sum(map(_N, rows)), ",".join(map(_IDS, rows)), b"".join(map(_DATA, rows)).decode("utf-8", "replace").encode("utf-8")))
        return out

    def encode(self, text: str) -> list[int]:
        ids = self.run([text])[0][1]
        return [int(i) for i in ids.split(",")] if ids else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.bytes_of[i] for i in ids).decode("utf-8", "replace")


def _between(text: str, mark: str) -> list:
    parts = text.split(mark)
    out: list = [parts[0]]
    for x in parts[1:]:
        out += [(mark,), x]
    return [x for x in out if x != ""]


@cache
def encoder(path: str) -> FragmentEncoder:
    return FragmentEncoder(path)


def codes(text: Column, path: str) -> Column:
    """struct<n_tokens, ids, decoded> of a text column: the full ids and the text they decode to."""

    @F.pandas_udf("n_tokens long, ids array<int>, decoded string")
    def code(s: pd.Series) -> pd.DataFrame:
        e = encoder(path)
        got = [x for part in groups(s) for x in e.run(part)]
        ids = [np.array(i.split(","), dtype=np.int32) if i else np.zeros(0, np.int32) for _, i, _ in got]
        return pd.DataFrame({"n_tokens": [n for n, _, _ in got], "ids": ids, "decoded": [d.decode() for _, _, d in got]})

    return code(text)


def digests(text: Column, path: str) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256> of a text column."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(s: pd.Series) -> pd.DataFrame:
        e = encoder(path)
        got = [(n, hashlib.sha256(i.encode()).hexdigest(), hashlib.sha256(d).hexdigest()) for part in groups(s) for n, i, d in e.run(part)]
        return pd.DataFrame(got, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest(text)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of every row.

    Null and empty texts give no ids and an empty text back; repeated rows are encoded each; an
    empty table gives none; other columns are ignored.
    """
    return docs.select("doc_id", codes(F.col("text"), path).alias("c")).select("doc_id", "c.*")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row; see :func:`encode`."""
    return docs.select("doc_id", digests(F.col("text"), path).alias("c")).select("doc_id", "c.*")
