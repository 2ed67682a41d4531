"""Token counts: pieces counted once per distinct pre-token, joined to per-document frequencies.

The distinct pre-tokens of all documents are a table with their counts; each meets the merge
rules once there, and only the number of its pieces is kept. Documents then join it: the part
of it that is most frequent, at most ``LEXICON`` rows, goes to the tasks, which sum frequency
times pieces for its pre-tokens; the others meet the table in a join by pre-token, and their
sums come back by row. No document's ids are ever made.
"""

from __future__ import annotations

import os
import re
from collections import Counter
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from loomline.llm.common import frequent, groups, materialise
from loomline.llm.pretokens import WORD_END, Splitter, pieces

#: Rows of the table that the tasks get, some 10 MB; beyond them pre-tokens are joined.
LEXICON = 250_000
#: A task passes on its counts when it holds as many pre-tokens.
HELD = 400_000


class TokenCounter:
    """Pre-tokens, and their numbers of pieces, of a lower-casing BPE vocabulary with word ends."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.splitter = Splitter(path, WORD_END, lower=True)
        library = self.splitter.library
        marks = [t.content for t in library.get_added_tokens_decoder().values()]
        self.marks = frozenset(marks)
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(marks, key=len, reverse=True))) + ")") if marks else None
        self.merger = Tokenizer(library.model)
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])

    def split(self, text: str) -> list[str]:
        """Pre-tokens of a text. A special token is one, which no other pre-token equals."""
        if self.cuts is None or not any(m in text for m in self.marks):
            return self.splitter.split(text)
        out: list[str] = []
        for k, part in enumerate(self.cuts.split(text)):
            out += [part] if k % 2 else self.splitter.split(part)
        return out

    def sizes(self, tokens: list[str]) -> list[int]:
        """The number of pieces of each pre-token."""
        plain = [t for t in tokens if t not in self.marks]
        found = dict.fromkeys(self.marks, 1)
        for part, _, starts in pieces(self.merger, plain):
            found.update(zip(part, (starts[1:] - starts[:-1]).tolist()))
        return [found[t] for t in tokens]


@cache
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _frames(counts: Counter, size: int = 50_000):
    kept = list(counts.items())
    for k in range(0, len(kept), size):
        yield pd.DataFrame(kept[k : k + size], columns=["token", "n"])


def _counted(path: str):
    def run(batches):
        split, counts = counter(path).split, Counter()
        for b in batches:
            for text in b["text"]:
                if text:
                    counts.update(split(text))
            if len(counts) > HELD:
                yield from _frames(counts)
                counts = Counter()
        yield from _frames(counts)

    return run


def _sized(path: str):
    def run(batches):
        for b in batches:
            yield b.assign(pieces=counter(path).sizes(b["token"].tolist()))

    return run


def lexicon(docs: DataFrame, path: str) -> DataFrame:
    """(token, n, pieces) of every distinct pre-token of all texts, as a written table."""
    counts = docs.select("text").mapInPandas(_counted(path), "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return materialise(counts.mapInPandas(_sized(path), "token string, n long, pieces int"), "lexicon", dealt=True)


def _frequencies(text: Column, path: str, known: dict[str, int]) -> Column:
    """struct<n, tokens, ns>: the pieces of a text's ``known`` pre-tokens, and the others with their frequencies."""

    @F.pandas_udf("n long, tokens array<string>, ns array<int>")
    def of(s: pd.Series) -> pd.DataFrame:
        split, out = counter(path).split, []
        get = known.get
        for part in groups(s):
            for text in part:
                n, tokens, ns = 0, [], []
                for t, m in Counter(split(text)).items():
                    k = get(t)
                    if k is None:
                        tokens.append(t)
                        ns.append(m)
                    else:
                        n += m * k
                out.append((n, tokens, ns))
        return pd.DataFrame(out, columns=["n", "tokens", "ns"])

    return of(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    Null and empty texts have 0 bytes and tokens. A very long text is one document like others;
    a task holds its distinct pre-tokens. Repeated rows are counted each; an empty table gives
    none; doc_ids may be null or repeat; other columns are ignored.
    """
    table = lexicon(docs, path)
    known = {r["token"]: r["pieces"] for r in frequent(table, LEXICON).collect()}
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), size, _frequencies(F.col("text"), path, known).alias("f"))
    rows = materialise(rows.select("doc_id", "row", "n_bytes", "f.*"), "frequencies")
    rest = rows.select("row", F.explode(F.arrays_zip("tokens", "ns")).alias("t")).select("row", F.col("t.tokens").alias("token"), F.col("t.ns").alias("m"))
    more = rest.join(table.select("token", "pieces"), "token").groupBy("row").agg(F.sum(F.col("m") * F.col("pieces")).alias("more"))
    out = rows.select("doc_id", "row", "n_bytes", "n").join(more, "row", "left")
    out = out.select("doc_id", "n_bytes", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
