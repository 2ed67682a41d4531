"""Spelling variants: words at an edit distance of one, grouped under the most frequent form.

All words, sorted, are cut into shards of bounded bytes, each of neighbouring words. Waves of a few
shards are broadcast as compact tries (front-coded: what a word shares with the one before it, and
the rest), and every word's automaton of distance one meets every shard of the wave, depth first.
The automaton has one error to spend. It is spent where a neighbour first differs from the word, so
the walk follows the word down the trie and leaves it, at each branch, only by other letters; every
neighbour is met once. A shard gives a word its number of neighbours there and the best of them,
and these are added up; neighbours are never rows.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomline.llm.common import arrow_rows, discard, gathered, materialise

#: Bytes of words, with 8 more each, of a shard and of the shards that are broadcast together.
SHARD_BYTES, WAVE_BYTES = 1_000_000, 4_000_000
#: Distinct words that a task counts before it passes them on.
COUNTED = 300_000
#: Rows of an Arrow batch of texts.
BATCH = 1000
_LOW = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_loaded: dict[str, list] = {}


def occurrences(docs: DataFrame, least_length: int = 5, one_in: int = 97) -> DataFrame:
    """(word, n) of all words of ``docs`` of at least ``least_length`` letters after misspelling one occurrence in ``one_in``.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, of which A-Z are lower-cased. Where
    ``one_in`` divides the crc32 of the doc_id (nothing where it is null), a colon and the run, the
    letter at the place that this number leaves over is deleted.
    """
    # Shorter runs give no word, whatever is deleted.
    find = re.compile("[a-zÀ-ÿ]{%d,}" % least_length).findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
        for b in batches:
            for key, text in zip(b.column(0), b.column(1)):
                text = text.as_py()
                if not text:
                    continue
                key = key.as_py()
                head = zlib.crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(find(text.encode().translate(_LOW).decode())).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % one_in == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least_length:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > COUNTED:
                    yield batch()
                    counts.clear()
        yield batch()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def front_coded(words: list[str], counts: list[int]) -> tuple[np.ndarray, str, np.ndarray, np.ndarray]:
    """Sorted words as (letters shared with the one before, all other letters, how many of these are a word's, counts)."""
    shared = [0, *(len(commonprefix((a, b))) for a, b in zip(words, words[1:]))] if words else []
    rest = [w[k:] for w, k in zip(words, shared)]
    return np.array(shared, np.int32), "".join(rest), np.array([len(r) for r in rest], np.int32), np.array(counts, np.int64)


def trie(shared: np.ndarray, letters: str, lengths: np.ndarray, counts: np.ndarray) -> dict:
    """The linked form: letter -> (rest of the edge, node below or None, count of the word that ends there or 0)."""
    words, at, word = [], 0, ""
    for k, n in zip(shared.tolist(), lengths.tolist()):
        word = word[:k] + letters[at : at + n]
        at += n
        words.append(word)
    ns = counts.tolist()
    root: dict = {}
    todo = [(root, 0, len(words), 0)]
    while todo:
        node, lo, hi, depth = todo.pop()
        while lo < hi:
            first = words[lo]
            c, end = first[depth], lo + 1
            while end < hi and words[end][depth] == c:
                end += 1
            if end == lo + 1:
                node[c] = (first[depth + 1 :], None, ns[lo])
            else:
                upto = len(commonprefix((first, words[end - 1])))
                ends_here = len(first) == upto
                below: dict = {}
                node[c] = (first[depth + 1 : upto], below, ns[lo] if ends_here else 0)
                todo.append((below, lo + ends_here, end, upto))
            lo = end
    return root


def _ends(rest: str, below: dict | None, n: int, left: str) -> int:
    """The count of the word that ``left`` leads to from within an edge, or 0."""
    while left.startswith(rest):
        left = left[len(rest) :]
        if not left:
            return n
        edge = below.get(left[0]) if below else None
        if edge is None:
            return 0
        rest, below, n = edge
        left = left[1:]
    return 0


def neighbours(root: dict, word: str) -> Iterator[tuple[int, str]]:
    """(count, word) of each word of a trie at a distance of exactly one."""
    node, i, size, here = root, 0, len(word), 0
    while True:
        # word[:i] has led to this node; `here` is the count of the word that ends in it.
        own, left, after = word[i : i + 1], word[i:], word[i + 1 :]
        if here and i == size - 1:
            yield here, word[:i]
        if node is None:
            return
        second = after[:1]
        for c, (rest, below, n) in node.items():
            if c != own:
                if m := _ends(rest, below, n, left):
                    yield m, word[:i] + c + left
                if own and (m := _ends(rest, below, n, after)):
                    yield m, word[:i] + c + after
                if c == second and (m := _ends(rest, below, n, after[1:])):
                    yield m, word[:i] + after
        edge = node.get(own)
        if edge is None:
            return
        rest, below, n = edge
        if not after.startswith(rest):
            # Leaves the word inside the edge, whose next letter is the only other one.
            k = len(commonprefix((rest, after)))
            i += 1 + k
            left, after = word[i:], word[i + 1 :]
            if m := _ends(rest[k + 1 :], below, n, left):
                yield m, word[:i] + rest[k] + left
            if left and (m := _ends(rest[k + 1 :], below, n, after)):
                yield m, word[:i] + rest[k] + after
            if after and (m := _ends(rest[k:], below, n, after)):
                yield m, word[:i] + after
            return
        i += 1 + len(rest)
        node, here = below, n


def _tries(shared) -> list[dict]:
    """A wave's tries, linked once a worker; those of another wave go."""
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = [trie(*s) for s in shared.value]
    return _loaded[shared.id]


class _Wave:
    """A broadcast with a name that no other has, by which workers keep what they made of it."""

    def __init__(self, spark, shards: list):
        self.broadcast, self.id = spark.sparkContext.broadcast(shards), uuid.uuid4().hex

    @property
    def value(self) -> list:
        return self.broadcast.value


def _met(words: DataFrame, wave: _Wave) -> DataFrame:
    """(word, n_near, best) of the words that have a neighbour in the wave."""
    out = "word string, n_near long, best_n long, best string"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tries = _tries(wave)
        for b in batches:
            rows = []
            for word in b.column(0).to_pylist():
                found = [x for t in tries for x in neighbours(t, word)]
                if found:
                    n, form = min((-n, w) for n, w in found)
                    rows.append((word, len(found), -n, form))
            cols = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["word", "n_near", "best_n", "best"])

    return words.select("word").mapInArrow(meet, out)


def _kept(table: DataFrame, name: str) -> DataFrame:
    """A table of words from a shuffle, written in a file a core: each file that a task writes starts processes beside it."""
    return materialise(gathered(table, 1), name)


def near_words(words: DataFrame, shard_bytes: int = SHARD_BYTES, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(word, n_near, best_n, best) of the words of ``words`` (word, n), a written table, that have a neighbour.

    Words are distinct, not null and not empty. A word longer than a shard is a shard of its own.
    """
    spark = words.sparkSession
    ranged = words.repartitionByRange("word").sortWithinPartitions("word").withColumn("__at", F.monotonically_increasing_id())
    ranged = _kept(ranged, "vocabulary")
    size = F.octet_length("word") + 8
    upto = F.sum(size).over(W.partitionBy("part").orderBy("__at"))
    shards = ranged.withColumn("part", F.shiftright("__at", 33)).withColumn("size", size).withColumn("shard", F.call_function("div", upto - F.col("size"), F.lit(shard_bytes)))
    shards = _kept(shards.select("word", "n", "part", "shard", "size"), "shards")
    sizes = shards.groupBy("part", "shard").agg(F.sum("size").alias("size")).orderBy("part", "shard").collect()
    waves: list[list] = []
    held = 0
    for r in sizes:
        if not waves or held + r["size"] > wave_bytes:
            waves.append([])
            held = 0
        waves[-1].append((r["part"], r["shard"]))
        held += r["size"]
    met = []
    for own in waves:
        rows = shards.filter((F.col("part") >= own[0][0]) & (F.col("part") <= own[-1][0]) & F.struct("part", "shard").between(_pair(own[0]), _pair(own[-1])))
        got = rows.toArrow().sort_by("word")
        keys = list(zip(got["part"].to_pylist(), got["shard"].to_pylist()))
        ws, ns = got["word"].to_pylist(), got["n"].to_pylist()
        # Words sort as their UTF-8 bytes do, so a shard's rows stay together.
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        wave = _Wave(spark, [front_coded(ws[a:b], ns[a:b]) for a, b in zip(cuts, cuts[1:])])
        met.append(materialise(_met(ranged, wave), "met"))
        wave.broadcast.destroy()
    out = None
    for m in met:
        out = m if out is None else out.unionByName(m)
    if out is None:
        return words.select("word", F.lit(0).cast("long").alias("n_near"), F.col("n").alias("best_n"), F.col("word").alias("best")).limit(0)
    best = F.min(F.struct((-F.col("best_n")).alias("k"), "best")).alias("b")
    summed = out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)
    result = _kept(summed.select("word", "n_near", (-F.col("b.k")).alias("best_n"), F.col("b.best").alias("best")), "near")
    discard(ranged, shards, *met)
    return result


def _pair(key: tuple[int, int]):
    return F.struct(F.lit(key[0]).cast("long").alias("part"), F.lit(key[1]).cast("long").alias("shard"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of (word, form) links, a written table: what following forms ends with. Forms lead to no circle."""
    held = links.select("word", F.col("form").alias("root"))
    while True:
        b = held.select(F.col("word").alias("__w"), F.col("root").alias("__r"))
        step = held.join(b, F.col("root") == F.col("__w"), "left")
        after = _kept(step.select("word", F.coalesce("__r", "root").alias("root"), F.col("__r").isNotNull().alias("moved")), "roots")
        if after.filter("moved").limit(1).count() == 0:
            return after.select("word", "root")
        held = after


def variants(docs: DataFrame, least_length: int = 5, least_n: int = 3, one_in: int = 97, times: int = 2, shard_bytes: int = SHARD_BYTES, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of ``least_length`` letters and ``least_n`` occurrences.

    ``form`` is the most frequent near word, the smallest of equals, if it is ``times`` as frequent
    as the word; ``root`` is what following forms leads to. Null and empty texts have no words; a
    null doc_id counts as an empty one in :func:`occurrences`; rows that repeat an id and its text
    count each; a very long text is counted by one task, a very long word is a shard of its own.
    An empty table has no words. Other columns are ignored.
    """
    with arrow_rows(docs.sparkSession, BATCH):
        words = _kept(occurrences(docs, least_length, one_in).filter(F.col("n") >= least_n), "words")
    near = near_words(words, shard_bytes, wave_bytes).withColumnRenamed("word", "__n")
    both = words.join(near, F.col("word") == F.col("__n"), "left")
    enough = F.col("best_n") >= times * F.col("n")
    formed = both.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("best")).alias("form"), F.when(enough, F.col("best_n")).alias("form_n"))
    formed = _kept(formed, "formed")
    ends = roots(formed.filter("form IS NOT NULL")).withColumnRenamed("word", "__n")
    out = formed.join(ends, F.col("word") == F.col("__n"), "left")
    return gathered(out.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), 1)
