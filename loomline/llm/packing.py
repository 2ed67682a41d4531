"""Packing documents into sequences of bounded length: bounded-space online best-fit.

A document's ids and an end id are one piece, or, where they are longer than a sequence, pieces of
a whole sequence each behind a first piece of what is left over. A piece goes to the open bin that
it fills best; open bins are kept in a bitset keyed by free space, whose lowest set bit at or above
the piece's length names that bin in one step. At most ``OPEN`` bins are open: where none fits and
all are taken, the fullest closes first. Pieces arrive in windows of ``WINDOW`` (one bin each would
still be open), of which the longest come first, so that short ones fill what long ones leave.

Every partition packs its own documents in the pass that encodes them. What remains in bins that
are less than full at its end is packed again together with what other partitions left, in ever
fewer tasks, until one task holds all that is left; a piece that is left over is a narrow row.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomline.llm import bpe
from loomline.llm.common import arrow_rows, groups, materialise
from loomline.llm.pretokens import UNSAFE, byte_chars, to_mapped

SIZE = 2048
#: Open bins of a task, and pieces of a window.
OPEN = 4096
WINDOW = 4096
#: A bin of at most this share of free space is not packed again.
FULL = 1 / 64
#: Pieces that one task packs after the first pass.
TASK_PIECES = 200_000
#: Chunks of text whose ids a worker keeps, in two halves.
MAX_STORE = 1_000_000
#: Pre-tokens without a blank that a worker keeps.
MAX_INNER = 100_000
#: Pre-tokens that meet the merge rules in one call.
TOKENS = 512
#: Rows of an Arrow batch of texts.
BATCH = 1000
_CHARS = np.array([ord(c) for c in byte_chars()[0]], "<u2")
# White space, a blank, white space: the only places where a blank may belong to what stands before it.
_BLANK_INSIDE = re.compile(r"\s (?:\s|\Z)")


class PackedEncoder:
    """Ids of texts as little-endian unsigned 32-bit integers, equal to the library's for a byte-level BPE vocabulary.

    A blank that neither stands between white space nor ends a text behind some always begins a
    pre-token, so texts are split at blanks and ids are kept by the chunk behind one.
    """

    def __init__(self, path: str):
        self.base = bpe.encoder(path)
        self.marks = tuple(self.base.specials)
        sizes = np.zeros(max(self.base.bytes_of) + 1, np.int64)
        for i, b in self.base.bytes_of.items():
            sizes[i] = len(b)
        self.sizes = sizes
        self.store: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _ids(self, tokens: set[str]) -> dict[str, bytes]:
        """Ids of pre-tokens. One behind a blank may be a known chunk; others, that stand within chunks, are kept by themselves."""
        out: dict[str, bytes] = {}
        new, ends, store, old, inner = [], [], self.store, self.old, self.inner
        for t in tokens:
            if t[0] != " ":
                found = inner.get(t)
                if found is None:
                    ends.append(t)
            else:
                found = store.get(t[1:]) or old.get(t[1:])
            if found is None:
                new.append(t)
            else:
                out[t] = found
        out.update(self._pretokens(new))
        if len(inner) + len(ends) > MAX_INNER:
            inner.clear()
            ends = ends[:MAX_INNER]
        inner.update((t, out[t]) for t in ends)
        return out

    def _pretokens(self, tokens: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens; where one ends among all ids follows from the bytes that ids stand for."""
        out: dict[str, bytes] = {}
        for k in range(0, len(tokens), TOKENS):
            part = tokens[k : k + TOKENS]
            data = np.frombuffer("\0".join(part).encode("utf-8"), np.uint8)
            cuts = np.append(np.flatnonzero(data == 0), len(data))
            chars = _CHARS[data]
            if len(cuts) == len(part):
                chars[cuts[:-1]] = ord(" ")
                mapped, upto = chars.tobytes().decode("utf-16-le"), cuts - np.arange(len(cuts))
            else:  # a pre-token that holds the separator itself
                each = [to_mapped(t.encode("utf-8")) for t in part]
                mapped, upto = " ".join(each), np.cumsum([len(m) for m in each])
            ids = np.array(self.base.merger.encode_batch_fast([mapped], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (4 * (np.searchsorted(np.cumsum(self.sizes[ids]), upto) + 1)).tolist()
            raw = ids.tobytes()
            out.update(zip(part, [raw[p:q] for p, q in zip([0, *ends], ends)]))
        return out

    def _learn_plain(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks behind a blank each. Those with white space at neither end are split together: a pre-token that begins with a blank begins a chunk."""
        plain = [c for c in chunks if c and c == c.strip()]
        text = " ".join(["", *plain])
        if not text.isascii() and UNSAFE.search(text):
            plain = [c for c in plain if c.isascii() or not UNSAFE.search(c)]
            text = " ".join(["", *plain])
        if not plain:
            return self._learn(chunks)
        tokens = self.base.splitter.findall(text)
        starts = [i for i, t in enumerate(tokens) if t[0] == " "]
        known = self._ids(set(tokens))
        data = list(map(known.__getitem__, tokens))
        out = {c: data[a] if b == a + 1 else b"".join(data[a:b]) for c, a, b in zip(plain, starts, [*starts[1:], len(tokens)], strict=True)}
        if len(out) < len(chunks):
            out.update(self._learn([c for c in chunks if c not in out]))
        return out

    def _learn(self, chunks: list[str], before: str = " ") -> dict[str, bytes]:
        split = self.base.splitter.split
        lists = [split(before + c) for c in chunks]
        known = self._ids(set().union(*lists))
        return {c: known[x[0]] if len(x) == 1 else b"".join([known[t] for t in x]) for c, x in zip(chunks, lists)}

    def _need(self, new: set[str]) -> None:
        """Has the store hold chunks that it lacks. A full store becomes the old one, which what is still in use comes back from."""
        back = {c: self.old[c] for c in new if c in self.old}
        if len(self.store) + len(new) > MAX_STORE // 2:
            self.store, self.old = {}, self.store
        self.store.update(back)
        if len(new) > len(back):
            self.store.update(self._learn_plain([c for c in new if c not in back]))

    def _whole(self, text: str) -> bytes:
        tokens = self.base._tokens(text)
        known = self._ids({t for t in tokens if isinstance(t, str)})
        marks = self.base.specials
        return b"".join([known[t] if isinstance(t, str) else marks[t[0]].to_bytes(4, "little") for t in tokens])

    def run(self, texts: list[str]) -> list[bytes]:
        lists = [None if _BLANK_INSIDE.search(t) or any(m in t for m in self.marks) else t.split(" ") for t in texts]
        first = [x.pop(0) if x else None for x in lists]
        heads = self._learn(list({h for h in first if h is not None}), "")
        get = self.store.get
        data = [list(map(get, x or ())) for x in lists]
        gaps = [[i for i, d in enumerate(row) if d is None] for row in data]
        self._need({x[i] for x, places in zip(lists, gaps) for i in places})
        of = self.store.__getitem__
        for x, row, places in zip(lists, data, gaps):
            for i in places:
                row[i] = of(x[i])
        return [self._whole(t) if x is None else heads[h] + b"".join(row) for t, h, x, row in zip(texts, first, lists, data)]


@cache
def encoder(path: str) -> PackedEncoder:
    return PackedEncoder(path)


class OpenBins:
    """The open bins of a task: a bitset of free spaces that some bin has, and the bins of each free space."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.bits = size, most, 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> list:
        own = self.by_free[free]
        out = own.pop()
        if not own:
            self.bits &= ~(1 << free)
        self.open -= 1
        return out

    def add(self, piece: tuple, length: int) -> list[list]:
        """Puts a piece where it fills best; the bins that this closes."""
        closed, fits = [], self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            pieces = self._take(free)
        else:
            if self.open == self.most:
                closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, pieces = self.size, []
        pieces.append(piece)
        free -= length
        if free == 0:
            closed.append(pieces)
        else:
            self.by_free[free].append(pieces)
            self.bits |= 1 << free
            self.open += 1
        return closed

    def rest(self, free_from: int) -> tuple[list[list], list[list]]:
        """The open bins of less free space than ``free_from``, and the others."""
        full = [p for own in self.by_free[:free_from] for p in own]
        return full, [p for own in self.by_free[free_from:] for p in own]


def _pieces(data: bytes, size: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, length) of a document's pieces; all but the first are whole sequences."""
    total = len(data) // 4
    first = (total - 1) % size + 1
    starts = [0, *range(first, total, size)]
    for k, (a, b) in enumerate(zip(starts, [*starts[1:], total])):
        yield k, a, b - a


def _packed(pieces: Iterator[tuple], schema: pa.Schema, size: int, step: int, last: bool, most_open: int, most_pieces: int) -> Iterator[pa.RecordBatch]:
    """Rows of packed pieces (doc_id, piece, start, length, crc, ids); with ``last`` no piece is left without a sequence."""
    bins, window, rows = OpenBins(size, most_open), [], []
    number = ((step << 24) | TaskContext.get().partitionId()) << 36
    by_length = lambda p: -p[3]

    def emit(pieces: list, packed: bool = True) -> None:
        nonlocal number
        at = 0
        for p in pieces:
            rows.append((*p, number if packed else None, at if packed else None))
            at += p[3]
        number += packed

    def batch() -> pa.RecordBatch:
        cols = list(zip(*rows)) if rows else [[] for _ in schema]
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    def pack() -> None:
        window.sort(key=by_length)
        for p in window:
            for closed in bins.add(p, p[3]):
                emit(closed)
        window.clear()

    for p in pieces:
        if p[3] == size:
            emit([p])
        else:
            window.append(p)
            if len(window) == most_pieces:
                pack()
        if len(rows) >= 5000:
            yield batch()
    pack()
    full, less = bins.rest(size + 1 if last else int(size * FULL) + 1)
    for pieces in full:
        emit(pieces)
    for pieces in less:
        emit(pieces, packed=False)
    yield batch()


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = 0, with_ids: bool = True, open_bins: int = OPEN, window: int = WINDOW, task_pieces: int = TASK_PIECES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), with ``with_ids`` also ids, of every piece of ``docs``.

    Null and empty texts are a piece of the end id alone; a null doc_id and repeated rows are
    documents like others; a very long text is encoded by one task, its pieces are rows; an empty
    table gives no pieces; other columns are ignored.
    """
    spark = docs.sparkSession
    id_type = docs.schema["doc_id"].dataType.simpleString()
    ids = ", ids array<int>" if with_ids else ""
    out = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long"
    closing = end.to_bytes(4, "little")
    arrow = _arrow_schema(out)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        e = encoder(path)
        for b in batches:
            keys = iter(b.column(0).to_pylist())
            for texts in groups(b.column(1).to_pylist()):
                for data in e.run(texts):
                    key, data = next(keys), data + closing
                    for k, a, n in _pieces(data, size):
                        own = data[4 * a : 4 * (a + n)]
                        head = (key, k, a, n, zlib.crc32(own))
                        yield (*head, np.frombuffer(own, "<i4")) if with_ids else head

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _packed(encoded(batches), arrow, size, 0, False, open_bins, window)

    def again(step: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from _packed((tuple(r.values())[:-2] for b in batches for r in b.to_pylist()), arrow, size, step, last, open_bins, window)

        return run

    with arrow_rows(spark, BATCH):
        packed = materialise(docs.select("doc_id", "text").mapInArrow(first, out), "packed")
    parts, step, before = [packed.filter("sequence_id IS NOT NULL")], 0, None
    while True:
        left = packed.filter("sequence_id IS NULL")
        n = left.count()
        if n == 0:
            break
        step += 1
        # Fewer tasks each time, even where hardly a bin was filled.
        tasks = -(-n // task_pieces)
        tasks = tasks if before is None else max(1, min(tasks, before // 2))
        before = tasks
        order = ["doc_id", "piece", "ids_crc32", "length"]
        dealt = left.repartition(tasks, F.hash(*order)).sortWithinPartitions(*order)
        packed = materialise(dealt.mapInArrow(again(step, tasks == 1), out), "packed")
        parts.append(packed.filter("sequence_id IS NOT NULL"))
        if tasks == 1:
            break
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def _arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(StructType.fromDDL(ddl))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, starts, ids): the sequences of pieces that were packed with ids, in order; ``starts`` is where each piece begins."""
    inside = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(inside.alias("p"))
    get = lambda name: F.transform("p", lambda x: x[name])
    total = F.aggregate(get("length"), F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("sequence_id", total.alias("n_tokens"), get("doc_id").alias("doc_ids"), get("offset").alias("starts"), F.flatten(get("ids")).alias("ids"))
