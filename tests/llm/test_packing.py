"""Packing: pieces hold every id once and in place, sequences are gapless and few."""

import collections
import random
import struct
import zlib

import pytest

from loomline.llm import packing, queries
from tests.llm.test_brute_force import fuzz

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(PATH)
    return [lib.encode(t or "", add_special_tokens=False).ids for t in texts]


def checked(rows, ids_of, size):
    """Pieces by brute force against ``rows``; the number of sequences."""
    want = collections.Counter()
    for doc, ids in ids_of:
        ids = [*ids, 0]
        first = (len(ids) - 1) % size + 1
        for k, a in enumerate([0, *range(first, len(ids), size)]):
            own = ids[a : first if k == 0 else a + size]
            want[doc, k, a, len(own), zlib.crc32(struct.pack(f"<{len(own)}I", *own))] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= size
    return len(by)


def test_encoder_equals_the_library():
    rng = random.Random(5)
    pool = [*"ab1. \n\t  é\xa0　'", " a", " b", "  ", " \n", "<|endoftext|>", "don't", "漢"]
    texts = fuzz(800, 3) + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    got = packing.PackedEncoder(PATH).run(texts)
    assert got == [struct.pack(f"<{len(i)}I", *i) for i in library(texts)]


def test_store_of_any_size_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(packing, "MAX_STORE", 20)
    e = packing.PackedEncoder(PATH)
    for k in range(4):
        texts = [" ".join(f"word{(k * 7 + i) % 40},{i % 3}" for i in range(30))]
        assert e.run(texts) == [struct.pack(f"<{len(i)}I", *i) for i in library(texts)]


def test_query_against_the_library(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    rows = queries.op11_packing(spark, SF).collect()
    ids = library([d["text"] for d in docs])
    n = checked(rows, [(d["doc_id"], i) for d, i in zip(docs, ids)], 2048)
    assert n <= -(-sum(len(i) + 1 for i in ids) // 2048) * 1.01 + 1


@pytest.mark.parametrize(("open_bins", "window", "task"), [(packing.OPEN, packing.WINDOW, packing.TASK_PIECES), (2, 3, 10)])
def test_hard_rows_over_many_partitions(spark, docs, open_bins, window, task):
    """Nulls, long texts, ties, repeated rows; with few bins and tasks pieces go through many rounds."""
    rows = [r for r in docs.collect()] + [(i, "few words of text " * (i % 9), *[None] * 6) for i in range(200, 300)]
    df = spark.createDataFrame(rows, docs.schema)
    got = packing.pack(df.repartition(6), PATH, size=256, end=7, open_bins=open_bins, window=window, task_pieces=task)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset"]
    out = got.collect()
    ids = library([r[1] for r in rows])
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"], r["ids_crc32"]].append(r)
        assert r["length"] == len(r["ids"])
    want = collections.Counter()
    for r, i in zip(rows, ids):
        i = [*i, 7]
        first = (len(i) - 1) % 256 + 1
        for k, a in enumerate([0, *range(first, len(i), 256)]):
            want[r[0], k, a, tuple(i[a : first if k == 0 else a + 256])] += 1
    assert want == collections.Counter((r["doc_id"], r["piece"], r["start"], tuple(r["ids"])) for r in out)
    s = packing.sequences(got).collect()
    assert sum(r["n_tokens"] for r in s) == sum(len(i) + 1 for i in ids) and all(r["n_tokens"] == len(r["ids"]) <= 256 and len(r["starts"]) == len(r["doc_ids"]) for r in s)
    least = -(-sum(len(i) + 1 for i in ids) // 256)
    assert len(s) <= (least * 1.02 + 1 if open_bins > 2 else least * 2)


def test_no_rows(spark, no_docs):
    assert packing.pack(no_docs, PATH).collect() == []


def test_the_fullest_bin_closes_first():
    bins = packing.OpenBins(10, 2)
    assert bins.add("a", 6) == [] and bins.add("b", 7) == []
    assert bins.add("c", 3) == [["b", "c"]]  # fits both; fills b
    assert bins.add("d", 8) == [] and bins.add("e", 9) == [["d"]]
    full, less = bins.rest(2)
    assert full == [["e"]] and less == [["a"]]


def test_chunks_are_split_together(monkeypatch):
    """Chunks without white space meet the splitter in one call; odd ones give the library's ids too."""
    e = packing.PackedEncoder(PATH)
    calls, was = [], e.base.splitter.split
    monkeypatch.setattr(e.base.splitter, "split", lambda t: calls.append(t) or was(t))
    odd = ["it's", "'s", "''ll", "a\x00b", "\x00", "x\ny", "\n", "nb\xa0sp", "li\u2028ne", "漢字", "é1!", "😀", "don't...", "\x85", "a\u200bb", "\ufb01"]
    text = " ".join(["head", *(f"word{i}, q{i}" for i in range(500)), *(y for x in odd for y in (x, "mid"))])
    got = e.run([text, text + " tail"])
    assert [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in got] == library([text, text + " tail"])
    assert len(calls) < 30


def test_a_known_pretoken_does_not_meet_the_merge_rules_again(monkeypatch):
    e, met = packing.PackedEncoder(PATH), []
    learn = e._pretokens
    monkeypatch.setattr(e, "_pretokens", lambda tokens: met.extend(tokens) or learn(tokens))
    texts = ["one two two, three.\nFour four", "two. two; one, three.\nTwo\n five", "x one.\nFour two!\n\nFour, \x00four five\n", "\nfive five\x1f \x85five"]
    for t in texts:
        assert e.run([t]) == [struct.pack(f"<{len(i)}I", *i) for i in library([t])]
    # Only one behind a blank that was no chunk by itself may come again.
    assert all(t[0] == " " and t[1:] not in e.store for t, n in collections.Counter(met).items() if n > 1)


def test_odd_chunks_alone(monkeypatch):
    """A text none of whose chunks can be split with others."""
    assert packing.PackedEncoder(PATH).run(["x 漢字 \u2028y"]) == [struct.pack(f"<{len(i)}I", *i) for i in library(["x 漢字 \u2028y"])]
