"""The Merkle manifest against a plain tree over sorted lists."""

import collections
import hashlib
import zlib

import pytest

from loomline.llm import merkle, queries

SF = "/root/testdata/sf0.001"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def tree(nodes):
    """The root and each node's siblings, level by level, as (left, right)."""
    proofs, of, level = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(level) > 1:
        above, owners = [], []
        for a in range(0, len(level), 8):
            run = level[a : a + 8]
            for k in range(len(run)):
                for i in of[a + k]:
                    proofs[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            above.append(digest(*run))
            owners.append([i for o in of[a : a + 8] for i in o])
        level, of = above, owners
    return level[0], proofs


def plain(rows):
    """Expected rows of (doc_id, source, lang, n_chars, text) tuples."""
    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    order = lambda r: (r[0] is not None, r[0] or 0, leaf(*r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: (own := sorted(by[x], key=order), *tree([leaf(*r) for r in own])) for x in langs}
    root, tops = tree([trees[x][1] for x in langs])
    out = []
    for x, top in zip(langs, tops):
        own, sub, proofs = trees[x]
        for r, proof in zip(own, proofs):
            steps = proof + top
            changed = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                changed = (*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4]))
            folded = leaf(*changed)
            for a, b in steps:
                folded = digest(a, folded, b)
            out.append((r[0], leaf(*r), sub, root, digest(*[a + b for a, b in steps]), folded, folded == root))
    return collections.Counter(out)


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries.op12_merkle(spark, SF)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert collections.Counter(map(tuple, got.collect())) == plain([tuple(r) for r in docs.select(*FIELDS).collect()])


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_blocks_of_any_size_over_hard_rows(spark, docs, levels):
    """Rounds of blocks, many languages, groups of 1, 8, 9, 64 and 65 leaves, nulls, repeated rows and ids."""
    rows = [tuple(r[c] for c in FIELDS) for r in docs.collect()]
    rows += [(1000 + i, "s", lang, i, f"Text {i} of {lang}") for lang, n in (("aa", 1), ("bb", 8), ("cc", 9), ("dd", 64), ("ee", 65), ("é", 3), ("😀", 70)) for i in range(n)]
    rows += [(i, "s", f"l{i}", 1, "A") for i in range(20)] + [(None, None, "aa", None, f"T{i}") for i in range(30)] + [(7, "s", "ff", 1, "Same")] * 600
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").withColumn("digest", merkle.F.lit(1)).withColumn("g", merkle.F.lit("x"))
    assert collections.Counter(map(tuple, merkle.verified(df.repartition(5), levels).collect())) == plain(rows)


def test_proofs_fold_to_the_root(spark):
    m = merkle.manifest(spark.read.parquet(f"{SF}/documents.parquet"))
    assert m.filter(merkle.fold(merkle.F.col("leaf"), merkle.F.col("proof")) != merkle.F.col("root")).count() == 0


def test_no_rows(spark, no_docs):
    assert merkle.verified(no_docs).collect() == []
