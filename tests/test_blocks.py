"""Folds and weaving against sequential models on random input."""

import random

from pyspark.sql import functions as F

from loomline.operators import blocks as B
from loomline.operators import tables
from loomline.plans import runs
from loomline.sources import files, sinks


def model_paths(items):
    path, out = [], []
    for label, level, text in items:
        if label == "section_header" and text.strip():
            path = path[: max(1, min(6, level)) - 1] + [text.strip()]
        out.append(list(path))
    return out


def test_heading_paths(spark):
    rng, rows, want = random.Random(4), [], {}
    for d in range(30):
        items = [(rng.choice(["section_header", "text", "list_item", "footnote"]), rng.randint(0, 8), rng.choice(["A", "B", " ", "C d", ""])) for _ in range(rng.randint(0, 12))]
        for p, (path, (label, level, text)) in enumerate(zip(model_paths(items), items)):
            rows.append((f"d{d}", p, label, level, 1, text, None, None))
            want[f"d{d}", p] = path
    got = B.with_headings(spark.createDataFrame(rows, files.ITEMS)).collect()
    assert {(r["doc_slug"], r["pos"]): r["heading_path"] for r in got} == want


def model_weave(blocks, tabs):
    out = [dict(kind="b", i=i, page=p, ref=None) for i, p in enumerate(blocks)]
    for j, p in enumerate(tabs):
        at = max((k for k, x in enumerate(out) if x["kind"] == "b" and x["page"] <= p), default=None)
        anchor = out[at]["i"] if at is not None else -1
        out.append(dict(kind="t", i=j, page=p, anchor=anchor, ref=None))
    b = [x for x in out if x["kind"] == "b"]
    woven = [x for a in [-1, *range(len(b))] for x in ([b[a]] if a >= 0 else []) + sorted((t for t in out if t["kind"] == "t" and t["anchor"] == a), key=lambda t: (t["page"], t["i"]))]
    for x, nxt in zip(woven, [*woven[1:], None]):
        here = x["i"] if x["kind"] == "b" else x["anchor"]
        follows = nxt is not None and nxt["kind"] == "t" and nxt["anchor"] == here
        x["ref"] = (nxt["i"] if follows else None) if x["kind"] == "b" else (nxt["i"] if follows and nxt["i"] > x["i"] else x["i"])
    return [(x["kind"], x["i"], x["ref"]) for x in woven]


def test_weaving(spark):
    rng, bs, ts, want = random.Random(5), [], [], {}
    for d in range(60):
        pages, tabs = [rng.randint(0, 4) for _ in range(rng.randint(0, 6))], [rng.randint(0, 5) for _ in range(rng.randint(0, 4))]
        bs += [(f"d{d}", i, p, "paragraph", f"b{i}", None) for i, p in enumerate(pages)]
        ts += [(f"d{d}", j, f"t{j}", p) for j, p in enumerate(tabs)]
        if pages or tabs:
            want[f"d{d}"] = model_weave(pages, tabs)
    b = spark.createDataFrame(bs, "doc_slug string, block_index int, page_number int, block_type string, text string, table_ref string")
    t = spark.createDataFrame(ts, "doc_slug string, table_index int, table_id string, page_number int")
    got = {}
    for r in sorted(tables.interleave(b, t).collect(), key=lambda r: (r["doc_slug"], r["seq"])):
        is_b = r["block_type"] == "paragraph"
        i = r["block_index"] if is_b else int(r["text"].removeprefix("[TABLE_REF: t").removesuffix("]"))
        got.setdefault(r["doc_slug"], []).append(("b" if is_b else "t", i, None if r["table_ref"] is None else int(r["table_ref"][1:])))
    assert got == want


def test_tables(spark):
    cell = lambda n, m: [[str(i)] * m for i in range(n)]
    rows = [
        ("d", 0, "table", None, 0, "", ["Actual"], cell(1, 1)),
        ("d", 1, "section_header", 1, 1, "Foreword", None, None),
        ("d", 2, "table", None, 1, "", ["a", "b"], cell(2, 2)),
        ("d", 3, "section_header", 1, 1, "Body", None, None),
        ("d", 4, "table", None, 2, "", [], []),
        ("d", 5, "text", None, 2, "x" * 199, None, None),
        ("d", 6, "table", None, 2, "", ["Target", "b"], cell(51, 2)),
        ("d", 7, "text", None, 2, "y" * 200, None, None),
        ("d", 8, "table", None, 3, "", ["Budget", "Actual"], [["1", None], ["2", "3"]]),
        ("d", 9, "footnote", None, 3, "gone", None, None),
    ]
    items = spark.createDataFrame(rows, files.ITEMS)
    skips = spark.createDataFrame([("d", ["FOREWORD"])], "doc_slug string, skip_sections array<string>")
    out = runs.extraction(items, skips)
    found = {r["table_id"]: r for r in out["tables"].collect()}
    assert sorted(found) == ["d_table_000", "d_table_002", "d_table_003"]
    assert len(found["d_table_002"]["caption"]) == 199 and found["d_table_003"]["caption"] == "" and found["d_table_000"]["caption"] == ""
    c = {r["table_id"]: r for r in out["chunks"].collect()}
    assert sorted(c) == ["d_table_002", "d_table_003"]
    assert c["d_table_002"]["data_type_hint"] == "projection" and c["d_table_003"]["data_type_hint"] == "mixed"
    assert len(c["d_table_002"]["markdown"].splitlines()) == 52 and c["d_table_003"]["markdown"].splitlines()[2] == "| 1 |  |"
    assert c["d_table_003"]["chunk"].startswith("Section: Body\nReference: d_table_003\n\n| Budget")
    assert [r["block_index"] for r in out["blocks"].orderBy("pos").collect()] == [0, 1, 2]


def test_sources_and_streaming(spark, tmp_path):
    from loomline.streaming import ingest

    d = tmp_path / "in"
    d.mkdir()
    for n, body in (("b.pdf", b"one two"), ("a.pdf", b"\xff"), ("c.PDF", b"")):
        (d / n).write_bytes(body)
    found = files.list_files(spark, str(d))
    assert [r["name"] for r in files.by_path(found).collect()] == ["a.pdf", "b.pdf"]
    texts = {r["name"]: (r["text"], r["is_scanned"]) for r in files.page_text(found, lambda c: [c.decode()] * 3, 0, 10).collect()}
    assert texts == {"a.pdf": ("", False), "b.pdf": ("one twoone", True)}
    src = found.select(F.col("name").alias("doc_slug"), "content", (F.col("name") == "b.pdf").alias("is_scanned"))
    make = lambda label: lambda: lambda c: [{"label": label, "text": c.decode(), "page_number": 1}]
    items, errors = files.convert(src, make("text"), make("caption"))
    assert [(r["doc_slug"], r["label"]) for r in items.collect()] == [("b.pdf", "caption")] and [r["doc_slug"] for r in errors.collect()] == ["a.pdf"]
    q = ingest.ingest(ingest.new_files(spark, str(d)), lambda s: s.select("name"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_store_and_read_back(spark, tmp_path):
    rows = [("d", 0, "section_header", 1, 1, "H é", None, None), ("d", 1, "table", None, 1, "", ["a", "a"], [["1", "2"], ["3", "4"]])]
    out = runs.extraction(spark.createDataFrame(rows, files.ITEMS))
    info = spark.createDataFrame([("d", "d.pdf", False), ("e", "e.pdf", True)], "doc_slug string, source_file string, is_scanned boolean")
    sinks.store(sinks.documents(info, out["blocks"], out["tables"]), str(tmp_path / "s"))
    back = {r["doc_slug"]: r for r in files.read_stored(spark, str(tmp_path / "s")).collect()}
    assert back["d"]["blocks"][0]["text"] == "H é" and back["d"]["tables"][0]["rows"] == [["1", "2"], ["3", "4"]] and back["e"]["blocks"] == []


def test_by_document_is_blocks_and_tables(spark):
    rows = [(d, k, label, 1 + k % 3, k // 3 or None, f"{label} {k}" if k % 7 else "", cols, cells)
            for d in ("a", "b") for k, (label, cols, cells) in enumerate([("section_header", None, None), ("text", None, None), ("table", ["x"], [["1"]]), ("caption", None, None), ("table", [], []), ("furniture", None, None), ("table", ["y", "y"], [["2", None]]), ("text", None, None), (None, None, None)])]
    headed = B.with_headings(spark.createDataFrame([*rows, ("c", 0, None, None, None, None, None, None)], files.ITEMS), spark.createDataFrame([("b", ["header 0", "no"])], "doc_slug string, skip_sections array<string>"))
    info = headed.select("doc_slug").distinct()
    want = {r["doc_slug"]: (r["blocks"] or [], [t.asDict() | {"cells": t["cells"].toJson()} for t in r["tables"] or []]) for r in sinks.documents(info, B.blocks(headed), B.tables(headed)).collect()}
    got = sinks.with_full_tables(B.by_document(headed))
    assert {r["doc_slug"]: (r["blocks"], [t.asDict() | {"cells": t["cells"].toJson()} for t in r["tables"]]) for r in got.collect()} == want
    plan = B.by_document(headed)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_slug") == 2  # items and skips
