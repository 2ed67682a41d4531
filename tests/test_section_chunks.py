"""Chunks of woven documents against a sequential model."""

import random
import re

import pytest

from loomline.operators import chunking, tables
from loomline.plans import runs

CONFIG = {
    "narrative": ("paragraph", 12, 3), "tables_only": ("row", 10, 0), "legal": ("clause", 9, 5), "audit_findings": ("finding", 11, 4), "hybrid": ("token", 8, 2),
}


def items(rng, n):
    """Rows (doc_slug, pos, label, level, page_number, text, columns, rows): headings, prose of several lines, tables of one row or more."""
    out = []
    for d in range(n):
        for pos in range(rng.randint(0, 12)):
            label = rng.choice(["section_header", "text", "text", "list_item", "table", "caption", "footer"])
            text = "".join(f"{rng.choice(['alpha', 'be', 'c'])}{rng.choice([' ', ' ', '. ', '; ', chr(10), chr(10) * 2, chr(10) + '  '])}" for _ in range(rng.randint(0, 30)))
            table = label == "table"
            out.append((f"d{d}", pos, label, rng.randint(1, 4), pos // 2, None if table else text, ["a", "Budget b"] if table else None, [[str(i), "x y"] for i in range(rng.randint(0, 4))] if table else None))
    return out


def model(rows, strategy, least, most, part_tokens):
    """The chunks of one document, one block after the other."""
    by, size, overlap = CONFIG[strategy]
    stream, path, index, last_text = [], [], 0, ""
    for _, pos, label, level, page, text, columns, cells in sorted(rows, key=lambda r: r[1]):
        text = (text or "").strip()
        if label == "section_header" and text:
            path = [*path[: level - 1], text]
        if label == "table":
            if cells:
                cap = last_text if len(last_text) < 200 else ""
                stream.append({"kind": "table", "page": page, "id": f"{rows[0][0]}_table_{index:03d}", "path": path, "rows": cells, "cap": cap})
            index += 1
        elif label != "footer" and text:
            last_text = text
            stream.append({"kind": "heading" if label == "section_header" else "prose", "page": page, "text": text, "path": path})
    # A marker stands behind the last block whose page is not beyond its own.
    blocks, woven = [x for x in stream if x["kind"] != "table"], []
    places = [(-1, []), *[(i, []) for i in range(len(blocks))]]
    for t in (x for x in stream if x["kind"] == "table"):
        at = max([i for i, b in enumerate(blocks) if b["page"] <= t["page"]], default=-1)
        places[at + 1][1].append(t)
    for i, found in places:
        woven += ([blocks[i]] if i >= 0 else []) + sorted(found, key=lambda t: (t["page"], t["id"]))
    chunks, section, own = [], [], []
    path = []
    for seq, x in enumerate(woven):
        if x["kind"] == "heading":
            section.append((path, own))
            own = []
        if x["kind"] != "table":
            path = x["path"]
        if x["kind"] == "table":
            texts = [f"[TABLE_REF: {x['id']}]"]
        elif x["kind"] == "heading":
            texts = [x["text"]]
        else:
            texts = re.findall(chunking.UNITS[by], x["text"])
        u = 0
        for t in texts:
            w = re.findall(chunking.WORD, t)
            for a in range(0, len(w), size):
                own.append((seq, u, w[a : a + size], x["id"] if x["kind"] == "table" else None))
                u += 1
        if x["kind"] == "table" and strategy in ("tables_only", "hybrid") and len(x["rows"]) >= 2:
            head = ([f"Section: {' > '.join(x['path'])}"] if x["path"] else []) + ([f"Table: {x['cap']}"] if x["cap"] else []) + [f"Reference: {x['id']}", "", "| a | Budget b |", "| --- | --- |"]
            body = "\n".join(head + [f"| {a} | {b} |" for a, b in x["rows"]])
            chunks.append((seq, 0, 1, x["path"], [x["id"]], len(re.findall(chunking.WORD, body)), body))
    section.append((path, own))
    for path, own in section if strategy != "tables_only" else []:
        parts, before = {}, 0
        for unit in own:
            parts.setdefault(before // part_tokens, []).append(unit)
            before += len(unit[2])
        for part in parts.values():
            done, now = [], []
            count = lambda us: sum(len(x[2]) for x in us)
            for unit in part:
                if count([*now, unit]) > size:
                    done.append(now)
                    keep = now
                    while count(keep) > overlap or count([*keep, unit]) > size or keep is now:
                        keep = keep[1:]
                        if not keep:
                            break
                    now = keep
                now = [*now, unit]
            if done and count(now) < least and count(both := done[-1] + [x for x in now if x not in done[-1]]) <= most:
                done[-1] = both
            else:
                done.append(now)
            for c in done:
                chunks.append((c[0][0], c[0][1], 0, path, [x[3] for x in c if x[3]], count(c), "\n".join(" ".join(x[2]) for x in c)))
    return [(i, strategy, *c[3:]) for i, c in enumerate(sorted(chunks, key=lambda c: c[:3]))]


@pytest.mark.parametrize(("seed", "part_tokens"), [(1, 100_000), (2, 25), (3, 100_000)])
def test_same_as_the_model(spark, seed, part_tokens):
    rng = random.Random(seed)
    rows = items(rng, 60)
    names = sorted({r[0] for r in rows})
    config = [(d, s := rng.choice(list(CONFIG)), *CONFIG[s]) for d in names]
    df = spark.createDataFrame(rows, "doc_slug string, pos int, label string, level int, page_number int, text string, columns array<string>, rows array<array<string>>")
    docs = spark.createDataFrame(config, "doc_slug string, chunking_strategy string, chunk_by string, chunk_size int, chunk_overlap int")
    e = runs.extraction(df)
    woven = tables.interleave(e["blocks"], e["tables"], carry=("heading_path",))
    got = {}
    for r in chunking.section_chunks(woven, e["chunks"], docs, 4, 14, part_tokens).collect():
        got.setdefault(r["doc_slug"], []).append(tuple(r)[1:])
    for d, strategy, *_ in config:
        want = model([r for r in rows if r[0] == d], strategy, 4, 14, part_tokens)
        assert sorted(got.get(d, [])) == want


def test_woven_rows_are_the_same_with_more_columns(spark):
    df = spark.createDataFrame(items(random.Random(4), 20), "doc_slug string, pos int, label string, level int, page_number int, text string, columns array<string>, rows array<array<string>>")
    e = runs.extraction(df)
    plain = e["woven"]
    more = tables.interleave(e["blocks"], e["tables"], carry=("heading_path",))
    assert more.columns == [*plain.columns, "table_id", "heading_path"]
    assert sorted(map(str, more.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_slug string, pos int, label string, level int, page_number int, text string, columns array<string>, rows array<array<string>>")
    docs = spark.createDataFrame([], "doc_slug string, chunking_strategy string, chunk_by string, chunk_size int, chunk_overlap int")
    assert runs.chunked(runs.extraction(df), docs).collect() == []
