"""Whole runs: the golden names, the cache, progress, chunks, previews, environments."""

import datetime
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomline.functions import fixed
from loomline.functions import text as T
from loomline.operators import cache, cascade, chunking, lookup, progress, retrieval, tables
from loomline.plans import runs
from loomline.sources import environment, files, sinks


def test_golden_names(spark):
    """Type, year, period, level and sources of every file name that needs no text."""
    lines = (Path(__file__).parent / "golden_names.txt").read_text().splitlines()[1:]
    want = {f: rest for f, *rest in (x.split(" | ") for x in lines)}
    assert len(want) == 142
    d = spark.createDataFrame([(f,) for f in want], "filename string")
    got = cascade.detect(d, lookup.override_table(spark), text=None).collect()
    assert {r["filename"]: [r["type"], r["fy"], r["period"], r["review_level"], f"{r['type_source']} {r['fy_source']} {r['period_source']}"] for r in got} == want


@pytest.mark.parametrize("compacted", [False, True])
def test_runs_convert_only_what_is_not_stored(spark, tmp_path, compacted):
    raw, out = tmp_path / "raw", str(tmp_path / "stored")
    out = files.stored_snapshots(spark, out, parts=2) if compacted else out
    raw.mkdir()
    # Two names whose slugs are the same, and a file that fails.
    long = "a" * 45
    for n, body in ((f"{long} 1.pdf", b"one"), (f"{long} 2.pdf", b"two"), ("bad.pdf", b"\xff")):
        (raw / n).write_bytes(body)
    config = spark.createDataFrame([(f"{long} 1.pdf", False, ["skip me"]), (f"{long} 2.pdf", True, []), ("bad.pdf", False, []), ("gone.pdf", False, [])], "filename string, is_scanned boolean, skip_sections array<string>")
    log = tmp_path / "log"
    log.mkdir()

    def make(kind):
        def converter():
            def convert(content):
                text = content.decode()
                (log / f"{kind}-{text}-{random.random()}").touch()
                yield {"label": "Section_Header", "text": "Skip me now", "page_number": 1}
                yield {"label": "text", "text": f"{kind} {text}", "page_number": 2}
                yield {"label": "table", "columns": ["x", "x"], "rows": [["1", "2"], ["3", "4"]], "page_number": 2}

            return convert

        return converter

    def run(n, force=False):
        rows = runs.extract(config, files.list_files(spark, str(raw)), make("plain"), make("ocr"), out, force, n).collect()
        return {r["source_file"]: r for r in rows}

    first = run(1)
    assert set(first) == {f"{long} 1.pdf", f"{long} 2.pdf", "bad.pdf"} and "decode" in first["bad.pdf"]["error"]
    assert first[f"{long} 1.pdf"]["blocks"] == [] and [b["text"] for b in first[f"{long} 2.pdf"]["blocks"]] == ["Skip me now", "ocr two"]
    t = first[f"{long} 2.pdf"]["tables"][0]
    assert t["markdown"].splitlines()[0] == "| x | x |" and t["records"] == [{"x": "2"}, {"x": "4"}] and t["rows"] == [["1", "2"], ["3", "4"]] and json.loads(t["cells"].toJson()) == [[1, 2], [3, 4]]
    assert first[f"{long} 2.pdf"]["total_pages"] == 2 and first[f"{long} 1.pdf"]["doc_slug"] != first[f"{long} 2.pdf"]["doc_slug"]
    done = len(list(log.iterdir()))
    assert done == 2
    (raw / "bad.pdf").write_bytes(b"good now")
    second = run(2)
    assert len(list(log.iterdir())) == done + 1 and second["bad.pdf"]["error"] is None and second["bad.pdf"]["run"] == 2
    third = run(3, force=True)
    assert len(list(log.iterdir())) == done + 4 and {r["run"] for r in third.values()} == {3} and len(third) == 3
    one = runs.extract_single(spark, str(raw / f"{long} 1.pdf"), make("single"))
    assert [r["text"] for r in one["blocks"].orderBy("pos").collect()] == ["Skip me now", "single one"] and one["pages"].first()["total_pages"] == 2
    shown = runs.preview(one)
    assert {k: v.count() for k, v in shown.items()} == {"blocks": 2, "tables": 1, "chunks": 1, "markers": 1}


def test_cache_of_failed_and_forced(spark):
    docs = spark.createDataFrame([("a.pdf",), ("b.pdf",), ("c.pdf",)], "filename string")
    stored = cache.keyed(spark.createDataFrame([("a.pdf", None), ("b.pdf", "broke")], "filename string, error string"))
    hits, misses = cache.split(docs, stored)
    assert [r["filename"] for r in hits.collect()] == ["a.pdf"] and sorted(r["filename"] for r in misses.collect()) == ["b.pdf", "c.pdf"]
    hits, misses = cache.split(docs, stored, force=True)
    assert hits.count() == 0 and misses.count() == 3


def test_progress_state_and_report(spark, tmp_path):
    path = str(tmp_path / "events")
    assert progress.read_events(spark, path).count() == 0
    t = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc)
    for rows in ([("a", "failed", 30.0, "x" * 150, t(10)), ("b", "completed", 60.0, None, t(20))], [("a", "completed", 90.0, None, t(100)), ("c", "failed", 12.0, "e", t(110)), ("d", "skipped", 0.0, "gone", t(120))]):
        sinks.append_events(spark.createDataFrame(rows, progress.SCHEMA), path)
    events = progress.read_events(spark, path)
    s = progress.session(events, F.timestamp_seconds(F.lit(50))).first()
    assert (s["done"], s["skip"], s["fail"], s["minutes"]) == (1, 1, 1, 1.7)
    lines = [r["line"] for r in progress.report(events, F.timestamp_seconds(F.lit(50))).orderBy("line_no").collect()]
    assert lines[0] == "Session complete: 1.7 min" and lines[4] == "  Overall: completed=2 failed=1 skipped=1" and lines[5:] == ["  c: e"]


def test_numbers_without_a_global_sort(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["p", "q", None]), rng.choice([None, 0, 1, 2, 8, 30]), "".join(rng.choice("abé") for _ in range(rng.randint(0, 7))) + str(i)) for i in range(300)]
    d = spark.createDataFrame(rows, "lane string, category int, filename string").withColumn("r", lookup.work_rank())
    rank = {r["filename"]: r["r"] for r in d.collect()}
    got = {r["filename"]: r["n"] for r in lookup.numbered(d, ["lane"], "r", "filename").collect()}
    for lane in ("p", "q", None):
        own = sorted((f for x, _, f in rows if x == lane), key=lambda f: (rank[f], f.encode()))
        assert [got[f] for f in own] == list(range(1, len(own) + 1))
    every = {r["filename"]: r["n"] for r in lookup.in_run_order(d).collect()}
    assert sorted(every, key=every.get) == [r["filename"] for r in lookup.in_work_order(d).collect()]


def test_chunks(spark):
    unit = "w " * 60
    rows = [("a", "\n\n".join([unit] * 5), "paragraph", 120, 0), ("b", "x " * 1300, "row", 500, 0), ("c", "  ", "row", 10, 0), ("d", None, "row", 10, 0), ("e", "one; two. three", "clause", 2, 1), ("f", "1. p\n  q\n2. r", "finding", 2, 0)]
    d = spark.createDataFrame(rows, "doc_slug string, text string, chunk_by string, chunk_size int, chunk_overlap int")
    got = {}
    for r in chunking.chunk(d, least=100).orderBy("doc_slug", "chunk_index").collect():
        got.setdefault(r["doc_slug"], []).append(r["n_tokens"])
    assert got == {"a": [120, 180], "b": [500, 500, 300], "e": [2, 2], "f": [3, 2]}
    small = [r["chunk"] for r in chunking.chunk(d.filter("doc_slug in ('e', 'f')"), least=1).orderBy("doc_slug", "chunk_index").collect()]
    assert small == ["one;\ntwo.", "two.\nthree", "three", "1. p q", "2. r"]


def test_current_and_weighted(spark):
    docs = spark.createDataFrame([("a", True, None, 1.0), ("b", None, "c", 2.0), ("c", True, None, 9.0), ("d", False, "e", 9.0), ("e", True, None, 1.0)], "filename string, index boolean, supersedes string, rag_weight double")
    assert sorted(r[0] for r in retrieval.current(docs).collect()) == ["a", "b"]
    hits = spark.createDataFrame([(1, "a", 0.8), (1, "b", 0.4), (1, "c", 1.0), (1, "d", 1.0)], "query_id long, filename string, score double")
    assert [tuple(r) for r in retrieval.weighted(hits, docs, 2).orderBy("rank").collect()] == [(1, 1, "a", 0.8), (1, 2, "b", 0.8)]


def test_environment(tmp_path):
    (tmp_path / "m" / "x").mkdir(parents=True)
    (tmp_path / "m" / "y").mkdir()
    (tmp_path / "m" / "y" / "f.pdf").touch()
    m, root = str(tmp_path / "m"), str(tmp_path)
    assert environment.resolve(root=root).raw_dir == f"{root}/data/raw" and environment.resolve(root=root, mounted=f"{root}/no").name == "local"
    e = environment.resolve(mounted=m, work_dir="/w", root=root)
    assert (e.name, e.raw_dir, e.cache_dir, e.log_dir) == ("cluster", f"{m}/y", "/w/cache", "/w")
    assert environment.resolve("/r", "/c", mounted=m, root=root).raw_dir == "/r"


def test_written_configuration(spark, tmp_path):
    d = spark.createDataFrame([("b it's 2020-21.pdf", "x"), ("a.pdf", "x")], "filename string, text string")
    sinks.write_config(runs.configuration(d), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text.startswith("pipeline:\n") and text.index("- filename: 'a.pdf'") < text.index("- filename: 'b it''s 2020-21.pdf'")
    back = files.read_config(spark, text).collect()
    assert [r["filename"] for r in back] == ["a.pdf", "b it's 2020-21.pdf"] and back[1]["fiscal_year"] == "2020_21" and back[0]["language"] == "english"
    assert files.read_config(spark, "pipeline:\n").count() == 0


def test_first_directory_and_rounding(spark, tmp_path):
    for n in ("b/2.pdf", "a/1.pdf", "a/0.pdf"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_bytes(b"x")
    found = files.first_directory(files.list_files(spark, str(tmp_path), recursive=True))
    assert [r["name"] for r in files.by_path(found).collect()] == ["0.pdf", "1.pdf"]
    d = spark.createDataFrame([(x,) for x in (0.25, 0.35, 12.04, 1.26, 7.0)], "x double")
    assert [r[0] for r in d.select(T.tenth(F.col("x"))).collect()] == [0.2, 0.4, 12.0, 1.3, 7.0]
    assert fixed.PREVIEW["blocks"] == 5


def test_typed_cells_keep_what_they_are(spark):
    cells = ["1", "-2.50", "007", "1e3", "", None, "true", 'say "x"\\', '{"a": [1, null]}', "[1, 2", "{", "é\n", "9" * 30, "[]", "0.1"]
    df = spark.createDataFrame([([cells, [], [None]],), ([],), (None,)], "rows array<array<string>>")
    got = df.select(tables.typed(F.col("rows")).alias("v")).select(F.to_json(F.struct("v")).alias("j"), F.col("v").cast("array<array<variant>>").alias("c")).collect()
    first = json.loads(got[0]["j"])["v"]
    want = [1, -2.5, "007", "1e3", "", None, "true", 'say "x"\\', {"a": [1, None]}, "[1, 2", "{", "é\n", "9" * 30, [], 0.1]
    assert first == [want, [], [None]] and len(got[0]["c"]) == 3 and json.loads(got[1]["j"])["v"] == [] and got[2]["c"] is None
