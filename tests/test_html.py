"""The page scanner on pages of every shape."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from loomline.plans import runs
from loomline.sources import files, html


def of(page):
    out = []
    for x in html.convert(page):
        assert x["page_number"] == 1
        out.append((x["label"], *([x["level"]] if x.get("level") else []), *([x["columns"], x["rows"]] if "columns" in x else [x["text"]])))
    return out


def test_blocks():
    page = "<!doctype html><title>T &lt;1&gt;</title><script>if (a<b) '</p>'</script><BODY>loose <h3 class='x'>A <b>b</b>ig</h3>one<br>two<p>p1<p>p2 &amp; é<ul><li>x<li><p>y</ul><!-- <p>no --><pre>a\n b</pre>tail"
    assert of(page) == [("title", "T <1>"), ("text", "loose"), ("section_header", 3, "A big"), ("text", "one two"), ("text", "p1"), ("text", "p2 & é"), ("list_item", "x"), ("text", "y"), ("text", "a b"), ("text", "tail")]


def test_furniture_and_what_breaks_off():
    assert of("<nav><ul><li>a<nav><p>b</nav><h1>c</h1></nav></nav><p>d<footer>e") == [("furniture", "a"), ("furniture", "b"), ("furniture", "c"), ("text", "d"), ("furniture", "e")]
    assert of("<p>a<!-- b") == of("<p>a<script>b") == of("<p>a<b class=") == of("a</") == [("text", "a")]
    assert of("1 < 2 <3 > x") == [("text", "1 < 2 <3 > x")] and of("") == of("<p></p> \n") == of("<") == [] or of("<") == [("text", "<")]
    assert of("<svg><text>no</svg>yes<style/>and") == [("text", "yesand")]
    assert of("İ<P>x</P>İ") == [("text", "İ"), ("text", "x"), ("text", "İ")]


def test_tables():
    page = """<p>before<table><caption>Cap <i>t</i></caption><thead><tr><th rowspan=2>k<th colspan="2">both</tr><tr><th>a</th><th>b</th></tr></thead>
      <tr><td rowspan=2>1<td><p>x</p><p>y</p></td><td>z</tr><tr><td colspan=2>w</tr><tr></tr><tr><td>last</table>after"""
    assert of(page) == [("text", "before"), ("caption", "Cap t"), ("table", ["k", "both a", "both b"], [["1", "x y", "z"], ["1", "w", "w"], ["last", "", ""]]), ("text", "after")]
    assert of("<table><tr><td>a<td>b<tr><td>1<td>2") == [("table", ["a", "b"], [["1", "2"]])]
    assert of("<table><tr><td>a<table><tr><td>in<td>ner</table>b</table>") == [("table", ["a in ner b"], [])]
    assert of("<table></table>") == [("table", [], [])] and of("<td>cell</td>") == [("text", "cell")]
    assert of("<table><tr><td colspan=0>a<td rowspan=5000>b</table>") == [("table", ["a", "b"], [])]


def test_any_soup_keeps_all_words():
    rng = random.Random(1)
    tags = ["<p>", "</p>", "<h2>", "</h2>", "<table>", "</table>", "<tr>", "<td rowspan=2>", "<th colspan=3>", "<li>", "<ul>", "<nav>", "</nav>", "<br>", "<caption>", "</caption>", "<b>", "</b>", "<", ">", "&", "&amp", "<!--x-->", "</td>"]
    for k in range(400):
        page = "".join(rng.choice(tags) if rng.random() < 0.6 else f" w{i} " for i in range(rng.randint(0, 40)))
        got = of(page)
        assert all(len(x) >= 2 for x in got)
        texts = [t for x in got for t in ([x[-1]] if not isinstance(x[-1], list) else [*x[1], *(c for line in x[2] for c in line)])]
        assert {w for t in texts for w in t.split() if w[0] == "w"} == {w for w in re.sub("<[a-z/!][^>]*>", " ", page).split() if w[0] == "w"}
        plain = [w for x in got if not isinstance(x[-1], list) for w in x[-1].split() if w[0] == "w"]
        assert page.count("<table>") > 1 or plain == sorted(plain, key=lambda w: int(w[1:]))


def test_a_very_long_page_takes_linear_time():
    began = time.time()
    assert len(of("<p>word " * 200_000)) == 200_000
    assert len(of("<" * 200_000)) == 1 and len(of("<p <" * 100_000)) == 0 and len(of("<table><tr>" + "<td>x" * 100_000)) == 1
    assert time.time() - began < 60


def test_pages_through_an_extraction(spark, tmp_path):
    """As rows of a table, and as files through the converter of a run."""
    page = "<h1>Top</h1><p>Intro<h2>Part</h2><table><tr><th>Actual<th>x<tr><td>1<td>2<tr><td>3<td>4</table>"
    df = spark.createDataFrame([(1, page, "s"), (2, None, "s"), (3, "", "s")], "id long, page string, text string")
    e = runs.extraction(html.items(df, "id", "page"))
    assert [(r["text"], r["heading_path"]) for r in e["blocks"].orderBy("pos").collect()] == [("Top", ["Top"]), ("Intro", ["Top"]), ("Part", ["Top", "Part"])]
    c = e["chunks"].first()
    assert c["heading_path"] == ["Top", "Part"] and c["caption"] == "Part" and (c["shape"]["rows"], c["shape"]["cols"]) == (2, 2)
    (tmp_path / "a.html").write_text(page)
    config = spark.createDataFrame([("a.html", False, [])], "filename string, is_scanned boolean, skip_sections array<string>")
    make = lambda: html.convert
    row = runs.extract(config, files.list_files(spark, str(tmp_path), ".html"), make, make, str(tmp_path / "out")).first()
    assert [b["text"] for b in row["blocks"]] == ["Top", "Intro", "Part"] and row["tables"][0]["columns"] == ["Actual", "x"] and row["total_pages"] == 1
    assert html.items(df.limit(0), "id", "page").filter(F.lit(True)).count() == 0


def test_items_of_many_pages_share_a_frame(monkeypatch):
    """Frames are bounded by rows and letters, keep the order, and hold what single rows held."""
    rows = [{"doc_slug": f"d{k // 3}", "pos": k % 3, "label": "text", "page_number": 1, "text": "x" * (k % 5)} for k in range(100)]
    whole = list(files.in_frames(iter(rows)))
    assert len(whole) == 1 and len(whole[0]) == 100
    monkeypatch.setattr(files, "FRAME_ROWS", 7)
    some = list(files.in_frames(iter(rows)))
    assert [len(f) for f in some] == [7] * 14 + [2]
    assert [s for f in some for s in f["doc_slug"]] == [r["doc_slug"] for r in rows]
    monkeypatch.setattr(files, "FRAME_CHARS", 1)
    assert max(f["text"].str.len().sum() for f in files.in_frames(iter(rows))) <= 5
    assert list(files.in_frames(iter([]))) == []


def test_pages_are_scanned_once(spark, tmp_path):
    """Blocks, tables and names of page_documents read items that were written, not the pages again."""
    from loomline.plans import catalog

    plan = catalog.page_documents(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan


CUT = ['"', "&", "&q", "&quo", "&quot", "&quot;", "&quot;&quot", "&quotes", "&amp;quot", "&am", "&amp", "&copy", "&middot &copy; &quot x"]


def test_references_that_are_cut_off():
    assert [of(f"<p>a {x}</p>")[0][1] for x in ("&quot", "&quot;&quot", "&quotes;", "&amp;quot", "&amp", "&copy")] == ["a &quot", 'a "&quot', "a &quotes;", "a &quot", "a &", "a ©"]
    assert of("<table><tr><td>&quot<td>&quot;</table>") == [("table", ["&quot", '"'], [])]


@pytest.mark.parametrize("name", ["page_items", "page_documents"])
def test_cut_references_are_those_of_the_sql(spark, tmp_path, name):
    from loomline.plans import catalog

    rows = [(k, f"<html><head><title>t {x}</title></head><body><h1>h {x}</h1><p>one {x} two<li>{x}</body></html>") for k, x in enumerate(CUT)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(str, map(tuple, catalog.queries()[name](spark, str(tmp_path)).select(*names).collect()))) == sorted(map(str, want.fetchall()))
