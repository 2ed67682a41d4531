"""Unit rows of the rules and the passes; invented names."""

from pyspark.sql import functions as F

from loomline.functions import fixed, rules
from loomline.functions import text as T
from loomline.operators import cascade, lookup, progress
from loomline.plans import runs
from loomline.sources import sinks


def detected(spark, rows, overrides=()):
    df = spark.createDataFrame(rows, "filename string, text string")
    over = lookup.override_table(spark, list(overrides)) if overrides else lookup.override_table(spark)
    return {r["filename"]: r for r in cascade.detect(df, over).collect()}


def test_file_names(spark):
    long = "word " * 40
    names = {
        "X Budget Summary 2021-22.pdf": ("budget_summary", "2021_22", "annual"),
        "X Budget Summary 2021-2022.pdf": ("budget_summary", "2021_22", "annual"),
        "X Budget Summary 2015-2022.pdf": ("budget_summary", "unknown", "annual"),
        "MTDS for 2023.pdf": ("debt_management_strategy", "2023_24", "annual"),
        "Economic Survey 2023.pdf": ("economic_survey", "2022_23", "annual"),
        "ngbirr second six months 2020_21.pdf": ("controller_of_budget", "2020_21", "h1"),
        "ngbirr second half 2020_21.pdf": ("controller_of_budget", "2020_21", "h2"),
        "Monetary Policy Statement 16th 2019.pdf": ("cbk_mpc_report", "2018_19", "h1"),
        "Monetary Policy Statement 21st 2019.pdf": ("cbk_mpc_report", "2018_19", "h2"),
        "cbk_2019 things.pdf": ("unknown", "2018_19", "annual"),
    }
    got = detected(spark, [(n, long) for n in names])
    assert {n: (got[n]["type"], got[n]["fy"], got[n]["period"]) for n in names} == names
    assert got["X Budget Summary 2015-2022.pdf"]["review_level"] == "hard"
    assert got["ngbirr second half 2020_21.pdf"]["review_level"] == "none"


def test_text_passes_and_overrides(spark):
    pad = "word " * 40
    got = detected(spark, [
        ("paper a.pdf", pad + "Economic survey. Financial year 2018/19. the second half"),
        ("paper b.pdf", "short"),
        ("paper c.pdf", pad * 20 + "FY 2012/19 but ended 30 June 2020"),
        ("paper d.pdf", pad + "revised   estimates"),
        ("paper e.pdf", None),
    ], [("paper d.pdf", "constitution", "na", None)])
    a, b, c, d = (got[f"paper {x}.pdf"] for x in "abcd")
    assert (a["type"], a["fy"], a["fy_source"], a["period"], a["review_level"]) == ("unknown", "2018_19", "cover", "h2", "hard")  # blanks became dots: that rule cannot fire
    assert b["is_scanned"] and b["review_level"] == "hard"
    assert (c["fy"], c["fy_source"], c["fy_review"]) == ("2019_20", "deep", "soft")
    assert (d["type"], d["fy"], d["type_source"], d["review_level"], d["supersedes_hint"]) == ("constitution", "na", "override", "soft", True)
    assert got["paper e.pdf"]["is_scanned"]


def test_levels_are_zero_filled(spark):
    df = spark.createDataFrame([("none",)], "review_level string")
    assert {r["review_level"]: r["n"] for r in cascade.review_counts(df).collect()} == {"none": 1, "soft": 0, "hard": 0}


def test_scalars(spark):
    df = spark.createDataFrame([(" \u0085 x it's ", "a" * 39 + "-b.tar.gz", 7, "h9")], "s string, n string, l int, b string")
    r = df.select(T.strip(F.col("s")).alias("s"), T.stem(F.col("n")).alias("n"), T.slug(T.stem(F.col("n"))).alias("g"), T.heading_level(F.col("l"), F.col("b")).alias("l"),
                  T.heading_level(F.lit(None).cast("int"), F.col("b")).alias("m"), T.table_id(F.lit("d"), F.lit(1234)).alias("t"), sinks.yaml_string(F.lit("it's")).alias("y")).first()
    assert r["s"] == "x it's" and r["n"] == "a" * 39 + "-b.tar" and r["g"] == "a" * 39 + "_" and (r["l"], r["m"]) == (6, 6) and r["t"] == "d_table_1234" and r["y"] == "'it''s'"


def test_merged_rules_keep_the_order():
    assert rules.merged([("a", "x"), ("b", "x"), ("c", "y"), ("d", "x")]) == [("(?:a)|(?:b)", "x"), ("(?:c)", "y"), ("(?:d)", "x")]
    assert [v for _, v in rules.merged(fixed.FILENAME_TYPES)][0] == "pure_tables"


def test_progress(spark):
    ev = spark.createDataFrame([("a", "failed", 1.0, "e", 1), ("a", "completed", 2.0, None, 2), ("b", "completed", 1.0, None, 1), ("b", "failed", 1.0, "x" * 300, 3), ("c", "skipped", 0.0, "gone", 1)],
                               "file string, status string, elapsed double, error string, t long").withColumn("ts", F.timestamp_seconds("t"))
    docs = spark.createDataFrame([("a", 1), ("b", 2), ("c", 8), ("d", None)], "filename string, category int")
    assert {r["filename"] for r in progress.pending(docs, ev).collect()} == {"b", "c", "d"}
    assert progress.pending(docs, ev, force=True).count() == 4
    files = spark.createDataFrame([("b",), ("c",), ("d",)], "name string")
    assert [r["filename"] for r in runs.resumed(docs, ev, files).collect()] == ["b", "c", "d"]
    s = progress.summary(ev).first()
    assert (s["completed"], s["failed"], s["skipped"]) == (1, 1, 1)
    assert max(len(r["error"] or "") for r in progress.latest(ev).collect()) == 200
