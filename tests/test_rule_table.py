"""Rules as rows against the chain of branches, and how many patterns are tried."""

import random
import re

from pyspark.sql import functions as F

from loomline.functions import fixed, rules
from loomline.operators import rule_table


def test_what_a_pattern_needs():
    n = rule_table.needed
    assert n("economic.survey") == ["economic"] and n(r"budget.?review.*outlook") == ["outlook"] and n("finance act|bill of finance") == ["finance act", "bill of finance"]
    assert n(r"\d{4}") == n("ab") == n("(?:abc)?") == n("abc|x") == n("(?i)abcd") == n("[abc]def?") == [] and n("(?:abcd)+x*(?=zzz)") == ["abcd"] and n("(") == []
    assert n(r"(mid|end).?year") == ["year"] and sorted(n("x(?:aaaa|bbbb)y")) == ["aaaa", "bbbb"] and n(r"^cover\.page$") == ["cover.page"]


def test_needed_runs_are_in_every_text_that_is_found():
    rng = random.Random(2)
    parts = ["abc", "de", "f", ".", "x?", "(?:gh|ijk)", "[lm]", "n+", "(?:opq){2}", r"\s", ".*", "|", "rst"]
    for _ in range(3000):
        p = "".join(rng.choice(parts) for _ in range(rng.randint(1, 6)))
        try:
            found = re.compile(p)
        except re.error:
            continue
        run = rule_table.needed(p)
        for _ in range(5):
            t = "".join(rng.choice(["abc", "de", "f", "gh", "ijk", "l", "n", "opqopq", " ", "rst", "z"]) for _ in range(8))
            assert not run or not found.search(t) or any(x in t for x in run)


def test_same_as_the_chain(spark):
    rng = random.Random(4)
    ordered = [*fixed.COVER_TYPES, *fixed.FILENAME_TYPES, (r"q\d", "no run"), ("zz", "short"), ("ab|cdef", "half")]
    rng.shuffle(ordered)
    pool = [w for p, _ in ordered for w in re.findall("[a-z]{2,}", p)] + ["q7", "zz", " ", ".", "_", "é", "\n"]
    texts = [(i, rng.choice([" ", ".", ""]).join(rng.choice(pool) for _ in range(rng.randint(0, 9)))) for i in range(400)] + [(900, None), (901, ""), (902, "x"), (903, "budget.summary " * 3000)]
    df = spark.createDataFrame([(*t, "p", 1) for t in texts], "id long, t string, pattern string, priority int").repartition(3)
    table = rule_table.table(spark, ordered)
    want = {r["id"]: r["w"] for r in df.select("id", rules.first_match(F.col("t"), ordered).alias("w")).collect()}
    got = rule_table.first_of(df, table, "id", "t").collect()
    assert {r["id"]: r["label"] for r in got} == want and len(got) == len(texts) and sum(v is not None for v in want.values()) > 100
    # A chain tries every pattern up to the first that is found; here most are never tried.
    tried = rule_table.tried(df, table, "id", "t").count()
    assert tried < len(ordered) * len(texts) / 4
    assert rule_table.first_of(df, table.limit(0), "id", "t").filter("label IS NOT NULL").count() == 0 and rule_table.first_of(df.limit(0), table, "id", "t").count() == 0


def test_more_grams_than_are_compared_first(spark, monkeypatch):
    monkeypatch.setattr(rule_table, "MOST_GRAMS", 2)
    df = spark.createDataFrame([(1, "an economic survey"), (2, "the finance act"), (3, "none")], "id long, t string")
    got = rule_table.first_of(df, rule_table.table(spark, [("survey", "a"), ("finance", "b"), ("act", "c"), ("economic", "d")]), "id", "t").collect()
    assert sorted(map(tuple, got)) == [(1, "a"), (2, "b"), (3, None)]
