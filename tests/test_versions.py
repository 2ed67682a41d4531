"""Chains and circles of supersession against following them one by one."""

import random

import pytest

from loomline.operators import versions
from loomline.plans import runs
from loomline.sources import sinks

SCHEMA = "filename string, supersedes string, n_newer int"


def model(rows):
    names = {f for f, _ in rows if f is not None}
    after = {}
    for f, s in rows:
        if f is not None and s is not None and f != s and s in names:
            after[s] = max(f, after.get(s, f))
    out = []
    for f in names:
        path = [f]
        while path[-1] in after and after[path[-1]] not in path:
            path.append(after[path[-1]])
        circle = path[-1] in after
        new = max(path[path.index(after[path[-1]]) :]) if circle else path[-1]
        out.append((f, after.get(f), new, None if circle else len(path) - 1, circle))
    return sorted(map(str, out))


def got(spark, rows):
    return sorted(str(tuple(r)) for r in versions.newest(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)).collect())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 9, 33])
def test_chains_and_circles_of_every_length(spark, n):
    rows = [("a0", None)] + [(f"a{i}", f"a{i - 1}") for i in range(1, n + 1)]
    rows += [(f"c{i}", f"c{(i + 1) % n}") for i in range(n)] + [("in", None), ("c0", "in"), (None, "a0"), ("lone", "lone"), ("gone by", "not there")]
    assert got(spark, rows) == model(rows)


def test_any_links(spark):
    rng = random.Random(6)
    rows = [(f"f{rng.randint(0, 150)}", rng.choice([None, *[f"f{rng.randint(0, 150)}"] * 3])) for _ in range(200)]
    assert got(spark, rows) == model(rows)


def test_no_rows(spark):
    assert got(spark, []) == []


def test_entries_name_what_supersedes_them(spark):
    d = spark.createDataFrame([("Budget 2019.pdf", "x"), ("Budget 2020.pdf", "x"), ("Other's.pdf", "x")], "filename string, text string")
    revisions = spark.createDataFrame([("Budget 2020.pdf", "Budget 2019.pdf")], "filename string, supersedes string")
    entries = {r["filename"]: r["entry"].splitlines() for r in sinks.config_lines(runs.superseding(runs.configuration(d), revisions)).collect()}
    line = lambda f, key: next(x.strip() for x in entries[f] if x.strip().startswith(key + ":"))
    assert line("Budget 2019.pdf", "superseded_by") == "superseded_by: 'Budget 2020.pdf'" and line("Budget 2019.pdf", "supersedes") == "supersedes: null"
    assert line("Budget 2020.pdf", "supersedes") == "supersedes: 'Budget 2019.pdf'" and line("Other's.pdf", "superseded_by") == "superseded_by: null"
