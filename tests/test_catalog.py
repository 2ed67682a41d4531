"""Every registered query of the library's own operators against its SQL."""

import duckdb
import pytest

from loomline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    r = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(x[names.index(c)]) for c in cols) for x in r.fetchall())
    assert got == want


def test_config_entries(spark):
    rows = catalog.queries()["config_entries"](spark, SF).collect()
    assert len(rows) == 200
    assert all("  - filename: '" in r["entry"] and r["entry"].rstrip().splitlines()[-1].startswith("    # resolved: ") for r in rows)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert {r["review_level"] for r in e.entry(spark).collect()} == {"none", "soft", "hard"}
    assert set(e.oracle_sql()) <= set(e.queries())


def test_lines_meet_once_and_without_their_rows(spark):
    """Tables' rows are far larger than the lines they come from: they are made after the only shuffle and the last sort."""
    plan = catalog.table_markdown(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    below = plan[min(k for k in (plan.find("Exchange hashpartitioning"), plan.find("Sort [doc_slug")) if k >= 0) :]
    assert plan.count("Exchange hashpartitioning") == 1
    assert "array_repeat" in plan and "array_repeat" not in below
