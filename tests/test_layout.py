"""No registered query depends on how its tables are dealt over files."""

import pytest

from loomline.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "nation embeddings customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def dealt(spark, tmp_path_factory):
    """The tables in another order, over seven files."""
    to = tmp_path_factory.mktemp("dealt")
    for t in TABLES:
        df = spark.read.parquet(f"{SF}/{t}.parquet")
        df.repartition(7, df.columns[-1]).sortWithinPartitions(df.columns[-1], ascending=False).write.parquet(f"{to}/{t}.parquet")
    return str(to)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_same_rows(spark, dealt, name):
    rows = lambda sf: sorted(map(str, catalog.queries()[name](spark, sf).collect()))
    assert rows(dealt) == rows(SF)
