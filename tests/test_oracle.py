"""Every query with SQL equals DuckDB's result; the others give rows."""

import pytest
from check_oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries
from flowmill.catalog import QUERIES

@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def own(names) -> list[str]:
    """Queries of the library itself; those of its subpackages have tests beside them."""
    return sorted(n for n in names if n in QUERIES)


@pytest.mark.parametrize("name", own(oracle_sql()))
def test_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name) is None


def test_every_query_has_sql():
    assert own(set(queries()) - set(oracle_sql())) == []


def test_entry(spark):
    df = entry(spark)
    assert df.columns[0] == "event_id" and df.columns[-1] == "attack" and len(df.columns) == 16
    assert df.count() == 600


def test_published_counts(spark):
    """Known values of the labeller and the matrix at sf0.01."""
    matrix = queries()["confusion"](spark, "/root/testdata/sf0.01").collect()
    cells = {(r["label"], r["prediction"]): r["n"] for r in matrix}
    assert [[cells[i, j] for j in range(6)] for i in range(6)] == [
        [182, 256, 668, 549, 5, 7], [228, 319, 484, 622, 4, 10], [166, 257, 663, 570, 4, 7],
        [229, 276, 525, 620, 4, 13], [182, 224, 710, 540, 3, 7], [228, 280, 513, 630, 2, 13],
    ]
    sample = queries()["sample_stratified"](spark, "/root/testdata/sf0.01").collect()
    assert (len(sample), sum(r["event_id"] for r in sample)) == (1998, 10341636)
