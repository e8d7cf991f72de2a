"""Every registered query against its SQL in DuckDB; the others must give rows."""

import pytest
from compare import compare, connect
from foliospark import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_matches_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).limit(1).count() == 1


def test_approximate_search_recall(spark, sf_dir):
    """Nine of ten exact neighbours for every question, from the vectors of a quarter of the rows."""
    found = QUERIES["approx_vector_search"](spark, sf_dir)
    assert found.filter("NOT (found_nine AND few_vectors)").count() == 0 < found.count()


def test_second_ingest_run_has_nothing_to_do(spark, sf_dir):
    rows = QUERIES["ingest_pages"](spark, sf_dir).collect()
    assert [r["status"] for r in rows] == ["skipped"]
