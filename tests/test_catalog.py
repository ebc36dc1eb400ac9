"""Each registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from spanloom.plans import catalog

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("orders", "lineitem"):
        c.sql(f"create view {t} as from '{DATA}/{t}.parquet'")
    return c


def table(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
@pytest.mark.parametrize("name", SQL)
def test_equals_sql(spark, duck, name):
    assert table(QUERIES[name](spark, DATA).toPandas()) == table(duck.sql(SQL[name]).df())


def test_only_known_queries_lack_sql():
    assert set(QUERIES) - set(SQL) == {"metrics_histogram_instant"}


def test_entry_point_names():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_streams_twice(spark):
    """A second call in the same session gives the same answer."""
    total = lambda: QUERIES["stream_service_names"](spark, DATA).groupBy().sum("span_count").first()[0]
    assert total() == total() == catalog.span_store(spark, DATA).count()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the tables are not here")
def test_instant_histogram_holds_all_spans(spark):
    """Adaptive bins: at most ten, ascending, within the values, holding every span."""
    from pyspark.sql import functions as F

    bins = QUERIES["metrics_histogram_instant"](spark, DATA).first().value
    spans = catalog.span_store(spark, DATA).where(F.col("start_ns").between(catalog.START, catalog.END))
    n, least, most = spans.agg(F.count("*"), F.min("duration_ns"), F.max("duration_ns")).first()
    assert len(bins) <= 10 and sum(b.y for b in bins) == n
    assert [b.x for b in bins] == sorted(b.x for b in bins) and least <= bins[0].x and bins[-1].x <= most
