"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import duckdb
import pytest

from sextant.plans import tabular

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(tabular.QUERIES))
def test_query(spark, duck, name):
    df = tabular.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(f"SELECT {', '.join(cols)} FROM ({tabular.ORACLES[name]})")
    assert sorted(duck.sql(tabular.ORACLES[name]).columns) == cols
    assert sorted(map(repr, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(repr, want.fetchall()))


def test_coverage_of_all_orders(spark, duck):
    got = tabular.QUERIES["coverage_documents"](spark, SF)
    orders, items = duck.sql("SELECT count(DISTINCT l_orderkey), count(*) FROM lineitem").fetchall()[0]
    assert (got.select("rel_path").distinct().count(), got.count()) == (orders, items)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
