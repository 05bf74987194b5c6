"""Each registered query against its SQL in DuckDB, over the small tables where they are."""

import os

import pytest

SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


def rows(df):
    def show(x):
        return "" if x is None or x != x else repr(round(float(x), 5)) if isinstance(x, float) else str(x)

    df = df.astype(object)[sorted(df.columns)]
    return sorted(tuple(show(x) for x in r) for r in df.itertuples(index=False))


def names():
    from namewright.plans import registry

    return sorted(registry.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    from namewright.plans import registry

    got = registry.QUERIES[name](spark, SMALL).toPandas()
    if name not in registry.ORACLE_SQL:
        assert len(got) > 0
    else:
        want = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if os.path.isdir("/root/testdata/sf0.001"):
        assert entry.entry(spark).count() == 1
