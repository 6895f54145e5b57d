"""Every market query against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from tapeloom.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def near(a, b):
    if isinstance(a, float) or isinstance(b, float):
        if a is None or b is None:
            return a is b
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    found = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    want = [tuple(r[names.index(c)] for c in columns) for r in found.fetchall()]
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, round(x, 3) if isinstance(x, float) else x) for x in r if not isinstance(x, float)) + tuple((x is not None, x or 0) for x in r if isinstance(x, float)))
    got, want = order(got), order(want)
    assert len(got) == len(want)
    assert all(near(a, b) for x, y in zip(got, want) for a, b in zip(x, y))


def test_eligible_after_2010(spark, tmp_path):
    """Bars from 2015 on, against the query's SQL."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (l_shipdate + INTERVAL 20 YEAR AS l_shipdate) FROM '{DATA}/lineitem.parquet') TO '{tmp_path}/lineitem.parquet'")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = c.execute(f"SELECT as_of, code FROM ({registry.oracle_sql()['v01_eligible']})").fetchall()
    got = registry.queries()["v01_eligible"](spark, str(tmp_path)).select("as_of", "code").collect()
    assert sorted(map(tuple, got)) == sorted(want) and want


@pytest.mark.parametrize("name", ["x01_normal_code", "x25_transfer_fee"])
def test_codes_beyond_their_board(spark, tmp_path, name):
    """Codes so large that a bare number leaves its board's prefix, or has seven digits."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT DISTINCT l_suppkey + s AS l_suppkey FROM '{DATA}/lineitem.parquet', unnest([0, 9990, 19998, 59994, 170004, 320004, 1500000]) x(s)) TO '{tmp_path}/lineitem.parquet'")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = c.execute(registry.oracle_sql()[name]).fetchall()
    assert sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect())) == sorted(want) and len(want) > 60


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_daily_ic_of_ranks_that_do_not_vary(spark, tmp_path, monkeypatch):
    """Twenty equal codes for each one: dates on which ranks don't vary. Dates are dealt into parts that follow the input."""
    from tapeloom.sources import lake

    monkeypatch.setattr(lake, "BUCKET_BYTES", 1 << 14)
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (l_suppkey + 100 * s AS l_suppkey) FROM '{DATA}/lineitem.parquet', range(20) x(s)) TO '{tmp_path}/lineitem.parquet'")
    c.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = sorted(c.execute(f"SELECT date, n, raw, residual, tail FROM ({registry.oracle_sql()['c20_daily_ic']})").fetchall())
    df = registry.queries()["c20_daily_ic"](spark, str(tmp_path)).select("date", "n", "raw", "residual", "tail")
    got = sorted(map(tuple, df.collect()))
    same = lambda a, b: a == b or isinstance(a, float) and isinstance(b, float) and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, abs_tol=1e-9))
    assert len(got) == len(want) > 100 and any(math.isnan(r[2]) for r in want)
    assert all(same(a, b) for x, y in zip(got, want) for a, b in zip(x, y))
    parts = lake.buckets_of(spark, [f"{tmp_path}/lineitem.parquet"])
    assert parts > 4 and f", {parts}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
