"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

from ledgerloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def cell(x):
    if x is None or x != x:
        return None
    if hasattr(x, "isoformat"):
        return x.isoformat()[:10]
    return round(float(x), 4) if isinstance(x, (int, float)) and not isinstance(x, bool) or type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    a = sorted((tuple(cell(r[n]) for n in sorted(names)) for r in got.collect()), key=str)
    b = sorted((tuple(cell(r[names.index(n)]) for n in sorted(names)) for r in want.fetchall()), key=str)
    assert a == b
