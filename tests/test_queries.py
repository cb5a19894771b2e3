"""Every registered query of the library on the smallest tables; against DuckDB where it has a SQL twin."""

import math

import duckdb
import pytest

from cytolake.plans import registry
from cytolake.plans.fixtures import TABLES

SF = "/root/testdata/sf0.001"


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    try:
        f = float(v)
    except (TypeError, ValueError):
        return "~" if v is None or str(v) in ("NaT", "<NA>") else str(v)
    if isinstance(v, bool):
        return str(v)
    return "~" if math.isnan(f) else str(int(f)) if f == int(f) and abs(f) < 1e15 else f"{f:.8g}"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    # Gene sets of ten genes or more begin at the next scale.
    got = registry.QUERIES[name](spark, SF.replace("0.001", "0.01") if name == "EX-24p" else SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got) and not got.isna().all().all()  # values are asserted by the tests against plain loops
        return
    want = duck.execute(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda d: sorted(zip(*(map(plain, d[c]) for c in sorted(d.columns))))
    assert rows(got) == rows(want)
