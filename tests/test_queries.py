"""Every query of the library against its SQL in DuckDB, over the smallest tables."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lotwright.plans import catalog

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


#: Queries without SQL, and the tests that hold their expressions against known outcomes.
ELSEWHERE = {
    "q_candidate_eval": "test_identity.py", "q_donor_score": "test_identity.py", "q_identity": "test_identity.py", "q_discriminators_rest": "test_identity.py", "q_identity_revalidate": "test_retail.py",
}


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, str(DATA))
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:  # a query over a table as it is may find nothing there; every other one has rows, and outcomes that another test knows
        assert name.endswith("_all") and name.removesuffix("_all") in catalog.queries() or name in ELSEWHERE and rows
        return
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    assert rows == Counter(tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in got.fetchall())
