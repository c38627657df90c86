"""Every core query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from quire.plans.catalog import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(clean(r[i]) for i in order) for r in rows), key=repr), sorted(names)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    if name not in SQL:
        assert df.count() > 0
        return
    expected = db.sql(SQL[name])
    assert _plain([tuple(r) for r in df.collect()], df.columns) == _plain(expected.fetchall(), expected.columns)
