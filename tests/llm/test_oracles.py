"""Each query with SQL against it on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_says_what_its_sql_says(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    cur = con.execute(ORACLES[name])
    names = sorted(c[0] for c in cur.description)
    at = [[c[0] for c in cur.description].index(n) for n in names]
    want = Counter(tuple(plain(r[k]) for k in at) for r in cur.fetchall())
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == names
    assert Counter(tuple(plain(r[c]) for c in names) for r in df.collect()) == want and want
