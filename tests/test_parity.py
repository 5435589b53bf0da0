"""Every query against its SQL on the smallest tables."""

import math
import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v if v is None or isinstance(v, (int, bool)) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name in registry.ORACLES:
        cur = duck.execute(registry.ORACLES[name])
        names = [c[0] for c in cur.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in cols) for r in cur.fetchall())
    else:
        assert got


def test_entry_names_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and registry.FLAGSHIP in entry.queries()


@pytest.mark.parametrize("gone", ["zstandard", "tessera.llm", "tessera.llm.queries"])
def test_archive_queries_need_no_optional_part(gone):
    """In a process of its own, where a package or the training-data operators can't be imported."""
    said = "import sys; sys.modules[sys.argv[1]] = None; import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql().keys() | e.registry.QUERIES))"
    run = subprocess.run([sys.executable, "-c", said, gone], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=True)
    assert run.stdout.strip() == "True"
