"""The driver contract: registered queries against their SQL, and the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from meshfront.plans import catalogue, oracles

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="the driver's tables aren't here")


def same(spark, query, sql, sf=SF):
    got = query(spark, sf)
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = con.execute(sql)
    names = [c[0] for c in r.description]
    want = r.fetchall()
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)

    def plain(rows):
        return sorted(tuple("null" if pd.isna(r[c]) else f"{float(r[c]):.9g}" if isinstance(r[c], (int, float)) and not isinstance(r[c], bool) else str(r[c]) for c in order) for r in rows)

    assert plain([x.asDict() for x in got.collect()]) == plain([dict(zip(names, x, strict=True)) for x in want])


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_mesh_query(spark, name):
    sql = oracles.sql().get(name)
    if sql is None:
        assert catalogue.QUERIES[name](spark, SF).count() > 0
    else:
        same(spark, catalogue.QUERIES[name], sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_optional_parts():
    repo = Path(entry.__file__).parent
    code = f"""
import sys
sys.path.insert(0, {str(repo)!r})
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('meshfront.llm'):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import __spark_entry__ as e
assert 'shocks' in e.queries() and not [k for k in e.queries() if k.startswith('op') or k == 'pipeline']
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True)
