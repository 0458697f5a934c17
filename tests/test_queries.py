"""Every query of the library's plans against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from rankwell.plans import corpus, hierarchy, matching, models, ranked, records, retrieval, search_indexes, stores, structures, workflow

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = retrieval.QUERIES | corpus.QUERIES | models.QUERIES | workflow.QUERIES | records.QUERIES | search_indexes.QUERIES | matching.QUERIES | structures.QUERIES | hierarchy.QUERIES | stores.QUERIES | ranked.QUERIES
SQL = retrieval.ORACLE_SQL | corpus.ORACLE_SQL | models.ORACLE_SQL | workflow.ORACLE_SQL | records.ORACLE_SQL | search_indexes.ORACLE_SQL | matching.ORACLE_SQL | structures.ORACLE_SQL | hierarchy.ORACLE_SQL | stores.ORACLE_SQL | ranked.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _plain(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    wanted = con.sql(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    assert _plain(tuple(r) for r in df.select(*columns).collect()) == _plain(wanted)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
