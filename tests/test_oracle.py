"""Every core query with SQL against an independent engine on the smallest data, compared as the driver compares."""

import glob
import os

import duckdb
import pytest

from folioforge import queries as core

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def shown(value):
        return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)

    return [columns[k] for k in order], sorted(tuple(shown(row[k]) for k in order) for row in rows)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows(spark, engine, name):
    frame = core.queries()[name](spark, FOLDER)
    answer = engine.execute(core.oracle_sql()[name])
    columns = [c[0] for c in answer.description]
    assert canonical(frame.columns, [tuple(r) for r in frame.collect()]) == canonical(columns, answer.fetchall())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, name):
    assert core.queries()[name](spark, FOLDER).columns
    core.queries()[name](spark, FOLDER).count()
