import duckdb
import pytest

from recollect.plans import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events orders".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(shown(row[i]) for i in order) for row in rows)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    want = con.sql(catalog.ORACLES[name])
    assert canonical(df.collect(), df.columns) == canonical(want.fetchall(), want.columns)
