"""Each query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from newsloom.plans.queries import QUERIES, SQL



def norm(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{small}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    rows = df.collect()
    assert len({*df.columns}) == len(df.columns)
    if name in SQL:
        r = duck.execute(SQL[name])
        columns = [c[0] for c in r.description]
        assert sorted(columns) == sorted(df.columns)
        k = sorted(columns)
        want = sorted(tuple(norm(x[columns.index(c)]) for c in k) for x in r.fetchall())
        assert sorted(tuple(norm(x[c]) for c in k) for x in rows) == want


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_predictions_are_right(spark, small):
    """The classifier tells the documents' languages apart."""
    rows = QUERIES["predict_batch"](spark, small).collect()
    known = [r for r in rows if r.status == "OK"]
    assert len(known) > 0.95 * len(rows) and sum(r.prediction == r.label for r in known) > 0.95 * len(known)
    assert all(r.prediction is None and r.score is None for r in rows if r.status != "OK")
