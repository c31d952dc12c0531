"""Every query against its DuckDB SQL, and the others for rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from lodestack import oracle
from lodestack.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def norm(rows):
    show = lambda v: f"{v:.7g}" if isinstance(v, float) else repr(v)
    return sorted(tuple((k, show(v)) for k, v in sorted(r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_matches_sql(spark, sf_dir, con, name):
    got = [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]
    out = con.sql(oracle.SQL[name])
    want = [dict(zip(out.columns, r, strict=True)) for r in out.fetchall()]
    assert norm(got) == norm(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(oracle.SQL)))
def test_gives_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).columns == ["question_id", "pmid", "score", "context_pos", "context_group"]
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
