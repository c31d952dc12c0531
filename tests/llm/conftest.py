import duckdb
import pytest

TABLES = "documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def oracle(sf_dir):
    """Rows that a DuckDB query gives over the test tables (or over other frames by name)."""

    def run(sql, **frames):
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        for name, rows in frames.items():
            con.register("_frame", rows)
            con.sql(f"CREATE OR REPLACE TABLE {name}_t AS SELECT * FROM _frame")
            con.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {name}_t")
        out = con.sql(sql)
        return [dict(zip(out.columns, r, strict=True)) for r in out.fetchall()]

    return run


def same(got, want):
    """Both lists of dicts hold the same rows, whatever their order; doubles to nine digits."""

    def norm(rows):
        return sorted(tuple((k, f"{v:.9g}" if isinstance(v, float) else repr(v)) for k, v in sorted(r.items())) for r in rows)

    got, want = norm(got), norm(want)
    assert got == want


@pytest.fixture(scope="session")
def same_rows():
    return same
