"""Every registered query of the library against DuckDB on the smallest tables."""

import duckdb
import pytest

from framelake.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)
        elif df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            df[c] = df[c].map(lambda v: "" if v is None or v != v else str(v))
        else:
            df[c] = df[c].astype(float).round(9).astype(str)
    return sorted(map(tuple, df.to_numpy().tolist())), list(df.columns)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, db, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(db.execute(ORACLE_SQL[name]).df())
