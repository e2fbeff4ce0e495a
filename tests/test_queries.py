"""Every query with SQL of its own against DuckDB on the smallest tables."""

import duckdb
import pytest

from mapperlake.plans import catalogue

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(table, columns):
    def one(v):
        return None if v is None or v != v else f"{v:.7g}" if isinstance(v, float) else v

    return sorted(map(repr, (tuple(one(v) for v in r) for r in zip(*(table[c] for c in columns), strict=True))))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toArrow().to_pydict()
    want = db.sql(ORACLE[name]).to_arrow_table().to_pydict()
    columns = sorted(got)
    assert columns == sorted(want)
    assert rows(got, columns) == rows(want, columns)
    if name not in ("k_search_owner", "x_join_theta", "x_intersect", "x_semi_in"):
        assert got[columns[0]], "an empty result shows nothing"
