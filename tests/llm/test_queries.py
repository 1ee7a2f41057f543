import os

import duckdb
import pytest

from tallyframe.llm import queries as Q

SF = "/root/testdata/sf0.01"
SQL = Q.oracle_sql()


def test_every_operator_has_its_query():
    names = list(Q.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        path = f"{SF}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    want = con.execute(SQL[name]).df()
    got = Q.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    text = lambda v: "~" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    rows = lambda d: sorted(tuple(text(v) for v in r) for r in d[sorted(want.columns)].astype(object).itertuples(index=False))
    number = lambda d: d.apply(lambda c: c.astype(float) if c.dtype.kind in "if" else c)
    assert rows(number(got)) == rows(number(want))
