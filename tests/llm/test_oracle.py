"""Every query with a SQL twin equals it on the small tables."""

import duckdb
import pytest

from msgshield.llm.oracle import ORACLE
from msgshield.llm.queries import QUERIES
from .helpers import SMALL


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = QUERIES[name](spark, SMALL)
    cur = con.execute(ORACLE[name])
    order = [c[0] for c in cur.description]
    assert sorted(order) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*order).collect()))) == sorted(map(repr, cur.fetchall()))
