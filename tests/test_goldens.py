"""The fixtures with known results, as the driver compares them."""

import duckdb
import pytest

from notemill import golden_queries as golden


@pytest.mark.parametrize("name", golden.QUERIES)
def test_goldens(spark, name):
    df = golden.QUERIES[name](spark, "")
    cols = sorted(df.columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
    want = duckdb.sql(f"SELECT {', '.join(cols)} FROM ({golden.ORACLE[name]})").fetchall()
    assert got == sorted(map(repr, want))
