from pathlib import Path

import duckdb
import pytest

from quarryscan.plans import catalogue

DATA = "/root/testdata/sf0.001"


def _rows(frame):
    """Rows with numbers rounded alike, in any order."""
    show = lambda v: "" if v is None else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(show(v) for v in row) for row in frame)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for path in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    want = con.sql(catalogue.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = catalogue.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert _rows(got.select(*columns).collect()) == _rows(want.select(*columns).fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
