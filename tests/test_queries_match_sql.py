"""Every query of the core library against its SQL on DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from lodestone import plans

SF = "/root/testdata/sf0.001"


def canonical(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6f}"
    if hasattr(x, "as_tuple"):
        return f"{float(x):.6f}"
    return str(x)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    got = plans.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(tuple(map(canonical, r)) for r in got.select(columns).collect())
    assert rows or name.startswith("keyword_"), "no rows"  # the smallest tables may not have the words
    if name in plans.ORACLES:
        want = duck.execute(plans.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == columns
        place = [names.index(c) for c in columns]
        assert rows == sorted(tuple(canonical(r[i]) for i in place) for r in want.fetchall())
