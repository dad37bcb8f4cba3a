"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from nearfold.plans.queries import ORACLES, QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, name):
    found = QUERIES[name](spark, str(DATA))
    names = sorted(found.columns)
    ours = sorted(tuple(map(str, r)) for r in found.select(*names).collect())
    db = duckdb.connect()
    for table in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {table.stem} AS SELECT * FROM '{table}'")
    theirs = db.execute(ORACLES[name])
    order = sorted(range(len(theirs.description)), key=lambda k: theirs.description[k][0])
    assert [theirs.description[k][0] for k in order] == names
    assert ours == sorted(tuple(str(r[k]) for k in order) for r in theirs.fetchall())
