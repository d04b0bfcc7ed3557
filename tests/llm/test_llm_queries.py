"""Every query of the subpackage on whole tables, against its oracle where SQL can express it."""

import pytest

from seine.llm.queries import REGISTRIES
from tests.conftest import canonical

QUERIES = {n: f for r in REGISTRIES for n, f in r.queries.items()}
SQL = {n: s for r in REGISTRIES for n, s in r.sql.items()}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name not in SQL:
        assert df.columns and rows
        return
    found = duck.execute(SQL[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)
