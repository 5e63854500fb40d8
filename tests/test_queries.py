"""Every query with SQL against DuckDB on the smallest tables; the others must give rows."""

import pytest

from hindsight import catalog
from tests.conftest import DATA


def canon(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    show = lambda v: "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    found = duck.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"burst_scan"}))
def test_gives_rows(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.columns and df.limit(1).count() == 1
