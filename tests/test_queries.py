import decimal

import duckdb
import pytest

from riskweave.plans import catalog, catalog_more  # noqa: F401  the latter adds to the catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    plain = lambda v: round(v, 9) if isinstance(v, float) else float(v) if isinstance(v, decimal.Decimal) else v
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr), sorted(columns)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df, want = catalog.QUERIES[name](spark, SF), db.sql(catalog.SQL[name])
    assert _normal([tuple(r) for r in df.collect()], df.columns) == _normal(want.fetchall(), want.columns)
