"""Every relational query against its SQL, on the smallest tables."""

import duckdb
import pytest

from quern.plans import artifacts, decoding, files, projections, reports
from quern.plans import queries as relational

SF = "/root/testdata/sf0.001"
QUERIES = {**relational.QUERIES, **reports.QUERIES, **artifacts.QUERIES, **decoding.QUERIES, **files.QUERIES, **projections.QUERIES}
SQL = {**relational.ORACLE_SQL, **reports.ORACLE_SQL, **artifacts.ORACLE_SQL, **decoding.ORACLE_SQL, **files.ORACLE_SQL, **projections.ORACLE_SQL}


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    result = con.execute(SQL[name])
    assert sorted(d[0] for d in result.description) == columns
    order = [[d[0] for d in result.description].index(c) for c in columns]
    want = sorted(([plain(row[k]) for k in order] for row in result.fetchall()), key=repr)
    assert sorted(([plain(r[c]) for c in columns] for r in found.collect()), key=repr) == want


def test_entry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
