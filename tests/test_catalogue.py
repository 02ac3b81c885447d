from pathlib import Path

import duckdb
import pytest

from arrowleaf import catalogue

SF = "/root/testdata/sf0.001"


def rows(frame, columns):
    return sorted(tuple(repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else repr(v) for v in r) for r in frame[columns].itertuples(index=False))


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_every_query_equals_its_sql(spark):
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    for name, query in catalogue.queries().items():
        got = query(spark, SF).toPandas()
        assert len(got) or name == "docs_leakage_pairs", name
        if sql := catalogue.oracle_sql().get(name):
            want = con.execute(sql).df()
            columns = sorted(want.columns)
            assert sorted(got.columns) == columns and rows(got, columns) == rows(want, columns), name
