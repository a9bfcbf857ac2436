import duckdb
import pytest

from twinsight.plans import code

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(code.QUERIES))
def test_code_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{SF}/part.parquet'")
    want = con.execute(code.SQL[name])
    columns = [c[0] for c in want.description]
    got = code.QUERIES[name](spark, SF).select(columns)
    rows = want.fetchall()
    assert rows and sorted(map(tuple, got.collect())) == sorted(rows)


def test_families_hold_several_forms(spark):
    rows = code.code_normalize(spark, SF).collect()
    forms = {}
    for r in rows:
        forms.setdefault(r["family"], set()).add((r["name"].split("_")[0], int(r["name"].split("_")[1]) % 4))
    assert max(map(len, forms.values())) >= 3 and all(len({shape for shape, _ in f}) == 1 for f in forms.values())
