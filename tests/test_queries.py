"""Registered queries against DuckDB on the smallest tables (a sample of names; the driver runs all)."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = """FLAGSHIP RET-1 RET-2 RET-3 RET-4 RET-5 RET-8 RET-10 RET-15 RET-16 VEC-6 VEC-16 WIN-8 JOIN-21 VEC-15 EVAL-1 EVAL-3 EVAL-7 EVAL-8 EVAL-11 AGG-9 AGG-28 QRK-18 QRK-18.bootstrap CAL-2 CAL-3 CAL-5
 AUD-1 AUD-5 AUD-8 JOIN-17 SMP-1 SMP-2 STR-8 WIN-4 SNK-1 SNK-14 SRC-10 SRC-11 JSN-2 JSN-4 PRJ-6 PRJ-7 STM-1 STM-2 STM-3 STM-6
 SRC-4 SRC-8 SRC-12 SRC-23 SNK-2 SNK-7 SNK-15 SMP-7 VEC-13 EVAL-9 QRK-16 QRK-17 UDF-6""".split()


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 7)
    return [norm(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(D), reason="needs the generated tables")
@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    df = entry.queries()[name](spark, D)
    cols = sorted(df.columns)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(repr([norm(r[names.index(c)]) for c in cols]) for r in cur.fetchall())
    assert sorted(repr([norm(r[c]) for c in cols]) for r in df.collect()) == want


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
