"""The registered queries against their SQL on the smallest tables; all of them with TIDEGLASS_ALL=1."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TIDEGLASS_SF", "/root/testdata/sf0.001")
NAMES = [n for n in entry.oracle_sql() if not n.startswith(("p3_", "p8_", "p9_", "p10_"))]
if not os.environ.get("TIDEGLASS_ALL"):
    NAMES = [n for n in NAMES if n[0] == "p" and n[1].isdigit() or n in ("bars_dollar", "asof_backward_grid", "features_causal", "touch_prob", "pair_backtest", "reliability", "isotonic", "upsert_merge", "bm25_topk", "chunks", "rank_ic", "sql_panels")]
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plain(d: pd.DataFrame) -> list[tuple]:
    d = d[sorted(d.columns)]
    out = []
    for r in d.itertuples(index=False):
        out.append(tuple(None if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and np.isnan(v)) else round(float(v), 9) if isinstance(v, (int, float, np.number)) and not isinstance(v, bool) else str(v)[:10] if isinstance(v, (pd.Timestamp,)) else str(v) for v in r))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


@needs_data
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    a, b = entry.queries()[name](spark, SF).toPandas(), duck.execute(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert plain(a) == plain(b)


@needs_data
def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_names():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q)
    assert {f"p{n}_found" for n in (1, 2, 4, 5, 6, 7)} <= set(q)
