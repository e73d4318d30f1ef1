"""Every registered query has its SQL, and a sample of families equals it on the smallest tables."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from compare import canonical
from tidemark.plans import catalog

SF = "/root/testdata/sf0.001"
SAMPLE = ["order_flow", "latest_ticks", "basis", "klines", "footprint_imbalance", "exec_price", "spread_signal", "coverage_alerts", "squeeze_state", "funding_runs", "parse_options", "prediction_state", "norm_books", "lake_quality", "stream_klines", "stream_prediction_state"]


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE_SQL) and len(catalog.QUERIES) > 140


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    cur = con.execute(catalog.ORACLE_SQL[name])
    want = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description], dtype=object)
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert set(got.columns) == set(want.columns)
    assert canonical(got) == canonical(want)
