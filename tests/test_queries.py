"""T1/T2: the driver contract -- entry smoke and every registered query against its
DuckDB oracle (small scale factor here; tools/compare.py runs the sf0.01 gate)."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from purchaseflow.plans.fixtures import TABLES

# The training-data operators have tests of their own.
QUERIES = {k: v for k, v in entry.queries().items() if k not in entry.LLM_QUERIES}
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in QUERIES}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def _rows(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i].lower())
    return sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_small}/{t}.parquet')")
    return con


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "File_Name" in df.columns


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, sf_small, name):
    df = QUERIES[name](spark, sf_small)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    res = duck.execute(ORACLES[name])
    cols = [d[0] for d in res.description]
    want = _rows(res.fetchall(), cols)
    assert sorted(c.lower() for c in df.columns) == sorted(c.lower() for c in cols)
    assert len(got) == len(want)
    assert got == want


def test_stream_ingest_exactly_once(spark, sf_small):
    df = QUERIES["q32_stream_ingest"](spark, sf_small)
    n_events = spark.read.parquet(f"{sf_small}/events.parquet").count()
    runs = {r["ingest_run"]: r["count"] for r in df.groupBy("ingest_run").count().collect()}
    assert df.count() == n_events
    assert df.select("attempt_seq").distinct().count() == n_events
    assert 3 not in runs  # the third pass finds nothing new
