"""The registry, and a cross-section of queries beside DuckDB on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import NAMES, rows

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["sma_family", "rsi_wilder", "upsert_by_key", "asof_ffill_join", "quantiles_exact", "label_encode", "trading_calendar", "max_drawdown_peak_trough", "marginal_component_risk", "state_breadth",
          "fund_piotroski", "news_sentiment_summary", "layer_returns_with_cost", "walk_forward", "network_components", "dq_clean", "two_sample_ks_regime", "stream_session_windows"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in NAMES.split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def test_registry_is_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert len(q) >= 360 and set(o) <= set(q) and len(o) >= 340


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["symbol", "date", "score", "position"] and df.count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    got, gc = rows(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry.oracle_sql()[name])
    want, wc = rows([d[0] for d in cur.description], cur.fetchall())
    assert gc == wc and got == want and got
