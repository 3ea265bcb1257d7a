"""A cross-section of the registered queries against their SQL on the smallest tables."""
import duckdb
import pytest

import __spark_entry__ as entry
from check_oracles import compare

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()
CHECKED = ["bars", "macd", "relative_strength_index", "band_features", "regression_features", "asof_join_backward", "analyst_mean_trailing_180d", "point_in_time_series",
           "sector_peer_valuation", "triple_barrier_label", "percentile_rank_average_ties", "piotroski_nine_tests", "snapshot_ratios", "put_call_ratio",
           "leg_turnover", "book_holdings", "setup_entry_exit", "position_pnl", "ledger_resolve", "streaming_tick_bars", "streaming_one_shot_alerts"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_flagship(spark):
    assert entry.entry(spark).columns == ["avg_top_ret", "avg_bottom_ret", "avg_spread", "hit_rate", "ann_spread", "n_days"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    assert compare([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), [d[0] for d in cur.description]) is None


def test_every_oracle_has_a_query_and_assembles():
    assert set(entry.oracle_sql()) <= set(entry.queries())
