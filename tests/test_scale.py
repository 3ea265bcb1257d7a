"""Plans that keep a task's share as the trades grow, against the plain ones on small rows."""
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import accounts as ac
from tapeloom.operators import boosting
from tapeloom.sources import market as M

LINE = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
        "l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")
ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Trades with repeated and missing keys, days and prices."""
    path = str(tmp_path_factory.mktemp("trades"))
    lines = [(None if i % 31 == 0 else i // 5, i % 7, None if i % 17 == 0 else i % 4, i % 3, float(i % 9), 1000.0 + i % 50, None if i % 23 == 0 else i % 5 / 100, 0.02,
              "AN"[i % 2], "F", None if i % 29 == 0 else datetime(2020, 1, 1 + i // 40)) for i in range(600)]
    lines += lines[:90]
    spark.createDataFrame(lines, LINE).write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, None if k == 6 else f"Brand#{k % 3 + 1}") for k in range(7)], "p_partkey long, p_brand string").write.parquet(f"{path}/part.parquet")
    spark.createDataFrame([(k, k % 9, "FOP"[k % 3], 1.0, datetime(2020, 1, 1 + k % 20), "5-LOW") for k in range(121)], ORDER).write.parquet(f"{path}/orders.parquet")
    return path


def rows_of(df):
    return sorted(map(repr, df.collect()))


def test_bars_of_many_trades_are_the_same_bars(spark, folder):
    plain, many = M.bars(spark, folder), M.bars_of_many(spark, folder)
    assert many.schema == plain.schema
    assert rows_of(many) == rows_of(plain)


@pytest.mark.parametrize("view", ["v_alerts", "v_insider", "v_grades", "v_positions"])
def test_joins_by_order_use_more_tasks_for_more_trades(spark, folder, monkeypatch, view):
    few = M.Market(spark, folder)
    monkeypatch.setattr(M, "ROWS_A_TASK", 30)
    many = M.Market(spark, folder)
    assert M.tasks(spark, folder) == 23 > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert [many._dealt(name).rdd.getNumPartitions() for name in ("orders", "lineitem", "part")] == [23] * 3
    assert "REPARTITION_BY_NUM" in many[view]._jdf.queryExecution().executedPlan().toString()
    assert rows_of(many[view]) == rows_of(few[view])
    assert rows_of(many.bars) == rows_of(few.bars)


def test_alerts_meet_prices_without_a_shuffle_by_ticker(spark):
    alerts = spark.createDataFrame([(1, "A", "above", 10, 0), (2, "A", "below", 10, 0), (3, "B", "above", 10, 1), (4, "C", "below", 10, 0)],
                                   "alert_id long, ticker string, direction string, threshold long, triggered int")
    prices = spark.range(1, 90).select(F.when(F.col("id") == 1, "A").when(F.col("id") == 2, "B").otherwise(F.concat(F.lit("x"), "id")).alias("ticker"), F.lit(11.0).alias("price"))
    fired = ac.fired_alerts(alerts, prices.distinct())
    assert [r.alert_id for r in fired.collect()] == [1]
    plan = fired._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan


def test_every_model_is_dealt_a_task_of_its_own_the_largest_first(spark):
    sizes = {m: 10 + (m * 7) % 11 for m in range(24)}
    rows = spark.range(24 * 21).select((F.col("id") % 24).cast("int").alias("model"), (F.col("id") / 24).cast("long").alias("k"))
    rows = rows.filter(F.col("k") < F.create_map(*[x for m, n in sizes.items() for x in (F.lit(m), F.lit(n))])[F.col("model")])
    dealt = boosting.dealt_by_size(rows, sizes)
    found = dealt.groupBy(F.spark_partition_id().alias("at"), "model").count().orderBy("at").collect()
    assert [r.at for r in found] == list(range(24))
    assert [r["count"] for r in found] == sorted(sizes.values(), reverse=True)
    assert dealt.groupBy("place").agg(F.count("*"))._jdf.queryExecution().executedPlan().toString().count("Exchange ") <= 1
