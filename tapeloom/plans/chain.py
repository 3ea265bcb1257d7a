"""From model to ledger: evaluation, books and ledger on the walk-forward model's own out-of-sample rows.

The fits' predictions are committed to a versioned table once per session and folder; everything here reads it.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.exprs import rounded
from tapeloom.operators import accounts as ac
from tapeloom.operators import book as bk
from tapeloom.operators import composite as cp
from tapeloom.operators import evaluation as ev
from tapeloom.operators import features as ft
from tapeloom.operators import labels as lb
from tapeloom.operators import models as md
from tapeloom.operators import strategies as st
from tapeloom.plans import models as mq
from tapeloom.plans.factors import panel_of
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.session import cut_lineage, scratch_folder
from tapeloom.sources.versions import PredictionTable

RUN = "walk_forward_5d"
SCHEMA = "fold int, ticker string, date date, close double, std_20 double, fwd_return double, pred_return double"
_tables: dict[tuple[str, str], str] = {}


def prediction_table(m) -> PredictionTable:
    """The session's table of this folder's out-of-sample predictions; fitted when it is first asked for."""
    name = (m.spark.sparkContext.applicationId, m.sf_dir)
    table = PredictionTable(m.spark, _tables.setdefault(name, f"{scratch_folder(m.spark)}/predictions"), SCHEMA)
    if not table.newest():
        rows = lb.add_target(mq.panel(m), 5)
        data = md.binned(rows, ft.FEATURES, ["ticker", "date"], ["ticker", "date", "close", "std_20", "fwd_return"])
        variant = md.Variant(ev.quarterly_folds(data, mq.FIRST, embargo=5), "fwd_return", ft.FEATURES, md.RETURN, mq.LEAST)
        oos = md.walk_forward(data, ft.FEATURES, [variant], ["ticker", "date", "close", "std_20"])
        table.append(oos.select("fold", "ticker", "date", "close", "std_20", F.col("y").alias("fwd_return"), F.col("margin").alias("pred_return")), RUN)
    return table


def predictions(m) -> DataFrame:
    return prediction_table(m).read()


ORACLE_VIEWS["v_target5"] = "SELECT ticker, date FROM (SELECT ticker, date, close, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date) AS ahead FROM v_bars) a WHERE ahead IS NOT NULL AND close <> 0"
ORACLE_VIEWS["v_mfold"] = f"""
SELECT CAST(i - 4 AS INT) AS fold, q - 6 AS train_end, q AS test_start, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS test_end
FROM (SELECT i, CAST(DATE '{mq.FIRST}' + to_months(CAST(3*i AS INT)) AS DATE) AS q FROM range(4, 400) t(i)) z WHERE q <= (SELECT max(date) FROM v_target5)"""
ORACLE_VIEWS["v_msize"] = """
SELECT fold, count(*) FILTER (WHERE date <= train_end) AS n_train, count(*) FILTER (WHERE date BETWEEN test_start AND test_end) AS n_test,
 min(date) FILTER (WHERE date >= test_start) AS first_date, max(date) FILTER (WHERE date BETWEEN test_start AND test_end) AS last_date
FROM v_mfold JOIN v_target5 ON date <= train_end OR date BETWEEN test_start AND test_end GROUP BY fold"""
_sized = f"n_train >= {mq.LEAST[0]} AND n_test >= {mq.LEAST[1]}"


@query("model_fold_sizes", "L-06", f"SELECT fold, n_train, n_test, train_end, test_start FROM v_msize JOIN v_mfold USING (fold) WHERE {_sized}")
def _(m):
    """Training and test rows of the folds that the return model is fitted on."""
    rows = cut_lineage(lb.add_target(m.staged().bars.select("ticker", "date", "close"), 5))
    return ev.sized_folds(rows, ev.quarterly_folds(rows, mq.FIRST, embargo=5), *mq.LEAST).select("fold", "n_train", "n_test", "train_end", "test_start")


@query("model_prediction_parts", "L-06, N-01", f"SELECT '{RUN}' AS run, fold, n_test AS n, first_date, last_date, n_test AS n_keys, CAST(1 AS INT) AS version FROM v_msize WHERE {_sized}")
def _(m):
    """The parts of the prediction table after a second, idempotent append: rows, dates and keys of every fold."""
    table = prediction_table(m)
    version = table.append(table.read().drop("run"), RUN)
    rows = table.read()
    return rows.groupBy("run", "fold").agg(F.count("*").alias("n"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                                           F.count_distinct("ticker", "date").alias("n_keys")).withColumn("version", F.lit(version).cast("int"))


@query("model_cost_sweep", "L-20, L-22, L-23, L-24, L-25")
def _(m):
    """Spread, costs and deploy verdict of the model's predictions."""
    rows = predictions(m)
    folds = ev.spearman(rows, "pred_return", "fwd_return", ["fold"]).select("fold", "rho")
    gate, spread, costs = ev.validation_gate(folds, "rho", 0.03, 0.0, 0.5), ev.long_short_spread(rows), cut_lineage(ev.cost_sweep(ev.leg_turnover(rows)))
    return rounded(costs.join(ev.deploy_verdict(gate, spread, costs), "bps"))


@query("model_ticker_records", "L-20")
def _(m):
    """Track record of every ticker on the model's predictions."""
    return ev.ticker_records(predictions(m))


@query("model_books", "M-03, M-04, M-05, M-06, M-07, M-08, M-09, M-10, M-11, M-12, M-13, M-14, M-15")
def _(m):
    """The compared books, held on the model's predictions."""
    rows = cut_lineage(predictions(m).select("ticker", "date", "close", "pred_return", "std_20"))
    ready = cut_lineage(bk.next_day_return(rows).join(bk.trailing_beta(rows, m.staged().bench), ["ticker", "date"]))
    parts = []
    for setups in (bk.ROUND_ONE, bk.ROUND_TWO):
        configs = bk.configs(m.spark, setups)
        parts.append(bk.compare(cut_lineage(bk.daily_book(bk.holdings(ready, configs))), m.bench, configs))
    return rounded(reduce(DataFrame.unionByName, parts))


LEDGER_VERSION = "walk_forward_5d"


def model_ledger(m) -> DataFrame:
    """What the live job would have appended on every test date, as if it ran that day."""
    weighted = bk.live_weights(predictions(m)).select("ticker", "date", "pred_return", "weight", "leg")
    return ac.ledger_rows(weighted, m.staged().bars.select("ticker", "date", F.col("close").alias("price")), LEDGER_VERSION)


@query("model_ledger_status", "N-01, N-02, N-03, N-05")
def _(m):
    """Pending and checked counts of the model's ledger, with its hit rates, a week after its last prediction."""
    ledger = cut_lineage(model_ledger(m))
    asof = ledger.agg(F.date_add(F.max("date"), 7)).first()[0]
    known = ledger.limit(0).select("ticker", "date")
    done = ac.resolved_outcomes(ledger, known, ac.last_prices(m.bars), F.lit(asof))
    halves = ac.half_split_hits(done)
    return rounded(ac.ledger_status(ledger, done).crossJoin(F.broadcast(halves)))     # one row


@query("baseline_rule_model_table", "K-12")
def _(m):
    """All labelled trades, those of the rule score, and those that the outcome classifier's out-of-sample probability picks."""
    panel = cut_lineage(panel_of(m))
    rule = cp.min_max(cp.rule_score(panel), "rule_score", "rule_signal").withColumn("one", F.lit(1.0))
    scored = mq.outcome_probabilities(m, keep=("atr_pct", "label"))
    parts = [("baseline", rule, "one", (0.0,)), ("rule", rule, "rule_signal", (0.6,)), ("model", scored, "prob", (0.55, 0.6, 0.65))]
    tables = [st.label_trades(rows, column, cuts).select(F.lit(name).alias("strategy"), "*") for name, rows, column, cuts in parts]
    return rounded(reduce(DataFrame.unionByName, tables), sharpe=5, annualized_return_est=5)
