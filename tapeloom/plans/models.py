"""Model queries (boosted trees have no SQL form; their folds and rows do) and sinks."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.exprs import rounded
from tapeloom.operators import evaluation as ev
from tapeloom.operators import factors as fa
from tapeloom.operators import features as ft
from tapeloom.operators import labels as lb
from tapeloom.operators import models as md
from tapeloom.plans.evaluation import SIG
from tapeloom.plans.factors import signals_of
from tapeloom.plans.labels import oos
from tapeloom.plans.registry import query
from tapeloom.session import cut_lineage, scratch_folder
from tapeloom.sources import sinks

FIRST = "1995-01-01"
HORIZONS = (1, 3, 5, 10, 21)
LEAST = (2000, 200)
# The ablation's feature groups.
GROUPS = {"Technical only": ft.TECHNICAL, "Fundamental only": ft.FUNDAMENTAL, "Sentiment only": ft.SENTIMENT,
          "Tech + Sentiment": ft.TECHNICAL + ft.SENTIMENT, "All features": ft.FEATURES}


def panel(m):
    """All features of full bars, imputed by date."""
    return ft.impute(ft.feature_frame(m.staged()))


def return_predictions(rows, days: int = 5, features=ft.FEATURES):
    """Out-of-sample predictions of quarterly folds."""
    return md.walk_forward_returns(rows, ev.quarterly_folds(rows, FIRST, embargo=days), features)


def fold_verdict(oos, keys):
    """Mean rank correlation over the folds, significant folds, and whether that is a signal, by key."""
    folds = ev.spearman(oos, "margin", "y", [*keys, "fold"])
    summed = folds.groupBy(*keys).agg(F.avg("rho").alias("mean_rho"), F.count_if(F.col("pval") < 0.05).alias("n_significant"), F.count("*").alias("n_folds"))
    rho, needed = F.coalesce("mean_rho", F.lit(0.0)), F.floor(F.col("n_folds") / 3)
    return summed.withColumn("signal", F.when((rho > 0.03) & (F.col("n_significant") >= needed), "YES").when(rho > 0.01, "weak").otherwise("none"))


@query("walk_forward_return_model", "L-06")
def _(m):
    oos = cut_lineage(return_predictions(lb.add_target(panel(m), 5)))
    per = ev.spearman(oos, "pred_return", "fwd_return", ["fold"])
    mse = oos.groupBy("fold").agg(F.avg(F.pow(F.col("pred_return") - F.col("fwd_return"), 2)).alias("mse"))
    return per.join(mse, "fold")


def outcome_probabilities(m, keep=()):
    """Out-of-sample probability of a win for every decided row."""
    rows = cut_lineage(lb.barrier_label(panel(m)).filter(F.col("label") != "NEUTRAL").withColumn("label_binary", (F.col("label") == "WIN").cast("int")))
    start = rows.agg(F.add_months(F.trunc(F.max("date"), "YEAR"), -24).cast("string")).first()[0]
    folds = ev.fixed_folds(m.spark, first=start, train_start=FIRST, earliest="1996-01-01")
    return cut_lineage(md.walk_forward_classes(rows, folds, ft.FEATURES, "label_binary", md.OUTCOME, keep=keep))


@query("outcome_classifier", "L-07, L-10")
def _(m):
    return ev.classification_metrics(outcome_probabilities(m), "label_binary", "prob", ["fold"])


@query("meta_label_classifier", "L-08, L-10")
def _(m):
    rows = cut_lineage(panel(m))
    calls = return_predictions(lb.add_target(rows, 5)).select("ticker", "date", "pred_return")
    called = cut_lineage(lb.long_calls(lb.barrier_label(rows, target=3.0, stop=1.5).join(calls, ["ticker", "date"])))
    folds = ev.quarterly_folds(called, FIRST, embargo=21)
    return ev.classification_metrics(cut_lineage(md.walk_forward_classes(called, folds, md.META_FEATURES, "meta_label", md.META)), "meta_label", "prob", ["fold"])


def event_rows(m):
    m.staged()
    events = lb.earnings_events(m.earnings, m.bars, m.bench)
    return lb.with_event_fundamentals(events, ft.fundamental_features(m.info, m.statements))


@query("event_classifier", "L-09, L-10")
def _(m):
    events = cut_lineage(event_rows(m))
    oos = cut_lineage(md.walk_forward_events(events, ev.yearly_folds(events)))
    return ev.classification_metrics(oos, "label_binary", "prob", ["year"])


def horizon_variants(data):
    """One family of fold models per horizon, each with a gap of its own before the test."""
    return [md.Variant(ev.quarterly_folds(data.filter(F.col(f"fwd_{days}").isNotNull()), FIRST, embargo=days), f"fwd_{days}", ft.FEATURES, md.RETURN, LEAST) for days in HORIZONS]


@query("lookahead_sweep", "L-15")
def _(m):
    targets = [f"fwd_{days}" for days in HORIZONS]
    data = md.binned(lb.add_targets(panel(m), HORIZONS), ft.FEATURES, ["ticker", "date"], ["ticker", "date", *targets])
    oos = cut_lineage(md.walk_forward(data, ft.FEATURES, horizon_variants(data), ["ticker", "date"]))
    days = F.element_at(F.array(*[F.lit(d) for d in HORIZONS]), F.col("variant") + 1)
    return fold_verdict(oos.withColumn("days", days), ["days"])


@query("feature_group_ablation", "L-16")
def _(m):
    data = md.binned(lb.add_target(panel(m), 5), ft.FEATURES, ["ticker", "date"], ["ticker", "date", "fwd_return"])
    folds = ev.quarterly_folds(data, FIRST, embargo=5)
    variants = [md.Variant(folds, "fwd_return", tuple(columns), md.RETURN, LEAST) for columns in GROUPS.values()]
    oos = cut_lineage(md.walk_forward(data, ft.FEATURES, variants, ["ticker", "date"]))
    name = F.element_at(F.array(*[F.lit(n) for n in GROUPS]), F.col("variant") + 1)
    return fold_verdict(oos.withColumn("feature_group", name), ["feature_group"]).drop("signal")


@query("final_fit_and_score", "L-18")
def _(m):
    rows = panel(m).withColumn("fwd_return", lb.forward_return(5))
    return md.fit_and_score(rows, ft.FEATURES)


@query("feature_importance", "L-19")
def _(m):
    return md.feature_importance(lb.add_target(panel(m), 5), ft.FEATURES)


@query("parquet_snapshot_sink", "A-09", "SELECT ticker, date, " + ", ".join(f"r6({c}) AS {c}" for c in ft.FEATURES) + " FROM v_live")
def _(m):
    path = scratch_folder(m.spark)
    sinks.write_live_features(ft.live_snapshot(ft.feature_frame(m.staged(), with_overlay=False)), path)
    return rounded(m.spark.read.parquet(path).select("ticker", "date", *ft.FEATURES))


@query("csv_sink", "A-10", "SELECT ticker, signal, r6(mean_ic_abs) AS mean_ic_abs, r6(mean_ic) AS mean_ic, r5(max_tstat) AS max_tstat, consistent FROM v_icsum")
def _(m):
    path = scratch_folder(m.spark)
    sinks.write_table_csv(fa.ic_summary(fa.time_series_ic(signals_of(m))), path)
    return rounded(m.spark.read.csv(path, header=True, schema="ticker string, signal string, mean_ic_abs double, mean_ic double, max_tstat double, consistent boolean"), max_tstat=5)


@query("json_publish_sink", "A-11", f"SELECT ticker, r4(rho) AS rho, n, {SIG} AS significant, CASE WHEN rho > 0 THEN 'positive' WHEN rho < 0 THEN 'negative' ELSE 'flat' END AS direction FROM v_record")
def _(m):
    path = scratch_folder(m.spark)
    sinks.publish_json(ev.ticker_records(oos(m)), path)
    return m.spark.read.json(path, schema="ticker string, rho double, pval double, n bigint, significant boolean, direction string").drop("pval")
