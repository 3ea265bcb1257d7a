"""Walk-forward folds, gates, spreads, turnover and costs."""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.ranks import average_rank
from tapeloom.operators.crosssection import legs
from tapeloom.operators.factors import rank_correlation, tied_rank
from tapeloom.session import staged


def quarterly_folds(rows: DataFrame, first: str = "2015-01-01", embargo: int = 5, skip: int = 4, months: int = 3) -> DataFrame:
    """Expanding folds with a gap of embargo+1 days before the test.

    Test windows are quarters by default; `months` widens them, and the windows
    always cover all dates after the first `skip`.
    """
    span = rows.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    start = F.lit(first).cast("date")
    quarters = span.filter(F.col("_hi") >= start).select("_lo", F.posexplode(F.expr(f"sequence(DATE'{first}', _hi, INTERVAL {months} MONTH)")).alias("_k", "test_start"))
    return quarters.filter(F.col("_k") >= skip).select(
        (F.col("_k") - skip).cast("int").alias("fold"), F.col("_lo").alias("train_start"), F.date_sub("test_start", embargo + 1).alias("train_end"),
        "test_start", F.date_sub(F.add_months("test_start", months), 1).alias("test_end"))


def fixed_folds(spark, first: str = "2022-01-01", n: int = 12, months: int = 3, train_start: str = "2010-01-01", embargo: int = 21, earliest: str = "2021-01-01") -> DataFrame:
    """A fixed number of quarterly folds."""
    rows = spark.range(n).select(F.col("id").cast("int").alias("fold"), F.add_months(F.lit(first).cast("date"), F.col("id").cast("int") * months).alias("test_start"))
    rows = rows.withColumn("train_end", F.date_sub("test_start", embargo + 1)).filter(F.col("train_end") >= F.lit(earliest).cast("date"))
    return rows.select("fold", F.lit(train_start).cast("date").alias("train_start"), "train_end", "test_start", F.date_sub(F.add_months("test_start", months), 1).alias("test_end"))


def yearly_folds(events: DataFrame, date: str = "earnings_date", warm: int = 3) -> DataFrame:
    """Test years from the fourth on; training takes all earlier events."""
    years = events.groupBy(F.year(date).alias("year")).agg(F.count("*").alias("n_test"))
    first = years.agg(F.min("year").alias("_min"))
    w = Window.partitionBy(F.lit(1)).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)   # a few years
    return (years.withColumn("n_train", F.coalesce(F.sum("n_test").over(w), F.lit(0))).crossJoin(F.broadcast(first))
            .filter(F.col("year") >= F.col("_min") + warm).select("year", "n_train", "n_test"))


def sized_folds(rows: DataFrame, folds: DataFrame, least_train: int, least_test: int) -> DataFrame:
    """Folds whose train and test parts hold enough rows.

    Rows are counted per date first, so the range join sees one row per day.
    """
    daily = rows.groupBy("date").agg(F.count("*").alias("n"))
    d = F.col("date")
    joined = daily.join(F.broadcast(folds), d.between(F.col("train_start"), F.col("train_end")) | d.between(F.col("test_start"), F.col("test_end")))   # folds: one row per quarter
    train = F.sum(F.when(d <= F.col("train_end"), F.col("n")).otherwise(0))
    test = F.sum(F.when(d >= F.col("test_start"), F.col("n")).otherwise(0))
    keys = ["fold", "train_start", "train_end", "test_start", "test_end"]
    return joined.groupBy(*keys).agg(train.alias("n_train"), test.alias("n_test")).filter((F.col("n_train") >= least_train) & (F.col("n_test") >= least_test))


def spearman(rows: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """Rank correlation over groups of any size, with its two-sided p-value."""
    keys = keys or []
    known = staged(rows.select(*keys, x, y).dropna(subset=[x, y]))     # read for either rank
    ranked = average_rank(average_rank(known, keys, x, "_rx"), keys, y, "_ry")
    out = ranked.groupBy(*keys).agg(rank_correlation("_rx", "_ry").alias("rho"), F.count("*").alias("n"))
    return out.withColumn("pval", student_p("rho", "n"))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1.0 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1.0) < 1e-13:
            break
    return h


def two_sided_t(rho: float, n: int) -> float | None:
    """P(|T| > t) with n-2 degrees of freedom for a correlation of rho."""
    if rho is None or n is None or n < 3:
        return None
    if abs(rho) >= 1:
        return 0.0
    df = n - 2
    x = 1.0 - rho * rho                      # df / (df + t^2)
    a, b = df / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if x < 1 else 0.0
    if x < (a + 1) / (a + b + 2):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1 - x) / b


@F.pandas_udf(T.DoubleType())
def student_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    """Used on result rows only (one per group)."""
    return pd.Series([None if pd.isna(r) else two_sided_t(float(r), int(k)) for r, k in zip(rho, n)], dtype="float64")


def classification_metrics(rows: DataFrame, label: str, probability: str, keys: list[str] | None = None, cut: float = 0.5) -> DataFrame:
    """Accuracy, precision, recall and rank-sum AUC (0.5 if undefined)."""
    keys = keys or []
    known = staged(rows.select(*keys, label, probability))
    hit, y = F.col(probability) >= cut, F.col(label) == 1
    ranked = average_rank(known, keys, probability, "_r")
    agg = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(hit == y).alias("_ok"), F.count_if(hit & y).alias("_tp"), F.count_if(hit).alias("_pp"),
        F.count_if(y).alias("_p"), F.sum(F.when(y, F.col("_r"))).alias("_rs"))
    p, neg = F.col("_p"), F.col("n") - F.col("_p")
    auc = F.when((p > 0) & (neg > 0), (F.col("_rs") - p * (p + 1) / 2) / (p * neg)).otherwise(0.5)
    return agg.select(*keys, "n", (F.col("_ok") / F.col("n")).alias("accuracy"), F.when(F.col("_pp") > 0, F.col("_tp") / F.col("_pp")).otherwise(0.0).alias("precision"),
                      F.when(p > 0, F.col("_tp") / p).otherwise(0.0).alias("recall"), auc.alias("auc"))


def fold_summary(folds: DataFrame, metric: str = "rho") -> DataFrame:
    return folds.agg(F.avg(metric).alias("mean_rho"), F.count_if(F.col("pval") < 0.05).alias("n_significant"), F.count("*").alias("n_folds"))


def validation_gate(folds: DataFrame, metric: str, combined: float = 1.0, half: float = 0.0, share: float = 0.0) -> DataFrame:
    """Mean, both time halves and the share of positive folds against limits."""
    w = Window.partitionBy(F.lit(1))   # one row per fold
    placed = folds.select(F.col(metric).alias("v"), F.row_number().over(w.orderBy("fold")).alias("_k"), F.count("*").over(w).alias("_n"))
    early = F.col("_k") <= F.floor(F.col("_n") / 2)
    zero = F.lit(0.0)
    out = placed.agg(F.coalesce(F.avg("v"), zero).alias("combined_metric"), F.coalesce(F.avg(F.when(early, F.col("v"))), zero).alias("first_half_metric"),
                     F.coalesce(F.avg(F.when(~early, F.col("v"))), zero).alias("second_half_metric"),
                     F.coalesce(F.avg((F.col("v") > 0).cast("double")), zero).alias("frac_positive"), F.count("*").alias("_n"), F.count("v").alias("_known"))
    c, a, b, f = (F.col(x) for x in ("combined_metric", "first_half_metric", "second_half_metric", "frac_positive"))
    ok = (F.col("_n") > 0) & (F.col("_n") == F.col("_known")) & (c > combined) & (a > half) & (b > half) & (f >= share)
    parts = F.concat_ws(" ", F.when(c <= combined, F.format_string("%s combined %.4f <= %.4f.", F.lit(metric), c, F.lit(float(combined)))),
                        F.when(a <= half, F.format_string("First half %.4f <= %.4f.", a, F.lit(float(half)))),
                        F.when(b <= half, F.format_string("Second half %.4f <= %.4f.", b, F.lit(float(half)))),
                        F.when(f < share, F.format_string("Only %.0f%% of folds positive (need >= %.0f%%).", f * 100, F.lit(share * 100.0))))
    passed = F.format_string("PASS: %s combined %.4f, halves %.4f/%.4f, %.0f%% folds positive", F.lit(metric), c, a, b, f * 100)
    reason = F.when(F.col("_n") == 0, "No fold results").when(F.col("_known") < F.col("_n"), F.format_string("Missing %s in folds", F.lit(metric))).when(ok, passed).otherwise(parts)
    return out.select(ok.alias("passed"), "combined_metric", "first_half_metric", "second_half_metric", "frac_positive", reason.alias("reason"))


def sharpe(returns: DataFrame, value: str, factor: float = 252.0, keys: list[str] | None = None) -> DataFrame:
    """Population-sigma Sharpe; zero for fewer than two values or no variation."""
    s = F.stddev_pop(value)
    return returns.groupBy(*(keys or [])).agg(F.when((F.count(value) >= 2) & (s > 1e-15), F.avg(value) / s * factor ** 0.5).otherwise(0.0).alias("sharpe"))


def long_short_daily(oos: DataFrame, fraction: float = 0.2, least: int = 5) -> DataFrame:
    picked = legs(oos, "pred_return", fraction, least=least)
    daily = picked.groupBy("date").agg(F.avg(F.when(F.col("leg") == 1, F.col("fwd_return"))).alias("top_ret"),
                                       F.avg(F.when(F.col("leg") == -1, F.col("fwd_return"))).alias("bottom_ret"))
    return daily.withColumn("spread", F.col("top_ret") - F.col("bottom_ret"))


def long_short_spread(oos: DataFrame, horizon: int = 5) -> DataFrame:
    """Mean quintile returns, spread, hit rate and the annualised spread."""
    return long_short_daily(oos).agg(
        F.avg("top_ret").alias("avg_top_ret"), F.avg("bottom_ret").alias("avg_bottom_ret"), F.avg("spread").alias("avg_spread"),
        F.avg((F.col("spread") > 0).cast("double")).alias("hit_rate"), (F.avg("spread") * (252 / horizon)).alias("ann_spread"), F.count("*").alias("n_days"))


def leg_turnover(oos: DataFrame, fraction: float = 0.1, least: int = 10) -> DataFrame:
    """Per kept date: share of names new in each leg, averaged over the legs.

    A name is new unless its previous appearance in the same leg was on the
    previous kept date; that is one lag per (leg, ticker), no self-join.
    """
    picked = legs(oos, "pred_return", fraction, least=least)
    kept = picked.select("date").distinct()
    numbered = kept.withColumn("_no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))   # one row per date
    placed = picked.select("date", "ticker", "leg", "_q", "fwd_return").join(numbered, "date")
    before = F.lag("_no").over(Window.partitionBy("leg", "ticker").orderBy("_no"))
    fresh = F.when(F.coalesce(before, F.lit(-1)) == F.col("_no") - 1, 0.0).otherwise(1.0)
    marked = placed.withColumn("_new", fresh)
    daily = marked.groupBy("date", "_no").agg((F.sum(F.col("_new") / F.col("_q")) / 2).alias("turnover"),
                                              F.avg(F.when(F.col("leg") == 1, F.col("fwd_return"))).alias("top_ret"),
                                              F.avg(F.when(F.col("leg") == -1, F.col("fwd_return"))).alias("bottom_ret"))
    return daily.select("date", "top_ret", "bottom_ret", (F.col("top_ret") - F.col("bottom_ret")).alias("spread"), F.when(F.col("_no") > 1, F.col("turnover")).alias("turnover"))


def cost_sweep(daily: DataFrame, bps=(5, 10, 20, 50), horizon: int = 5) -> DataFrame:
    """Net spread per rebalance and per year for each round-trip cost."""
    gross = daily.agg(F.avg("spread").alias("gross_spread"), F.avg((F.col("spread") > 0).cast("double")).alias("hit_rate"), F.avg("turnover").alias("turnover"))
    swept = gross.withColumn("bps", F.explode(F.array(*[F.lit(b) for b in bps])))
    net = F.col("gross_spread") - F.col("turnover") * F.col("bps") / 10000
    return swept.select("bps", "gross_spread", (F.col("gross_spread") * (252 / horizon)).alias("gross_annual_spread"), "hit_rate", "turnover",
                        (F.col("turnover") * 252).alias("annual_turnover"), net.alias("net_spread"), (net * (252 / horizon)).alias("net_annual_spread"))


def deploy_verdict(gate: DataFrame, spread: DataFrame, costs: DataFrame) -> DataFrame:
    """Cleared only with a passed gate and a positive spread; a word per cost."""
    net = F.col("net_annual_spread")
    word = F.when(net > 0.06, "still worth running").when(net > 0, "marginal").otherwise("dead — costs eat the whole edge")
    joined = costs.crossJoin(F.broadcast(gate.select("passed"))).crossJoin(F.broadcast(spread.select("avg_spread")))   # one row each
    return joined.select("bps", (F.col("passed") & (F.col("avg_spread") > 0)).alias("cleared"), word.alias("verdict"))


def threshold_backtest(oos: DataFrame, probability: str, outcome: str, cut: float = 0.55) -> DataFrame:
    """All events, buys at or above the cut, sells below its mirror."""
    subsets = F.array_compact(F.array(F.lit("baseline"), F.when(F.col(probability) >= cut, "buy"), F.when(F.col(probability) < 1 - cut, "sell")))
    rows = oos.withColumn("subset", F.explode(subsets))
    r = F.col(outcome)
    return rows.groupBy("subset").agg(F.count("*").alias("n"), F.avg((F.col("label") == "WIN").cast("double")).alias("win_rate"), F.avg(r).alias("avg_ret"),
                                      (F.avg(r) / (F.stddev_samp(r) + 1e-8) * 2).alias("sharpe"))


def pillar_moments(rows: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Sums of products for the normal equations, one mergeable aggregate."""
    xs = {"one": F.lit(1.0), **{c: F.col(c) for c in columns}}
    names = list(xs)
    pairs = [F.sum(xs[a] * xs[b]).alias(f"{a}__{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.agg(*pairs, *[F.sum(xs[a] * F.col(target)).alias(f"{a}__y") for a in names])


def ridge(rows: DataFrame, columns: list[str], target: str, penalty: float = 1.0) -> dict[str, float]:
    """Ridge weights with an unpenalised intercept; a tiny system on the driver."""
    import numpy as np
    moments = pillar_moments(rows, columns, target).first()
    names = ["one", *columns]
    k = len(names)
    a = np.array([[moments[f"{names[min(i, j)]}__{names[max(i, j)]}"] for j in range(k)] for i in range(k)])
    a[range(1, k), range(1, k)] += penalty
    solved = np.linalg.solve(a, np.array([moments[f"{n}__y"] for n in names]))
    return dict(zip(["intercept", *columns], map(float, solved)))


def track_record(tickers: DataFrame, records: DataFrame, aggregate: DataFrame) -> DataFrame:
    """The ticker's own record, else the aggregate figures."""
    joined = tickers.join(records, "ticker", "left").crossJoin(F.broadcast(aggregate))   # one row
    return joined.select("ticker", F.coalesce("rho", "median_rho").alias("rho"), F.when(F.col("rho").isNotNull(), "ticker").otherwise("aggregate").alias("source"))


def ticker_records(oos: DataFrame) -> DataFrame:
    """Rank correlation, significance and direction per ticker."""
    ranked = oos.select("ticker", tied_rank(["ticker"], "pred_return").alias("_x"), tied_rank(["ticker"], "fwd_return").alias("_y"))
    rho = ranked.groupBy("ticker").agg(rank_correlation("_x", "_y").alias("rho"), F.count("*").alias("n"))
    rho = rho.withColumn("pval", student_p("rho", "n"))
    direction = F.when(F.col("rho") > 0, "positive").when(F.col("rho") < 0, "negative").otherwise("flat")
    return rho.select("ticker", F.round("rho", 4).alias("rho"), F.round("pval", 4).alias("pval"), "n", (F.col("pval") < 0.05).alias("significant"), direction.alias("direction"))


def aggregate_stats(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n_tickers"), F.count_if(F.col("rho") > 0).alias("n_positive"), F.count_if("significant").alias("n_significant"),
                       F.median("rho").alias("median_rho"))
