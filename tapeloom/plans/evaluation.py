"""Evaluation and book queries (inventory families L and M, and A-12, A-13)."""
from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.exprs import change, rounded
from tapeloom.operators import book as bk
from tapeloom.operators import crosssection as xs
from tapeloom.operators import evaluation as ev
from tapeloom.operators import features as ft
from tapeloom.operators import labels as lb
from tapeloom.operators.labels import earnings_events
from tapeloom.plans.labels import legs_sql, oos, predictions
from tapeloom.plans.registry import ORACLE_VIEWS, query
from tapeloom.plans.sqltext import last
from tapeloom.session import cut_lineage

FIRST = "1995-01-01"     # the tables cover 1995 to 2001
ORACLE_VIEWS["v_folds"] = f"""
SELECT CAST(k - 4 AS INT) AS fold, lo AS train_start, CAST(q - 6 AS DATE) AS train_end, q AS test_start, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS test_end
FROM (SELECT (SELECT min(date) FROM v_oos) AS lo, i AS k, CAST(DATE '{FIRST}' + to_months(CAST(3*i AS INT)) AS DATE) AS q FROM range(0, 200) t(i)) z WHERE k >= 4 AND q <= (SELECT max(date) FROM v_oos)"""
FOLD = "fold, train_start, train_end, test_start, test_end"


@query("quarterly_folds", "L-01", f"SELECT {FOLD} FROM v_folds")
def _(m):
    return ev.quarterly_folds(oos(m), FIRST, embargo=5)


@query("fixed_folds", "L-02", """
SELECT CAST(i AS INT) AS fold, DATE '1995-01-01' AS train_start, CAST(q - 22 AS DATE) AS train_end, q AS test_start, CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS test_end
FROM (SELECT i, CAST((SELECT date_trunc('year', max(date)) FROM v_bars) - INTERVAL 3 YEAR + to_months(CAST(3*i AS INT)) AS DATE) AS q FROM range(0, 12) t(i)) z WHERE q - 22 >= DATE '1996-01-01'""")
def _(m):
    start = m.bars.agg(F.add_months(F.trunc(F.max("date"), "YEAR"), -36).cast("string")).first()[0]
    return ev.fixed_folds(m.spark, first=start, train_start="1995-01-01", earliest="1996-01-01")


@query("label_embargo_folds", "L-03", f"SELECT fold, train_start, CAST(train_end - 16 AS DATE) AS train_end, test_start, test_end FROM v_folds")
def _(m):
    return ev.quarterly_folds(oos(m), FIRST, embargo=21)


@query("yearly_folds", "L-04", """
SELECT CAST(year AS INT) AS year, CAST(n_train AS BIGINT) AS n_train, n_test FROM (SELECT year, n_test, coalesce(sum(n_test) OVER (ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n_train, min(year) OVER () AS y0
 FROM (SELECT year(earnings_date) AS year, count(*) AS n_test FROM v_earnings GROUP BY 1) a) b WHERE year >= y0 + 3""")
def _(m):
    return ev.yearly_folds(m.earnings)


@query("sized_folds", "L-05", f"""
SELECT * FROM (SELECT {FOLD}, count(*) FILTER (WHERE date <= train_end) AS n_train, count(*) FILTER (WHERE date >= test_start) AS n_test
 FROM v_folds JOIN v_oos ON date BETWEEN train_start AND train_end OR date BETWEEN test_start AND test_end GROUP BY ALL) z WHERE n_train >= 2000 AND n_test >= 200""")
def _(m):
    rows = oos(m)
    return ev.sized_folds(rows, ev.quarterly_folds(rows, FIRST), 2000, 200)


# A probability the SQL side can compute too: the logistic of the prediction.
ORACLE_VIEWS["v_cls"] = "SELECT ticker, date, 1/(1+exp(-40*pred_return)) AS prob, (fwd_return > 0)::INT AS y, year(date) AS yr FROM v_oos"
ORACLE_VIEWS["v_cls_rank"] = "SELECT *, rank() OVER (PARTITION BY yr ORDER BY prob) + (count(*) OVER (PARTITION BY yr, prob) - 1)/2.0 AS r FROM v_cls"


@query("classification_metrics", "L-10", """
SELECT CAST(yr AS INT) AS yr, count(*) AS n, r6(avg(((prob >= 0.5) = (y = 1))::INT)) AS accuracy, r6(coalesce(count(*) FILTER (WHERE prob >= 0.5 AND y = 1)/nullif(count(*) FILTER (WHERE prob >= 0.5), 0), 0)) AS precision,
 r6(coalesce(count(*) FILTER (WHERE prob >= 0.5 AND y = 1)/nullif(count(*) FILTER (WHERE y = 1), 0), 0)) AS recall,
 r6(coalesce((sum(r) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1)*(count(*) FILTER (WHERE y = 1)+1)/2)/nullif(count(*) FILTER (WHERE y = 1)*count(*) FILTER (WHERE y = 0), 0), 0.5)) AS auc FROM v_cls_rank GROUP BY yr""")
def _(m):
    rows = oos(m).select((1 / (1 + F.exp(-40 * F.col("pred_return")))).alias("prob"), (F.col("fwd_return") > 0).cast("int").alias("y"), F.year("date").alias("yr"))
    return rounded(ev.classification_metrics(rows, "y", "prob", ["yr"]))


ORACLE_VIEWS["v_rho_year"] = """
SELECT yr, corr(x, y) AS rho, count(*) AS n FROM (SELECT year(date) AS yr, rank() OVER (PARTITION BY year(date) ORDER BY pred_return) + (count(*) OVER (PARTITION BY year(date), pred_return) - 1)/2.0 AS x,
  rank() OVER (PARTITION BY year(date) ORDER BY fwd_return) + (count(*) OVER (PARTITION BY year(date), fwd_return) - 1)/2.0 AS y FROM v_oos) a GROUP BY yr"""


def yearly_rho(m):
    return ev.spearman(oos(m).withColumn("yr", F.year("date")), "pred_return", "fwd_return", ["yr"])


@query("spearman_by_year", "L-11", "SELECT CAST(yr AS INT) AS yr, r6(rho) AS rho, n FROM v_rho_year")
def _(m):
    return rounded(yearly_rho(m).select("yr", "rho", "n"))


@query("spearman_overall", "L-11, N-04", """
SELECT r6(corr(x, y)) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY pred_return) + (count(*) OVER (PARTITION BY pred_return) - 1)/2.0 AS x, rank() OVER (ORDER BY fwd_return) + (count(*) OVER (PARTITION BY fwd_return) - 1)/2.0 AS y FROM v_oos) a HAVING count(*) >= 10""")
def _(m):
    return rounded(ev.spearman(oos(m), "pred_return", "fwd_return").select("rho", "n").filter("n >= 10"))


@query("spearman_p_values", "L-11")
def _(m):
    return yearly_rho(m)


# |t| > the 5 % point of a normal is the large-sample form of p < 0.05.
@query("fold_summary", "L-12", "SELECT r6(avg(rho)) AS mean_rho, count(*) FILTER (WHERE abs(rho)*sqrt((n-2)/(1-rho*rho)) > 1.9605) AS n_significant, count(*) AS n_folds FROM v_rho_year")
def _(m):
    return rounded(ev.fold_summary(yearly_rho(m)))


def gate_sql(half=0.0, combined=0.03, share=0.5):
    return f"""
SELECT *, c > {combined} AND a > {half} AND b > {half} AND f >= {share} AS passed FROM (SELECT avg(rho) AS c, avg(rho) FILTER (WHERE k <= nn // 2) AS a, avg(rho) FILTER (WHERE k > nn // 2) AS b, avg((rho > 0)::INT) AS f
 FROM (SELECT rho, row_number() OVER (ORDER BY yr) AS k, count(*) OVER () AS nn FROM v_rho_year) z) y"""


ORACLE_VIEWS["v_gate"] = gate_sql()


@query("validation_gate", "L-13", """
SELECT passed, r6(c) AS combined_metric, r6(a) AS first_half_metric, r6(b) AS second_half_metric, r6(f) AS frac_positive,
 CASE WHEN passed THEN printf('PASS: rho combined %.4f, halves %.4f/%.4f, %.0f%% folds positive', c, a, b, f*100) ELSE concat_ws(' ', CASE WHEN c <= 0.03 THEN printf('rho combined %.4f <= %.4f.', c, 0.03) END, CASE WHEN a <= 0 THEN printf('First half %.4f <= %.4f.', a, 0.0) END,
   CASE WHEN b <= 0 THEN printf('Second half %.4f <= %.4f.', b, 0.0) END, CASE WHEN f < 0.5 THEN printf('Only %.0f%% of folds positive (need >= %.0f%%).', f*100, 50.0) END) END AS reason FROM v_gate""")
def _(m):
    folds = yearly_rho(m).select(F.col("yr").alias("fold"), "rho")
    return rounded(ev.validation_gate(folds, "rho", combined=0.03, half=0.0, share=0.5))


@query("sharpe_ratio", "L-14", "SELECT ticker, r6(CASE WHEN count(r) >= 2 AND stddev_pop(r) > 1e-15 THEN avg(r)/stddev_pop(r)*sqrt(252) ELSE 0 END) AS sharpe FROM (SELECT ticker, close/lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM v_bars) a GROUP BY ticker")
def _(m):
    return rounded(ev.sharpe(m.bars.select("ticker", change("close", 1).alias("r")), "r", keys=["ticker"]))


MOMENT_COLS = [f"pillar_{n}" for n in xs.PILLARS_TRAINING]
ORACLE_VIEWS["v_pillar_target"] = """
SELECT p.*, clip(f, -0.25, 0.25) AS y FROM v_pillar_train p JOIN (SELECT ticker, date, lead(close, 5) OVER (PARTITION BY ticker ORDER BY date)/close - 1 AS f FROM v_bars) b USING (ticker, date) WHERE f IS NOT NULL"""
_TERMS = {"one": "1.0::DOUBLE", **{c: c for c in MOMENT_COLS}}
_NAMES = list(_TERMS)


def pillar_targets(m):
    """Pillar means of the training panel with the 5-day forward return."""
    frame = ft.feature_frame(m.staged())
    columns = [c for cols in xs.PILLARS_TRAINING.values() for c in cols]
    scored = xs.pillar_means(xs.zscores(frame, columns), xs.PILLARS_TRAINING).select("ticker", "date", *MOMENT_COLS)
    return scored.join(lb.add_target(m.bars, 5).select("ticker", "date", "fwd_return"), ["ticker", "date"])


@query("pillar_normal_equations", "L-17", "SELECT " + ", ".join(f"r2(sum({_TERMS[a]}*{_TERMS[b]})) AS {a}__{b}" for i, a in enumerate(_NAMES) for b in _NAMES[i:]) + ", " + ", ".join(
    f"r4(sum({_TERMS[a]}*y)) AS {a}__y" for a in _NAMES) + " FROM v_pillar_target")
def _(m):
    moments = ev.pillar_moments(pillar_targets(m), MOMENT_COLS, "fwd_return")
    return moments.select(*[F.round(c, 4 if c.endswith("__y") else 2).alias(c) for c in moments.columns])


# The weights solve (X'X + penalty without intercept) w = X'y: what is left over is zero in every equation.
@query("ridge_weights", "L-17", "SELECT term, 0.0::DOUBLE AS residual FROM (SELECT unnest(['intercept', " + ", ".join(f"'{c}'" for c in MOMENT_COLS) + "]) AS term) t")
def _(m):
    rows = cut_lineage(pillar_targets(m))
    weights = ev.ridge(rows, MOMENT_COLS, "fwd_return")
    fitted = F.lit(weights["intercept"])
    for name in MOMENT_COLS:
        fitted = fitted + F.col(name) * weights[name]
    left = rows.withColumn("_e", F.col("fwd_return") - fitted)
    gaps = left.agg(F.sum("_e").alias("intercept"), *[(F.sum(F.col("_e") * F.col(c)) - weights[c]).alias(c) for c in MOMENT_COLS])
    terms = F.explode(F.array(*[F.struct(F.lit(c).alias("term"), (F.round(c, 6) + 0.0).alias("residual")) for c in ["intercept", *MOMENT_COLS]])).alias("t")
    return gaps.select(terms).select("t.term", F.abs("t.residual").alias("residual"))


ORACLE_VIEWS["v_record"] = """
SELECT ticker, corr(x, y) AS rho, count(*) AS n FROM (SELECT ticker, rank() OVER (PARTITION BY ticker ORDER BY pred_return) + (count(*) OVER (PARTITION BY ticker, pred_return) - 1)/2.0 AS x,
  rank() OVER (PARTITION BY ticker ORDER BY fwd_return) + (count(*) OVER (PARTITION BY ticker, fwd_return) - 1)/2.0 AS y FROM v_oos) a GROUP BY ticker"""
SIG = "abs(rho)*sqrt((n-2)/(1-rho*rho)) > 1.9623"


@query("track_record_shape", "A-12", f"SELECT ticker, r4(rho) AS rho, n, {SIG} AS significant, CASE WHEN rho > 0 THEN 'positive' WHEN rho < 0 THEN 'negative' ELSE 'flat' END AS direction FROM v_record")
def _(m):
    return ev.ticker_records(oos(m)).drop("pval")


@query("track_record_aggregate", "A-13", f"SELECT count(*) AS n_tickers, count(*) FILTER (WHERE rho > 0) AS n_positive, count(*) FILTER (WHERE {SIG}) AS n_significant, r6(median(round(rho, 4))) AS median_rho FROM v_record")
def _(m):
    return rounded(ev.aggregate_stats(ev.ticker_records(oos(m))))


@query("track_record_fallback", "L-20", f"""
SELECT s.ticker, r4(coalesce(r.rho, (SELECT median(round(rho, 4)) FROM v_record))) AS rho, CASE WHEN r.rho IS NULL THEN 'aggregate' ELSE 'ticker' END AS source FROM v_sectors s LEFT JOIN (SELECT * FROM v_record WHERE {SIG}) r USING (ticker)""")
def _(m):
    records = ev.ticker_records(oos(m))
    out = ev.track_record(m.sectors.select("ticker"), records.filter("significant").select("ticker", "rho"), ev.aggregate_stats(records).select("median_rho"))
    return rounded(out, 4)


@query("event_threshold_backtest", "L-21", """
SELECT subset, count(*) AS n, r6(avg((label = 'WIN')::INT)) AS win_rate, r6(avg(relative_ret_30d)) AS avg_ret, r5(avg(relative_ret_30d)/(stddev_samp(relative_ret_30d)+1e-8)*2) AS sharpe
FROM (SELECT *, 1/(1+exp(-surprise_pct*10)) AS prob FROM v_events) e, (VALUES ('baseline'), ('buy'), ('sell')) s(subset) WHERE subset = 'baseline' OR (subset = 'buy' AND prob >= 0.55) OR (subset = 'sell' AND prob < 0.45) GROUP BY subset""")
def _(m):
    m.staged()
    events = earnings_events(m.earnings, m.bars, m.bench).withColumn("prob", 1 / (1 + F.exp(-F.col("surprise_pct") * 10)))
    return rounded(ev.threshold_backtest(events, "prob", "relative_ret_30d"), sharpe=5)


ORACLE_VIEWS["v_ls"] = "SELECT date, avg(fwd_return) FILTER (WHERE leg = 1) AS top_ret, avg(fwd_return) FILTER (WHERE leg = -1) AS bottom_ret FROM v_leg5 GROUP BY date"
ORACLE_VIEWS["v_spread"] = "SELECT avg(top_ret) AS avg_top_ret, avg(bottom_ret) AS avg_bottom_ret, avg(top_ret-bottom_ret) AS avg_spread, avg((top_ret > bottom_ret)::INT) AS hit_rate, avg(top_ret-bottom_ret)*252/5 AS ann_spread, count(*) AS n_days FROM v_ls"


@query("long_short_spread", "L-22, F-07, E-04, C-13", "SELECT r6(avg_top_ret) AS avg_top_ret, r6(avg_bottom_ret) AS avg_bottom_ret, r6(avg_spread) AS avg_spread, r6(hit_rate) AS hit_rate, r6(ann_spread) AS ann_spread, n_days FROM v_spread")
def _(m):
    return rounded(ev.long_short_spread(oos(m)))


ORACLE_VIEWS["v_turn"] = """
SELECT d.date, d.no, t.turnover, t.top_ret - t.bottom_ret AS spread FROM v_kept d JOIN (
 SELECT a.date, sum((b.ticker IS NULL)::INT/greatest(1, floor(a.n*0.1)))/2 AS turnover, avg(a.fwd_return) FILTER (WHERE a.leg = 1) AS top_ret, avg(a.fwd_return) FILTER (WHERE a.leg = -1) AS bottom_ret
 FROM v_leg10 a JOIN v_kept k ON k.date = a.date LEFT JOIN v_kept p ON p.no = k.no - 1 LEFT JOIN v_leg10 b ON b.date = p.date AND b.ticker = a.ticker AND b.leg = a.leg GROUP BY a.date) t ON t.date = d.date"""
ORACLE_VIEWS["v_kept"] = "SELECT date, row_number() OVER (ORDER BY date) AS no FROM (SELECT DISTINCT date FROM v_leg10) z"


@query("leg_turnover", "L-23", "SELECT date, r6(spread) AS spread, r6(CASE WHEN no > 1 THEN turnover END) AS turnover FROM v_turn")
def _(m):
    return rounded(ev.leg_turnover(oos(m)).select("date", "spread", "turnover"))


ORACLE_VIEWS["v_costs"] = """
SELECT CAST(bps AS INT) AS bps, g, hit, t, g - t*bps/10000 AS net FROM (SELECT avg(spread) AS g, avg((spread > 0)::INT) AS hit, avg(CASE WHEN no > 1 THEN turnover END) AS t FROM v_turn) a, (VALUES (5), (10), (20), (50)) b(bps)"""


@query("cost_sweep", "L-24", "SELECT bps, r6(g) AS gross_spread, r6(g*252/5) AS gross_annual_spread, r6(hit) AS hit_rate, r6(t) AS turnover, r5(t*252) AS annual_turnover, r6(net) AS net_spread, r6(net*252/5) AS net_annual_spread FROM v_costs")
def _(m):
    return rounded(ev.cost_sweep(ev.leg_turnover(oos(m))), annual_turnover=5)


@query("deploy_verdict", "L-25", "SELECT bps, (SELECT passed FROM v_gate) AND (SELECT avg_spread > 0 FROM v_spread) AS cleared, CASE WHEN net*252/5 > 0.06 THEN 'still worth running' WHEN net > 0 THEN 'marginal' ELSE 'dead — costs eat the whole edge' END AS verdict FROM v_costs")
def _(m):
    m.staged()
    gate = ev.validation_gate(yearly_rho(m).select(F.col("yr").alias("fold"), "rho"), "rho", 0.03, 0.0, 0.5)
    return ev.deploy_verdict(gate, ev.long_short_spread(oos(m)), ev.cost_sweep(ev.leg_turnover(oos(m))))


# ---- books -----------------------------------------------------------------
ORACLE_VIEWS["v_cal"] = "SELECT date, n, row_number() OVER (ORDER BY date) - 1 AS i, lead(date) OVER (ORDER BY date) AS nd, lag(date) OVER (ORDER BY date) AS pd FROM (SELECT date, count(pred_return) AS n FROM v_pred GROUP BY date) z"
ORACLE_VIEWS["v_ret"] = "SELECT p.*, x.close/p.close - 1 AS ret FROM v_pred p JOIN v_cal c ON c.date = p.date LEFT JOIN v_pred x ON x.ticker = p.ticker AND x.date = c.nd"
ORACLE_VIEWS["v_own"] = "SELECT p.ticker, p.date, c.i, p.close/x.close - 1 AS r, m.m FROM v_pred p JOIN v_cal c ON c.date = p.date LEFT JOIN v_pred x ON x.ticker = p.ticker AND x.date = c.pd LEFT JOIN v_mkt m ON m.date = p.date"
ORACLE_VIEWS["v_mkt"] = "SELECT date, close/lag(close) OVER (ORDER BY date) - 1 AS m FROM v_bench"


def beta_sql(n):
    return f"""SELECT a.ticker, a.date, CASE WHEN count(CASE WHEN b.r IS NOT NULL AND b.m IS NOT NULL THEN 1 END) = {n} THEN covar_samp(b.r, b.m)/var_samp(b.m) END AS beta
FROM v_own a JOIN v_own b ON b.ticker = a.ticker AND b.i BETWEEN a.i - {n - 1} AND a.i GROUP BY a.ticker, a.date"""


ORACLE_VIEWS["v_beta60"], ORACLE_VIEWS["v_beta5"] = beta_sql(60), beta_sql(5)


@query("next_day_return", "M-01", "SELECT ticker, date, r6(ret) AS ret FROM v_ret")
def _(m):
    return rounded(bk.next_day_return(predictions(m.bars)).select("ticker", "date", "ret"))


@query("trailing_beta", "M-02", "SELECT a.ticker, a.date, r5(a.beta) AS beta_60, r5(b.beta) AS beta_5 FROM v_beta60 a JOIN v_beta5 b USING (ticker, date)")
def _(m):
    m.staged()
    rows = predictions(m.bars)
    wide, narrow = bk.trailing_beta(rows, m.bench, 60), bk.trailing_beta(rows, m.bench, 5)
    return rounded(wide.withColumnRenamed("beta", "beta_60").join(narrow.withColumnRenamed("beta", "beta_5"), ["ticker", "date"]), 5)


def _configs_sql(rows):
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).lower()
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows) + ") c(config, hysteresis, vol_weight, fraction, top_n, every, neutral)"


def held_views(tag, rows):
    """Book oracle by plain joins over day numbers, one step per rule."""
    v = ORACLE_VIEWS
    v[f"v_cfg{tag}"] = _configs_sql(rows)
    v[f"v_day{tag}"] = f"""SELECT *, last_value(CASE WHEN reb THEN v END IGNORE NULLS) OVER (PARTITION BY config ORDER BY date) AS block FROM (
 SELECT c.*, d.date, d.i, row_number() OVER (PARTITION BY config ORDER BY date) AS v, d.i % every = 0 AS reb FROM v_cal d, v_cfg{tag} c WHERE d.n >= 10) z"""
    v[f"v_rk{tag}"] = f"""SELECT p.ticker, p.pred_return, p.std_20, p.ret, b.beta, p.n, p.pct, d.*, g.leg, coalesce(top_n, greatest(1, floor(p.n*fraction))) AS target, CASE WHEN g.leg = 1 THEN p.hi ELSE p.lo END <= coalesce(top_n, greatest(1, floor(p.n*fraction))) AS pick
FROM v_prank p JOIN v_beta60 b USING (ticker, date) JOIN v_day{tag} d ON d.date = p.date, (VALUES (1), (-1)) g(leg)"""
    v[f"v_st{tag}"] = f"""SELECT a.*, CASE WHEN hysteresis THEN coalesce(last_value(CASE WHEN leg = 1 THEN CASE WHEN pct >= 1 - fraction THEN true WHEN pct < 0.6 THEN false END ELSE CASE WHEN pct <= fraction THEN true WHEN pct > 0.4 THEN false END END IGNORE NULLS) OVER (PARTITION BY config, leg, ticker, isl ORDER BY v), false)
  ELSE EXISTS (SELECT 1 FROM v_rk{tag} s WHERE s.config = a.config AND s.leg = a.leg AND s.ticker = a.ticker AND s.v = a.block AND s.pick) AND a.seen = a.v - a.block + 1 END AS held
FROM (SELECT *, v - row_number() OVER (PARTITION BY config, leg, ticker ORDER BY v) AS isl, count(*) OVER (PARTITION BY config, leg, ticker, block ORDER BY v) AS seen FROM v_rk{tag}) a"""
    v[f"v_hold{tag}"] = f"""SELECT *, CASE WHEN vol_weight AND sum(inv) OVER g IS NOT NULL THEN inv/sum(inv) OVER g ELSE 1/count(*) OVER g END AS weight FROM (
 SELECT a.*, 1/nullif(a.std_20, 0) AS inv, NOT coalesce(b.held, false) AS fresh FROM v_st{tag} a LEFT JOIN v_st{tag} b ON b.config = a.config AND b.leg = a.leg AND b.ticker = a.ticker AND b.v = a.v - 1 WHERE a.held) z WINDOW g AS (PARTITION BY config, date, leg)"""
    v[f"v_book{tag}"] = f"""SELECT config, date, nl AS n_long, ns AS n_short, gl + gs*k AS gross_exposure, gl - gs*k AS net_exposure, rl - rs*k AS ret, k AS short_scale, CASE WHEN usable THEN bl - k*bs END AS net_beta, CASE WHEN reb THEN (tl + ts)/2 END AS turnover FROM (
 SELECT *, CASE WHEN usable THEN least(greatest(bl/bs, 0.2), 5) ELSE 1.0 END AS k FROM (SELECT *, neutral AND bs <> 0 AND nl > 0 AND ns > 0 AS usable FROM (
  SELECT config, neutral, reb, date, count(*) FILTER (WHERE leg = 1) AS nl, count(*) FILTER (WHERE leg = -1) AS ns, coalesce(sum(weight) FILTER (WHERE leg = 1), 0) AS gl, coalesce(sum(weight) FILTER (WHERE leg = -1), 0) AS gs,
   sum(weight*ret) FILTER (WHERE leg = 1)/sum(weight) FILTER (WHERE leg = 1 AND ret IS NOT NULL) AS rl, sum(weight*ret) FILTER (WHERE leg = -1)/sum(weight) FILTER (WHERE leg = -1 AND ret IS NOT NULL) AS rs,
   coalesce(sum(weight*beta) FILTER (WHERE leg = 1), 0) AS bl, coalesce(sum(weight*beta) FILTER (WHERE leg = -1), 0) AS bs, coalesce(sum(1/target) FILTER (WHERE leg = 1 AND fresh), 0) AS tl, coalesce(sum(1/target) FILTER (WHERE leg = -1 AND fresh), 0) AS ts
  FROM v_hold{tag} GROUP BY config, neutral, reb, date) a) b) c"""
    v[f"v_sum{tag}"] = f"""SELECT *, ar/nullif(av, 0) AS sh FROM (SELECT config, avg(ret)*252 AS ar, stddev_samp(ret)*sqrt(252) AS av, avg(turnover) AS t, count(ret) AS nd, max(abs(net_exposure)) AS mn, date_diff('day', min(date), max(date))/365.25 AS yrs FROM v_book{tag} GROUP BY config) z"""
    v[f"v_ab{tag}"] = f"""SELECT config, a*252 AS aa, b, a/sqrt((syy - b*sxy)/(n-2)*(1/n + mx*mx/sxx)) AS ta, n FROM (SELECT config, count(*)::DOUBLE AS n, regr_intercept(ret, m) AS a, regr_slope(ret, m) AS b, regr_sxx(ret, m) AS sxx, regr_syy(ret, m) AS syy, regr_sxy(ret, m) AS sxy, avg(m) AS mx
 FROM v_book{tag} JOIN v_mkt USING (date) WHERE ret IS NOT NULL AND m IS NOT NULL GROUP BY config) z WHERE n >= 30"""


ORACLE_VIEWS["v_prank"] = """
SELECT *, (rank() OVER (PARTITION BY date ORDER BY pred_return) + (count(*) OVER (PARTITION BY date, pred_return) - 1)/2.0)/n AS pct FROM (
 SELECT *, count(*) OVER (PARTITION BY date) AS n, row_number() OVER (PARTITION BY date ORDER BY pred_return, ticker) AS lo, row_number() OVER (PARTITION BY date ORDER BY pred_return DESC, ticker DESC) AS hi FROM v_ret WHERE pred_return IS NOT NULL) z WHERE n >= 10"""
held_views("1", bk.ROUND_ONE)
held_views("2", bk.ROUND_TWO)


def held(m, rows):
    m.staged()
    base = predictions(m.bars)
    beta = bk.trailing_beta(base, m.bench)
    ready = bk.next_day_return(base).join(beta, ["ticker", "date"])
    return bk.holdings(ready, bk.configs(m.spark, rows))


@query("book_holdings", "M-03, M-05, M-06", "SELECT config, ticker, date, leg, r6(weight) AS weight, fresh FROM v_hold1")
def _(m):
    return rounded(held(m, bk.ROUND_ONE).select("config", "ticker", "date", "leg", "weight", "fresh"))


@query("rebalanced_holdings", "M-04, M-06", "SELECT config, ticker, date, leg, r6(weight) AS weight, fresh FROM v_hold2")
def _(m):
    return rounded(held(m, bk.ROUND_TWO).select("config", "ticker", "date", "leg", "weight", "fresh"))


@query("daily_book", "M-07, M-08, M-09", "SELECT config, date, n_long, n_short, r6(gross_exposure) AS gross_exposure, r6(net_exposure) AS net_exposure, r6(ret) AS ret, r6(short_scale) AS short_scale, r6(net_beta) AS net_beta, r6(turnover) AS turnover FROM v_book2")
def _(m):
    return rounded(bk.daily_book(held(m, bk.ROUND_TWO)))


@query("book_summary", "M-10", "SELECT config, r6(ar) AS ann_return, r6(av) AS ann_vol, r6(sh) AS sharpe, r6(t) AS turnover, nd AS n_days FROM v_sum1")
def _(m):
    return rounded(bk.summary(bk.daily_book(held(m, bk.ROUND_ONE))).select("config", "ann_return", "ann_vol", "sharpe", "turnover", "n_days"))


@query("sharpe_standard_errors", "M-11", f"SELECT config, r6(sqrt((1 + 0.5*sh*sh/252)/nd)*sqrt(252)) AS se_daily_based, r6(1/sqrt(yrs)) AS se_annual_block FROM v_sum1")
def _(m):
    return rounded(bk.sharpe_errors(bk.summary(bk.daily_book(held(m, bk.ROUND_ONE)))).select("config", "se_daily_based", "se_annual_block"))


@query("alpha_beta", "M-12", "SELECT config, r6(aa) AS alpha_annualized, r6(b) AS beta, r5(ta) AS t_stat_alpha, CAST(n AS BIGINT) AS n_obs FROM v_ab1")
def _(m):
    return rounded(bk.alpha_beta(bk.daily_book(held(m, bk.ROUND_ONE)), m.bench), t_stat_alpha=5)


def mixed_sql(source, value, salt, out):
    """The integer mixer of the bootstrap, step by step."""
    steps = f"SELECT *, (({value})*1000003 + ({salt})*7919) & {bk.MASK} AS x FROM {source}"
    for _ in range(3):
        steps = f"SELECT * REPLACE ((xor(x, x >> 16)*{bk.MIXER}) & {bk.MASK} AS x) FROM ({steps})"
    return f"SELECT * EXCLUDE (x), xor(x, x >> 16) AS {out} FROM ({steps})"


ORACLE_VIEWS["v_starts"] = mixed_sql("(" + mixed_sql("(SELECT path, b FROM range(0, 1000) p(path), range(0, 1000) q(b))", "path", "42", "h") + ")", "h", "b + 1", "s")


for tag in ("1", "2"):
    ORACLE_VIEWS[f"v_boot{tag}"] = f"""
SELECT config, quantile_cont(sr, 0.05) AS p5, quantile_cont(sr, 0.5) AS p50, quantile_cont(sr, 0.95) AS p95 FROM (
 SELECT d.config, d.path, CASE WHEN stddev_pop(s.ret) > 0 THEN avg(s.ret)*252/(stddev_pop(s.ret)*sqrt(252)) ELSE 0 END AS sr
 FROM (SELECT z.config, path, b, o, s % (n - 20) + o AS k FROM (SELECT config, count(ret) AS n FROM v_book{tag} GROUP BY config) z, v_starts, range(0, 20) r(o) WHERE b < ceil(n/20) AND b*20 + o < n AND n >= 100) d
 JOIN (SELECT config, ret, row_number() OVER (PARTITION BY config ORDER BY date) - 1 AS k FROM v_book{tag} WHERE ret IS NOT NULL) s ON s.config = d.config AND s.k = d.k GROUP BY d.config, d.path) x GROUP BY config"""


@query("block_bootstrap_sharpe", "M-13", "SELECT config, r5(p5) AS p5, r5(p50) AS p50, r5(p95) AS p95 FROM v_boot1")
def _(m):
    return rounded(bk.block_bootstrap(cut_lineage(bk.daily_book(held(m, bk.ROUND_ONE)))), 5)


def compare_sql(tag):
    return f"""
SELECT s.config, r6(sh) AS sharpe, r6(sqrt((1 + 0.5*sh*sh/252)/nd)*sqrt(252)) AS se_daily_based, r6(1/sqrt(yrs)) AS se_annual_block, r5(p5) AS sharpe_p5, r5(p95) AS sharpe_p95, 252.0/every AS rebalances_per_yr, r6(ar) AS ann_return, r6(av) AS ann_vol, r6(t) AS turnover, mn < 0.05 AS net_exposure_ok,
 r6(aa) AS alpha_annualized, r6(b) AS beta, r5(ta) AS t_stat_alpha, r6(ar - t*10/10000*252/every) AS net_return_10bps, r6(ar - t*20/10000*252/every) AS net_return_20bps FROM v_sum{tag} s LEFT JOIN v_ab{tag} USING (config) LEFT JOIN v_boot{tag} USING (config) JOIN v_cfg{tag} USING (config)"""


def comparison(m, rows):
    daily = cut_lineage(bk.daily_book(held(m, rows)))
    return rounded(bk.compare(daily, m.bench, bk.configs(m.spark, rows)), t_stat_alpha=5, sharpe_p5=5, sharpe_p95=5)


@query("two_by_two_books", "M-14", compare_sql("1"))
def _(m):
    return comparison(m, bk.ROUND_ONE)


@query("six_book_comparison", "M-15", compare_sql("2"))
def _(m):
    return comparison(m, bk.ROUND_TWO)


ORACLE_VIEWS["v_curve"] = "SELECT *, cum/max(cum) OVER (PARTITION BY config ORDER BY date) - 1 AS dd FROM (SELECT config, date, ret, exp(sum(ln(1+ret)) OVER (PARTITION BY config ORDER BY date)) AS cum FROM v_book1 WHERE ret IS NOT NULL) z"


@query("book_drawdown", "M-16", "SELECT config, r6(min(dd)) AS max_drawdown, arg_min(date, dd) AS max_drawdown_date FROM v_curve GROUP BY config")
def _(m):
    return rounded(bk.drawdown_and_years(bk.daily_book(held(m, bk.ROUND_ONE)))[0])


@query("book_years", "M-16", "SELECT config, CAST(year AS INT) AS year, r6(s) AS year_return, r5(s/sum(s) OVER (PARTITION BY config)) AS share FROM (SELECT config, year(date) AS year, sum(ret) AS s FROM v_curve GROUP BY 1, 2) z")
def _(m):
    return rounded(bk.drawdown_and_years(bk.daily_book(held(m, bk.ROUND_ONE)))[1], share=5)


ORACLE_VIEWS["v_livew"] = f"""
SELECT ticker, date, pred_return, leg, CASE leg WHEN 'long' THEN w WHEN 'short' THEN -w ELSE 0.0 END AS weight FROM (SELECT *, coalesce(inv/sum(inv) OVER (PARTITION BY date, leg), CASE WHEN sum(inv) OVER (PARTITION BY date, leg) IS NULL THEN 1/count(*) OVER (PARTITION BY date, leg) END, 0) AS w FROM (
 SELECT *, 1/nullif(std_20, 0) AS inv, CASE WHEN row_number() OVER (PARTITION BY date ORDER BY pred_return, ticker) <= q THEN 'short' WHEN row_number() OVER (PARTITION BY date ORDER BY pred_return DESC, ticker DESC) <= q THEN 'long' ELSE 'none' END AS leg
 FROM (SELECT *, greatest(1, floor(count(*) OVER (PARTITION BY date)*0.2)) AS q FROM v_pred WHERE pred_return IS NOT NULL) a) b) c"""


@query("signed_live_weights", "M-17", "SELECT ticker, date, leg, r6(weight) AS weight FROM v_livew")
def _(m):
    rows = predictions(m.bars).filter(F.col("pred_return").isNotNull())
    return rounded(bk.live_weights(rows).select("ticker", "date", "leg", "weight"))
