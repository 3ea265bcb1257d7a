"""Long-short books: selection, weights, returns, exposure and statistics.

All configurations are an extra key of one plan. Holding rules are window
expressions over valid days: a rebalancing block is a partition key, presence is
a running count, and the hysteresis band is a last-decision carry. Groups are
one name's days in one configuration, or one date's names.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.exprs import by_ticker, clip
from tapeloom.functions.rolling import Roll, rolled

YEAR = 252
MASK, MIXER = 2**31 - 1, 73244475   # 31 bits times 27 bits stay below 2**63
CONFIG = ("config", "hysteresis", "vol_weight", "fraction", "top_n", "every", "neutral")
# Names of the compared books.
ROUND_ONE = [("A: naive + equal", False, False, 0.1, None, 1, False), ("B: hysteresis + equal", True, False, 0.1, None, 1, False),
             ("C: naive + inverse-vol", False, True, 0.1, None, 1, False), ("D: hysteresis + inv-vol", True, True, 0.1, None, 1, False)]
ROUND_TWO = [("C (baseline: decile, daily, vol-wt)", False, True, 0.1, None, 1, False), ("quintile (top/bottom 20%, daily)", False, True, 0.2, None, 1, False),
             ("fixed-20 names, daily", False, True, 0.1, 20, 1, False), ("C, rebalance every 3d", False, True, 0.1, None, 3, False),
             ("C, rebalance every 5d (signal horizon)", False, True, 0.1, None, 5, False), ("C, beta-neutralized", False, True, 0.1, None, 1, True)]
LEAST = 10


def configs(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, "config string, hysteresis boolean, vol_weight boolean, fraction double, top_n int, every int, neutral boolean")


def calendar(rows: DataFrame) -> DataFrame:
    """Distinct dates with their number and the next date (one row per day)."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    days = rows.groupBy("date").agg(F.count("pred_return").alias("n"))
    return days.select("date", "n", (F.row_number().over(w) - 1).alias("i"), F.lead("date").over(w).alias("next_date"), F.lag("date").over(w).alias("prev_date"))


def next_day_return(rows: DataFrame) -> DataFrame:
    """Return to the next calendar date; NULL when the ticker skips it."""
    days = calendar(rows).select("date", "next_date")
    w = by_ticker()
    ahead = rows.select("*", F.lead("date").over(w).alias("_d"), F.lead("close").over(w).alias("_c"))
    joined = ahead.join(days, "date")
    return joined.select(*rows.columns, F.when(F.col("_d") == F.col("next_date"), F.col("_c") / F.col("close") - 1).alias("ret"))


def trailing_beta(rows: DataFrame, benchmark: DataFrame, window: int = 60) -> DataFrame:
    """Covariance over variance against the benchmark in a full window.

    The window counts calendar dates; a date without the ticker breaks it.
    """
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    market = benchmark.select("date", (F.col("close") / F.lag("close").over(w) - 1).alias("_m"))
    days = calendar(rows).select("date", "i", "prev_date")
    s = by_ticker()
    own = rows.select("ticker", "date", "close", F.lag("date").over(s).alias("_d"), F.lag("close").over(s).alias("_c"))
    joined = own.join(days, "date").join(market, "date", "left")
    r = F.when(F.col("_d") == F.col("prev_date"), F.col("close") / F.col("_c") - 1)
    staged = joined.select("ticker", "date", "i", "_m", r.alias("_r"))
    both = F.col("_r").isNotNull() & F.col("_m").isNotNull()
    x, y = F.when(both, F.col("_m")), F.when(both, F.col("_r"))
    sums = rolled(staged, [Roll("sum", x, {window: "_sx"}), Roll("sum", y, {window: "_sy"}), Roll("sum", x * x, {window: "_sxx"}),
                           Roll("sum", x * y, {window: "_sxy"}), Roll("sum", both.cast("double"), {window: "_k"})])
    first = F.lag("i", window - 1).over(s)
    whole = (F.col("_k") == window) & (F.col("i") - first == window - 1)
    vx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / window
    return sums.select("ticker", "date", F.when(whole & (vx > 0), (F.col("_sxy") - F.col("_sx") * F.col("_sy") / window) / vx).alias("beta"))


def _ranked(rows: DataFrame) -> DataFrame:
    up = Window.partitionBy("date").orderBy("pred_return", "ticker")
    down = Window.partitionBy("date").orderBy(F.col("pred_return").desc(), F.col("ticker").desc())
    day = Window.partitionBy("date")
    ties = F.count("*").over(Window.partitionBy("date", "pred_return"))
    n = F.count("*").over(day)
    ranked = rows.filter(F.col("pred_return").isNotNull()).select(
        "*", n.alias("n"), F.row_number().over(up).alias("lo"), F.row_number().over(down).alias("hi"),
        ((F.rank().over(Window.partitionBy("date").orderBy("pred_return")) + (ties - 1) / 2) / n).alias("pct"))
    return ranked.filter(F.col("n") >= LEAST)


def holdings(rows: DataFrame, setups: DataFrame) -> DataFrame:
    """Names held per config, date and leg, with weight and a new-name flag."""
    days = calendar(rows).filter(F.col("n") >= LEAST)
    per = days.select("date", "i").crossJoin(F.broadcast(setups))   # a handful of configs
    w = Window.partitionBy("config").orderBy("date")
    per = per.select("*", F.row_number().over(w).alias("v"), (F.col("i") % F.col("every") == 0).alias("rebalance"))
    per = per.withColumn("block", F.last(F.when(F.col("rebalance"), F.col("v")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wide = _ranked(rows).join(per, "date").withColumn("leg", F.explode(F.array(F.lit(1), F.lit(-1))))
    target = F.coalesce(F.col("top_n"), F.greatest(F.lit(1), F.floor(F.col("n") * F.col("fraction"))).cast("int"))
    long = F.col("leg") == 1
    chosen = F.when(long, F.col("hi") <= target).otherwise(F.col("lo") <= target)
    name = Window.partitionBy("config", "leg", "ticker")
    block = Window.partitionBy("config", "leg", "ticker", "block").orderBy("v")
    upto = (Window.unboundedPreceding, 0)
    placed = wide.select("*", target.alias("target"), chosen.alias("_chosen"), (F.col("v") - F.row_number().over(name.orderBy("v"))).alias("_run"))
    # Naive: chosen on the block's first day and present on every valid day since.
    there = F.count("*").over(block.rowsBetween(*upto)) == F.col("v") - F.col("block") + 1
    naive = F.coalesce(F.first("_chosen").over(block.rowsBetween(*upto)) & there & F.col("block").isNotNull(), F.lit(False))
    # Band: enter at the fraction, stay inside forty per cent, absence ends it.
    enter = F.when(long, F.col("pct") >= 1 - F.col("fraction")).otherwise(F.col("pct") <= F.col("fraction"))
    leave = F.when(long, F.col("pct") < 0.6).otherwise(F.col("pct") > 0.4)
    run = Window.partitionBy("config", "leg", "ticker", "_run").orderBy("v").rowsBetween(*upto)
    band = F.coalesce(F.last(F.when(enter, True).when(leave, False), ignorenulls=True).over(run), F.lit(False))
    held = placed.withColumn("held", F.when(F.col("hysteresis"), band).otherwise(naive)).drop("_chosen", "_run")
    before = name.orderBy("v")
    stayed = (F.lag("v").over(before) == F.col("v") - 1) & F.lag("held").over(before)
    held = held.select("*", (F.col("held") & ~F.coalesce(stayed, F.lit(False))).alias("fresh")).filter("held")
    inverse = F.when(F.col("std_20") != 0, 1 / F.col("std_20"))
    held = held.withColumn("_inv", inverse)
    group = Window.partitionBy("config", "date", "leg")
    scaled = F.sum("_inv").over(group)
    weight = F.when(F.col("vol_weight") & scaled.isNotNull(), F.col("_inv") / scaled).otherwise(1 / F.count("*").over(group))
    return held.withColumn("weight", weight).drop("_inv")


def daily_book(held: DataFrame) -> DataFrame:
    """Return and exposure of each config and date."""
    w, r = F.col("weight"), F.col("ret")

    def leg(sign: int) -> list[Column]:
        on, tag = F.col("leg") == sign, "l" if sign == 1 else "s"
        paid = F.when(on & r.isNotNull(), w)
        return [F.sum(paid * r).alias(f"_wr_{tag}"), F.sum(paid).alias(f"_w_{tag}"), F.coalesce(F.sum(F.when(on, w)), F.lit(0.0)).alias(f"_g_{tag}"),
                F.coalesce(F.sum(F.when(on, w * F.col("beta"))), F.lit(0.0)).alias(f"_b_{tag}"), F.count_if(on).alias(f"n_{'long' if sign == 1 else 'short'}"),
                F.sum(F.when(on & F.col("fresh"), 1 / F.col("target"))).alias(f"_t_{tag}")]
    daily = held.groupBy("config", "neutral", "rebalance", "date").agg(*leg(1), *leg(-1))
    usable = F.col("neutral") & (F.col("_b_s") != 0) & (F.col("n_long") > 0) & (F.col("n_short") > 0)
    scale = F.when(usable, clip(F.col("_b_l") / F.col("_b_s"), 0.2, 5)).otherwise(1.0)
    daily = daily.withColumn("short_scale", scale)
    k = F.col("short_scale")
    return daily.select("config", "date", "n_long", "n_short", (F.col("_g_l") + F.col("_g_s") * k).alias("gross_exposure"), (F.col("_g_l") - F.col("_g_s") * k).alias("net_exposure"),
                        F.when(usable, F.col("_b_l") - k * F.col("_b_s")).alias("net_beta"), "short_scale",
                        (F.col("_wr_l") / F.col("_w_l") - F.col("_wr_s") / F.col("_w_s") * k).alias("ret"),
                        F.when(F.col("rebalance"), (F.coalesce("_t_l", F.lit(0.0)) + F.coalesce("_t_s", F.lit(0.0))) / 2).alias("turnover"))


def summary(daily: DataFrame) -> DataFrame:
    s = F.stddev_samp("ret") * YEAR ** 0.5
    out = daily.groupBy("config").agg((F.avg("ret") * YEAR).alias("ann_return"), s.alias("ann_vol"), F.avg("turnover").alias("turnover"), F.count("ret").alias("n_days"),
                                      (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"),
                                      F.max(F.abs("net_exposure")).alias("max_abs_net"), F.avg("gross_exposure").alias("gross"))
    return out.withColumn("sharpe", F.when(F.col("ann_vol") > 0, F.col("ann_return") / F.col("ann_vol")))


def sharpe_errors(book: DataFrame) -> DataFrame:
    """Standard errors by days and by years, both as the book's own dates span them."""
    daily = F.col("sharpe") / YEAR ** 0.5
    return book.select("*", (F.sqrt((1 + 0.5 * daily * daily) / F.col("n_days")) * YEAR ** 0.5).alias("se_daily_based"), F.when(F.col("years") > 0, 1 / F.sqrt("years")).alias("se_annual_block"))


def alpha_beta(daily: DataFrame, benchmark: DataFrame, least: int = 30) -> DataFrame:
    """OLS on the benchmark's next-day return; the regression is one aggregate."""
    w = Window.partitionBy(F.lit(1)).orderBy("date")
    market = benchmark.select("date", (F.col("close") / F.lag("close").over(w) - 1).alias("m")).dropna()
    joined = daily.filter(F.col("ret").isNotNull()).join(market, "date")
    fit = joined.groupBy("config").agg(F.count("*").alias("n_obs"), F.regr_slope("ret", "m").alias("beta"), F.regr_intercept("ret", "m").alias("_a"),
                                       F.regr_sxx("ret", "m").alias("_sxx"), F.regr_syy("ret", "m").alias("_syy"), F.regr_sxy("ret", "m").alias("_sxy"), F.avg("m").alias("_mx"))
    rss = F.col("_syy") - F.col("beta") * F.col("_sxy")
    se = F.sqrt(rss / (F.col("n_obs") - 2) * (1 / F.col("n_obs") + F.col("_mx") * F.col("_mx") / F.col("_sxx")))
    return fit.filter(F.col("n_obs") >= least).select("config", (F.col("_a") * YEAR).alias("alpha_annualized"), "beta", (F.col("_a") / se).alias("t_stat_alpha"), "n_obs")


def compare(daily: DataFrame, benchmark: DataFrame, setups: DataFrame, bps=(10, 20)) -> DataFrame:
    """Summary, errors, bootstrap bounds, alpha, rebalances and net returns of every configuration."""
    bounds = block_bootstrap(daily).select("config", F.col("p5").alias("sharpe_p5"), F.col("p95").alias("sharpe_p95"))
    book = sharpe_errors(summary(daily)).join(bounds, "config", "left").join(alpha_beta(daily, benchmark), "config", "left").join(F.broadcast(setups.select("config", "every")), "config")   # a handful of configs
    nets = [(F.col("ann_return") - F.col("turnover") * (b / 10000) * (YEAR / F.col("every"))).alias(f"net_return_{b}bps") for b in bps]
    return book.select("config", "sharpe", "se_daily_based", "se_annual_block", "sharpe_p5", "sharpe_p95", (YEAR / F.col("every")).alias("rebalances_per_yr"), "ann_return", "ann_vol", "turnover", (F.col("max_abs_net") < 0.05).alias("net_exposure_ok"),
                       "alpha_annualized", "beta", "t_stat_alpha", *nets)


def mix31(df: DataFrame, column: str, salt: Column) -> DataFrame:
    """Append `_mixed`: a 31-bit integer that looks random, from a number and a salt (multiply, shift, xor: no overflow)."""
    out = df.withColumn("_mixed", ((F.col(column).cast("bigint") * 1000003) + salt.cast("bigint") * 7919).bitwiseAND(MASK))
    for _ in range(3):
        out = out.withColumn("_mixed", (F.col("_mixed").bitwiseXOR(F.shiftright("_mixed", 16)) * MIXER).bitwiseAND(MASK))
    return out.withColumn("_mixed", F.col("_mixed").bitwiseXOR(F.shiftright("_mixed", 16)))


def block_bootstrap(daily: DataFrame, block: int = 20, n_boot: int = 1000, seed: int = 42) -> DataFrame:
    """Percentiles of the Sharpe over resampled paths of whole blocks.

    Block starts come from an integer mixer over (path, block), so they are reproducible and independent of each other. A drawn block
    is one row: its sums of returns and squares are differences of running sums, which every config carries as two arrays with an
    entry per trading day (a path's last block may be cut).
    """
    w = Window.partitionBy("config").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    days = daily.filter(F.col("ret").isNotNull()).select("config", "date", F.sum("ret").over(w).alias("s"), F.sum(F.col("ret") * F.col("ret")).over(w).alias("q"))
    run = F.array_sort(F.collect_list(F.struct("date", "s", "q")))
    zero = F.array(F.lit(0.0))
    series = days.groupBy("config").agg(F.count("*").alias("_n"), run.alias("_run")).filter(F.col("_n") >= block * 5)
    series = series.select("config", "_n", F.concat(zero, F.transform("_run", lambda x: x["s"])).alias("_s"), F.concat(zero, F.transform("_run", lambda x: x["q"])).alias("_q"))
    sizes = series.select("config", "_n")
    paths = sizes.withColumn("path", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))).withColumn("b", F.explode(F.expr(f"sequence(0, CAST(ceil(_n / {block}) AS INT) - 1)")))
    mixed = mix31(mix31(paths, "path", F.lit(seed)), "_mixed", F.col("b") + 1)
    start = (F.col("_mixed") % (F.col("_n") - block)).cast("int")
    drawn = mixed.select("config", "path", start.alias("_lo"), (start + F.least(F.lit(block), F.col("_n") - F.col("b") * block)).cast("int").alias("_hi"))
    met = drawn.join(F.broadcast(series), "config")     # one row per config
    def between(c: str) -> Column:
        return F.sum(F.get(c, F.col("_hi")) - F.get(c, F.col("_lo")))
    per = met.groupBy("config", "path").agg(between("_s").alias("_x"), between("_q").alias("_y"), F.max("_n").alias("_n"))
    mean = F.col("_x") / F.col("_n")
    sigma = F.sqrt(F.greatest(F.col("_y") / F.col("_n") - mean * mean, F.lit(0.0)))
    sr = F.when(sigma > 1e-12, mean * YEAR / (sigma * YEAR ** 0.5)).otherwise(0.0)
    return per.groupBy("config").agg(*[F.percentile(sr, F.lit(p / 100)).alias(f"p{p}") for p in (5, 50, 95)])


def drawdown_and_years(daily: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Worst drawdown with its date, and the sum of returns by year."""
    w = Window.partitionBy("config").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    curve = daily.filter(F.col("ret").isNotNull()).withColumn("cum", F.exp(F.sum(F.log1p("ret")).over(w)))
    curve = curve.withColumn("dd", F.col("cum") / F.max("cum").over(w) - 1)
    worst = curve.groupBy("config").agg(F.min("dd").alias("max_drawdown"), F.min_by("date", F.struct("dd", "date")).alias("max_drawdown_date"))
    years = curve.groupBy("config", F.year("date").alias("year")).agg(F.sum("ret").alias("year_return"))
    whole = F.sum("year_return").over(Window.partitionBy("config"))
    years = years.select("*", F.when(whole != 0, F.col("year_return") / whole).alias("share"))
    return worst, years


def live_weights(rows: DataFrame, fraction: float = 0.2) -> DataFrame:
    """Quintile legs and signed inverse-volatility weights of one date."""
    day = Window.partitionBy("date")
    n = F.count("*").over(day)
    q = F.greatest(F.lit(1), F.floor(n * fraction))
    up, down = day.orderBy("pred_return", "ticker"), day.orderBy(F.col("pred_return").desc(), F.col("ticker").desc())
    leg = F.when(F.row_number().over(up) <= q, "short").when(F.row_number().over(down) <= q, "long").otherwise("none")
    placed = rows.withColumn("leg", leg).withColumn("_inv", F.when(F.col("std_20") != 0, 1 / F.col("std_20")))
    group = Window.partitionBy("date", "leg")
    size = F.coalesce(F.when(F.sum("_inv").over(group).isNull(), 1 / F.count("*").over(group)).otherwise(F.col("_inv") / F.sum("_inv").over(group)), F.lit(0.0))
    weight = F.when(F.col("leg") == "long", size).when(F.col("leg") == "short", -size).otherwise(0.0)
    return placed.withColumn("weight", weight).drop("_inv")
