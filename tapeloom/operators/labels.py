"""Barrier labels, forward returns, regimes and the earnings-event set."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.exprs import by_ticker, change, clip, frame
from tapeloom.functions.ranks import exact_median
from tapeloom.operators.alignment import asof_backward, numbered
from tapeloom.operators.indicators import true_range
from tapeloom.session import cut_lineage

LOOKAHEAD = 21


def barrier_label(df: DataFrame, target: float = 3.0, stop: float = 1.5, lookahead: int = LOOKAHEAD,
                  atr: str = "atr_pct", out: str = "label") -> DataFrame:
    """First barrier touched in the next bars; on the same bar the stop wins.

    The look-ahead is unrolled into lead columns and one first-match chain, so
    it stays a single window pass and a compiled projection.
    """
    w = by_ticker()
    width = F.col(atr) * F.col("close")
    upper, lower = F.col("close") + target * width, F.col("close") - stop * width
    ahead = df.select("*", *[F.lead("high", k).over(w).alias(f"_h{k}") for k in range(1, lookahead + 1)],
                      *[F.lead("low", k).over(w).alias(f"_l{k}") for k in range(1, lookahead + 1)])
    touched = F.coalesce(*[F.when(F.col(f"_l{k}") <= lower, "LOSS").when(F.col(f"_h{k}") >= upper, "WIN")
                           for k in range(1, lookahead + 1)], F.lit("NEUTRAL"))
    known = F.col(f"_h{lookahead}").isNotNull()
    return ahead.select(*df.columns, F.when(known, touched).otherwise("NEUTRAL").alias(out))


def long_calls(df: DataFrame) -> DataFrame:
    """Resolved rows that the primary model called long."""
    kept = df.filter((F.col("pred_return") > 0) & (F.col("label") != "NEUTRAL"))
    return kept.withColumn("meta_label", (F.col("label") == "WIN").cast("int"))


def forward_return(days: int) -> Column:
    ahead = F.lead("close", days).over(by_ticker())
    return clip(F.when(F.col("close") != 0, ahead / F.col("close") - 1), -0.25, 0.25)


def add_target(df: DataFrame, days: int = 5, out: str = "fwd_return") -> DataFrame:
    return df.withColumn(out, forward_return(days)).filter(F.col(out).isNotNull())


def add_targets(df: DataFrame, days=(1, 3, 5, 10, 21)) -> DataFrame:
    """Several horizons in one window pass."""
    return df.select("*", *[forward_return(n).alias(f"fwd_{n}") for n in days])


def regime(benchmark: DataFrame, n: int = 63, edge: float = 0.03) -> DataFrame:
    w = Window.partitionBy(F.lit(1)).orderBy("date")   # one calendar-long series
    prior = F.lag("close", n).over(w)
    move = F.when(prior != 0, F.col("close") / prior - 1)
    return benchmark.select("date", F.when(move > edge, "bull").when(move < -edge, "bear").otherwise("neutral").alias("market_regime"))


def with_regime(df: DataFrame, benchmark: DataFrame) -> DataFrame:
    joined = df.join(regime(benchmark), "date", "left")
    return joined.withColumn("market_regime", F.coalesce("market_regime", F.lit("neutral")))


def training_panel(features: DataFrame, benchmark: DataFrame, warmup: int = 60, least: int = 30) -> DataFrame:
    """Labelled rows after the warm-up, without NEUTRAL, of tickers with enough rows."""
    labelled = barrier_label(features.withColumn("_rn", F.row_number().over(by_ticker())))
    kept = labelled.filter((F.col("_rn") > warmup) & (F.col("label") != "NEUTRAL")).drop("_rn")
    kept = kept.withColumn("_n", F.count("*").over(Window.partitionBy("ticker"))).filter(F.col("_n") >= least).drop("_n")
    return with_regime(kept, benchmark).withColumn("label_binary", (F.col("label") == "WIN").cast("int"))


EVENT_FUNDAMENTALS = ("revenue_growth", "profit_margin", "roe", "fcf_yield", "piotroski_score")


def _event_bars(bars: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Bars with everything an event needs from its entry bar and its eve."""
    w = by_ticker()
    market = benchmark.select("date", F.col("close").alias("_spy"))
    priced = bars.join(market, "date", "left").withColumn("_tr", true_range())
    spy = F.last("_spy", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.when(F.count("close").over(frame(252)) >= 50, F.max("close").over(frame(252)))
    base = priced.select("ticker", "date", "close", spy.alias("_spy"), F.row_number().over(w).alias("_rn"),
                         (F.avg("_tr").over(frame(14)) / (F.col("close") + 1e-8)).alias("_atr"), high.alias("_h52"))
    return base.select("*", F.lead("close", 30).over(w).alias("_exit"), F.lead("_spy", 30).over(w).alias("_spy_exit"),
                       *[F.lag(c, n).over(w).alias(f"_{c.strip('_')}_{n}") for c in ("close", "_spy") for n in (21, 63)])


def earnings_events(earnings: DataFrame, bars: DataFrame, benchmark: DataFrame, least: int = 4) -> DataFrame:
    """One row per report with surprise, pre-event and post-event returns."""
    order = Window.partitionBy("ticker").orderBy("earnings_date")
    clean = earnings.dropna(subset=["eps_actual", "eps_estimate", "surprise_pct"])
    surprise = F.col("surprise_pct") / 100
    events = clean.select("ticker", "earnings_date", surprise.alias("_s"),
                          F.coalesce(F.lag(surprise).over(order), F.lit(0.0)).alias("_p"),
                          F.count("*").over(Window.partitionBy("ticker")).alias("_n")).filter(F.col("_n") >= least)
    ready = _event_bars(bars, benchmark)
    row = F.struct(*[c for c in ready.columns if c != "ticker"])
    sides = events.select("ticker", F.col("earnings_date").alias("date"), F.struct("earnings_date", "_s", "_p").alias("_event")).unionByName(
        ready.select("ticker", "date", row.alias("_bar")), allowMissingColumns=True)
    w = Window.partitionBy("ticker").orderBy("date")
    found = sides.select("ticker", "_event",
                         F.first("_bar", ignorenulls=True).over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing)).alias("e"),
                         F.last("_bar", ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("b"))
    found = found.filter(F.col("_event").isNotNull() & F.col("e._exit").isNotNull() & (F.col("e._rn") > 63))
    entry, spy = F.col("e.close"), F.col("e._spy")
    stock_move = (F.col("e._exit") - entry) / (entry + 1e-8)
    spy_move = F.coalesce((F.col("e._spy_exit") - spy) / (spy + 1e-8), F.lit(0.0))

    def pre(n: int) -> Column:
        past, spy_past = F.col(f"e._close_{n}"), F.col(f"e._spy_{n}")
        return clip(entry / past - 1 - (spy - spy_past) / (spy_past + 1e-8), -0.5, 0.5)
    s, p = F.col("_event._s"), F.col("_event._p")
    out = found.select(
        "ticker", F.col("_event.earnings_date").alias("earnings_date"), F.col("e.date").alias("entry_date"),
        clip(s, -0.5, 0.5).alias("surprise_pct"), clip(p, -0.5, 0.5).alias("prev_surprise_pct"),
        clip(s - p, -0.5, 0.5).alias("surprise_acceleration"), pre(21).alias("pre_ret_1m_vs_spy"), pre(63).alias("pre_ret_3m_vs_spy"),
        clip(F.coalesce("b._atr", F.lit(0.02)), 0, 0.2).alias("atr_pct"),
        clip(entry / (F.coalesce("b._h52", entry) + 1e-8), 0, 1).alias("high_52w_proximity"),
        (stock_move - spy_move).alias("relative_ret_30d"))
    label = F.when(F.col("relative_ret_30d") > 0.03, "WIN").when(F.col("relative_ret_30d") < -0.03, "LOSS")
    return out.withColumn("label", label).filter(F.col("label").isNotNull()).withColumn("label_binary", (F.col("label") == "WIN").cast("int"))


def with_event_fundamentals(events: DataFrame, fundamentals: DataFrame) -> DataFrame:
    """Snapshot fundamentals per event, gaps filled by the exact global median."""
    joined = cut_lineage(events.join(fundamentals.select("ticker", *EVENT_FUNDAMENTALS), "ticker", "left"))
    long = joined.select(F.expr("stack({}, {}) as (feature, value)".format(
        len(EVENT_FUNDAMENTALS), ", ".join(f"'{c}', `{c}`" for c in EVENT_FUNDAMENTALS))))
    medians = exact_median(long, ["feature"], "value").groupBy().pivot("feature", list(EVENT_FUNDAMENTALS)).agg(F.first("median"))
    medians = medians.select(*[F.col(c).alias(f"_m_{c}") for c in EVENT_FUNDAMENTALS])
    filled = joined.crossJoin(F.broadcast(medians))   # one row
    return filled.select(*[F.coalesce(F.col(c), F.col(f"_m_{c}")).alias(c) if c in EVENT_FUNDAMENTALS else F.col(c) for c in joined.columns])
