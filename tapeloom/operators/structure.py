"""Swing structure, price levels and trade plans, one row per ticker.

Swings are windows over a ticker's bars; everything after them is arithmetic on
the newest bar and on level arrays of at most twenty entries.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.exprs import by_ticker, last_rows, leading
from tapeloom.functions.messages import EXITS
from tapeloom.functions.smoothing import ewm_span
from tapeloom.operators.indicators import atr_full, common_indicators


def swings(bars: DataFrame, n: int = 3) -> DataFrame:
    """Swing highs and lows where the smoothed midpoint turns."""
    w = by_ticker()
    staged = ewm_span(bars.withColumn("_mid", (F.col("high") + F.col("low")) / 2), "_mid", "_s", n)
    step = F.signum(F.col("_s") - F.lag("_s").over(w))
    staged = staged.select("*", F.row_number().over(w).alias("_rn"), F.coalesce(step, F.lit(0.0)).alias("_g"))
    staged = staged.select("*", (F.col("_g") != F.lag("_g").over(w)).alias("_turn"))
    frame = w.rowsBetween(-(n - 1), 0)
    down = F.col("_g") < 0
    high = F.when(F.col("_turn") & down, F.max("high").over(frame))
    low = F.when(F.col("_turn") & ~down, F.min("low").over(frame))
    return staged.select(*bars.columns, high.alias("swing_high"), low.alias("swing_low"),
                         F.when(F.col("_turn"), F.when(down, -1).otherwise(1)).alias("_trend"))


def carried(swung: DataFrame) -> DataFrame:
    """Most recent and second most recent swing of each side, carried forward."""
    w = by_ticker()
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)

    def last(c, frame) -> Column:
        return F.last(c, ignorenulls=True).over(frame)
    staged = swung.select("*", last("swing_high", upto).alias("last_high"), last("swing_low", upto).alias("last_low"), last("_trend", upto).alias("trend"),
                          F.when(F.col("swing_high").isNotNull(), last("swing_high", before)).alias("_ph"),
                          F.when(F.col("swing_low").isNotNull(), last("swing_low", before)).alias("_pl"))
    return staged.select(*[c for c in staged.columns if c not in ("_ph", "_pl", "_trend")], last("_ph", upto).alias("prev_high"), last("_pl", upto).alias("prev_low"))


def bias() -> Column:
    h, l, ph, pl = (F.col(c) for c in ("last_high", "last_low", "prev_high", "prev_low"))
    known = ph.isNotNull() & pl.isNotNull()
    return F.when((h > ph) & (l > pl), "bullish").when((h < ph) & (l < pl), "bearish").when(known, "mixed").otherwise("insufficient")


def snapshot(bars: DataFrame, n: int = 3) -> DataFrame:
    """Newest bar per ticker with structure, levels, indicators and ATR."""
    ready = carried(swings(atr_full(common_indicators(bars)), n))
    kept = ("close", "rsi", "sma20", "sma50", "bb_lower", "atr", "last_high", "last_low", "prev_high", "prev_low")
    rows = last_rows(ready.select("ticker", "date", "volume", "swing_high", "swing_low", *kept), 20)
    recent = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    rows = rows.withColumn("_rd", recent)
    out = rows.groupBy("ticker").agg(
        F.count("*").alias("n"), F.max_by(F.struct(*kept), "date").alias("r"), F.avg("volume").alias("_v20"), F.avg(F.when(F.col("_rd") <= 5, F.col("volume"))).alias("_v5"),
        F.array_sort(F.collect_list("swing_high")).alias("swing_highs"), F.sort_array(F.collect_list("swing_low"), asc=False).alias("swing_lows"))
    out = out.select("ticker", "n", "r.*", "swing_highs", "swing_lows", ((F.col("n") >= 20) & (F.col("_v5") > F.col("_v20") * 1.3)).alias("vol_surge"))
    return out.withColumn("bias", bias())


def setup_type(snap: DataFrame) -> DataFrame:
    """Five classes, first rule that holds; short histories are RANGE."""
    close, b = F.col("close"), F.col("bias")
    away = F.when(F.col("sma50") > 0, (close - F.col("sma50")) / F.col("sma50"))
    kind = (F.when(F.col("n") < 20, "RANGE").when((b == "bearish") & (close <= F.col("last_low") * 1.005), "BREAKDOWN")
            .when((close >= F.col("last_high") * 0.995) & (F.col("vol_surge") | (b == "bullish")), "BREAKOUT")
            .when(F.col("rsi") < 30, "MEAN_REVERSION").when(away < -0.08, "MEAN_REVERSION")
            .when((b == "bullish") & (close < F.col("last_high") * 0.97), "PULLBACK").otherwise("RANGE"))
    return snap.withColumn("setup_type", kind)


def _first(array: Column, test, k: int = 0) -> Column:
    found = F.filter(array, test)
    return F.when(F.size(found) > k, found[k])


def entry_exit(setups: DataFrame) -> DataFrame:
    """Entry, stop and two targets anchored on structure, by setup class."""
    c, atr, s20, s50, bb = (F.col(x) for x in ("close", "atr", "sma20", "sma50", "bb_lower"))
    highs, lows, kind = F.col("swing_highs"), F.col("swing_lows"), F.col("setup_type")
    staged = setups.select(
        "*", F.when(F.size(highs) > 0, F.element_at(highs, -1)).alias("_top"), F.when(F.size(lows) > 0, lows[0]).alias("_bot"),
        _first(lows, lambda x: x < c).alias("_sup"), _first(highs, lambda x: x > c).alias("_res"))
    staged = staged.withColumn("_anchor", F.coalesce("_sup", "sma20", "sma50"))
    top, bot, anchor, sup, res = (F.col(x) for x in ("_top", "_bot", "_anchor", "_sup", "_res"))
    deep = _first(lows, lambda x: x < anchor * 0.995)
    banded = bb < c * 0.99
    entry = (F.when(kind == "BREAKOUT", F.round(top * 1.001, 2)).when(kind == "PULLBACK", F.when(anchor.isNotNull(), F.round(F.least(anchor * 1.002, c * 0.999), 2)))
             .when(kind == "MEAN_REVERSION", F.round(F.when(banded, bb).when(s20.isNotNull(), s20 * 0.97).otherwise(c * 0.97), 2))
             .when(kind == "RANGE", F.when(sup.isNotNull(), F.round(F.least(sup * 1.002, c * 0.999), 2))))
    staged = staged.withColumn("entry", entry).withColumn("_deep", deep)
    e = F.col("entry")
    stop = (F.when(kind == "BREAKOUT", F.round(F.coalesce(bot * 0.997, e - 2 * atr), 2))
            .when(kind == "PULLBACK", F.round(F.coalesce(F.col("_deep") * 0.997, anchor * 0.97), 2))
            .when(kind == "MEAN_REVERSION", F.round(e * 0.97, 2)).when(kind == "RANGE", F.round(sup * 0.97, 2)))
    above = _first(highs, lambda x: x > e)
    tp1 = (F.when(kind == "BREAKOUT", F.round(e + 1.5 * atr, 2)).when(kind == "PULLBACK", F.round(F.coalesce(above, e + 2 * atr), 2))
           .when(kind == "MEAN_REVERSION", F.round(F.coalesce(s20, e * 1.04), 2)).when(kind == "RANGE", F.round(F.coalesce(res, e + 2 * atr), 2)))
    staged = staged.withColumn("stop_loss", F.when(e.isNotNull(), stop)).withColumn("tp1", F.when(e.isNotNull(), tp1))
    t1 = F.col("tp1")
    tp2 = (F.when(kind == "BREAKOUT", F.coalesce(_first(highs, lambda x: x > t1 * 1.01), e + 3 * atr))
           .when(kind == "PULLBACK", F.coalesce(_first(highs, lambda x: x > e, 1), e + 3 * atr))
           .when(kind == "MEAN_REVERSION", F.coalesce(s50, s20 * 1.03, e * 1.08)).when(kind == "RANGE", t1 * 1.02))
    yearly = F.when(c > 0, atr / c).otherwise(0.02) * 252 ** 0.5
    shares = F.when(yearly > 0, F.floor(100 / (c * yearly))).otherwise(0)
    return staged.select(*setups.columns, "entry", "stop_loss", "tp1", F.when(e.isNotNull(), F.round(tp2, 2)).alias("tp2"), shares.alias("vol_adj_shares"))


def pivot_points(bars: DataFrame) -> DataFrame:
    """Classic pivots of the last completed session (the second-newest bar)."""
    two = last_rows(bars.select("ticker", "date", "high", "low", "close"), 2)
    bar = two.groupBy("ticker").agg(F.min_by(F.struct("high", "low", "close"), "date").alias("b")).select("ticker", "b.*")
    h, lo = F.col("high"), F.col("low")
    p = (h + lo + F.col("close")) / 3
    levels = {"PP": p, "R1": 2 * p - lo, "R2": p + (h - lo), "R3": h + 2 * (p - lo), "S1": 2 * p - h, "S2": p - (h - lo), "S3": lo - 2 * (h - p)}
    return bar.select("ticker", *[F.round(v, 2).alias(k) for k, v in levels.items()])


def swing_levels(bars: DataFrame, window: int = 10, most: int | None = None, newest: int | None = None) -> DataFrame:
    """Distinct levels from centred extremes, nearest to the price's side first; `newest` extremes and `most` levels a side, if given."""
    w = by_ticker()
    half = window // 2
    frame = w.rowsBetween(-half, window - half - 1)
    full = F.count("*").over(frame) >= window
    marked = bars.select("ticker", "date", F.when(full & (F.col("high") == F.max("high").over(frame)), F.col("high")).alias("_h"),
                         F.when(full & (F.col("low") == F.min("low").over(frame)), F.col("low")).alias("_l"))

    def side(c: str, ascending: bool) -> DataFrame:
        found = marked.filter(F.col(c).isNotNull()).select("ticker", "date", c)
        found = found if newest is None else last_rows(found, newest)
        return found.groupBy("ticker").agg(leading(F.sort_array(F.collect_set(F.round(c, 2)), asc=ascending), most).alias(c))
    return side("_h", False).withColumnRenamed("_h", "resistance").join(side("_l", True).withColumnRenamed("_l", "support"), "ticker", "full")


# ATR multiples of stop and target.
STOP, TARGET = 1.0, 3.0


def trade_levels(priced: DataFrame) -> DataFrame:
    """Entry, stop and target by ATR for a verdict; none for a hold."""
    c, atr, v = F.col("close"), F.col("atr"), F.col("verdict")
    side = F.when(v == "BUY", 1).when(v.isin("SELL", "SELL / AVOID"), -1)
    entry = F.when(side.isNotNull(), F.round(c, 2))
    staged = priced.select("*", entry.alias("entry"), F.round(c - side * STOP * atr, 2).alias("stop_loss"), F.round(c + side * TARGET * atr, 2).alias("take_profit"), side.alias("_side"))
    risk = F.round((F.col("entry") - F.col("stop_loss")) * F.col("_side"), 2)
    reward = F.round((F.col("take_profit") - F.col("entry")) * F.col("_side"), 2)
    staged = staged.select(*[x for x in staged.columns if x != "_side"], risk.alias("risk_per_share"), reward.alias("reward_per_share"))
    return staged.withColumn("risk_reward_ratio", F.when(F.col("risk_per_share") > 0, F.round(F.col("reward_per_share") / F.col("risk_per_share"), 2)))


def trade_plan(rows: DataFrame) -> DataFrame:
    """Limit entry, stop, targets, horizon and size from one row of inputs.

    Inputs: close, atr, confidence, verdict, fundamental, support and resistance
    arrays, structure columns (setup_type, entry, stop_loss, tp1, tp2),
    analyst_target, week52_rank, altman_zone, momentum_trend, short_pct,
    earnings_days, sector_trend, vix.
    """
    price, atr = F.col("close"), F.col("atr")
    conf = F.col("confidence")
    conviction = F.when(conf >= 0.65, "high").when(conf >= 0.45, "medium").otherwise("low")

    def yes(c: Column) -> Column:
        return F.coalesce(c, F.lit(False))
    s = rows.select("*", conviction.alias("conviction"), yes((F.col("earnings_days") > 0) & (F.col("earnings_days") <= 14)).alias("_near"),
                    yes(F.col("momentum_trend").isin("strong_up", "up")).alias("_strong"), yes(F.col("verdict") == "BUY").alias("_buy"),
                    yes((F.abs(F.col("entry") - price) / price < 0.08) & ((F.col("setup_type") == "BREAKOUT") | (F.col("entry") <= price * 1.001))).alias("_valid"),
                    F.sort_array(F.filter("support", lambda x: x < price), asc=False).alias("_sup"))
    conv = F.col("conviction")
    base = F.when(F.col("_buy"), F.when((conv == "high") & F.col("_strong"), 0.003).when(conv == "high", 0.007).when(conv == "medium", 0.010).otherwise(0.015)).otherwise(
        F.when(conv == "high", 0.010).when(conv == "medium", 0.018).otherwise(0.025))

    def add(condition: Column, amount: float) -> Column:
        return F.when(yes(condition), amount).otherwise(0.0)
    adj = (add(F.col("_near"), 0.005) + add(F.col("sector_trend") == "downtrend", 0.003) + add(F.col("altman_zone") == "distress", 0.005)
           + add(F.col("short_pct") >= 20, 0.003) + add(~F.col("_buy") & (F.col("week52_rank") > 0.9), 0.008))
    cap = F.when(F.col("_buy"), 0.03).otherwise(0.05)
    s = s.withColumn("_disc", F.when(F.col("_valid"), (price - F.col("entry")) / price).otherwise(F.least(base + adj, cap)))
    naive = price * (1 - F.col("_disc"))
    near = _first(F.col("_sup"), lambda x: (x >= price - price * (F.col("_disc") * 1.5)) & (F.abs(x - naive) / price < 0.015))
    s = s.withColumn("limit_entry", F.when(F.col("_valid"), F.col("entry")).otherwise(F.coalesce(near * 0.997, naive)))
    limit = F.col("limit_entry")
    floor = limit - 1.5 * atr
    below = _first(F.col("_sup"), lambda x: (x < limit * 0.995) & (x * 0.995 > floor)) * 0.995
    by_atr = F.coalesce(below, F.when(floor < limit * 0.92, limit * 0.95).otherwise(floor))
    structural = yes((F.col("stop_loss") < limit) & (F.col("stop_loss") > limit * 0.9))
    stop = F.when(structural, F.col("stop_loss")).otherwise(by_atr)
    s = s.withColumn("_stop0", stop)
    s = s.withColumn("stop", F.when(F.col("_near") & (F.col("_stop0") < limit * 0.97), limit * 0.97).otherwise(F.col("_stop0")))
    dist = limit - F.col("stop")
    s = s.select("*", (limit + F.greatest(dist, atr)).alias("_min1"), (limit + F.greatest(dist * 1.5, atr * 2)).alias("_min2"),
                 F.filter("resistance", lambda x: x > limit).alias("_res"))
    min1, min2, target = F.col("_min1"), F.col("_min2"), F.col("analyst_target")
    wall = F.coalesce(F.array_min(F.filter("_res", lambda x: x >= min1)), min1)
    eased = F.when((target > price) & (target * 0.95 >= min1), F.least(wall, target * 0.95)).otherwise(wall)
    s = s.withColumn("take_profit_1", F.when(yes(F.col("tp1") >= min1), F.col("tp1")).otherwise(eased))
    one = F.col("take_profit_1")
    far = F.array_min(F.filter("_res", lambda x: (x > one * 1.01) & (x >= min2)))
    two = F.when(yes((F.col("tp2") > one * 1.01) & (F.col("tp2") >= min2)), F.col("tp2")).otherwise(
        F.coalesce(far, F.when(target >= min2, target), F.greatest(min2, limit + 3 * atr)))
    risk = limit - F.col("stop")
    horizon = (F.when(F.col("_strong") & (conv == "high"), "2–6 weeks (momentum trade)")
               .when((conv == "high") & (F.col("fundamental") > 0.4), "2–4 months (fundamental + momentum)")
               .when(conv == "medium", "4–8 weeks (wait for catalyst)").otherwise("1–2 weeks (speculative; tight stops)"))
    vix = F.col("vix")
    size = F.when(vix.isNull() | (vix <= 15), 100.0).when(vix >= 25, 0.0).otherwise(100 - (vix - 15) / 10 * 100)
    return s.select("*", two.alias("take_profit_2"), F.when(risk > 0, F.round((one - limit) / risk, 2)).otherwise(0.0).alias("risk_reward"),
                    horizon.alias("time_horizon"), (F.round(size / 5) * 5).cast("int").alias("position_size_pct"))


def exit_conditions(plans: DataFrame) -> DataFrame:
    """Plain exit triggers that apply to the plan, as an array."""
    f = F.format_string
    rows = [f(EXITS["stop"], "stop"),
            F.when(F.col("fundamental") > 0.3, EXITS["fundamentals"]),
            F.when(F.col("piotroski") >= 6, f(EXITS["piotroski"], "piotroski")),
            f(EXITS["target"], "take_profit_1", "take_profit_2"),
            F.when(F.col("_strong"), EXITS["momentum"]).otherwise(
                EXITS["trend"]),
            F.when((F.col("earnings_days") != 0) & (F.col("earnings_days") <= 30), f(EXITS["earnings"], "earnings_days")),
            F.when(F.col("sector_trend") == "downtrend", EXITS["sector"]),
            F.lit(EXITS["patience"])]
    return plans.select("ticker", F.array_compact(F.array(*rows)).alias("exit_conditions"))
