"""Signal rows (ticker, label, status, text) from indicators, market data and events."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import messages as M
from tapeloom.functions.exprs import clip, first, lagged, latest_first, newest, rolling, signal, upto
from tapeloom.operators import indicators as ind

INDICATOR_COLUMNS = ("sma20", "sma50", "rsi", "macd", "macd_signal", "bb_upper", "bb_lower", "bb_mid")


def volume_signal(bars: DataFrame) -> DataFrame:
    last = newest(ind.volume_indicators(bars), "close", "prev_close", "vol_ratio")
    busy = F.col("vol_ratio") > 1.5
    up, down = busy & (F.col("close") > F.col("prev_close")), busy & (F.col("close") < F.col("prev_close"))
    status = F.when(up, "good").when(down, "warning").otherwise("neutral")
    text = (F.when(up, M.VOLUME["up"]).when(down, M.VOLUME["down"])
            .when(F.col("vol_ratio") < 0.7, F.format_string(M.VOLUME["low"], "vol_ratio"))
            .otherwise(F.format_string(M.VOLUME["normal"], "vol_ratio")))
    return last.select("ticker", *signal("Volume", status, text))


def indicator_summary(indicators: DataFrame) -> DataFrame:
    """Votes of the newest bar that has every indicator."""
    complete = indicators.dropna(subset=list(INDICATOR_COLUMNS))
    last = newest(complete, "close", *INDICATOR_COLUMNS)
    close = F.col("close")
    votes = (F.when(F.col("rsi") > 70, -1.0).when(F.col("rsi") < 30, 1.0).otherwise(0.0)
             + F.when(F.col("sma20") > F.col("sma50"), 1.0).otherwise(-1.0)
             + F.when(F.col("macd") > F.col("macd_signal"), 1.0).otherwise(-1.0)
             + F.when(close > F.col("bb_upper"), -1.0).when(close < F.col("bb_lower"), 1.0)
             .when(close > F.col("bb_mid"), 0.5).otherwise(0.0))
    verdict = F.when(F.col("score") >= 2, "BULLISH").when(F.col("score") <= -2, "BEARISH").otherwise("MIXED")
    return last.withColumn("score", votes).withColumn("verdict", verdict)


def pick(key: Column, texts: dict[str, Column | str], default: Column | str | None = None) -> Column:
    """Text chosen by key; the values may be literals or columns."""
    out = None
    for name, value in texts.items():
        value = F.lit(value) if isinstance(value, str) else value
        out = F.when(key == name, value) if out is None else out.when(key == name, value)
    return out.otherwise(F.lit(default) if isinstance(default, str) else default) if default is not None else out


def good_warning(key: Column, good: tuple[str, ...], warning: tuple[str, ...]) -> Column:
    return F.when(key.isin(*good), "good").when(key.isin(*warning), "warning").otherwise("neutral")


def fear_regime(vix: Column) -> Column:
    return F.when(vix > 25, "high_fear").when((vix >= 15) | vix.isNull(), "neutral").otherwise("complacency")


def market_context(bars: DataFrame, vix: DataFrame) -> DataFrame:
    """Rank in the 52-week range next to the newest volatility index."""
    now = vix.agg(F.max_by("vix", "date").alias("vix"))
    joined = ind.range_rank(bars).crossJoin(F.broadcast(now))   # one row
    return joined.withColumn("vix_regime", fear_regime(F.col("vix")))


def market_context_signal(context: DataFrame) -> DataFrame:
    regime, rank = F.col("vix_regime"), F.col("week52_rank")
    pct = rank * 100
    vix_text = F.when(F.col("vix").isNull(), M.CONTEXT["missing"]).otherwise(pick(regime, {
        k: F.format_string(M.CONTEXT[k], "vix") for k in ("high_fear", "complacency", "neutral")}))
    rank_text = (F.when(rank > 0.8, F.format_string(M.CONTEXT["high"], pct)).when(rank < 0.2, F.format_string(M.CONTEXT["low"], pct))
                 .otherwise(F.format_string(M.CONTEXT["mid"], pct)))
    status = good_warning(regime, ("high_fear",), ("complacency",))
    return context.select("ticker", *signal("Market Context", status, F.concat(vix_text, F.lit(". "), rank_text)))


def sector_trend(etf: DataFrame) -> DataFrame:
    """SMA20 against SMA50 of each sector series, and its 20-row return."""
    rows = etf.select(F.col("sector").alias("ticker"), "date", "close")
    staged = rows.select("ticker", "date", "close", rolling(F.avg, F.col("close"), 20).alias("s20"), rolling(F.avg, F.col("close"), 50).alias("s50"),
                         lagged("close", 20).alias("past"), F.count("close").over(upto()).alias("n"))
    last = newest(staged, "close", "s20", "s50", "past", "n")
    trend = (F.when(F.col("n") < 50, "unknown").when(F.col("s20") > F.col("s50"), "uptrend")
             .when(F.col("s20") < F.col("s50"), "downtrend").otherwise("neutral"))
    return last.select(F.col("ticker").alias("sector"), trend.alias("trend"),
                       F.when(F.col("n") >= 50, (F.col("close") - F.col("past")) / F.col("past") * 100).alias("etf_1mo_return"))


def sector_signal(sectors: DataFrame, trends: DataFrame) -> DataFrame:
    joined = sectors.join(trends, "sector", "left")
    trend = F.coalesce("trend", F.lit("unknown"))
    text = pick(trend, {k: F.format_string(M.SECTOR[k], "sector") for k in M.SECTOR})
    return joined.select("ticker", *signal("Sector Trend", good_warning(trend, ("uptrend",), ("downtrend",)), text))


def relative_signal(performance: DataFrame, period: str) -> DataFrame:
    status = F.when(F.col("alpha_pct") > 5, "good").when(F.col("alpha_pct") < -5, "warning").otherwise("neutral")
    shown = ("ticker", "ticker_return_pct", "spy_return_pct", F.lit(period), "alpha_pct")
    return performance.select("ticker", *signal("vs Market", status, pick(status, {k: F.format_string(t, *shown) for k, t in M.RELATIVE.items()})))


def momentum_signal(scores: DataFrame) -> DataFrame:
    status = good_warning(F.col("trend"), ("strong_up", "up"), ("down", "strong_down"))
    parts = [F.when(F.col(c).isNotNull(), F.format_string(M.MOMENTUM["part"], F.col(c), F.lit(c[4:]))) for _, c, _ in ind.MOMENTUM_HORIZONS]
    joined = F.concat_ws(", ", *parts)
    prefix = pick(F.col("trend"), {k: M.MOMENTUM[k] for k in ("strong_up", "up", "strong_down", "down", "neutral")})
    text = F.when(joined == "", M.MOMENTUM["none"]).otherwise(F.concat(prefix, joined, F.lit(".")))
    return scores.select("ticker", *signal("Momentum", status, text))


def pmo_signal(scores: DataFrame) -> DataFrame:
    status = good_warning(F.col("trend"), ("leading",), ("lagging",))
    text = pick(F.col("trend"), {k: F.format_string(t, "rs_score") for k, t in M.PMO.items()})
    return scores.select("ticker", *signal("PMO Relative Strength", status, text))


def put_call(options: DataFrame, asof) -> DataFrame:
    """Put and call volume of the nearest expiry on or after the as-of date.

    Volumes are summed per (ticker, expiry) before the nearest one is taken.
    """
    sums = options.filter(F.col("expiry") >= asof).groupBy("ticker", "expiry").agg(
        F.sum(F.when(F.col("side") == "call", F.col("volume")).otherwise(0.0)).alias("c"),
        F.sum(F.when(F.col("side") == "put", F.col("volume")).otherwise(0.0)).alias("p"))
    near = sums.groupBy("ticker").agg(F.min_by(F.struct("expiry", "c", "p"), "expiry").alias("r")).select("ticker", "r.*")
    ratio = F.when(F.col("c") > 0, F.col("p") / F.col("c"))
    word = F.when(ratio > 1.2, "bullish").when(ratio < 0.6, "bearish").otherwise("neutral")
    return near.select("ticker", "expiry", F.col("c").cast("bigint").alias("call_volume"), F.col("p").cast("bigint").alias("put_volume"),
                       ratio.alias("put_call_ratio"), word.alias("signal"))


def options_signal(flows: DataFrame) -> DataFrame:
    status = F.when(F.col("put_call_ratio").isNull(), "neutral").otherwise(good_warning(F.col("signal"), ("bullish",), ("bearish",)))
    shown, expiry = F.format_string("%.2f", "put_call_ratio"), F.col("expiry").cast("string")
    texts = {k: F.format_string(M.OPTIONS[k], shown, expiry) for k in ("bullish", "bearish")}
    texts["neutral"] = F.format_string(M.OPTIONS["neutral"], shown, F.col("call_volume"), F.col("put_volume"), expiry)
    text = F.when(F.col("put_call_ratio").isNull(), M.OPTIONS["none"]).otherwise(pick(F.col("signal"), texts))
    return flows.select("ticker", *signal("Options", status, text))


def month_ahead_expiry(options: DataFrame, asof) -> DataFrame:
    """Expiry closest to 30 days among those 14 or more days away, else of all."""
    listed = options.filter(F.col("expiry") >= asof).select("ticker", "expiry").distinct()
    days = F.datediff("expiry", asof)
    order = F.struct((days < 14).cast("int"), F.abs(days - 30), F.col("expiry"))
    return listed.groupBy("ticker").agg(F.min_by("expiry", order).alias("expiry"))


def implied_vol(options: DataFrame, bars: DataFrame, asof) -> DataFrame:
    """IV30 near the money, RV30, their ratio and the reading."""
    chain = options.join(month_ahead_expiry(options, asof), ["ticker", "expiry"], "left_semi")
    price = newest(bars, "close").select("ticker", F.col("close").alias("price"))
    # Counting equal values first keeps the placeholder test a partial aggregate.
    values = chain.filter(F.col("iv") > 0.001).groupBy("ticker", F.round("iv", 9).alias("iv")).agg(F.count("*").alias("k"))
    spread = values.groupBy("ticker").agg((F.max("k") / F.sum("k")).alias("top_share"))
    near = chain.join(price, "ticker").filter(F.col("strike").between(F.col("price") * 0.95, F.col("price") * 1.05) & (F.col("iv") > 0.05))
    iv = near.groupBy("ticker").agg(F.avg("iv").alias("iv30"))
    rv = newest(ind.realised_vol(bars.select("ticker", "date", "close")), "rv30").select("ticker", "rv30")
    joined = rv.join(spread, "ticker", "left").join(iv, "ticker", "left")
    usable = F.coalesce(F.col("top_share") <= 0.6, F.lit(False))
    iv30 = F.when(usable, F.col("iv30"))
    ratio = F.when(F.col("rv30") > 0, iv30 / F.col("rv30"))
    word = (F.when(F.col("top_share").isNull(), M.VOL_RATIO["unpopulated"]).when(~usable, M.VOL_RATIO["placeholder"])
            .when(iv30.isNull(), M.VOL_RATIO["no_atm"]).when(ratio > 1.3, M.VOL_RATIO["over"]).when(ratio < 0.8, M.VOL_RATIO["under"])
            .otherwise(M.VOL_RATIO["fair"]))
    value = F.when(ratio > 1.3, clip(1 - ratio, -1, 1)).when(ratio < 0.8, clip((0.8 - ratio) / 0.8, -1, 1)).otherwise(0.0)
    return joined.select("ticker", "top_share", iv30.alias("iv30"), "rv30", ratio.alias("ratio"), word.alias("interpretation"), value.alias("signal"))


def vol_signal(vols: DataFrame) -> DataFrame:
    ratio = F.col("ratio")
    status = F.when(ratio > 1.3, "warning").when(ratio < 0.8, "good").otherwise("neutral")
    text = F.when(ratio.isNull(), F.col("interpretation")).otherwise(
        F.format_string(M.VOL_RATIO["text"], F.col("iv30") * 100, F.col("rv30") * 100, ratio, F.col("interpretation")))
    return vols.select("ticker", *signal("Vol Ratio", status, text))


# Words of the transaction classes.
INSIDER_BUY, INSIDER_SELL = "(?i)purchase|buy|acquisition|acquired", "(?i)sale|sell|disposed|exercise"


def insider_activity(insider: DataFrame, most: int | None = None) -> DataFrame:
    """Buys and sells among the transactions of each ticker, or its `most` newest ones."""
    order = Window.partitionBy("ticker").orderBy(F.col("date").desc(), "order_id", "line_id", "party_id", "shares")
    recent = insider if most is None else first(insider.withColumn("_k", F.row_number().over(order)), "_k", most)
    buy = F.col("text").rlike(INSIDER_BUY)
    counted = recent.groupBy("ticker").agg(F.count_if(buy).alias("buy_count"), F.count_if(~buy & F.col("text").rlike(INSIDER_SELL)).alias("sell_count"))
    b, s = F.col("buy_count"), F.col("sell_count")
    return counted.withColumn("net_sentiment", F.when((b > s) & (b >= 2), "bullish").when(s > b * 2, "bearish").otherwise("neutral"))


def insider_signal(activity: DataFrame) -> DataFrame:
    b, s, mood = F.col("buy_count"), F.col("sell_count"), F.col("net_sentiment")
    none = b + s == 0
    status = F.when(none, "neutral").otherwise(good_warning(mood, ("bullish",), ("bearish",)))
    text = F.when(none, M.INSIDER["none"]).otherwise(pick(mood, {
        "bullish": F.format_string(M.INSIDER["bullish"], b, s), "bearish": F.format_string(M.INSIDER["bearish"], s, b),
        "neutral": F.format_string(M.INSIDER["neutral"], b, s)}))
    return activity.select("ticker", *signal("Insider", status, text))


def top_holders(holders: DataFrame, most: int | None = None) -> DataFrame:
    """Holders by shares with their place, the first `most` if that is given."""
    order = Window.partitionBy("ticker").orderBy(F.col("shares").desc(), "holder")
    return first(holders.withColumn("place", F.row_number().over(order)), "place", most)


def ownership_signal(info: DataFrame) -> DataFrame:
    inst, own = F.col("institution_pct") * 100, F.col("insider_pct") * 100
    status = F.when(inst > 70, "good").when(inst < 20, "warning").otherwise("neutral")
    text = F.concat(F.format_string(M.OWNERSHIP["base"], inst, own), pick(status, {k: M.OWNERSHIP[k] for k in ("good", "warning", "neutral")}))
    return info.select("ticker", *signal("Ownership", status, text))


def short_signal(info: DataFrame) -> DataFrame:
    pct, ratio = F.col("short_pct_float") * 100, F.col("short_ratio")
    squeeze = F.when(pct >= 20, "high").when(pct >= 10, "moderate").otherwise("low")
    days = F.when(ratio != 0, F.format_string(M.SHORT_INTEREST["days"], ratio)).otherwise("")
    body = F.concat(F.format_string(M.SHORT_INTEREST["pct"], pct, days), pick(squeeze, {k: M.SHORT_INTEREST[k] for k in ("high", "moderate", "low")}))
    status = F.when(pct >= 20, "warning").otherwise("neutral")
    return info.select("ticker", *signal("Short Interest", status, F.when(pct.isNull(), M.SHORT_INTEREST["none"]).otherwise(body)))


CONSENSUS = {"strong_buy": "Strong Buy", "buy": "Buy", "hold": "Hold", "underperform": "Underperform", "sell": "Sell"}


def analyst_signal(info: DataFrame, bars: DataFrame) -> DataFrame:
    """Upside of the mean target over the last close, and the consensus."""
    price = newest(bars, "close").select("ticker", "close")
    key = F.col("recommendation")
    word = pick(key, CONSENSUS, F.initcap(key))
    staged = info.join(price, "ticker").withColumn("upside_pct", (F.col("target_mean") - F.col("close")) / F.col("close") * 100).withColumn("consensus", word)
    up, none = F.col("upside_pct"), (F.col("n_analysts") == 0) | F.col("target_mean").isNull()
    lower = F.lower("consensus")
    status = (F.when(none, "neutral").when(lower.contains("strong buy") | (up > 20), "good")
              .when(lower.contains("sell") | (up < -10), "warning").otherwise("neutral"))
    text = F.when(none, M.ANALYST["none"]).otherwise(F.format_string(M.ANALYST["text"], F.col("n_analysts"), F.col("consensus"), F.col("target_mean"), up))
    return staged.select("ticker", "upside_pct", "consensus", *signal("Analyst", status, text))


def earnings_history(earnings: DataFrame, quarters: int = 4) -> DataFrame:
    """Beats, misses and mean surprise of the newest quarters."""
    order = Window.partitionBy("ticker").orderBy(F.col("earnings_date").desc())
    recent = earnings.withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= quarters)
    a, e, s = F.col("eps_actual"), F.col("eps_estimate"), F.col("surprise_pct")
    repaired = F.when(s.isNull() & (e != 0), (a - e) / F.abs(e) * 100).when((F.abs(s) < 2) & (e != 0), s / F.abs(e) * 100).otherwise(s)
    return recent.groupBy("ticker").agg(F.count_if(a > e).alias("beat_count"), F.count_if(a <= e).alias("miss_count"), F.avg(repaired).alias("avg_surprise_pct"))


def earnings_signal(history: DataFrame) -> DataFrame:
    b, m_, avg = F.col("beat_count"), F.col("miss_count"), F.col("avg_surprise_pct")
    n = b + m_
    extra = F.when(avg.isNull() | (avg == 0), "").otherwise(F.format_string(M.EARNINGS["surprise"], avg))
    status = F.when(n == 0, "neutral").when(b >= 3, "good").when(m_ >= 3, "warning").otherwise("neutral")
    text = (F.when(n == 0, M.EARNINGS["none"]).when(b >= 3, F.format_string(M.EARNINGS["good"], b, n, extra))
            .when(m_ >= 3, F.format_string(M.EARNINGS["warning"], m_, n, extra)).otherwise(F.format_string(M.EARNINGS["neutral"], b, m_, n, extra)))
    return history.select("ticker", *signal("Earnings", status, text))


def next_earnings(earnings: DataFrame, asof) -> DataFrame:
    due = F.min(F.when(F.col("earnings_date") >= asof, F.col("earnings_date")))
    found = earnings.groupBy("ticker").agg(due.alias("earnings_date"))
    return found.withColumn("days_away", F.datediff("earnings_date", asof))


def next_earnings_signal(due: DataFrame) -> DataFrame:
    d = F.col("days_away")
    status = F.when(d.isNull(), "neutral").when(d <= 14, "warning").otherwise("good")
    t = {k: F.format_string(v, d) for k, v in M.NEXT_EARNINGS.items() if k != "unknown"}
    text = (F.when(d.isNull(), M.NEXT_EARNINGS["unknown"]).when(d <= 3, t["d3"]).when(d <= 7, t["d7"]).when(d <= 14, t["d14"]).otherwise(t["far"]))
    return due.select("ticker", "days_away", *signal("Earnings", status, text))


def proximity_signal(due: DataFrame) -> DataFrame:
    d = F.col("days_away")
    level = F.when(d.isNull(), "unknown").when(d <= 14, "high").when(d <= 30, "medium").otherwise("low")
    status = pick(level, {"high": "warning", "medium": "neutral"}, "good")
    text = F.when(d.isNull(), M.PROXIMITY["unknown"]).otherwise(pick(level, {k: F.format_string(M.PROXIMITY[k], d) for k in ("high", "medium", "low")}))
    return due.select("ticker", *signal("Earnings Risk", status, text))


def relevant_news(news: DataFrame, companies: DataFrame, most: int | None = None, least: int = 0) -> DataFrame:
    """Articles naming the ticker or the company; all articles of a ticker with fewer than `least` of them. `most`: a ticker's first.

    Documents are read once: texts are judged where they lie, and only (ticker, doc_id, relevant) and the columns besides text go on.
    A ticker's first articles are picked in every task before they meet, so that no task sees a hot ticker whole.
    """
    text, word = F.lower("text"), F.lower(F.split("company", " ")[0])
    hit = text.contains(F.lower("ticker")) | F.coalesce((F.length(word) > 3) & text.contains(word), F.lit(False))
    # One row per ticker, which the plan broadcasts if it is small.
    flagged = news.join(companies, "ticker", "left").withColumn("relevant", F.coalesce(hit, F.lit(False))).drop("text", "company")
    if least <= 0:
        kept = flagged.filter("relevant")
        return kept if most is None else _first_by_ticker(kept, most)
    if most is None:
        counts = flagged.groupBy("ticker").agg(F.count_if("relevant").alias("_n"))
        return flagged.join(counts, "ticker").filter(F.col("relevant") | (F.col("_n") < least)).drop("_n")
    # The first relevant ones and the first of all are enough to decide, if as many as `least` are kept of the relevant.
    both = flagged.withColumn("_pool", F.explode(F.when(F.col("relevant"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
    best = _first_by_ticker(both, max(most, least), ["_pool"])
    enough = F.count_if(F.col("_pool") == 0).over(Window.partitionBy("ticker")) >= least      # at most twice `most` rows a ticker
    chosen = best.withColumn("_enough", enough).filter((F.col("_pool") == 0) == F.col("_enough"))
    return first(chosen.withColumn("_k", F.row_number().over(Window.partitionBy("ticker").orderBy("doc_id"))), "_k", most).drop("_pool", "_enough", "_k")


def _first_by_ticker(rows: DataFrame, most: int, keys: list[str] | None = None) -> DataFrame:
    """The `most` rows of each (ticker, keys) with the least doc_id; every task passes on no more of them than that."""
    order = Window.partitionBy("ticker", *(keys or [])).orderBy("doc_id")
    return first(rows.withColumn("_k", F.row_number().over(order)), "_k", most).drop("_k")


def headline_mood(news: DataFrame) -> DataFrame:
    """Majority label of each ticker's headlines."""
    kinds = ("positive", "negative", "neutral")
    counted = news.groupBy("ticker").agg(*[F.count_if(F.col("sentiment") == k).alias(k) for k in kinds])
    p, n, u = (F.col(k) for k in kinds)
    whole = p + n + u
    label = (F.when(whole == 0, M.HEADLINES["none"]).when((p > n) & (p > u), F.format_string(M.HEADLINES["positive"], p, whole))
             .when((n > p) & (n > u), F.format_string(M.HEADLINES["negative"], n, whole)).otherwise(F.format_string(M.HEADLINES["mixed"], u, whole)))
    return counted.select("ticker", *kinds, label.alias("overall"))
