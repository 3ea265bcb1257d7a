"""Positions, alerts, usage roll-ups and the prediction ledger."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.exprs import cut, first, last_rows, leading, newest
from tapeloom.functions.messages import ALERTS, THESIS
from tapeloom.session import lookup


def last_prices(bars: DataFrame) -> DataFrame:
    return newest(bars.select("ticker", "date", "close"), "close").select("ticker", F.col("close").alias("price"))


def pnl(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost, value, profit and status of every priced position."""
    joined = positions.join(prices, "ticker")
    cost, value = F.col("shares") * F.col("buy_price"), F.col("shares") * F.col("price")
    gain = value - cost
    return joined.select("*", cost.alias("cost_basis"), value.alias("current_value"), gain.alias("pnl_dollars"),
                         F.when(cost != 0, gain / cost * 100).otherwise(0.0).alias("pnl_pct"),
                         F.when(gain > 0.01, "profit").when(gain < -0.01, "loss").otherwise("breakeven").alias("status"))


def portfolio_summary(valued: DataFrame) -> DataFrame:
    out = valued.groupBy("account").agg(F.sum("cost_basis").alias("total_cost"), F.sum("current_value").alias("total_value"), F.count("*").alias("n_positions"))
    gain = F.col("total_value") - F.col("total_cost")
    return out.select("*", gain.alias("total_pnl_dollars"), F.when(F.col("total_cost") != 0, gain / F.col("total_cost") * 100).otherwise(0.0).alias("total_pnl_pct"))


def daily_change(positions: DataFrame, bars: DataFrame) -> DataFrame:
    """Change in value of each account since the bar before the last."""
    two = last_rows(bars.select("ticker", "date", "close"), 2)
    ends = two.groupBy("ticker").agg(F.max_by("close", "date").alias("b"), F.min_by("close", "date").alias("a"), F.count("*").alias("n")).filter("n = 2")
    return positions.join(ends, "ticker").groupBy("account").agg(F.sum((F.col("b") - F.col("a")) * F.col("shares")).alias("day_change"))


def allocation(valued: DataFrame) -> DataFrame:
    """Share of each position in its account; an account holds at most one position per ticker."""
    whole = F.sum("current_value").over(Window.partitionBy("account"))
    return valued.select("account", "ticker", F.when(whole != 0, F.col("current_value") / whole).alias("share"))


def latest_position(entries: DataFrame) -> DataFrame:
    """Upsert view: the newest entry per (account, ticker) wins."""
    newest_entry = F.max_by(F.struct("shares", "buy_price"), F.struct("entered", "entry_id"))
    return entries.groupBy("account", "ticker").agg(newest_entry.alias("r"), F.count("*").alias("n_entries")).select("account", "ticker", "r.*", "n_entries")


def fired_alerts(alerts: DataFrame, prices: DataFrame) -> DataFrame:
    """Untriggered alerts whose threshold the price has crossed. Prices, one per ticker, are looked up where the alerts lie."""
    joined = alerts.filter(F.col("triggered") == 0).join(lookup(prices), "ticker")
    hit = ((F.col("direction") == "above") & (F.col("price") >= F.col("threshold"))) | ((F.col("direction") == "below") & (F.col("price") <= F.col("threshold")))
    return joined.filter(hit)


PRIORITY = {"high": 0, "medium": 1, "low": 2}


def alert_suggestions(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Ranked price alerts from targets, levels and the pivot, with their reasons; of one price and direction the most urgent."""
    p = F.col("price")

    def item(when: Column, price: Column, direction: str, priority: int, reason: str) -> Column:
        before, after = ALERTS[reason].split("{}")
        text = F.concat(F.lit(before), price.cast("string"), F.lit(after))
        return F.when(when, F.struct(price.alias("target_price"), F.lit(direction).alias("direction"), F.lit(priority).alias("priority"), text.alias("reason")))
    mean, high, low, pp = (F.col(c) for c in ("target_mean", "target_high", "target_low", "PP"))
    s, r = F.col("support"), F.col("resistance")

    def at(levels: Column, k: int) -> Column:
        return F.when(F.size(levels) > k, levels[k])
    items = [item(mean > p * 1.02, mean, "above", 0, "analyst mean"), item(high > p * 1.05, high, "above", 2, "analyst high"), item(low < p * 0.98, low, "below", 1, "analyst low")]
    items += [item(at(s, k) < p * 0.99, at(s, k), "below", k, "support") for k in (0, 1)]
    items += [item(at(r, k) > p * 1.01, at(r, k), "above", k, "resistance") for k in (0, 1)]
    items += [item(pp < p * 0.98, pp, "below", 1, "pivot below"), item(pp > p * 1.02, pp, "above", 1, "pivot above")]
    made = rows.select("ticker", p.alias("price"), F.posexplode(F.array_compact(F.array(*items))).alias("place", "made"))
    once = made.groupBy("ticker", "price", "made.direction", "made.target_price").agg(F.min(F.struct("made.priority", "place", "made.reason")).alias("_r"))
    ranked = once.select("ticker", "price", "direction", "target_price", "_r.priority", "_r.reason")
    order = Window.partitionBy("ticker").orderBy("priority", F.abs(F.col("target_price") - F.col("price")), "direction", "target_price")
    return first(ranked.withColumn("place", F.row_number().over(order)), "place", most).drop("price")


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Totals, by source and by day in one aggregation."""
    day = F.to_date("created_at")
    rows = calls.select("source", day.alias("day"), "cost_usd", "in_tokens", "out_tokens")
    grouped = rows.groupingSets([[], ["source"], ["day"]], "source", "day").agg(
        F.count("*").alias("n"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"), F.coalesce(F.sum("in_tokens"), F.lit(0)).alias("in_tok"),
        F.coalesce(F.sum("out_tokens"), F.lit(0)).alias("out_tok"), F.grouping_id().alias("_g"))
    return grouped.select(F.when(F.col("_g") == 3, "total").when(F.col("_g") == 1, "source").otherwise("day").alias("level"), "source", "day", "n", "cost", "in_tok", "out_tok")


def recent_calls(calls: DataFrame, most: int | None = None) -> DataFrame:
    """Calls from the newest on, the first `most` of them if that is given."""
    ordered = calls.orderBy(F.desc("created_at"), F.desc("id"))
    return ordered if most is None else ordered.limit(most)


# Prices per token of direct and batched calls.
PRICES = {"direct": (1.00 / 1e6, 5.00 / 1e6), "batch": (0.50 / 1e6, 2.50 / 1e6)}


def token_costs(texts: DataFrame, prompt: str, reply: str) -> DataFrame:
    def tokens(c: str) -> Column:
        return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("bigint")
    staged = texts.withColumn("in_tokens", tokens(prompt)).withColumn("out_tokens", tokens(reply))
    costs = [(F.col("in_tokens") * i + F.col("out_tokens") * o).alias(f"{name}_cost") for name, (i, o) in PRICES.items()]
    return staged.select("*", *costs)


def bucketed_text(signals: DataFrame, width: int | None = None, most: int | None = None) -> DataFrame:
    """Bullish and bearish lines per ticker, ordered by label; `most` signals a side and `width` characters a text, if given."""
    rows = signals.groupBy("ticker").agg(F.array_sort(F.collect_list(F.struct("label", "text", "status"))).alias("s"))   # one row per kind of signal

    def side(status: str) -> Column:
        kept = leading(F.filter("s", lambda x: x["status"] == status), most)
        return F.array_join(F.transform(kept, lambda x: F.concat(x["label"], F.lit(":"), cut(x["text"], width))), " | ")
    good, bad = side("good"), side("warning")
    return rows.select("ticker", F.concat_ws("\n", F.when(good != "", F.concat(F.lit("BULL: "), good)), F.when(bad != "", F.concat(F.lit("BEAR: "), bad))).alias("compact"))


def reply_fields(replies: DataFrame, text: str, schema: str) -> DataFrame:
    """Parse the outermost {...} of a free-text reply."""
    return replies.withColumn("_json", F.regexp_extract(text, r"(?s)(\{.*\})", 1)).withColumn("parsed", F.from_json("_json", schema)).drop("_json")


def thesis(rows: DataFrame, most: int | None = None, width: int | None = None) -> DataFrame:
    """Headline, key risk, key catalyst, points and one-liner; `most` points a side and `width` characters a signal's text, if given.

    rows: ticker, verdict, good and warning arrays of (label, text), and the
    snapshot columns used below.
    """
    f = F.format_string
    v = F.col("verdict")

    def first_label(c: str) -> Column:
        return F.lower(F.when(F.size(c) > 0, F.col(c)[0]["label"]))

    def first_text(c: str) -> Column:
        return F.when(F.size(c) > 0, F.col(c)[0]["text"])

    def has(c: Column, *words: str) -> Column:
        return c.rlike("|".join(words))
    g, w = first_label("good"), first_label("warning")
    headline = (F.when(v == "BUY", F.when(has(g, "fundamental", "valuation"), THESIS["buy_value"])
                       .when(has(g, "momentum", "technical"), THESIS["buy_momentum"])
                       .when(has(g, "growth", "earnings"), THESIS["buy_growth"]).otherwise(THESIS["buy"]))
                .when(v == "HOLD / WATCH", F.when(has(w, "valuation"), THESIS["hold_valuation"])
                      .when(has(w, "technical"), THESIS["hold_technical"])
                      .when(has(w, "sector"), THESIS["hold_sector"]).otherwise(THESIS["hold"]))
                .otherwise(F.when(has(w, "fundamental", "earnings"), THESIS["sell_fundamental"])
                           .when(has(w, "valuation"), THESIS["sell_valuation"])
                           .when(has(w, "technical"), THESIS["sell_technical"]).otherwise(THESIS["sell"])))
    days, short = F.col("earnings_days"), F.col("short_pct")
    risk = F.coalesce(
        F.when((days > 0) & (days < 14), f(THESIS["risk_earnings"], days)),
        F.when(F.col("altman_zone") == "distress", f(THESIS["risk_distress"], "z_score")),
        F.when(F.col("ev_ebitda") > 25, f(THESIS["risk_premium"], "ev_ebitda")),
        F.when(F.col("sector_trend") == "downtrend", f(THESIS["risk_sector"], "sector")),
        F.when(short > 15, f(THESIS["risk_short"], short)), first_text("warning"),
        F.lit(THESIS["risk_none"]))
    rising = F.col("momentum_trend").isin("up", "strong_up")
    year = F.when(F.col("ret_1yr").isNull(), "").otherwise(f(" (%+.1f%% 1yr)", "ret_1yr"))
    catalyst = F.coalesce(
        F.when(F.col("upside_pct") > 30, f(THESIS["catalyst_target"], "upside_pct", "target_mean")),
        F.when(rising, F.concat(F.lit(THESIS["catalyst_momentum"]), year, F.lit(THESIS["catalyst_trend"]))),
        F.when(F.col("earnings_growth") * 100 > 20, f(THESIS["catalyst_earnings"], F.col("earnings_growth") * 100)),
        F.when(F.col("fcf_yield") > 5, f(THESIS["catalyst_cash"], "fcf_yield")), first_text("good"),
        F.lit(THESIS["catalyst_none"]))
    facts = F.concat_ws(", ", F.when(F.col("profit_margin") * 100 > 20, f("%.0f%% margins", F.col("profit_margin") * 100)),
                        F.when(F.col("revenue_growth") > 0, f("%.0f%% revenue growth", F.col("revenue_growth") * 100)),
                        F.when(F.col("trailing_pe") > 30, f("%.0fx P/E (pricey)", "trailing_pe")), F.when(F.col("sector_trend") == "downtrend", f("%s headwind", "sector")))
    view = F.when(F.col("upside_pct") > 20, f("Analysts bullish (%+.1f%% target).", "upside_pct")).otherwise("")
    line = f("%s: %s. %s %s.", "ticker", F.when(facts == "", "mixed fundamentals").otherwise(facts), view, "verdict")

    def points(c: str, mark: str, *more: tuple[str, Column, Column]) -> Column:
        """The signals first, then further facts whose topic no signal covers."""
        signals = F.coalesce(c, F.array().cast("array<struct<label:string,text:string,status:string>>"))
        own = F.transform(leading(signals, most), lambda x: F.concat(F.lit(mark + " "), x["label"], F.lit(": "), cut(x["text"], width)))
        topics = F.lower(F.array_join(F.transform(signals, lambda x: x["label"]), "\n"))
        facts = [F.when(F.coalesce(test, F.lit(False)) & ~topics.contains(topic), F.concat(F.lit(mark + " "), text)) for topic, test, text in more]
        return leading(F.concat(own, F.array_compact(F.array(*facts))), most)
    grown = F.when(F.coalesce(F.col("ret_1yr"), F.lit(0.0)) == 0, "").otherwise(f(" (+%.1f%% 1yr)", "ret_1yr"))
    bull = points("good", "✅",
                  ("analyst", F.col("upside_pct") > 20, f(THESIS["bull_analyst"], "upside_pct")),
                  ("piotroski", F.col("piotroski") >= 7, f(THESIS["bull_piotroski"], "piotroski")),
                  ("fcf", F.col("fcf_yield") > 5, f(THESIS["bull_cash"], "fcf_yield")),
                  ("momentum", rising, F.concat(F.lit(THESIS["bull_momentum"]), grown)),
                  ("short", short < 3, f(THESIS["bull_short"], short)))
    bear = points("warning", "⚠️",
                  ("valuation", F.col("ev_ebitda") > 25, f(THESIS["bear_valuation"], "ev_ebitda")),
                  ("earnings", (days > 0) & (days < 14), f(THESIS["bear_earnings"], days)),
                  ("sector", F.col("sector_trend") == "down", f(THESIS["bear_sector"], "sector")),
                  ("short", short > 15, f(THESIS["bear_short"], short)))
    return rows.select("ticker", headline.alias("headline"), risk.alias("key_risk"), catalyst.alias("key_catalyst"), line.alias("one_liner"),
                       bull.alias("bull_points"), bear.alias("bear_points"))


def freshness(entries: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """Newest entry per key and whether its age exceeds the lifetime."""
    latest = entries.groupBy("key").agg(F.max("cached_at").alias("cached_at"))
    age = F.unix_seconds(now.cast("timestamp")) - F.unix_seconds(F.col("cached_at").cast("timestamp"))
    return latest.select("key", age.alias("age_seconds"), (age > ttl_seconds).alias("stale"))


def window_change(bars: DataFrame, n: int = 5) -> DataFrame:
    recent = last_rows(bars.select("ticker", "date", "close"), n)
    out = recent.groupBy("ticker").agg(F.min_by("close", "date").alias("a"), F.max_by("close", "date").alias("b"))
    return out.select("ticker", ((F.col("b") - F.col("a")) / F.col("a") * 100).alias("change_pct"))


# ---- prediction ledger -------------------------------------------------------

def ledger_rows(weighted: DataFrame, prices: DataFrame, version: str, least: int = 10) -> DataFrame:
    """Rows to append: priced names of dates with a real universe."""
    n = F.count("*").over(Window.partitionBy("date"))
    sized = weighted.withColumn("_n", n).filter(F.col("_n") >= least).drop("_n")
    priced = sized.join(prices, ["ticker", "date"]).filter(F.col("price") != 0)
    return priced.select("date", "ticker", "pred_return", "weight", "leg", F.lit(version).alias("model_version"), F.col("price").alias("price_at_prediction"))


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").partitionBy("date").parquet(path)


def resolved_outcomes(ledger: DataFrame, outcomes: DataFrame, prices: DataFrame, asof: Column, days: int = 7) -> DataFrame:
    """Outcomes of unchecked predictions that are old enough."""
    open_rows = ledger.join(outcomes.select("ticker", "date"), ["ticker", "date"], "left_anti").filter(F.datediff(asof, "date") >= days)
    priced = open_rows.join(prices, "ticker").filter(F.col("price") != 0)
    return priced.select("ticker", "date", "pred_return", F.col("price").alias("realized_price"), asof.alias("checked_date"),
                         ((F.col("price") - F.col("price_at_prediction")) / F.col("price_at_prediction")).alias("realized_return"))


def half_split_hits(checked: DataFrame, least: int = 2) -> DataFrame:
    """Top half against bottom half per date; the odd middle name is left out."""
    day = Window.partitionBy("date")
    rn = F.row_number().over(day.orderBy("pred_return", "ticker"))
    placed = checked.select("date", "realized_return", rn.alias("_k"), F.count("*").over(day).alias("_n")).filter(F.col("_n") >= least)
    half = F.floor(F.col("_n") / 2)
    daily = placed.groupBy("date").agg(F.avg(F.when(F.col("_k") > F.col("_n") - half, F.col("realized_return"))).alias("top"),
                                       F.avg(F.when(F.col("_k") <= half, F.col("realized_return"))).alias("bottom"))
    spread = F.col("top") - F.col("bottom")
    return daily.agg(F.avg("top").alias("avg_top"), F.avg("bottom").alias("avg_bottom"), F.avg(spread).alias("avg_spread"), F.avg((spread > 0).cast("double")).alias("win_rate"), F.count("*").alias("n_days"))


def ledger_status(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pending and checked counts with mean figures per model version."""
    joined = ledger.join(outcomes.select("ticker", "date", "realized_return"), ["ticker", "date"], "left")
    done = F.col("realized_return").isNotNull()
    return joined.groupBy("model_version").agg(F.count_if(~done).alias("pending"), F.count_if(done).alias("checked"), F.avg("realized_return").alias("mean_realized"),
                                               F.avg(F.when(done, (F.signum("pred_return") == F.signum("realized_return")).cast("double"))).alias("direction_hits"))
