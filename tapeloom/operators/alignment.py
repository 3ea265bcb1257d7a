"""Point-in-time alignment: as-of joins, trailing ranges, bar offsets, peers.

As-of and trailing-range lookups are a union of both sides and one window, never
a non-equi join. Event sides are reduced to one row per (ticker, date) first by
partial aggregation, so a ticker with very many events shuffles only its days.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.exprs import by_ticker, spread
from tapeloom.functions.ranks import positions


def _merged(left: DataFrame, right: DataFrame, payload: list[str], right_date: str) -> DataFrame:
    """Left rows plus right rows reduced to one struct per (ticker, day)."""
    daily = right.groupBy("ticker", F.col(right_date).alias("date")).agg(
        F.max(F.struct(*payload)).alias("_right"))
    rows = left.withColumn("_left", F.lit(True))
    return rows.unionByName(daily, allowMissingColumns=True)


def asof_backward(left: DataFrame, right: DataFrame, right_date: str, payload: list[str]) -> DataFrame:
    """Attach the newest right row with right_date <= date, per ticker."""
    merged = _merged(left, right, [right_date, *payload] if right_date not in payload else payload, right_date)
    known = (Window.partitionBy("ticker").orderBy("date")
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    found = merged.withColumn("_hit", F.last("_right", ignorenulls=True).over(known)).filter("_left")
    return found.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in payload])


def asof_forward(left: DataFrame, right: DataFrame, right_date: str, payload: list[str]) -> DataFrame:
    """Attach the first right row with right_date >= date, per ticker."""
    merged = _merged(left, right, [right_date, *payload] if right_date not in payload else payload, right_date)
    ahead = (Window.partitionBy("ticker").orderBy("date")
             .rangeBetween(Window.currentRow, Window.unboundedFollowing))
    found = merged.withColumn("_hit", F.first("_right", ignorenulls=True).over(ahead)).filter("_left")
    return found.select(*left.columns, *[F.col(f"_hit.{c}").alias(c) for c in payload])


def numbered(bars: DataFrame) -> DataFrame:
    """Bar number inside its ticker, for n-th-bar arithmetic."""
    return bars.withColumn("rn", F.row_number().over(by_ticker()))


def bar_offset(events: DataFrame, bars: DataFrame, offset: int, columns: dict[str, str]) -> DataFrame:
    """Join the bar `offset` rows after (before, if negative) the event's bar."""
    target = numbered(bars).select("ticker", (F.col("rn") - offset).alias("rn"),
                                   *[F.col(c).alias(a) for c, a in columns.items()])
    return events.join(target, ["ticker", "rn"], "left")


def reindexed(bars: DataFrame, series: DataFrame, value: str, out: str) -> DataFrame:
    """Left join of one dated series; dates it lacks give NULL."""
    return bars.join(series.select("date", F.col(value).alias(out)), "date", "left")


def on_all_tickers(bars: DataFrame, share: float = 1.0) -> DataFrame:
    """Rows of the dates on which every ticker (or a share of them) has a bar."""
    n = bars.select(F.count_distinct("ticker").alias("_n"))
    dates = bars.groupBy("date").agg(F.count_distinct("ticker").alias("_k")).crossJoin(F.broadcast(n))   # one row
    return bars.join(dates.filter(F.col("_k") >= share * F.col("_n")).select("date"), "date", "left_semi")


# Words that classify an insider transaction, and grade scores.
BUY_WORDS, SELL_WORDS = "(?i)purchase|buy", "(?i)sale|sell"
GRADES = {"strong buy": 2, "buy": 1, "outperform": 1, "overweight": 1, "positive": 1,
          "hold": 0, "neutral": 0, "market perform": 0, "equal weight": 0, "in-line": 0,
          "underperform": -1, "sell": -1, "underweight": -1, "negative": -1, "strong sell": -2}


def daily_insider(insider: DataFrame) -> DataFrame:
    return insider.groupBy("ticker", "date").agg(
        F.count_if(F.col("text").rlike(BUY_WORDS)).cast("double").alias("buys"),
        F.count_if(F.col("text").rlike(SELL_WORDS)).cast("double").alias("sells"))


def daily_grades(grades: DataFrame) -> DataFrame:
    table = F.create_map(*[F.lit(x) for pair in GRADES.items() for x in pair])
    score = table[F.lower("to_grade")].cast("double")
    return grades.groupBy("ticker", "date").agg(F.sum(score).alias("grade_sum"), F.count(score).cast("double").alias("grade_n"))


def _trailing(days: int):
    return (Window.partitionBy("ticker").orderBy("_day").rangeBetween(-days, 0))


def trailing_sentiment(bars: DataFrame, insider: DataFrame | None = None, grades: DataFrame | None = None,
                       filings: DataFrame | None = None, filing_columns: tuple[str, ...] = ()) -> DataFrame:
    """Bars with trailing insider ratio, trailing grade mean and as-of filings.

    One union and one (ticker, day) sort serve all three lookups.
    """
    merged = bars.withColumn("_bar", F.lit(True))
    extra: dict[str, Column] = {}
    if insider is not None:
        merged = merged.unionByName(daily_insider(insider), allowMissingColumns=True)
        buys, sells = F.sum("buys").over(_trailing(90)), F.sum("sells").over(_trailing(90))
        extra["insider_net_ratio"] = F.when(buys + sells > 0, (buys - sells) / (buys + sells)).otherwise(0.0)
    if grades is not None:
        merged = merged.unionByName(daily_grades(grades), allowMissingColumns=True)
        points, n = F.sum("grade_sum").over(_trailing(180)), F.sum("grade_n").over(_trailing(180))
        extra["analyst_score"] = F.when(n > 0, points / n).otherwise(0.0)
    if filings is not None:
        daily = filings.groupBy("ticker", F.col("filed_date").alias("date")).agg(
            F.max(F.struct("filed_date", *filing_columns)).alias("_filing"))
        merged = merged.unionByName(daily, allowMissingColumns=True)
        known = Window.partitionBy("ticker").orderBy("_day").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        extra["_known"] = F.last("_filing", ignorenulls=True).over(known)
    merged = spread(merged).withColumn("_day", F.datediff("date", F.lit("1970-01-01").cast("date")))
    out = merged.select("*", *[c.alias(n) for n, c in extra.items()]).filter("_bar")
    kept = [n for n in extra if n != "_known"]
    picked = [F.col(f"_known.{c}").alias(f"pit_{c}") for c in filing_columns] if filings is not None else []
    return out.select(*bars.columns, *kept, *picked)


RATIOS = ("revenue_growth", "profit_margin", "roe", "debt_to_equity")


def point_in_time_ratios(facts: DataFrame) -> DataFrame:
    """Ratios as known at each filing date (the change points).

    Flow facts count only when they span about a year; the growth needs a
    period that ended between 365 and 465 days before the latest one. Facts are
    reduced to one row per (ticker, filing date); what is known by then is a
    running maximum. The earlier period is looked up among those that end in the
    same hundred days, two keys per filing, so nothing grows along a ticker.
    """
    span = F.datediff("fiscal_period_end", "start_date")
    annual = F.col("start_date").isNotNull() & span.between(350, 380)
    flow = F.col("concept").isin("Revenues", "NetIncomeLoss")
    value = F.when(~flow | annual, F.col("value"))
    names = {"Revenues": "_rev", "NetIncomeLoss": "_ni", "Liabilities": "_tl", "StockholdersEquity": "_eq"}
    periods = facts.groupBy("ticker", "filed_date", "fiscal_period_end").agg(
        *[F.max(F.when(F.col("concept") == c, value)).alias(a) for c, a in names.items()])
    end = F.col("fiscal_period_end")
    revenue = F.when(F.col("_rev").isNotNull(), F.struct(end.alias("end"), "filed_date", F.col("_rev").alias("value")))
    daily = periods.groupBy("ticker", "filed_date").agg(
        *[F.max_by(a, F.when(F.col(a).isNotNull(), end)).alias(a) for a in names.values()], F.max(revenue).alias("_new"))
    known = Window.partitionBy("ticker").orderBy("filed_date").rowsBetween(Window.unboundedPreceding, 0)
    state = daily.select("ticker", "filed_date", *[F.last(a, ignorenulls=True).over(known).alias(a) for a in names.values()], F.max("_new").over(known).alias("_now"))

    def hundred(day):
        return F.floor(F.unix_date(day) / 100)
    low, high = F.date_sub(F.col("_now.end"), 464), F.date_sub(F.col("_now.end"), 365)
    asked = state.filter(F.col("_now").isNotNull()).select("ticker", "filed_date", low.alias("_low"), high.alias("_high"),
                                                           F.explode(F.array_distinct(F.array(hundred(low), hundred(high)))).alias("_hundred"))
    earlier = periods.filter(F.col("_rev").isNotNull()).select("ticker", hundred(end).alias("_hundred"), F.struct(end.alias("end"), "filed_date", F.col("_rev").alias("value")).alias("_old"))
    fits = (F.col("_old.filed_date") <= F.col("filed_date")) & F.col("_old.end").between(F.col("_low"), F.col("_high"))
    found = asked.join(earlier, ["ticker", "_hundred"]).filter(fits).groupBy("ticker", "filed_date").agg(F.max("_old").alias("_was"))
    state = state.join(found, ["ticker", "filed_date"], "left")

    def share(top, bottom):
        return F.when(F.col(bottom) != 0, F.col(top) / F.col(bottom))
    was = F.col("_was.value")
    return state.select("ticker", "filed_date", F.when(was != 0, (F.col("_now.value") - was) / F.abs(was)).alias("revenue_growth"),
                        share("_ni", "_rev").alias("profit_margin"), share("_ni", "_eq").alias("roe"),
                        share("_tl", "_eq").alias("debt_to_equity"))


def sector_valuation(info: DataFrame, sectors: DataFrame) -> DataFrame:
    """P/E against the median of the other positive P/Es of the sector.

    The leave-one-out median follows from the order statistics around the
    middle of the whole sector, so no pair of peers is ever formed.
    """
    joined = sectors.join(info.select("ticker", "trailing_pe"), "ticker", "left").withColumnRenamed("trailing_pe", "pe")
    placed = positions(joined.filter(F.col("pe") > 0), ["sector"], "pe")
    half = F.floor(F.col("total") / 2)

    def at(k):
        return F.max(F.when((F.col("before") < k) & (k <= F.col("before") + F.col("n")), F.col("pe")))
    middle = placed.groupBy("sector").agg(F.max("total").alias("_n"), *[
        at(half + k).alias(f"_m{k + 1}") for k in (-1, 0, 1, 2)])
    own = placed.select("sector", "pe", F.col("before").alias("_before"))
    staged = joined.join(middle, "sector", "left").join(own, ["sector", "pe"], "left")
    n, inside = F.col("_n"), F.col("pe").isNotNull() & (F.col("pe") > 0)
    peers = F.when(inside, n - 1).otherwise(n)

    def others(k):
        """k-th smallest of the peers, k an offset from n div 2."""
        full = F.floor(n / 2) + k
        place = F.when(inside & (F.col("_before") + 1 <= full), k + 1).otherwise(k)
        out = None
        for shift in (-1, 0, 1, 2):
            case = F.when(place == shift, F.col(f"_m{shift + 1}"))
            out = case if out is None else F.coalesce(out, case)
        return out
    # Peer counts: m = n or n-1; the middle positions as offsets from n div 2.
    odd_n = n % 2 == 1
    low = F.when(inside, F.when(odd_n, 0).otherwise(0)).otherwise(F.when(odd_n, 1).otherwise(0))
    high = F.when(inside, F.when(odd_n, 1).otherwise(0)).otherwise(1)
    median = (others(low) + others(high)) / 2
    result = staged.select("ticker", "sector", F.when(inside, F.col("pe")).alias("ticker_pe"),
                           F.when(peers >= 3, peers).alias("peers_used"),
                           F.when(peers >= 3, median).alias("sector_median_pe"))
    ratio = F.col("ticker_pe") / F.col("sector_median_pe")
    word = F.when(ratio < 0.85, "cheap").when(ratio > 1.15, "expensive").when(ratio.isNotNull(), "fair")
    return result.withColumn("pe_vs_sector", word)
