"""Financial score cards from annual statements and snapshot fields."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions import messages as M
from tapeloom.functions.exprs import signal, total

# Field, statement, item keys in order of preference.
LINE_ITEMS = (
    ("ni", "income", ("net income",)),
    ("ta", "balance", ("total assets",)),
    ("ocf", "cash", ("operating cash flow", "total cash from operations")),
    ("ltd", "balance", ("long term debt",)),
    ("ca", "balance", ("current assets",)),
    ("cl", "balance", ("current liabilities",)),
    ("gp", "income", ("gross profit",)),
    ("rev", "income", ("total revenue", "revenue")),
    ("re", "balance", ("retained earnings", "accumulated deficit")),
    ("ebit", "income", ("ebit", "operating income")),
    ("tl", "balance", ("total liabilities",)),
    ("eq", "balance", ("stockholders equity", "total equity")),
    ("sh", "balance", ("shares outstanding",)),
    ("osn", "balance", ("ordinary shares number", "share issued", "common stock", "shares outstanding")),
    ("debt", "balance", ("total debt", "long term debt")),
    ("cash", "balance", ("cash and cash equivalents", "cash")),
)


def line_items(statements: DataFrame) -> DataFrame:
    """Resolve statement items to fields: best-ranked key contained in the name.

    The alias list is a fixed table of a few dozen rows.
    """
    spark = statements.sparkSession
    keys = [(field, stmt, key, rank) for field, stmt, names in LINE_ITEMS for rank, key in enumerate(names)]
    aliases = spark.createDataFrame(keys, "field string, _stmt string, _key string, _rank int")
    matched = statements.join(F.broadcast(aliases), (F.col("stmt") == F.col("_stmt"))
                              & F.lower("item").contains(F.col("_key")))
    field = Window.partitionBy("ticker", "field")
    choice = F.struct("_rank", "item")
    return (matched.withColumn("_best", F.min(choice).over(field)).filter(choice == F.col("_best"))
            .select("ticker", "field", "item", "period_end", "value"))


def statement_years(statements: DataFrame, years: int = 2) -> DataFrame:
    """One row per ticker: <field>0 is the newest year, <field>1 the one before."""
    age = F.dense_rank().over(Window.partitionBy("ticker").orderBy(F.col("period_end").desc())) - 1
    aged = line_items(statements).withColumn("_age", age).filter(F.col("_age") < years)
    return aged.groupBy("ticker").agg(*[
        F.max(F.when((F.col("field") == field) & (F.col("_age") == k), F.col("value"))).alias(f"{field}{k}")
        for field, _, _ in LINE_ITEMS for k in range(years)])


def over(top: str, bottom: str) -> Column:
    return F.when(F.col(bottom) != 0, F.col(top) / F.col(bottom))


def piotroski_flags() -> dict[str, tuple[str, Column]]:
    """Test name -> (group, condition); an unknown comparison counts as failed."""
    roa0, roa1 = over("ni0", "ta0"), over("ni1", "ta1")
    tests = {
        "roa_positive": ("profitability", roa0 > 0),
        "ocf_positive": ("profitability", F.col("ocf0") > 0),
        "roa_increasing": ("profitability", roa0 > roa1),
        "accruals_quality": ("profitability", over("ocf0", "ta0") > roa0),
        "lt_debt_ratio_decreased": ("leverage", over("ltd0", "ta0") < over("ltd1", "ta1")),
        "current_ratio_improved": ("leverage", over("ca0", "cl0") > over("ca1", "cl1")),
        "no_new_shares": ("leverage", F.col("sh0") <= F.col("sh1")),
        "gross_margin_improved": ("efficiency", over("gp0", "rev0") > over("gp1", "rev1")),
        "asset_turnover_improved": ("efficiency", over("rev0", "ta0") > over("rev1", "ta1")),
    }
    return {name: (group, F.coalesce(test, F.lit(False))) for name, (group, test) in tests.items()}


def piotroski(years: DataFrame) -> DataFrame:
    """Nine-test score with its group scores and the map of flags."""
    flags = piotroski_flags()
    tested = years.select("ticker", *[test.alias(name) for name, (_, test) in flags.items()])

    def points(*groups: str) -> Column:
        return total([F.col(n).cast("int") for n, (g, _) in flags.items() if g in groups])
    scored = tested.select("*", *[points(g).alias(g) for g in ("profitability", "leverage", "efficiency")])
    scored = scored.withColumn("score", F.col("profitability") + F.col("leverage") + F.col("efficiency"))
    pairs = [item for name in flags for item in (F.lit(name), F.col(name))]
    reading = F.when(F.col("score") >= 7, "strong").when(F.col("score") <= 3, "weak").otherwise("neutral")
    return scored.select(*scored.columns, F.create_map(*pairs).alias("components"), reading.alias("interpretation"))


def piotroski_signal(scores: DataFrame) -> DataFrame:
    status = F.when(F.col("score") >= 7, "good").when(F.col("score") <= 3, "warning").otherwise("neutral")
    health = F.when(status == "good", M.HEALTH["good"]).when(status == "warning", M.HEALTH["warning"]).otherwise(M.HEALTH["neutral"])
    text = F.format_string(M.PIOTROSKI, F.col("score"), health, F.col("profitability"), F.col("leverage"), F.col("efficiency"))
    return scores.select("ticker", *signal("Piotroski F-Score", status, text))


def eight_test_score() -> Column:
    """Score without the share test; every test needs total assets."""
    flags = [test.cast("int") for name, (_, test) in piotroski_flags().items() if name != "no_new_shares"]
    usable = F.coalesce(F.col("ta0") != 0, F.lit(False))
    return F.when(usable, F.least(total(flags), F.lit(9))).otherwise(0)


def piotroski_eight(years: DataFrame) -> DataFrame:
    return years.select("ticker", eight_test_score().alias("score8"))


# Weights of the five Z-Score terms and the zone limits.
Z_WEIGHTS = (1.2, 1.4, 3.3, 0.6, 1.0)
Z_GREY, Z_SAFE = 1.81, 2.99


def altman_market(years: DataFrame, info: DataFrame) -> DataFrame:
    """Z-Score with market value of equity; missing terms are left out."""
    joined = years.join(info.select("ticker", "market_cap"), "ticker", "left")
    terms = joined.select(
        "ticker", F.when(F.col("ta0") != 0, (F.col("ca0") - F.col("cl0")) / F.col("ta0")).alias("x1"),
        over("re0", "ta0").alias("x2"), over("ebit0", "ta0").alias("x3"),
        over("market_cap", "tl0").alias("x4"), over("rev0", "ta0").alias("x5"))
    names = ("x1", "x2", "x3", "x4", "x5")
    known = total([F.col(n).isNotNull().cast("int") for n in names])
    z = total([F.coalesce(w * F.col(n), F.lit(0.0)) for w, n in zip(Z_WEIGHTS, names)])
    scored = terms.withColumn("n_terms", known).withColumn("z_score", F.when(known > 0, z))
    zone = (F.when(F.col("z_score").isNull(), "unknown").when(F.col("z_score") > Z_SAFE, "safe")
            .when(F.col("z_score") >= Z_GREY, "grey").otherwise("distress"))
    return scored.withColumn("zone", zone)


def altman_signal(scores: DataFrame) -> DataFrame:
    zone = F.col("zone")
    status = F.when(zone == "safe", "good").when(zone == "distress", "warning").otherwise("neutral")
    base = F.when(zone == "safe", F.format_string(M.ALTMAN["safe"], "z_score")).when(
        zone == "grey", F.format_string(M.ALTMAN["grey"], "z_score")).otherwise(F.format_string(M.ALTMAN["distress"], "z_score"))
    part = F.when(F.col("n_terms") < 5, F.format_string(M.ALTMAN["partial"], "n_terms")).otherwise("")
    text = F.when(zone == "unknown", M.ALTMAN["none"]).otherwise(F.concat(base, part))
    return scores.select("ticker", *signal("Altman Z-Score", status, text))


def altman_book_value() -> Column:
    """Z-Score with book equity; missing items count as zero."""
    def zero(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))
    ta = F.col("ta0")
    base = F.when(zero("tl0") != 0, F.col("tl0")).otherwise(ta)
    z = (1.2 * (zero("ca0") - zero("cl0")) / ta + 1.4 * zero("re0") / ta + 3.3 * zero("ebit0") / ta
         + 0.6 * zero("eq0") / base + zero("rev0") / ta)
    return F.when(ta != 0, z)


def altman_book(years: DataFrame) -> DataFrame:
    return years.select("ticker", altman_book_value().alias("z_book"))


def snapshot_ratios(years: DataFrame) -> DataFrame:
    return years.select("ticker", over("ca0", "cl0").alias("current_ratio"), over("debt0", "eq0").alias("debt_to_equity"),
                        over("ni0", "rev0").alias("profit_margin"))


def bands(value: Column, cuts, texts: dict[str, str], *shown: Column) -> Column:
    """Signal struct for the first (condition, status, text key) that holds."""
    shown = shown or (value,)
    out = None
    for condition, status, key in cuts:
        row = F.struct(F.lit(status).alias("status"), F.format_string(texts[key], *shown).alias("text"))
        if condition is None:
            return out.otherwise(row)
        out = F.when(condition, row) if out is None else out.when(condition, row)
    return out


def fundamental_signals(info: DataFrame) -> DataFrame:
    """Up to seven signals per ticker; a missing metric gives none."""
    pe, beta, short = F.col("trailing_pe"), F.col("beta"), F.col("short_ratio")
    growth, margin = F.col("revenue_growth") * 100, F.col("profit_margin") * 100
    debt, liquid = F.col("debt_to_equity") / 100, F.col("current_ratio")
    rows = (
        ("P/E Ratio", pe.isNotNull() & (pe != 0), bands(pe, (
            (pe < 0, "warning", "negative"), (pe < 15, "good", "cheap"), (pe < 30, "neutral", "fair"),
            (None, "warning", "expensive")), M.PE)),
        ("Revenue Growth", growth.isNotNull(), bands(growth, (
            (growth > 15, "good", "good"), (growth > 0, "neutral", "neutral"), (None, "warning", "warning")), M.GROWTH)),
        ("Profit Margin", margin.isNotNull(), bands(margin, (
            (margin > 15, "good", "good"), (margin > 5, "neutral", "neutral"), (None, "warning", "warning")), M.MARGIN)),
        ("Debt", debt.isNotNull(), bands(debt, (
            (debt < 0.5, "good", "good"), (debt < 1.5, "neutral", "neutral"), (None, "warning", "warning")), M.DEBT)),
        ("Liquidity", liquid.isNotNull(), bands(liquid, (
            (liquid > 1.5, "good", "good"), (liquid > 1, "neutral", "neutral"), (None, "warning", "warning")), M.LIQUIDITY)),
        ("Volatility (Beta)", beta.isNotNull(), F.when(beta > 1.5, F.struct(
            F.lit("warning").alias("status"), F.format_string(M.BETA["warning"], beta, beta).alias("text"))).otherwise(
            bands(beta, ((beta > 0.8, "neutral", "neutral"), (None, "good", "good")), M.BETA))),
        ("Short Interest", short.isNotNull(), bands(short, (
            (short > 10, "warning", "warning"), (short > 5, "neutral", "neutral"), (None, "good", "good")), M.SHORT_RATIO)),
    )
    made = F.array(*[F.when(present, F.struct(F.lit(label).alias("label"), body["status"].alias("status"),
                                              body["text"].alias("text"))) for label, present, body in rows])
    return info.select("ticker", F.inline(F.array_compact(made)))


def advanced_valuation(info: DataFrame) -> DataFrame:
    def truthy(*names: str) -> Column:
        out = F.lit(True)
        for name in names:
            out = out & F.coalesce(F.col(name) != 0, F.lit(False))
        return out
    fcf = F.when(truthy("free_cashflow", "market_cap"), F.col("free_cashflow") / F.col("market_cap") * 100)
    ev = F.when(truthy("enterprise_value", "ebitda"), F.col("enterprise_value") / F.col("ebitda"))
    share = F.when(truthy("free_cashflow", "shares_outstanding"), F.col("free_cashflow") / F.col("shares_outstanding"))
    staged = info.select("ticker", fcf.alias("fcf_yield"), ev.alias("ev_ebitda"), share.alias("fcf_per_share"))
    fcf_word = (F.when(F.col("fcf_yield").isNull(), "unknown").when(F.col("fcf_yield") > 5, "cheap")
                .when(F.col("fcf_yield") >= 2, "fair").otherwise("expensive"))
    ev_word = (F.when(F.col("ev_ebitda").isNull(), "unknown").when(F.col("ev_ebitda") < 10, "cheap")
               .when(F.col("ev_ebitda") <= 20, "fair").otherwise("expensive"))
    staged = staged.withColumn("fcf_interpretation", fcf_word).withColumn("ev_ebitda_interpretation", ev_word)
    a, b = F.col("fcf_interpretation"), F.col("ev_ebitda_interpretation")
    status = (F.when((a == "unknown") & (b == "unknown"), "unknown").when((a == "cheap") & (b == "cheap"), "good")
              .when((a == "expensive") & (b == "expensive"), "warning").otherwise("neutral"))
    mixed = F.format_string(
        M.VALUATION["mixed"],
        F.when(F.col("fcf_yield").isNull(), M.VALUATION["no_fcf"]).otherwise(F.format_string(M.VALUATION["fcf"], F.col("fcf_yield"), a)),
        F.when(F.col("ev_ebitda").isNull(), M.VALUATION["no_ev"]).otherwise(F.format_string(M.VALUATION["ev"], F.col("ev_ebitda"), b)))
    text = (F.when(status == "unknown", M.VALUATION["unknown"])
            .when(status == "good", F.format_string(M.VALUATION["cheap"], "fcf_yield", "ev_ebitda"))
            .when(status == "warning", F.format_string(M.VALUATION["expensive"], "fcf_yield", "ev_ebitda")).otherwise(mixed))
    return staged.select("*", status.alias("status"), text.alias("text"))


def balance_trends(statements: DataFrame, years: int = 4) -> DataFrame:
    """Debt, assets, cash and revenue of the last years, and two trends."""
    age = F.dense_rank().over(Window.partitionBy("ticker").orderBy(F.col("period_end").desc())) - 1
    aged = line_items(statements).withColumn("_age", age).filter(F.col("_age") < years)

    def billions(field: str) -> Column:
        return F.round(F.max(F.when(F.col("field") == field, F.col("value"))) / 1e9, 2).alias(field)
    yearly = aged.groupBy("ticker", "_age", F.year("period_end").alias("year")).agg(
        *[billions(f) for f in ("debt", "ta", "cash", "rev")])
    yearly = (yearly.withColumn("net_debt", F.round(F.col("debt") - F.col("cash"), 2))
              .withColumn("debt_to_assets", F.when(F.col("ta") > 0, F.round(F.col("debt") / F.col("ta"), 3))))

    def ends(field: str) -> list[Column]:
        known = F.when(F.col(field).isNotNull(), F.col("_age"))
        return [F.min_by(field, known).alias(f"{field}_new"), F.max_by(field, known).alias(f"{field}_old"),
                F.count(field).alias(f"{field}_n")]
    series = F.array_sort(F.collect_list(F.struct("_age", "year", "debt", "ta", "cash", "net_debt", "debt_to_assets", "rev")))
    shaped = yearly.groupBy("ticker").agg(series.alias("history"), *ends("debt"), *ends("rev"),
                                          F.min_by("net_debt", "_age").alias("net_debt_now"))

    def moved(field: str, up: str, down: str) -> Column:
        # From nothing there is no change in percent; that counts as stable.
        pct = F.try_divide(F.col(f"{field}_new") - F.col(f"{field}_old"), F.abs(F.col(f"{field}_old"))) * 100
        return (F.when(F.col(f"{field}_n") < 2, "unknown").when(pct > 10, up).when(pct < -10, down).otherwise("stable"))
    return shaped.select("ticker", "history", "net_debt_now", moved("debt", "increasing", "decreasing").alias("debt_trend"),
                         moved("rev", "growing", "shrinking").alias("revenue_trend"))


def balance_signal(trends: DataFrame) -> DataFrame:
    debt, revenue, net = F.col("debt_trend"), F.col("revenue_trend"), F.col("net_debt_now")
    none = (debt == "unknown") & (revenue == "unknown")
    status = (F.when(none, "neutral").when(revenue == "shrinking", "warning").when(debt == "decreasing", "good")
              .when(debt == "increasing", "warning").when(revenue == "growing", "good").otherwise("neutral"))
    debt_text = (F.when(debt == "decreasing", M.BALANCE["decreasing"]).when(debt == "increasing", M.BALANCE["increasing"])
                 .when(debt == "stable", M.BALANCE["stable"]))
    revenue_text = F.when(revenue == "growing", M.BALANCE["growing"]).when(revenue == "shrinking", M.BALANCE["shrinking"])
    net_text = F.when(net.isNotNull(), F.format_string(M.BALANCE["net"], F.abs(net), F.when(net > 0, "debt").otherwise("cash")))
    joined = F.concat_ws(" ", debt_text, revenue_text, net_text)
    text = F.when(none, M.BALANCE["none"]).when(joined == "", M.BALANCE["unclear"]).otherwise(joined)
    return trends.select("ticker", *signal("Balance Sheet", status, text))


def share_count(years: DataFrame) -> DataFrame:
    now, before = F.col("osn0"), F.col("osn1")
    pct = F.when((now > 0) & (before > 0), (now - before) / before * 100)
    trend = (F.when(F.col("share_change_pct").isNull(), "unknown").when(F.col("share_change_pct") < -1, "buyback")
             .when(F.col("share_change_pct") > 2, "diluting").otherwise("stable"))
    staged = years.select("ticker", F.when(pct.isNotNull(), now).alias("shares_current"),
                          F.when(pct.isNotNull(), before).alias("shares_prior"), pct.alias("share_change_pct"))
    return staged.withColumn("share_trend", trend)


def share_signal(counts: DataFrame) -> DataFrame:
    trend, pct = F.col("share_trend"), F.round("share_change_pct", 2)
    status = F.when(trend == "buyback", "good").when(trend == "diluting", "warning").otherwise("neutral")
    text = (F.when(trend == "unknown", M.DILUTION["unknown"])
            .when(trend == "buyback", F.format_string(M.DILUTION["buyback"], F.abs(pct)))
            .when(trend == "diluting", F.format_string(M.DILUTION["diluting"], pct))
            .otherwise(F.format_string(M.DILUTION["stable"], F.abs(pct))))
    return counts.select("ticker", *signal("Share Count", status, text))
