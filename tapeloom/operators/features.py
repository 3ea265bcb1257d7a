"""The 57-column feature panel.

Every price feature is a frame of the one (ticker, date) window, so the whole
panel costs one shuffle of the bars on ticker; filings and events enter through
the same shuffle as unioned day rows. Windows over fixed positions (ranks,
quantiles, regressions on the bar index) are unrolled into lag columns and
wide frames are put together from narrow ones, so no frame is re-aggregated
row by row.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.exprs import by_date, by_ticker, clip, newest, total
from tapeloom.functions.ranks import exact_median
from tapeloom.functions.rolling import Roll, rolled
from tapeloom.operators import indicators as ind
from tapeloom.operators.alignment import RATIOS, point_in_time_ratios, trailing_sentiment
from tapeloom.operators.scorecards import altman_book_value, eight_test_score, statement_years
from tapeloom.session import lookup, staged

# The ordered feature contract.
TECHNICAL = (
    "rsi", "macd_above_signal", "bb_position", "sma20_vs_sma50", "volume_surge_20d", "atr_pct", "cmf_20d", "roc_21d",
    "alpha_21d", "sector_alpha_21d", "high_52w_proximity", "kmid", "klen", "kup", "klow", "ksft", "roc_5", "roc_10",
    "roc_60", "ma_5", "ma_10", "ma_20", "ma_60", "std_5", "std_10", "std_20", "std_60", "beta_5", "beta_10", "beta_20",
    "rsqr_10", "rsqr_20", "resi_10", "resi_20", "max_20", "min_20", "qtlu_10", "qtld_10", "rank_10", "corr_10",
    "cntp_10", "cntn_10", "vma_20")
FUNDAMENTAL = ("pe_ratio", "forward_pe", "profit_margin", "roe", "debt_to_equity", "revenue_growth", "earnings_growth",
               "fcf_yield", "gross_profitability", "piotroski_score", "altman_z")
SENTIMENT = ("short_interest_pct", "insider_net_ratio", "analyst_score")
FEATURES = TECHNICAL + FUNDAMENTAL + SENTIMENT
EPS = 1e-8
MIN_BARS = 100


# Bounds of the features that are clipped.
BOUNDS = {
    "bb_position": (0, 1), "sma20_vs_sma50": (-0.5, 0.5), "volume_surge_20d": (-1, 3), "atr_pct": (0, 0.2), "cmf_20d": (-1, 1),
    "high_52w_proximity": (0, 1), "kmid": (-0.5, 0.5), "klen": (-0.5, 0.5), "kup": (-0.5, 0.5), "klow": (-0.5, 0.5),
    "ksft": (-0.5, 0.5), "max_20": (0, 2), "min_20": (0, 1), "vma_20": (0, 10), "roc_21d": (-0.5, 0.5), "roc_5": (-0.5, 0.5),
    "roc_10": (-0.5, 0.5), "roc_60": (-0.5, 0.5), "ma_5": (-0.5, 1.5), "ma_10": (-0.5, 1.5), "ma_20": (-0.5, 1.5),
    "ma_60": (-0.5, 1.5), "std_5": (0, 1), "std_10": (0, 1), "std_20": (0, 1), "std_60": (0, 1), "beta_5": (-0.5, 0.5),
    "beta_10": (-0.5, 0.5), "beta_20": (-0.5, 0.5), "rsqr_10": (0, 1), "rsqr_20": (0, 1), "resi_10": (0, 1), "resi_20": (0, 1),
    "qtlu_10": (0, 2), "qtld_10": (0, 1), "corr_10": (-1, 1),
}


def oscillator_features(df: DataFrame) -> DataFrame:
    """RSI and MACD state; the Bollinger and mean features need only price_features."""
    staged = ind.oscillators(df)
    above = F.coalesce(F.col("macd") > F.col("macd_signal"), F.lit(False)).cast("double")
    kept = [c for c in df.columns]
    return staged.select(*kept, (clip(F.col("rsi"), 0, 100) / 100).alias("rsi"), above.alias("macd_above_signal"))


def _closes(n: int) -> list[Column]:
    return [F.col(f"_c{k}") for k in range(n)]


def _fit(n: int) -> dict[str, Column]:
    """Mean, squared deviations and least-squares line of the last n closes."""
    center, sxx = (n - 1) / 2.0, n * (n * n - 1) / 12.0
    mean = total(_closes(n)) / n
    slope = total([c * ((n - 1 - k) - center) for k, c in enumerate(_closes(n))]) / sxx
    return {f"_m{n}": mean, f"_b{n}": slope}


def price_features(df: DataFrame) -> DataFrame:
    """All features that need only a ticker's own bars, except the oscillators.

    Lag columns of the close serve means, deviations, regressions and order
    statistics; wider frames are put together from them.
    """
    w = by_ticker()
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    rn = F.row_number().over(w)
    staged = df.select("*", rn.alias("_rn"), F.lag("volume", 1).over(w).alias("_pv"), c.alias("_c0"),
                       *[F.lag("close", k).over(w).alias(f"_c{k}") for k in range(1, 22)], F.lag("close", 60).over(w).alias("_c60"))
    prior = F.col("_c1")
    spread = h - low + EPS
    dc, dv = F.when(prior != 0, c / prior - 1), F.when(F.col("_pv") != 0, v / F.col("_pv") - 1)
    staged = staged.select("*", F.greatest(h - low, F.abs(h - prior), F.abs(low - prior)).alias("_tr"),
                           (((c - low) - (h - c)) / spread * v).alias("_mf"),
                           F.when(dv.isNotNull(), dc).alias("_dc"), F.when(dc.isNotNull(), dv).alias("_dv"))
    fits: dict[str, Column] = {}
    for n in (5, 10, 20):
        fits |= _fit(n)
    staged = staged.select("*", *[value.alias(name) for name, value in fits.items()])

    def spreads(n: int) -> Column:
        return total([(x - F.col(f"_m{n}")) * (x - F.col(f"_m{n}")) for x in _closes(n)])
    staged = staged.select("*", *[spreads(n).alias(f"_q{n}") for n in (5, 10, 20)],
                           F.sort_array(F.array(*_closes(10))).alias("_sorted"), F.greatest(*_closes(20)).alias("_top20"))
    pair = F.col("_dc").isNotNull()
    staged = rolled(staged, [
        Roll("max", h, {20: "_hi20"}), Roll("min", low, {20: "_lo20"}), Roll("sum", v, {20: "_v20"}),
        Roll("sum", F.col("_mf"), {20: "_mf20"}), Roll("sum", F.col("_tr"), {14: "_tr14"}),
        Roll("sum", F.col("_dc"), {10: "_sx"}), Roll("sum", F.col("_dv"), {10: "_sy"}), Roll("sum", F.col("_dc") * F.col("_dc"), {10: "_sxx"}),
        Roll("sum", F.col("_dv") * F.col("_dv"), {10: "_syy"}), Roll("sum", F.col("_dc") * F.col("_dv"), {10: "_sxy"}),
        Roll("sum", pair.cast("double"), {10: "_np"})])

    def back(name: str, k: int) -> Column:
        return F.lag(name, k).over(w)
    staged = staged.select("*", back("_m20", 20).alias("_m20a"), back("_m20", 40).alias("_m20b"), back("_q20", 20).alias("_q20a"),
                           back("_q20", 40).alias("_q20b"), back("_m10", 40).alias("_m10b"),
                           F.greatest(F.col("_top20"), *[back("_top20", k) for k in (*range(20, 240, 20), 232)]).alias("_top252"))
    m20, m20a, m20b = F.col("_m20"), F.col("_m20a"), F.col("_m20b")
    staged = staged.select("*", ((m20 + m20a + m20b) / 3).alias("_m60"), ((m20 * 2 + m20a * 2 + F.col("_m10b")) / 5).alias("_m50"))
    m60 = F.col("_m60")
    between = total([(x - m60) * (x - m60) for x in (m20, m20a, m20b)]) * 20
    q60 = F.col("_q20") + F.col("_q20a") + F.col("_q20b") + between
    sigma = {n: F.sqrt((F.col(f"_q{n}") if n < 60 else q60) / (n - 1)) for n in (5, 10, 20, 60)}
    base = o + EPS
    rows = F.col("_rn")
    out = {
        "bb_position": ((c - (m20 - 2 * sigma[20])) / (4 * sigma[20] + EPS)),
        "sma20_vs_sma50": (m20 / (F.col("_m50") + EPS) - 1),
        "volume_surge_20d": (v / (F.col("_v20") / F.least(rows, F.lit(20)) + EPS) - 1),
        "atr_pct": (F.col("_tr14") / F.least(rows, F.lit(14)) / (c + EPS)),
        "cmf_20d": F.when((rows >= 20) & (F.col("_v20") != 0), (F.col("_mf20") / F.col("_v20"))),
        "high_52w_proximity": F.when(rows >= 252, (c / F.greatest(F.col("_top252"), F.lit(EPS)))),
        "kmid": ((c - o) / base), "klen": ((h - low) / base),
        "kup": ((h - F.greatest(o, c)) / base), "klow": ((F.least(o, c) - low) / base),
        "ksft": ((c * 2 - h - low) / base),
        "max_20": F.when(rows >= 20, (F.col("_hi20") / c)), "min_20": F.when(rows >= 20, (F.col("_lo20") / c)),
        "vma_20": F.when(rows >= 20, (F.col("_v20") / 20 / (c * 1e4))),
    }
    for name, k in (("roc_21d", 21), ("roc_5", 5), ("roc_10", 10), ("roc_60", 60)):
        past = F.col(f"_c{k}")
        out[name] = (F.when(past != 0, c / past - 1))
    for n in (5, 10, 20, 60):
        out[f"ma_{n}"] = (F.col(f"_m{n}") / c)
        out[f"std_{n}"] = (sigma[n] / c)
    for n in (5, 10, 20):
        out[f"beta_{n}"] = (F.col(f"_b{n}") / c)
    for n in (10, 20):
        slope, mean, deviations = F.col(f"_b{n}"), F.col(f"_m{n}"), F.col(f"_q{n}")
        r2 = F.when(deviations > 1e-18, slope * slope * (n * (n * n - 1) / 12.0) / deviations).when(deviations.isNotNull(), 0.0)
        residual = total([F.abs(x - mean - slope * ((n - 1) / 2.0 - k)) for k, x in enumerate(_closes(n))]) / n
        out[f"rsqr_{n}"], out[f"resi_{n}"] = r2, (residual / (mean + EPS))

    def quantile(q: float) -> Column:
        low_at = int(9 * q)
        a, b = F.col("_sorted")[low_at], F.col("_sorted")[low_at + 1]
        return F.when(F.col("_c9").isNotNull(), a + (b - a) * (9 * q - low_at))
    recent = _closes(10)
    out["qtlu_10"], out["qtld_10"] = (quantile(0.8) / c), (quantile(0.2) / c)
    out["rank_10"] = total([(recent[k] < c).cast("double") for k in range(1, 10)]) / 10
    out["cntp_10"] = total([(recent[k] > recent[k + 1]).cast("double") for k in range(9)]) / 10
    out["cntn_10"] = total([(recent[k] < recent[k + 1]).cast("double") for k in range(9)]) / 10
    vx = F.col("_sxx") - F.col("_sx") * F.col("_sx") / 10
    vy = F.col("_syy") - F.col("_sy") * F.col("_sy") / 10
    varied = (F.col("_np") >= 10) & (vx > 1e-14 * F.col("_sxx")) & (vy > 1e-14 * F.col("_syy"))
    out["corr_10"] = F.when(varied, ((F.col("_sxy") - F.col("_sx") * F.col("_sy") / 10) / F.sqrt(vx * vy)))
    out["_ret21"] = F.when(F.col("_c21") != 0, c / F.col("_c21") - 1)
    raw = staged.select(*df.columns, *[value.alias(name) for name, value in out.items()])
    return raw.select(*df.columns, *[clip(F.col(n), *BOUNDS[n]).alias(n) if n in BOUNDS else F.col(n) for n in out])


def series_change(series: DataFrame, n: int, out: str, *keys: str) -> DataFrame:
    """n-row change of a dated series; without keys it is one calendar-long series."""
    window = Window.partitionBy(*(keys or [F.lit(1)])).orderBy("date")
    prior = F.lag("close", n).over(window)
    return series.select(*keys, "date", F.when(prior != 0, F.col("close") / prior - 1).alias(out))


def relative_features(df: DataFrame, benchmark: DataFrame, sectors: DataFrame, etf: DataFrame) -> DataFrame:
    """Own 21-bar return against the benchmark's and the sector's.

    The changes are as long as the calendar and are looked up where the wide rows lie, once they are counted as small.
    """
    market = lookup(series_change(benchmark, 21, "_spy21"))
    sector = lookup(series_change(etf, 21, "_etf21", "sector"))
    joined = df.join(market, "date", "left").join(lookup(sectors), "ticker", "left").join(sector, ["sector", "date"], "left")
    alpha = clip(F.col("_ret21") - F.col("_spy21"), -0.5, 0.5)
    own_sector = clip(F.col("_ret21") - F.col("_etf21"), -0.5, 0.5)
    covered = F.col("sector").isNotNull()
    return joined.select(*df.columns, alpha.alias("alpha_21d"), F.when(covered, own_sector).otherwise(alpha).alias("sector_alpha_21d"))


def technical_features(bars: DataFrame, benchmark: DataFrame, sectors: DataFrame, etf: DataFrame) -> DataFrame:
    n = F.count("*").over(Window.partitionBy("ticker"))
    out = bars.withColumn("_n", n).filter(F.col("_n") >= MIN_BARS).drop("_n")
    return relative_features(price_features(oscillator_features(out)), benchmark, sectors, etf)


def snapshot_features(info: DataFrame) -> DataFrame:
    fcf, cap = F.col("free_cashflow"), F.col("market_cap")
    return info.select(
        "ticker", clip(F.col("trailing_pe"), -100, 100).alias("pe_ratio"), clip(F.col("forward_pe"), -100, 100).alias("forward_pe"),
        "profit_margin", "roe", clip(F.col("debt_to_equity"), -50, 50).alias("debt_to_equity"), "revenue_growth", "earnings_growth",
        F.when((fcf != 0) & (cap > 0), clip(fcf / cap, -0.5, 0.5)).alias("fcf_yield"),
        F.col("gross_profit").alias("_gp"), F.col("short_pct_float").alias("short_interest_pct"))


def fundamental_features(info: DataFrame, statements: DataFrame) -> DataFrame:
    """One row per ticker: snapshot fields, profitability and score cards."""
    cards = statement_years(statements).select("ticker", "ta0", eight_test_score().alias("score8"), altman_book_value().alias("z_book"))
    joined = snapshot_features(info).join(cards, "ticker", "left")
    gross = F.when(F.col("ta0") > 0, clip(F.col("_gp") / F.col("ta0"), -1, 2))
    return joined.select(*[c for c in joined.columns if c not in ("_gp", "ta0", "score8", "z_book")], gross.alias("gross_profitability"),
                         (F.col("score8") / 9).alias("piotroski_score"), clip(F.col("z_book"), -5, 15).alias("altman_z"))


def overlay(df: DataFrame) -> DataFrame:
    """Point-in-time value where known, else the snapshot."""
    kept = [c for c in df.columns if not c.startswith("pit_")]
    return df.select(*[F.coalesce(F.col(f"pit_{c}"), F.col(c)).alias(c) if c in RATIOS else F.col(c) for c in kept])


def contract(df: DataFrame, *lead: str) -> DataFrame:
    """The ordered contract columns; a missing one becomes a NULL column."""
    have = set(df.columns)
    return df.select(*lead, *[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in FEATURES])


def feature_frame(m, with_overlay: bool = True) -> DataFrame:
    """All features of all bars; training adds the filings overlay, live does not."""
    filings = point_in_time_ratios(m.facts) if with_overlay else None
    aligned = trailing_sentiment(m.bars, m.insider, m.grades, filings, RATIOS if with_overlay else ())
    out = technical_features(aligned, m.bench, m.sectors, m.etf).join(lookup(fundamental_features(m.info, m.statements)), "ticker", "left")
    if with_overlay:
        out = overlay(out)
    return contract(out, "ticker", "date", "high", "low", "close")


def impute(df: DataFrame, columns=FEATURES) -> DataFrame:
    """Per-date median, then the column's global median, then zero.

    The per-date medians are one window on date. Their result is staged as
    columns, because the fallback reads it again, but only the columns that
    still hold NULLs: an exact distributed median is computed for those.
    """
    w = by_date()
    daily = df.select(*[c for c in df.columns if c not in columns],
                      *[F.coalesce(F.col(c), F.median(c).over(w)).alias(c) for c in columns])
    daily = staged(daily.select(*df.columns))
    gaps = daily.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    open_columns = [c for c in columns if gaps[c]]
    if not open_columns:
        return daily
    long = daily.select(F.expr("stack({}, {}) as (feature, value)".format(
        len(open_columns), ", ".join(f"'{c}', `{c}`" for c in open_columns))))
    medians = {r["feature"]: r["median"] for r in exact_median(long, ["feature"], "value").collect()}   # one row per feature
    filled = [F.coalesce(F.col(c), F.lit(medians.get(c)).cast("double"), F.lit(0.0)).alias(c) if c in open_columns else F.col(c)
              for c in daily.columns]
    return daily.select(*filled)


def live_snapshot(features: DataFrame) -> DataFrame:
    """Newest row per ticker, imputed over its own cross-section.

    Tickers may end on different dates; each row keeps its own.
    """
    return impute(newest(features, *FEATURES))
