"""The wording of signals, as printf patterns."""

VOLUME = {
    "up": "Price rising on HIGH volume — strong conviction move. Buyers are serious.",
    "down": "Price falling on HIGH volume — strong selling pressure. Take caution.",
    "low": "Volume is LOW (%.1fx average) — weak conviction. Don't trust this move.",
    "normal": "Volume is normal (%.1fx average) — no strong confirmation signal.",
}

PE = {"negative": "P/E is negative (%.1f) — company is losing money.",
      "cheap": "P/E is %.1f — cheap relative to earnings. Potentially undervalued.",
      "fair": "P/E is %.1f — fairly valued.",
      "expensive": "P/E is %.1f — expensive. Market expects high growth to justify price."}
GROWTH = {"good": "Revenue growing at %.1f%% — strong growth.",
          "neutral": "Revenue growing at %.1f%% — slow but positive.",
          "warning": "Revenue shrinking %.1f%% — declining business."}
MARGIN = {"good": "Keeps %.1f¢ of every $1 in revenue — healthy margins.",
          "neutral": "Keeps %.1f¢ of every $1 — thin but positive margins.",
          "warning": "Keeps only %.1f¢ of every $1 — very thin or negative margins."}
DEBT = {"good": "Debt/equity %.2f — low debt, financially stable.",
        "neutral": "Debt/equity %.2f — moderate debt, manageable.",
        "warning": "Debt/equity %.2f — high debt load. Risk if earnings drop."}
LIQUIDITY = {"good": "Current ratio %.2f — can comfortably pay short-term bills.",
             "neutral": "Current ratio %.2f — just enough to cover short-term bills.",
             "warning": "Current ratio %.2f — may struggle to pay short-term bills."}
BETA = {"warning": "Beta %.2f — moves %.1fx the market. High risk/reward.",
        "neutral": "Beta %.2f — moves roughly with the market.",
        "good": "Beta %.2f — less volatile than the market. Defensive stock."}
SHORT_RATIO = {"warning": "Short ratio %.1f days — heavy short selling. Many betting price falls.",
               "neutral": "Short ratio %.1f days — moderate short interest.",
               "good": "Short ratio %.1f days — low short interest. Few betting against it."}
PIOTROSKI = "Score %d/9 — %s. Profitability: %d/4, Leverage: %d/3, Efficiency: %d/2."
HEALTH = {"good": "strong financial health", "warning": "weak financial health", "neutral": "moderate financial health"}
ALTMAN = {"safe": "Z-Score %.2f — safe zone. Low bankruptcy risk.",
          "grey": "Z-Score %.2f — grey zone. Moderate bankruptcy risk.",
          "distress": "Z-Score %.2f — distress zone. High bankruptcy risk.",
          "partial": " (Based on %d/5 components)",
          "none": "Insufficient data to calculate Z-Score."}
VALUATION = {"unknown": "Insufficient data for advanced valuation.",
             "cheap": "FCF yield %.1f%% (cheap) · EV/EBITDA %.1f (cheap valuation).",
             "expensive": "FCF yield %.1f%% (expensive) · EV/EBITDA %.1f (expensive valuation).",
             "fcf": "FCF yield %.1f%% (%s)", "no_fcf": "FCF yield N/A", "ev": "EV/EBITDA %.1f (%s)",
             "no_ev": "EV/EBITDA N/A", "mixed": "%s · %s (mixed signals)."}
BALANCE = {"none": "No balance sheet data available.",
           "decreasing": "Debt decreasing YoY — improving financial health.",
           "increasing": "Debt increasing YoY — monitor leverage carefully.",
           "stable": "Debt stable YoY.", "growing": "Revenue growing.",
           "shrinking": "Revenue shrinking — concerning.",
           "net": "$%.1fB net %s.", "unclear": "Balance sheet data available but no clear trend."}
DILUTION = {"unknown": "Share count data unavailable.",
            "buyback": "Shares reduced %.1f%% YoY — active buybacks. Company returning capital.",
            "diluting": "Shares increased %.1f%% YoY — significant dilution. Earnings per share hurt.",
            "stable": "Share count stable (±%.1f%% YoY). No major buybacks or dilution."}

CONTEXT = {"high_fear": "VIX %.1f — high fear (contrarian opportunity)", "complacency": "VIX %.1f — complacency (elevated risk)",
           "neutral": "VIX %.1f", "missing": "VIX unavailable",
           "high": "at %.0f%% of 52W range — near 52W high, momentum strong but watch for resistance",
           "low": "at %.0f%% of 52W range — near 52W low, potential value or falling knife", "mid": "at %.0f%% of 52W range"}
SECTOR = {"unknown": "Sector momentum unknown for %s.", "uptrend": "%s in uptrend — SMA20 above SMA50. Sector tailwind.",
          "downtrend": "%s in downtrend — sector headwind. Be cautious.", "neutral": "%s in neutral trend — SMA20 near SMA50."}
RELATIVE = {"good": "%s %+.1f%% vs S&P 500 %+.1f%% over %s — outperforming by %+.1f%%.",
            "warning": "%s %+.1f%% vs S&P 500 %+.1f%% over %s — underperforming by %+.1f%%.",
            "neutral": "%s %+.1f%% vs S&P 500 %+.1f%% over %s — roughly in line (%+.1f%%)."}
MOMENTUM = {"strong_up": "Strong upward momentum: ", "up": "Upward momentum: ", "strong_down": "Strong downward momentum: ",
            "down": "Downward momentum: ", "neutral": "Neutral momentum: ", "part": "%+.1f%% (%s)",
            "none": "Insufficient data to calculate momentum."}
PMO = {"leading": "Stock PMO is outperforming SPY by %+.2f points — relative strength trending upward (momentum leader).",
       "lagging": "Stock PMO is underperforming SPY by %+.2f points — relative strength trending downward (momentum laggard).",
       "neutral": "Stock PMO is trading near SPY (%+.2f points diff) — momentum parity with broader market."}
OPTIONS = {"none": "No options data available.",
           "bullish": "Put/Call ratio %s (high puts vs calls) — market is fearful. Contrarian signal: potential bounce. Expiry %s.",
           "bearish": "Put/Call ratio %s (lots of call buying) — market is greedy. Contrarian caution: may be overbought. Expiry %s.",
           "neutral": "Put/Call ratio %s — balanced options activity. %d calls vs %d puts. Expiry %s."}
VOL_RATIO = {"over": "Vol overpriced — premium selling setup", "under": "Vol underpriced — directional play", "fair": "Vol fairly priced",
             "placeholder": "IV unreliable — showing realized vol only", "unpopulated": "IV unavailable — options data not populated",
             "no_atm": "IV unavailable for ATM strikes", "text": "IV %.1f%% / RV %.1f%% = %.2f — %s"}
INSIDER = {"none": "No recent insider transaction data.",
           "bullish": "Insiders buying — %d purchases vs %d sales recently. Positive signal.",
           "bearish": "Insiders selling — %d sales vs %d purchases recently. Caution.",
           "neutral": "Mixed insider activity — %d buys, %d sells. No clear signal."}
OWNERSHIP = {"base": "%.1f%% held by institutions, %.1f%% held by insiders.",
             "good": " High institutional ownership — big funds are committed.",
             "warning": " Low institutional ownership — limited big-money support.", "neutral": " Normal ownership structure."}
SHORT_INTEREST = {"none": "No short interest data available.", "pct": "%.1f%% of float shorted%s.", "days": " (%.1f days to cover)",
                  "high": " HIGH short interest — strong bearish bet by market. Risk of short squeeze if price rises sharply.",
                  "moderate": " Moderate short interest — some bearish pressure but not extreme.",
                  "low": " Low short interest — market not heavily betting against this stock."}
ANALYST = {"none": "No analyst coverage found.", "text": "%d analysts say %s. Average target $%.2f (%+.1f%% from current price)."}
EARNINGS = {"none": "No historical earnings data available.", "surprise": " Avg surprise: %+.1f%%",
            "good": "Beat estimates %d/%d recent quarters.%s Consistent outperformer.",
            "warning": "Missed estimates %d/%d recent quarters.%s Execution concerns.",
            "neutral": "Mixed earnings — %d beats, %d misses out of %d quarters.%s"}
NEXT_EARNINGS = {"d3": "⚠️ Earnings in %d days — expect big price swings. High risk to hold through this.",
                 "d7": "Earnings in %d days — volatility expected soon. Consider your position size.",
                 "d14": "Earnings in %d days — watch for guidance updates.",
                 "far": "Next earnings in %d days — no immediate earnings risk.", "unknown": "Earnings date unknown."}
PROXIMITY = {"unknown": "Earnings date unknown.", "high": "Earnings in %d days — elevated volatility expected. Size positions carefully.",
             "medium": "Earnings in %d days — moderate event risk.", "low": "Earnings in %d days — no immediate event risk."}
HEADLINES = {"none": "No data", "positive": "Mostly Positive (%d/%d headlines)", "negative": "Mostly Negative (%d/%d headlines)",
             "mixed": "Mixed / Neutral (%d/%d neutral)"}

# Price alerts; {} is the target price.
ALERTS = {
    "analyst mean": "Analyst avg target ${} — alert when price reaches consensus",
    "analyst high": "Analyst high target ${} — most bullish scenario",
    "analyst low": "Analyst low target ${} — alert if price drops to most bearish estimate",
    "support": "Key support ${} — price breaking below this is a bearish signal",
    "resistance": "Key resistance ${} — breaking above signals potential breakout",
    "pivot below": "Pivot point ${} — dropping below pivot is bearish",
    "pivot above": "Pivot point ${} — reclaiming pivot is bullish",
}

# Exit conditions of a trade plan.
EXITS = {
    "stop": "Price drops below stop $%.2f — close position",
    "fundamentals": "Fundamentals deteriorate (earnings miss >10%, guidance cut) — re-evaluate",
    "piotroski": "Piotroski score drops below 5 (currently %d/9) — financial health weakening",
    "target": "Take 50%% off at TP1 ($%.2f), let rest run to TP2 ($%.2f)",
    "momentum": "MACD crosses below signal AND RSI drops below 45 — momentum broken, exit remaining",
    "trend": "RSI drops below 35 and price closes below 50-day SMA — trend broken",
    "earnings": "Earnings in %dd — consider taking profit before if up >5%%, re-enter after if thesis intact",
    "sector": "Sector still in downtrend — size smaller, exit faster on any weakness",
    "patience": "Re-evaluate thesis in 4–8 weeks if price hasn't moved toward TP1",
}

# Thesis of a ticker: headline by verdict and leading signal, key risk, key catalyst, points.
THESIS = {
    "buy_value": "Strong fundamentals at reasonable valuation",
    "buy_momentum": "Momentum building with improving technicals",
    "buy_growth": "Exceptional growth engine with strong execution",
    "buy": "Compelling risk-reward setup",
    "hold_valuation": "Mixed picture — strength offset by premium valuation",
    "hold_technical": "Mixed picture — fundamentals strong but technicals weakening",
    "hold_sector": "Mixed picture — company strength offset by sector headwind",
    "hold": "Mixed signals warrant cautious stance",
    "sell_fundamental": "Deteriorating fundamentals with limited upside",
    "sell_valuation": "Stretched valuation with deteriorating momentum",
    "sell_technical": "Technical breakdown with bearish implications",
    "sell": "Risk-reward heavily skewed to downside",
    "risk_earnings": "Earnings release in %d days introduces event risk; volatility spike likely",
    "risk_distress": "Altman Z-Score %.2f signals financial distress; bankruptcy risk elevated",
    "risk_premium": "Valuation premium (EV/EBITDA %.1fx) leaves little room for disappointment",
    "risk_sector": "%s sector momentum turning negative; sector rotation risk",
    "risk_short": "High short interest (%.1f%%) indicates bearish positioning and crowding",
    "risk_none": "No material risks identified; upside risk moderate",
    "catalyst_target": "Analyst consensus %.1f%% upside to $%.2f target reflects significant value",
    "catalyst_momentum": "Strong price momentum",
    "catalyst_trend": " suggests trend continuation",
    "catalyst_earnings": "Earnings growth of %.1f%% YoY with track record of beat-and-raise",
    "catalyst_cash": "Strong free cash flow yield (%.1f%%) supports buybacks and dividend growth",
    "catalyst_none": "Lack of near-term catalysts; monitor for fundamental inflection",
    "bull_analyst": "Analyst Coverage: %.1f%% upside target implies significant room",
    "bull_piotroski": "Piotroski F-Score: %d/9 shows strong financial health",
    "bull_cash": "Free Cash Flow: %.1f%% yield provides downside cushion",
    "bull_momentum": "Momentum: Price momentum accelerating",
    "bull_short": "Short Interest: Low %.1f%% reduces squeeze risk downside",
    "bear_valuation": "Valuation: EV/EBITDA %.1fx well above historical average",
    "bear_earnings": "Earnings Event: Earnings in %d days adds near-term volatility",
    "bear_sector": "Sector Headwind: %s momentum negative",
    "bear_short": "Short Interest: High %.1f%% indicates significant bearish positioning",
}
