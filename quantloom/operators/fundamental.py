"""Fundamental factors on quarterly reports: one row per (symbol, report_date)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.series import Series, div, flag, with_pos

R = Series(("symbol",), ("report_date",))


def over_positive(a, b, scale=1.0, default=None) -> Column:
    """a / b x scale where b is positive, else the default."""
    b = F.col(b) if isinstance(b, str) else b
    out = F.when(b > 0, div(a, b) * scale)
    return out if default is None else out.otherwise(F.lit(default))


def per_share(c: str) -> Column:
    return div(c, "shares")


def valuation(df: DataFrame, s: Series = R) -> DataFrame:
    """Price multiples; NULL where the denominator is not positive."""
    d = df.withColumns({"_eps": per_share("net_income"), "_cap": F.col("price") * F.col("shares"), "_ev": F.col("price") * F.col("shares") + F.col("total_debt") - F.col("cash")})
    p = F.col("price")
    d = d.withColumns({"pe_ratio": over_positive(p, "_eps"), "pb_ratio": over_positive(p, per_share("equity")), "ps_ratio": over_positive(p, per_share("revenue")),
                       "pcf_ratio": over_positive(p, per_share("operating_cash_flow")), "ev_ebitda": over_positive("_ev", "ebitda"), "ev_sales": over_positive("_ev", "revenue"),
                       "_g": s.pct("_eps", 4)})
    return d.withColumns({"peg_ratio": over_positive("pe_ratio", F.col("_g") * 100), "dividend_yield": over_positive(per_share("dividends"), p, 100.0, 0.0),
                          "fcf_yield": over_positive(div(F.col("operating_cash_flow") - F.col("capex"), "shares"), p, 100.0, 0.0),
                          "earnings_yield": F.coalesce(over_positive(F.lit(1.0), "pe_ratio", 100.0), F.lit(0.0))})


def profitability(df: DataFrame) -> DataFrame:
    spec = {"roe": ("net_income", "equity", 100), "roa": ("net_income", "total_assets", 100), "roic": ("operating_income", F.col("equity") + F.col("total_debt"), 100),
            "gross_margin": ("gross_profit", "revenue", 100), "operating_margin": ("operating_income", "revenue", 100), "net_margin": ("net_income", "revenue", 100),
            "ebitda_margin": ("ebitda", "revenue", 100), "asset_turnover": ("revenue", "total_assets", 1), "equity_multiplier": ("total_assets", "equity", 1)}
    return df.withColumns({k: over_positive(a, b, float(m), 0.0) for k, (a, b, m) in spec.items()})


GROWTH = {"revenue_growth": "revenue", "earnings_growth": "net_income", "assets_growth": "total_assets", "equity_growth": "equity", "ebitda_growth": "ebitda", "ocf_growth": "operating_cash_flow", "dividend_growth": "dividends"}


def growth(df: DataFrame, periods=4, s: Series = R) -> DataFrame:
    """Compound growth per period in percent, 0 where the base is not positive, NULL without a base row."""
    out = {}
    for k, c in GROWTH.items():
        base = s.lag(c, periods)
        ratio = div(c, base)
        out[k] = F.when(base > 0, F.when(ratio >= 0, (F.pow(ratio, F.lit(1.0 / periods)) - 1) * 100)).when(base.isNotNull(), 0.0)
    return df.withColumns(out)


def quality(df: DataFrame) -> DataFrame:
    spec = {"debt_to_assets": ("total_liabilities", "total_assets", 100), "debt_to_equity": ("total_debt", "equity", 100), "current_ratio": ("current_assets", "current_liabilities", 1),
            "quick_ratio": (F.col("current_assets") - F.col("inventory"), "current_liabilities", 1), "cash_ratio": ("cash", "current_liabilities", 1),
            "interest_coverage": ("operating_income", "interest_expense", 1), "inventory_turnover": ("cogs", "inventory", 1), "receivables_turnover": ("revenue", "receivables", 1),
            "payables_turnover": ("cogs", "current_liabilities", 1), "cash_flow_quality": ("operating_cash_flow", "net_income", 1),
            "accruals_ratio": (F.col("net_income") - F.col("operating_cash_flow"), "total_assets", 100)}
    d = df.withColumns({k: over_positive(a, b, float(m), 0.0) for k, (a, b, m) in spec.items()})
    i, r, p = (F.col(c) for c in ("inventory_turnover", "receivables_turnover", "payables_turnover"))
    return d.withColumn("cash_conversion_cycle", F.when((i > 0) & (r > 0) & (p > 0), div(F.lit(365.0), i) + div(F.lit(365.0), r) - div(F.lit(365.0), p)).otherwise(0.0))


def leverage_efficiency(df: DataFrame) -> DataFrame:
    wc = F.col("current_assets") - F.col("current_liabilities")
    return df.withColumns({
        "financial_leverage": over_positive("total_assets", "equity", 1.0, 0.0), "long_term_debt_ratio": over_positive("total_debt", "total_assets", 100.0, 0.0),
        "debt_to_capital": over_positive("total_debt", F.col("total_debt") + F.col("equity"), 100.0, 0.0), "net_debt_to_ebitda": over_positive(F.col("total_debt") - F.col("cash"), "ebitda", 1.0, 0.0),
        "fixed_asset_turnover": over_positive("revenue", F.col("total_assets") - F.col("current_assets"), 1.0, 0.0), "working_capital_turnover": over_positive("revenue", wc, 1.0, 0.0)})


def piotroski(df: DataFrame, s: Series = R) -> DataFrame:
    d = df.withColumns({"_roa": div("net_income", "total_assets"), "_cr": div("current_assets", "current_liabilities"), "_gm": div("gross_profit", "revenue"), "_at": div("revenue", "total_assets")})
    points = [F.col("net_income") > 0, F.col("operating_cash_flow") > 0, F.col("_roa") > s.lag("_roa"), F.col("operating_cash_flow") > F.col("net_income"),
              F.col("total_debt") < s.lag("total_debt"), F.col("_cr") > s.lag("_cr"), F.col("shares") <= s.lag("shares"), F.col("_gm") > s.lag("_gm"), F.col("_at") > s.lag("_at")]
    total = flag(points[0])
    for p in points[1:]:
        total = total + flag(p)
    return d.withColumn("f_score", total)


def altman_z(df: DataFrame) -> DataFrame:
    # fixed values: weights of the five ratios
    ta = "total_assets"
    parts = [(1.2, F.col("current_assets") - F.col("current_liabilities"), ta), (1.4, F.col("retained_earnings"), ta), (3.3, F.col("operating_income"), ta),
             (0.6, F.col("price") * F.col("shares"), "total_liabilities"), (1.0, F.col("revenue"), ta)]
    total = F.lit(0.0)
    for k, a, b in parts:
        total = total + over_positive(a, b, k, 0.0)
    return df.withColumn("z_score", total)


def relative_intrinsic(df: DataFrame, discount=0.10, terminal=0.03, s: Series = R) -> DataFrame:
    """Share of past reports whose multiple at the current price is not below today's; Gordon and simple DCF price ratios."""
    d = df.withColumns({"_eps": per_share("net_income"), "_fcf": div(F.col("operating_cash_flow") - F.col("capex"), "shares"), "_dps": per_share("dividends")})
    d = d.withColumn("_pe", over_positive("price", "_eps"))
    past = F.collect_list(F.col("_eps")).over(s.run)
    share = F.size(F.filter(past, lambda e: F.try_divide(F.col("price"), F.col("_eps")) <= F.try_divide(F.col("price"), e))) / F.size(past)

    def rate(c):
        base = s.lag(c, 3)
        return F.when((base > 0) & (F.col(c) > 0), F.pow(div(c, base), F.lit(1 / 3)) - 1)
    d = d.withColumns({"_dg": rate("_dps"), "_fg": rate("_fcf"), "pe_percentile": F.when(F.size(past) >= 8, share)})
    gordon = F.col("_dps") * (1 + F.col("_dg")) / F.nullif(discount - F.col("_dg"), F.lit(0.0))
    dcf = F.col("_fcf") * (1 + F.col("_fg")) / (discount - terminal)
    return d.withColumns({"gordon_model_ratio": F.when((F.col("_dg") > 0) & (F.col("_dg") < discount), div("price", gordon)),
                          "dcf_ratio": F.when((F.col("_fg") > 0) & (F.col("_fg") < discount) & (dcf > 0), div("price", dcf))})


def cv(x: str, s: Series, inverse=True) -> Column:
    """1 - std / |mean| of all reports so far (at least four), or std / |mean|."""
    r = div(F.stddev_samp(x).over(s.run), F.abs(F.avg(x).over(s.run)))
    return F.when(F.count(x).over(s.run) >= 4, (1 - r) if inverse else r)


def earnings_quality(df: DataFrame, s: Series = R) -> DataFrame:
    d = df.withColumns({"_g": s.pct("net_income"), "_rg": s.pct("revenue"), "_t": div("revenue", "receivables")})
    ni = F.col("net_income")
    return d.withColumns({"accruals": div(ni - F.col("operating_cash_flow"), F.abs(ni)), "earnings_stability": cv("net_income", s, False),
                          "earnings_growth_consistency": cv("_g", s), "revenue_growth_stability": cv("_rg", s),
                          "ar_turnover_change": s.pct("_t"), "earnings_surprise": div(ni - s.lag(ni), F.abs(s.lag(ni)))})


def strength_trends(df: DataFrame, s: Series = R) -> DataFrame:
    d = with_pos(df, s).withColumns({"_de": div("total_debt", "equity"), "_dr": div("total_liabilities", "total_assets"), "_ic": div("operating_income", "interest_expense"),
                                     "_ard": div("receivables", "revenue") * 365, "_ivd": div("inventory", "cogs") * 365, "_fcf": F.col("operating_cash_flow") - F.col("capex"),
                                     "_og": s.pct("operating_cash_flow")})

    def trend(c):
        return F.when(F.count(c).over(s.run) >= 4, F.regr_slope(F.col(c), F.col("_pos")).over(s.run))
    return d.withColumns({"debt_equity_stability": cv("_de", s), "debt_ratio_trend": trend("_dr"), "ocf_stability": cv("operating_cash_flow", s), "ocf_growth_trend": F.avg("_og").over(s.run),
                          "fcf_stability": cv("_fcf", s), "cash_coverage_ratio": div("operating_cash_flow", F.abs("capex") + F.abs("dividends")), "interest_coverage_trend": trend("_ic"),
                          "working_capital_turnover": div("revenue", F.col("current_assets") - F.col("current_liabilities")), "ar_days_trend": trend("_ard"), "inventory_days_trend": trend("_ivd")})


def selection_quality_value_growth(df: DataFrame, s: Series = R) -> DataFrame:
    d = valuation(profitability(quality(df)), s)
    d = d.withColumns({"_rg4": s.pct("revenue", 4), "_fcf": F.col("operating_cash_flow") - F.col("capex")})

    def inv(c):
        return div(F.lit(1.0), F.col(c) + 1e-8)
    return d.withColumns({
        "roe_stability": -s.std("roe", 4), "gross_margin_trend": s.diff("gross_margin", 4), "net_margin_quality": s.mean("net_margin", 4), "debt_stability": -s.std("debt_to_assets", 4),
        "liquidity_quality": F.col("current_ratio"), "interest_coverage_quality": F.log1p(F.greatest("interest_coverage", F.lit(0.0))),
        "sel_earnings_yield": inv("pe_ratio"), "book_to_market": inv("pb_ratio"), "sales_to_price": inv("ps_ratio"), "cashflow_yield": inv("pcf_ratio"),
        "roe_adjusted_pb": div("roe", F.col("pb_ratio") + 1e-8), "revenue_growth_1y": F.col("_rg4"), "revenue_growth_3y": s.pct("revenue", 12), "earnings_growth_1y": s.pct("net_income", 4),
        "asset_growth_1y": s.pct("total_assets", 4), "growth_stability": -s.std("_rg4", 4), "sel_fcf_stability": -s.std("_fcf", 4)})


def selection_momentum(df: DataFrame, s: Series) -> DataFrame:
    """Blend of four horizons, RSI and MACD momentum."""
    from quantloom.functions.series import span
    from quantloom.operators.technical import gains_losses
    d = s.ewm(df, {"_e12": ("close", span(12), True), "_e26": ("close", span(26), True)})
    d = gains_losses(d, s)
    d = d.withColumns({f"momentum_{k}": s.pct("close", n) for k, n in (("1m", 20), ("3m", 60), ("6m", 120), ("12m", 240))})
    rs = s.mean("_gain", 14) / (s.mean("_loss", 14) + 1e-8)
    return d.withColumns({"momentum_strength": 0.25 * (F.col("momentum_1m") + F.col("momentum_3m") + F.col("momentum_6m") + F.col("momentum_12m")),
                          "rsi_momentum": 100 - 100 / (1 + rs), "macd_momentum": F.col("_e12") - F.col("_e26"), "revision_momentum": s.mean("ret", 20), "rating_momentum": s.diff("volume", 20)})
