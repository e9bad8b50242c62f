"""Queries of cross-sectional, market-state and fundamental factors."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.series import S, div
from quantloom.operators import cross_section as X
from quantloom.operators import fundamental as FU
from quantloom.plans.q_basics import rank_pct
from quantloom.plans.registry import query
from quantloom.plans.sql import Q, Sql, chain, ewm, flag

K = "symbol date"


def rk(c, by="date", kind="min"):
    p = f"PARTITION BY {by}, {c} IS NULL"
    r = f"rank() OVER ({p} ORDER BY {c})"
    if kind == "avg":
        r = f"({r} + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2)"
    return f"CASE WHEN {c} IS NOT NULL THEN {r} / count({c}) OVER (PARTITION BY {by}) END"


RR = {"price_rank": "close", "return_rank": "ret", "volatility_rank": "vol", "volume_rank": "volume", "momentum_rank": "r21", "turnover_rank": "turn", "relative_strength_rank": "rs",
      **{f"return_{n}d_rank": f"r{n}" for n in (5, 10, 21, 63)}}


@query("xs_relative_ranks", K, " ".join(RR), sql=chain("returns", {"vol": Q.std("ret", 21), "turn": "volume / nullif(close, 0)", "rs": "ret - avg(ret) OVER (PARTITION BY date)",
       **{f"r{n}": Q.sum("ret", n) for n in (5, 10, 21, 63)}}, {k: rk(c) for k, c in RR.items()}), tables="returns")
def xs_relative_ranks(t):
    return X.relative_ranks(t.bars())


IND = chain("returns", {"mom": Q.sum("ret", 21), "vol": Q.std("ret", 21)}, "SELECT * FROM {src} JOIN sector USING (symbol) WHERE industry IN (SELECT industry FROM sector GROUP BY 1 HAVING count(*) > 1)",
            {"industry_rank": rk("ret", "date, industry"), "industry_momentum_rank": rk("mom", "date, industry"), "industry_volatility_rank": rk("vol", "date, industry")})


@query("xs_industry_rank", K, "industry_rank industry_momentum_rank industry_volatility_rank", sql=IND, tables="returns sector")
def xs_industry_rank(t):
    return X.industry_ranks(t.closes(), t.sector().select("symbol", "industry"))


@query("xs_industry_relative", K, "industry_relative_return industry_relative_strength",
       sql=chain("returns", {"own": Q.mean("ret", 21, lo=-21, hi=-1)}, "SELECT * FROM {src} JOIN sector USING (symbol)",
                 {"industry_relative_return": "ret - avg(ret) OVER (PARTITION BY date, industry)", "industry_relative_strength": "own - avg(own) OVER (PARTITION BY date, industry)"}), tables="returns sector")
def xs_industry_relative(t):
    return X.industry_relative(t.closes(), t.sector().select("symbol", "industry"))


@query("xs_market_cap", K, "market_cap_rank market_cap_percentile relative_market_cap market_cap_change_rank market_cap_stability_rank",
       sql=chain("bars", {"cap": "close * volume"}, {"chg": Q.pct("cap"), "stab": f"-{Q.std('cap', 21)}", "med": "quantile_cont(cap, 0.5) OVER (PARTITION BY date)"},
                 {"market_cap_rank": rk("cap"), "market_cap_percentile": rk("cap", kind="avg"), "relative_market_cap": "cap / nullif(med, 0)", "market_cap_change_rank": rk("chg"), "market_cap_stability_rank": rk("stab")}), tables="bars")
def xs_market_cap(t):
    return X.market_cap_relative(t.bars().withColumn("cap", F.col("close") * F.col("volume")))


VALD = ("WITH r AS (SELECT symbol AS nk, report_date, lead(report_date) OVER (PARTITION BY symbol ORDER BY report_date) AS nxt, net_income / nullif(shares, 0) AS eps, equity / nullif(shares, 0) AS bvps FROM reports), "
        "v AS (SELECT b.symbol, b.date, b.close / nullif(eps, 0) AS pe, b.close / nullif(bvps, 0) AS pb FROM bars b JOIN supplier s ON s.s_suppkey = b.symbol JOIN r ON r.nk = s.s_nationkey AND b.date >= r.report_date AND (r.nxt IS NULL OR b.date < r.nxt)), "
        "m AS (SELECT *, quantile_cont(pe, 0.5) OVER (PARTITION BY date) AS mpe, quantile_cont(pb, 0.5) OVER (PARTITION BY date) AS mpb FROM v), "
        f"k AS (SELECT *, {rk('pe')} AS pe_rank, {rk('pb')} AS pb_rank FROM m) SELECT *, pe / nullif(mpe, 0) AS relative_pe, pb / nullif(mpb, 0) AS relative_pb, (pe_rank + pb_rank) / 2 AS valuation_composite_rank FROM k")


@query("xs_valuation", K, "pe pb pe_rank pb_rank relative_pe relative_pb valuation_composite_rank", sql=VALD, tables="bars reports", staged=True)
def xs_valuation(t):
    """Every date takes the last report of each nation on or before it (nations x dates rows); bars meet that table by equality."""
    r = t.reports().select(F.col("symbol").alias("nk"), F.col("report_date").alias("date"), div("net_income", "shares").alias("eps"), div("equity", "shares").alias("bvps"))
    days = t.bars().select("date").distinct().crossJoin(F.broadcast(t.read("nation").select(F.col("n_nationkey").cast("long").alias("nk"))))  # the nations: a fixed dimension
    known = days.select("nk", "date", F.lit(None).cast("struct<eps:double,bvps:double>").alias("r"), F.lit(True).alias("_day")).unionByName(r.select("nk", "date", F.struct("eps", "bvps").alias("r"), F.lit(False).alias("_day")))
    upto = Window.partitionBy("nk").orderBy("date").rangeBetween(Window.unboundedPreceding, 0)
    known = known.withColumn("r", F.last("r", ignorenulls=True).over(upto)).where(F.col("_day") & F.col("r").isNotNull()).select("nk", "date", "r.*")
    s = t.read("supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").cast("long").alias("nk"))
    d = t.closes().join(s, "symbol").join(known, ["nk", "date"])
    return X.valuation_relative(d.select("symbol", "date", div("close", "eps").alias("pe"), div("close", "bvps").alias("pb")))


MW = (5, 10, 21, 63, 126, 252)
MOMR = chain("returns", {f"m{n}": Q.sum("ret", n) for n in MW},
             {k: v for n in MW for k, v in {f"momentum_{n}d_rank": rk(f"m{n}"), f"relative_momentum_{n}d": f"m{n} - avg(m{n}) OVER (PARTITION BY date)", f"momentum_{n}d_percentile": rk(f"m{n}", kind="avg")}.items()},
             {"xs": "list_filter([momentum_5d_rank, momentum_10d_rank, momentum_21d_rank], lambda x: x IS NOT NULL)"}, {"momentum_consistency": "CASE WHEN len(xs) >= 2 THEN 1 - list_stddev_pop(xs) END"})


@query("xs_momentum", K, " ".join(f"momentum_{n}d_rank relative_momentum_{n}d momentum_{n}d_percentile" for n in MW) + " momentum_consistency", sql=MOMR, tables="returns")
def xs_momentum(t):
    return X.momentum_relative(t.closes())


QI = Sql("", "date")


def irank(x, n):
    f = QI.frame(-(n - 1))
    a = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {f}"
    return f"(CASE WHEN count({x}) OVER {f} >= {n} AND {x} IS NOT NULL THEN (len(list_filter({a}, lambda z_: z_ < {x})) + (len(list_filter({a}, lambda z_: z_ = {x})) + 1) / 2.0::DOUBLE) / {n} END)"


@query("state_bull_bear", "date", "momentum_state bull_bear_strength", "trend_state",
       sql=chain("market_returns", {"sh": QI.mean("mret", 25), "lg": QI.mean("mret", 50), "mom": QI.sum("mret", 21), "r63": QI.sum("mret", 63), "sd": QI.std("mret", 63)}, {"p": irank("mom", 252)},
                 {"trend_state": flag("sh > lg"), "bull_bear_strength": "coalesce(r63 / nullif(sd, 0), 0)", "lo": "min(p) OVER ()", "hi": "max(p) OVER ()"},
                 {"momentum_state": "CASE WHEN p IS NOT NULL THEN least(greatest(ceil((p - lo) / nullif((hi - lo) / 5, 0)) - 1, 0), 4) END"}), tables="market_returns")
def state_bull_bear(t):
    return X.bull_bear(t.market_returns())


@query("state_breadth", "date", "up_stock_ratio market_breadth new_high_low_ratio",
       sql=chain("returns", {"full_": f"count(close) OVER {Q.frame(-252)} > 252", "mx": f"max(close) OVER {Q.frame(-252)}", "mn": f"min(close) OVER {Q.frame(-252)}"},
                 final="SELECT date, count(*) FILTER (WHERE ret > 0) / count(*) AS up_stock_ratio, (count(*) FILTER (WHERE ret > 0) - count(*) FILTER (WHERE ret < 0)) / count(*) AS market_breadth, "
                       "count(*) FILTER (WHERE full_ AND close = mx) / (count(*) FILTER (WHERE full_ AND close = mn) + 1e-6::DOUBLE) AS new_high_low_ratio FROM {src} GROUP BY date"), tables="returns")
def state_breadth(t):
    return X.breadth(t.closes())


@query("state_volatility", K, "volatility_clustering relative_volatility_state", "volatility_state volatility_breakout volatility_trend_state",
       sql=chain("returns", {"v": Q.std("ret", 21)}, {"vv": Q.std("v", 21), "p": rank_pct("v", 252), "rel": "v / nullif(quantile_cont(v, 0.5) OVER (PARTITION BY date), 0)"},
                 {"volatility_clustering": f"coalesce({rank_pct('vv', 252)}, 0.5)", "relative_volatility_state": f"coalesce({rank_pct('rel', 252)}, 0.5)", "volatility_state": "CASE WHEN p <= 0.33 THEN 0 WHEN p > 0.67 THEN 2 ELSE 1 END",
                  "volatility_breakout": flag(f"v > {Q.mean('v', 63)} + 2 * {Q.std('v', 63)}"), "volatility_trend_state": flag(f"{Q.mean('v', 21)} > {Q.mean('v', 42)}")}), tables="returns")
def state_volatility(t):
    return X.volatility_state(t.closes())


@query("state_liquidity", K, "liquidity_state liquidity_risk_state market_depth_state", "liquidity_shock_state",
       sql=chain("returns", {"liq": "1 / (abs(ret) / (volume + 1e-6::DOUBLE) + 1e-6::DOUBLE)", "vv": f"round({Q.std('volume', 21)}, 9)", "dep": f"volume / ({Q.max('close', 5)} - {Q.min('close', 5)} + 1e-6::DOUBLE)"},
                 {"liquidity_state": f"coalesce({rank_pct('liq', 252)}, 0.5)", "liquidity_risk_state": f"coalesce({rank_pct('vv', 252)}, 0.5)", "market_depth_state": f"coalesce({rank_pct('dep', 252)}, 0.5)",
                  "liquidity_shock_state": flag(f"volume > {Q.mean('volume', 21)} + 2 * {Q.std('volume', 21)}")}), tables="returns")
def state_liquidity(t):
    return X.liquidity_state(t.bars())


# the check side enumerates all pairs of the sample; the job itself never does
def aligned(src, window, ahead, group=""):
    """Pair enumeration on a common calendar: scaled series inside each window, pairs joined on the window and the date."""
    g = f", a.{group}" if group else ""
    same = f" AND a.{group} = b.{group}" if group else ""
    k = f"PARTITION BY date{', ' + group if group else ''}"
    return (f"WITH v AS (SELECT *, dense_rank() OVER (ORDER BY date) AS p FROM {src}), "
            f"z AS (SELECT a.symbol, a.date{g}, b.p, count(*) OVER w AS n, (b.ret - avg(b.ret) OVER w) / nullif(stddev_samp(b.ret) OVER w, 0) / sqrt(count(*) OVER w - 1) AS u "
            f"FROM v a JOIN v b ON a.symbol = b.symbol AND b.p BETWEEN a.p - {window - 1 + ahead} AND a.p - {ahead} WINDOW w AS (PARTITION BY a.symbol, a.date)), "
            f"y AS (SELECT * FROM z WHERE 2 * n > {window} AND u IS NOT NULL), m AS (SELECT *, count(*) OVER ({k}) AS k FROM (SELECT DISTINCT symbol, date{', ' + group if group else ''} FROM y)), "
            f"c AS (SELECT a.symbol, a.date, sum(a.u * b.u) AS c FROM y a JOIN y b ON a.date = b.date AND a.p = b.p{same} AND a.symbol <> b.symbol GROUP BY 1, 2) "
            "SELECT symbol, date, CASE WHEN k > 1 THEN coalesce(c, 0) / (k - 1) END AS mean_corr FROM m LEFT JOIN c USING (symbol, date)")


MC = aligned("(SELECT * FROM returns WHERE ret IS NOT NULL)", 21, 1)


RS_ = (f"WITH mc AS ({MC}), r0 AS (SELECT a.*, mc.mean_corr FROM returns_market a LEFT JOIN mc USING (symbol, date)), "
       f"r1 AS (SELECT *, CASE WHEN ret < 0 THEN ret ELSE 0.0 END AS dn, CASE WHEN count(CASE WHEN ret IS NOT NULL AND mret IS NOT NULL THEN 1 END) OVER {Q.frame(-63, -1)} > 10 THEN covar_samp(ret, mret) OVER {Q.frame(-63, -1)} / "
       f"nullif(var_pop(CASE WHEN ret IS NOT NULL THEN mret END) OVER {Q.frame(-63, -1)}, 0) END AS b, {Q.quantile('ret', 63, 0.05)} AS q FROM r0), r2 AS (SELECT *, {Q.std('dn', 63)} AS dd FROM r1) SELECT symbol, date, " +
       ", ".join(f"coalesce({rank_pct(c, 252)}, 0.5) AS {k}" for k, c in (("systematic_risk_state", "b"), ("tail_risk_state", "q"), ("downside_risk_state", "dd"), ("contagion_risk_state", "mean_corr"))) + " FROM r2")


@query("state_risk", K, "systematic_risk_state tail_risk_state downside_risk_state contagion_risk_state", sql=RS_, tables="returns_market", staged=True)
def state_risk(t):
    return X.risk_state(t.returns_with_market())


# --- fundamentals -----------------------------------------------------------------------------
RK = "symbol report_date"
QR = Sql("symbol", "report_date")


def pos(a, b, m=1, d=None):
    return f"CASE WHEN ({b}) > 0 THEN ({a}) / ({b}) * {m} {'ELSE ' + str(d) if d is not None else ''} END"


VAL_STEPS = ({"eps": "net_income / shares", "ev": "price * shares + total_debt - cash", "fcf": "operating_cash_flow - capex"},
             {"pe_ratio": pos("price", "eps"), "pb_ratio": pos("price", "equity / shares"), "ps_ratio": pos("price", "revenue / shares"), "pcf_ratio": pos("price", "operating_cash_flow / shares"),
              "ev_ebitda": pos("ev", "ebitda"), "ev_sales": pos("ev", "revenue"), "g": QR.pct("eps", 4)},
             {"peg_ratio": pos("pe_ratio", "g * 100"), "dividend_yield": pos("dividends / shares", "price", 100, 0), "fcf_yield": pos("fcf / shares", "price", 100, 0), "earnings_yield": "coalesce(" + pos("1.0::DOUBLE", "pe_ratio", 100) + ", 0)"})


@query("fund_valuation", RK, "pe_ratio pb_ratio ps_ratio pcf_ratio ev_ebitda ev_sales peg_ratio dividend_yield fcf_yield earnings_yield", sql=chain("reports", *VAL_STEPS), tables="reports")
def fund_valuation(t):
    return FU.valuation(t.reports())


PROF = {"roe": pos("net_income", "equity", 100, 0), "roa": pos("net_income", "total_assets", 100, 0), "roic": pos("operating_income", "equity + total_debt", 100, 0), "gross_margin": pos("gross_profit", "revenue", 100, 0),
        "operating_margin": pos("operating_income", "revenue", 100, 0), "net_margin": pos("net_income", "revenue", 100, 0), "ebitda_margin": pos("ebitda", "revenue", 100, 0),
        "asset_turnover": pos("revenue", "total_assets", 1, 0), "equity_multiplier": pos("total_assets", "equity", 1, 0)}


@query("fund_profitability", RK, " ".join(PROF), sql=chain("reports", PROF), tables="reports")
def fund_profitability(t):
    return FU.profitability(t.reports())


@query("fund_growth", RK, " ".join(FU.GROWTH),
       sql=chain("reports", {f"b_{c}": QR.lag(c, 4) for c in FU.GROWTH.values()}, {k: f"CASE WHEN b_{c} > 0 THEN (CASE WHEN {c} >= 0 THEN (pow({c} / b_{c}, 0.25::DOUBLE) - 1) * 100 END) WHEN b_{c} IS NOT NULL THEN 0 END" for k, c in FU.GROWTH.items()}), tables="reports")
def fund_growth(t):
    return FU.growth(t.reports())


QUAL = {"debt_to_assets": pos("total_liabilities", "total_assets", 100, 0), "debt_to_equity": pos("total_debt", "equity", 100, 0), "current_ratio": pos("current_assets", "current_liabilities", 1, 0),
        "quick_ratio": pos("current_assets - inventory", "current_liabilities", 1, 0), "cash_ratio": pos("cash", "current_liabilities", 1, 0), "interest_coverage": pos("operating_income", "interest_expense", 1, 0),
        "inventory_turnover": pos("cogs", "inventory", 1, 0), "receivables_turnover": pos("revenue", "receivables", 1, 0), "payables_turnover": pos("cogs", "current_liabilities", 1, 0),
        "cash_flow_quality": pos("operating_cash_flow", "net_income", 1, 0), "accruals_ratio": pos("net_income - operating_cash_flow", "total_assets", 100, 0)}


@query("fund_quality", RK, " ".join(QUAL) + " cash_conversion_cycle",
       sql=chain("reports", QUAL, {"cash_conversion_cycle": "CASE WHEN inventory_turnover > 0 AND receivables_turnover > 0 AND payables_turnover > 0 THEN 365 / inventory_turnover + 365 / receivables_turnover - 365 / payables_turnover ELSE 0 END"}), tables="reports")
def fund_quality(t):
    return FU.quality(t.reports())


LEV = {"financial_leverage": pos("total_assets", "equity", 1, 0), "long_term_debt_ratio": pos("total_debt", "total_assets", 100, 0), "debt_to_capital": pos("total_debt", "total_debt + equity", 100, 0),
       "net_debt_to_ebitda": pos("total_debt - cash", "ebitda", 1, 0), "fixed_asset_turnover": pos("revenue", "total_assets - current_assets", 1, 0), "working_capital_turnover": pos("revenue", "current_assets - current_liabilities", 1, 0)}


@query("fund_leverage_efficiency", RK, " ".join(LEV), sql=chain("reports", LEV), tables="reports")
def fund_leverage_efficiency(t):
    return FU.leverage_efficiency(t.reports())


@query("fund_piotroski", RK, "", "f_score",
       sql=chain("reports", {"roa": "net_income / nullif(total_assets, 0)", "cr": "current_assets / nullif(current_liabilities, 0)", "gm": "gross_profit / nullif(revenue, 0)", "at_": "revenue / nullif(total_assets, 0)"},
                 {"f_score": " + ".join(flag(c) for c in ("net_income > 0", "operating_cash_flow > 0", f"roa > {QR.lag('roa')}", "operating_cash_flow > net_income", f"total_debt < {QR.lag('total_debt')}", f"cr > {QR.lag('cr')}",
                                                          f"shares <= {QR.lag('shares')}", f"gm > {QR.lag('gm')}", f"at_ > {QR.lag('at_')}"))}), tables="reports")
def fund_piotroski(t):
    return FU.piotroski(t.reports())


@query("fund_altman_z", RK, "z_score", sql=chain("reports", {"z_score": " + ".join("(" + x + ")" for x in (pos("current_assets - current_liabilities", "total_assets", 1.2, 0), pos("retained_earnings", "total_assets", 1.4, 0), pos("operating_income", "total_assets", 3.3, 0),
       pos("price * shares", "total_liabilities", 0.6, 0), pos("revenue", "total_assets", 1, 0)))}), tables="reports")
def fund_altman_z(t):
    return FU.altman_z(t.reports())


def rate(c):
    return f"CASE WHEN {QR.lag(c, 3)} > 0 AND {c} > 0 THEN pow({c} / {QR.lag(c, 3)}, (1.0::DOUBLE / 3)) - 1 END"


@query("fund_relative_intrinsic", RK, "pe_percentile gordon_model_ratio dcf_ratio",
       sql=chain("reports", {"eps": "net_income / nullif(shares, 0)", "fcf": "(operating_cash_flow - capex) / nullif(shares, 0)", "dps": "dividends / nullif(shares, 0)"},
                 {"past": f"list(eps) OVER {QR.frame(None, 0)}", "dg": rate("dps"), "fg": rate("fcf")},
                 {"pe_percentile": "CASE WHEN len(past) >= 8 THEN len(list_filter(past, lambda e: price / nullif(eps, 0) <= price / nullif(e, 0))) / len(past) END",
                  "gordon_model_ratio": "CASE WHEN dg > 0 AND dg < 0.1 THEN price / nullif(dps * (1 + dg) / (0.1::DOUBLE - dg), 0) END",
                  "dcf_ratio": "CASE WHEN fg > 0 AND fg < 0.1 AND fcf > 0 THEN price / nullif(fcf * (1 + fg) / (0.1::DOUBLE - 0.03::DOUBLE), 0) END"}), tables="reports")
def fund_relative_intrinsic(t):
    return FU.relative_intrinsic(t.reports())


def cv(c, inv=True):
    f = QR.frame(None, 0)
    r = f"stddev_samp({c}) OVER {f} / nullif(abs(avg({c}) OVER {f}), 0)"
    return f"CASE WHEN count({c}) OVER {f} >= 4 THEN {'1 - ' if inv else ''}{r} END"


def trend(c):
    f = QR.frame(None, 0)
    return f"CASE WHEN count({c}) OVER {f} >= 4 THEN regr_slope({c}, k) OVER {f} END"


@query("fund_earnings_quality", RK, "accruals earnings_stability earnings_growth_consistency revenue_growth_stability ar_turnover_change earnings_surprise",
       sql=chain("reports", {"g": QR.pct("net_income"), "rg": QR.pct("revenue"), "tt": "revenue / nullif(receivables, 0)"},
                 {"accruals": "(net_income - operating_cash_flow) / nullif(abs(net_income), 0)", "earnings_stability": cv("net_income", False), "earnings_growth_consistency": cv("g"), "revenue_growth_stability": cv("rg"),
                  "ar_turnover_change": QR.pct("tt"), "earnings_surprise": f"{QR.diff('net_income')} / nullif(abs({QR.lag('net_income')}), 0)"}), tables="reports")
def fund_earnings_quality(t):
    return FU.earnings_quality(t.reports())


ST = {"debt_equity_stability": cv("de"), "debt_ratio_trend": trend("dr"), "ocf_stability": cv("operating_cash_flow"), "ocf_growth_trend": f"avg(og) OVER {QR.frame(None, 0)}", "fcf_stability": cv("fcf"),
      "cash_coverage_ratio": "operating_cash_flow / nullif(abs(capex) + abs(dividends), 0)", "interest_coverage_trend": trend("ic"), "working_capital_turnover": "revenue / nullif(current_assets - current_liabilities, 0)",
      "ar_days_trend": trend("ard"), "inventory_days_trend": trend("ivd")}


@query("fund_strength_trends", RK, " ".join(ST),
       sql=chain("reports", {"k": QR.pos(), "de": "total_debt / nullif(equity, 0)", "dr": "total_liabilities / nullif(total_assets, 0)", "ic": "operating_income / nullif(interest_expense, 0)", "ard": "receivables / nullif(revenue, 0) * 365",
                             "ivd": "inventory / nullif(cogs, 0) * 365", "fcf": "operating_cash_flow - capex", "og": QR.pct("operating_cash_flow")}, ST), tables="reports")
def fund_strength_trends(t):
    return FU.strength_trends(t.reports())


SEL = {"roe_stability": f"-{QR.std('roe', 4)}", "gross_margin_trend": QR.diff("gross_margin", 4), "net_margin_quality": QR.mean("net_margin", 4), "debt_stability": f"-{QR.std('debt_to_assets', 4)}", "liquidity_quality": "current_ratio",
       "interest_coverage_quality": "ln(1 + greatest(interest_coverage, 0))", **{k: f"1 / nullif({c} + 1e-8::DOUBLE, 0)" for k, c in (("sel_earnings_yield", "pe_ratio"), ("book_to_market", "pb_ratio"), ("sales_to_price", "ps_ratio"), ("cashflow_yield", "pcf_ratio"))},
       "roe_adjusted_pb": "roe / nullif(pb_ratio + 1e-8::DOUBLE, 0)", "revenue_growth_1y": "rg4", "revenue_growth_3y": QR.pct("revenue", 12), "earnings_growth_1y": QR.pct("net_income", 4), "asset_growth_1y": QR.pct("total_assets", 4),
       "growth_stability": f"-{QR.std('rg4', 4)}", "sel_fcf_stability": f"-{QR.std('fcf', 4)}"}


@query("sel_quality_value_growth", RK, " ".join(SEL), sql=chain("reports", QUAL, PROF, *VAL_STEPS, {"rg4": QR.pct("revenue", 4)}, SEL), tables="reports")
def sel_quality_value_growth(t):
    return FU.selection_quality_value_growth(t.reports())


@query("sel_momentum", K, "momentum_1m momentum_3m momentum_6m momentum_12m momentum_strength rsi_momentum macd_momentum revision_momentum rating_momentum",
       sql=chain("returns", {"d": Q.diff("close"), **{f"momentum_{k}": Q.pct("close", n) for k, n in (("1m", 20), ("3m", 60), ("6m", 120), ("12m", 240))}}, {"g": "CASE WHEN d > 0 THEN d ELSE 0.0 END", "l": "CASE WHEN d < 0 THEN -d ELSE 0.0 END"},
                 ewm("{src}", "close", "e12", 2 / 13, True), ewm("{src}", "close", "e26", 2 / 27, True),
                 {"momentum_strength": "0.25 * (momentum_1m + momentum_3m + momentum_6m + momentum_12m)", "rsi_momentum": f"100 - 100 / (1 + {Q.mean('g', 14)} / ({Q.mean('l', 14)} + 1e-8::DOUBLE))", "macd_momentum": "e12 - e26",
                  "revision_momentum": Q.mean("ret", 20), "rating_momentum": Q.diff("volume", 20)}), tables="returns")
def sel_momentum(t):
    """Return and volume stand in for the revision and rating series, which the tables lack."""
    return FU.selection_momentum(t.returns(), S)
