"""Risk factors, risk metrics and portfolio risk.

Portfolio variance and contributions use the identities w'Cw = var(r_p) and (Cw)_i = cov(r_i, r_p):
one weighted sum by date replaces the symbol x symbol matrix.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.draws import unit, with_draw
from quantloom.functions.exact import with_group_stats
from quantloom.functions.series import S, Series, div, flag, ladder, with_pos
from quantloom.operators.relational import g1, g2, top_n

YEAR = math.sqrt(252)
# fixed values: standard normal quantiles at 1, 5 and 10 %, and the 5 % and 1 % quantiles of t(6)
Z = {1: -2.3263478740408408, 5: -1.6448536269514729, 10: -1.2815515655446004}
T6 = {1: -3.142668403290986, 5: -1.9431802805153022}

# fixed values: stress scenarios (factor shocks and probability)
SCENARIOS = {
    "2008_Financial_Crisis": (0.01, {"market": -0.40, "size": -0.20, "value": 0.10, "momentum": -0.15, "quality": 0.05, "volatility": 0.30}),
    "COVID_2020": (0.005, {"market": -0.35, "growth": 0.15, "tech": 0.20, "energy": -0.50, "travel": -0.60, "healthcare": 0.10}),
    "Interest_Rate_Rise": (0.10, {"market": -0.15, "duration": -0.25, "growth": -0.20, "value": 0.10, "financials": 0.15, "utilities": -0.15, "reits": -0.20}),
    "Inflation_Rise": (0.15, {"market": -0.10, "commodities": 0.30, "energy": 0.25, "materials": 0.20, "tech": -0.15, "bonds": -0.20, "reits": 0.10}),
}


def daily_returns(df: DataFrame, s: Series = S) -> DataFrame:
    return df.withColumn("ret", s.pct("close"))


def volatility(df: DataFrame, window=20, s: Series = S) -> DataFrame:
    return daily_returns(df, s).withColumn("volatility", s.std("ret", window) * YEAR)


def drawdown(df: DataFrame, s: Series = S) -> DataFrame:
    d = daily_returns(df, s).withColumn("equity", s.cumprod(1 + F.coalesce("ret", F.lit(0.0))))
    return d.withColumn("drawdown", div("equity", s.cummax("equity")) - 1)


def rolling_var(df: DataFrame, window=252, alpha=0.05, annualize=True, s: Series = S) -> DataFrame:
    return daily_returns(df, s).withColumn("var", -s.quantile("ret", window, alpha) * (YEAR if annualize else 1.0))


def series_moments(df: DataFrame, ret="ret", by=("symbol",)) -> DataFrame:
    r = F.col(ret)
    return df.groupBy(*by).agg(F.avg(r).alias("mu"), F.stddev_samp(r).alias("sd"), g1(r).alias("skew"), g2(r).alias("kurt"), F.count(r).alias("n"))


def historical_var(levels=(1, 5, 10), ret="ret") -> Column:
    """Exact quantiles of one calendar-bounded series."""
    return F.percentile(F.col(ret), [p / 100 for p in levels])


def var_table(df: DataFrame, levels=(1, 5, 10), ret="ret", by=("symbol",)) -> DataFrame:
    m = series_moments(df, ret, by).join(df.groupBy(*by).agg(historical_var(levels, ret).alias("_q")), list(by))
    cols = {}
    for i, p in enumerate(levels):
        z = Z[p]
        cf = (F.lit(z) + (z * z - 1) * F.col("skew") / 6 + (z ** 3 - 3 * z) * F.col("kurt") / 24
              - (2 * z ** 3 - 5 * z) * F.col("skew") * F.col("skew") / 36)
        cols.update({f"hist_var_{p}": F.col("_q")[i], f"param_var_{p}": F.col("mu") + z * F.col("sd"), f"modified_var_{p}": F.col("mu") + cf * F.col("sd")})
    return m.withColumns(cols).drop("_q")


def cvar_table(df: DataFrame, levels=(1, 5, 10), ret="ret", by=("symbol",)) -> DataFrame:
    q = df.groupBy(*by).agg(historical_var(levels, ret).alias("_q"), F.avg(ret).alias("mu"), F.stddev_samp(ret).alias("sd"))
    j = df.select(*by, ret).join(q, list(by))
    agg = [F.avg(F.when(F.col(ret) <= F.col("_q")[i], F.col(ret))).alias(f"hist_cvar_{p}") for i, p in enumerate(levels)]
    out = j.groupBy(*by).agg(*agg, F.first("mu").alias("mu"), F.first("sd").alias("sd"))
    dens = {p: math.exp(-Z[p] ** 2 / 2) / math.sqrt(2 * math.pi) / (p / 100) for p in levels}
    return out.withColumns({f"param_cvar_{p}": F.col("mu") - F.col("sd") * dens[p] for p in levels})


def monte_carlo_var(df: DataFrame, levels=(1, 5, 10), draws=10000, seed=7, ret="ret", by=("symbol",)) -> DataFrame:
    """Normal simulation.  The draws come from (seed, draw) alone, so they do not depend on the
    partitioning; mean + sd * z is monotone in z, so one simulated z distribution serves all series."""
    z = df.sparkSession.range(draws)
    for name, part in (("_u", 1), ("_v", 2)):
        z = with_draw(z, name, seed, [F.lit(part), F.col("id")])
    z = z.select((F.sqrt(-2 * F.log(unit("_u"))) * F.cos(2 * math.pi * unit("_v"))).alias("z"))
    q = z.agg(F.percentile("z", [p / 100 for p in levels]).alias("_z"))
    m = df.groupBy(*by).agg(F.avg(ret).alias("mu"), F.stddev_samp(ret).alias("sd"))
    m = m.crossJoin(F.broadcast(q))  # one row
    return m.select(*by, *[(F.col("mu") + F.col("sd") * F.col("_z")[i]).alias(f"mc_var_{p}") for i, p in enumerate(levels)])


def ewma_garch(df: DataFrame, lam=0.94, omega=0.01, alpha=0.1, beta=0.8, ret="ret", s: Series = S) -> DataFrame:
    """Last EWMA volatility and fixed-parameter GARCH(1,1) volatility, both as closed weighted sums."""
    d = with_pos(df.where(F.col(ret).isNotNull()), s)
    d = d.withColumns({"_n": F.count(F.lit(1)).over(s.whole)})
    age, r2 = F.col("_n") - F.col("_pos"), F.col(ret) * F.col(ret)
    w = F.pow(F.lit(lam), age)
    gw = F.when(age >= 1, F.pow(F.lit(beta), age - 1))
    g = d.groupBy(*s.by).agg(div(F.sum(w * r2), F.sum(w)).alias("_e"), F.sum(gw * (omega + alpha * r2)).alias("_g"),
                             F.var_pop(ret).alias("_v0"), F.first("_n").alias("_n"))
    var = F.coalesce("_g", F.lit(0.0)) + F.pow(F.lit(beta), F.col("_n") - 1) * F.col("_v0")
    return g.withColumns({"ewma_vol": F.sqrt("_e") * YEAR, "garch_vol": F.sqrt(var) * YEAR}).drop("_e", "_g", "_v0", "_n")


def drawdown_table(df: DataFrame, price="close", s: Series = S) -> DataFrame:
    """Largest drawdown with peak and trough dates, current drawdown and its length in rows."""
    o = s.order[0]
    d = with_pos(df.withColumn("_peak", s.cummax(price)), s)
    before = F.max(price).over(s.frame(-10 ** 9, -1))
    d = d.withColumn("_new", F.when(before.isNull() | (F.col(price) > before), F.col(o)))
    d = d.withColumns({"_pd": F.max("_new").over(s.run), "_dd": div(F.col(price) - F.col("_peak"), "_peak"),
                       "_up": F.max(F.when(F.col(price) >= F.col("_peak"), F.col("_pos"))).over(s.run)})
    worst = F.min(F.struct("_dd", F.col(o).alias("t"), "_pd"))
    last = F.max_by(F.struct(price, (F.col("_pos") - F.col("_up")).alias("len")), o)
    g = d.groupBy(*s.by).agg(worst.alias("_w"), last.alias("_l"), F.max(price).alias("_m"))
    return g.select(*s.by, F.abs("_w._dd").alias("max_drawdown"), F.col("_w._pd").alias("peak_date"), F.col("_w.t").alias("trough_date"),
                    div(F.col("_m") - F.col(f"_l.{price}"), "_m").alias("current_drawdown"), F.col("_l.len").alias("duration"))


def ratio_columns(rf=0.02, ret="ret") -> dict:
    r = F.col(ret)
    ex = F.avg(r) * 252 - rf
    return {"sharpe": F.coalesce(div(ex, F.stddev_samp(r) * YEAR), F.lit(0.0)),
            "sortino": F.coalesce(div(ex, F.stddev_samp(F.when(r < 0, r)) * YEAR), F.lit(0.0)), "annual_return": F.avg(r) * 252}


def ratios(df: DataFrame, rf=0.02, ret="ret", price="close", s: Series = S) -> DataFrame:
    g = df.groupBy(*s.by).agg(*[c.alias(k) for k, c in ratio_columns(rf, ret).items()])
    return g.join(drawdown_table(df, price, s).select(*s.by, "max_drawdown"), list(s.by)).withColumn(
        "calmar", F.coalesce(div("annual_return", "max_drawdown"), F.lit(0.0)))


def beta_market(df: DataFrame, ret="ret", market="mret", by=("symbol",)) -> DataFrame:
    ok = F.col(ret).isNotNull() & F.col(market).isNotNull()
    return df.where(ok).groupBy(*by).agg(F.coalesce(div(F.covar_samp(ret, market), F.var_samp(market)), F.lit(1.0)).alias("beta"))


def comprehensive(df: DataFrame, rf=0.02, s: Series = S) -> DataFrame:
    """All metrics of a series as long rows (metric, value, level, method)."""
    by = list(s.by)
    w = (var_table(df).join(cvar_table(df).drop("mu", "sd"), by).join(ewma_garch(df, s=s), by).join(ratios(df, rf, s=s), by)
         .join(drawdown_table(df, s=s).select(*by, "current_drawdown"), by).join(beta_market(df), by))
    rows = []
    for p in (1, 5, 10):
        rows += [("Historical VaR", f"hist_var_{p}", p, "Historical"), ("Parametric VaR", f"param_var_{p}", p, "Normal"),
                 ("Modified VaR", f"modified_var_{p}", p, "Cornish-Fisher"), ("CVaR", f"hist_cvar_{p}", p, "Historical")]
    w = w.withColumn("vol", F.col("sd") * YEAR)
    rows += [("Volatility", "vol", 0, "Simple"), ("EWMA Volatility", "ewma_vol", 0, "EWMA"), ("Maximum Drawdown", "max_drawdown", 0, "Historical"),
             ("Current Drawdown", "current_drawdown", 0, "Current"), ("Sharpe", "sharpe", 0, "Standard"), ("Sortino", "sortino", 0, "Downside"),
             ("Calmar", "calmar", 0, "Return/Drawdown"), ("Beta", "beta", 0, "Regression")]
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(c).alias("value"), F.lit(p).alias("level"), F.lit(k).alias("method")) for m, c, p, k in rows])
    return w.select(*by, F.explode(arr).alias("_m")).select(*by, "_m.*")


# --- portfolios ------------------------------------------------------------------------------
def portfolio_returns(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """(portfolio, date, pret): weighted sum of the members' returns, missing ones count 0."""
    return (weights.join(returns.where(F.col("ret").isNotNull()).select("symbol", "date", "ret"), "symbol")
            .groupBy("portfolio", "date").agg(F.sum(F.col("weight") * F.col("ret")).alias("pret")))


P = Series(("portfolio",), ("date",))


def portfolio_var(pr: DataFrame, lookback=252, horizon=10) -> DataFrame:
    """Historical VaR and CVaR over the last rows, scaled by the root of the horizon."""
    d = with_pos(pr, P).withColumn("_n", F.count(F.lit(1)).over(P.whole)).where(F.col("_pos") > F.col("_n") - lookback)
    q = d.groupBy("portfolio").agg(F.percentile("pret", [0.05, 0.01]).alias("_q"))
    j = d.join(q, "portfolio").groupBy("portfolio").agg(
        F.first("_q").alias("_q"), F.avg(F.when(F.col("pret") <= F.col("_q")[0], F.col("pret"))).alias("_c"), F.stddev_samp("pret").alias("_s"))
    return j.select("portfolio", (-F.col("_q")[0]).alias("var_5"), (-F.col("_q")[1]).alias("var_1"), (-F.col("_c")).alias("cvar_5"),
                    (-F.col("_q")[0] * math.sqrt(horizon)).alias("var_5_h"), (F.col("_s") * YEAR).alias("volatility"))


def portfolio_parametric(pr: DataFrame) -> DataFrame:
    """w'Cw as the variance of the portfolio return, annualised; normal and t(6) VaR."""
    g = pr.groupBy("portfolio").agg((F.var_samp("pret") * 252).alias("variance"))
    sd = F.sqrt("variance")
    return g.withColumns({"volatility": sd, "var_normal_5": -Z[5] * sd, "var_normal_1": -Z[1] * sd, "var_t_5": -T6[5] * sd, "var_t_1": -T6[1] * sd})


def risk_contributions(weights: DataFrame, returns: DataFrame) -> DataFrame:
    """Marginal (Cw)_i / sigma and component w_i (Cw)_i / sigma contributions, annualised."""
    pr = portfolio_returns(weights, returns)
    sigma = pr.groupBy("portfolio").agg(F.stddev_samp("pret").alias("_s"), F.avg("pret").alias("_m"), F.count(F.lit(1)).alias("_n"))
    j = (weights.join(returns.where(F.col("ret").isNotNull()).select("symbol", "date", "ret"), "symbol").join(pr, ["portfolio", "date"]))
    # absent returns count 0, so sums over the present rows and the portfolio's own date count give the covariance
    g = j.groupBy("portfolio", "symbol").agg(F.first("weight").alias("weight"), F.sum(F.col("ret") * F.col("pret")).alias("_xy"), F.sum("ret").alias("_x"))
    g = g.join(sigma, "portfolio")
    cov = div(F.col("_xy") - F.col("_x") * F.col("_m"), F.col("_n") - 1)
    return g.select("portfolio", "symbol", "weight", (div(cov, "_s") * YEAR).alias("marginal"), (F.col("weight") * div(cov, "_s") * YEAR).alias("component"))


def scenario_rows(spark) -> DataFrame:
    rows = [(n, p, f, s) for n, (p, shocks) in SCENARIOS.items() for f, s in shocks.items()]
    return spark.createDataFrame(rows, "scenario string, probability double, factor string, shock double")


def stress_test(weights: DataFrame, exposures: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Portfolio impact by scenario and factor; scenarios are a fixed short list."""
    return (weights.join(exposures, "symbol").groupBy("portfolio", "factor").agg(F.sum(F.col("weight") * F.col("exposure")).alias("exposure"))
            .join(F.broadcast(scenarios), "factor")
            .withColumn("contribution", F.col("exposure") * F.col("shock")).groupBy("portfolio", "scenario", "probability")
            .agg(F.sum("contribution").alias("impact"), F.max("contribution").alias("best_factor"), F.min("contribution").alias("worst_factor"),
                 F.count(F.lit(1)).alias("n_factors")))


def factor_attribution(weights: DataFrame, exposures: DataFrame, factor_cov: DataFrame, specific: DataFrame) -> DataFrame:
    """Variance share of each factor pair (a <= b) and of specific risk."""
    pe = weights.join(exposures, "symbol").groupBy("portfolio", "factor").agg(F.sum(F.col("weight") * F.col("exposure")).alias("x"))
    a = pe.select("portfolio", F.col("factor").alias("a"), F.col("x").alias("xa"))
    b = pe.select("portfolio", F.col("factor").alias("b"), F.col("x").alias("xb"))
    fac = a.join(factor_cov, "a").join(b, ["portfolio", "b"]).withColumn(
        "contribution", F.when(F.col("a") == F.col("b"), 1.0).otherwise(2.0) * F.col("xa") * F.col("xb") * F.col("cov"))
    fac = fac.select("portfolio", F.concat_ws("_", "a", F.when(F.col("a") != F.col("b"), F.col("b"))).alias("source"), "contribution")
    sp = weights.join(specific, "symbol").groupBy("portfolio").agg(
        F.sum(F.col("weight") ** 2 * F.col("specific") ** 2).alias("contribution")).select("portfolio", F.lit("specific").alias("source"), "contribution")
    allr = fac.unionByName(sp)
    return with_group_stats(allr, ["portfolio"], {"_t": F.sum("contribution")}).withColumn("share", div("contribution", "_t") * 100).drop("_t")


def exposure_metrics(pos: DataFrame, capital: float = 100000.0) -> DataFrame:
    v = F.col("market_value")
    a = F.abs(v)
    g = pos.groupBy("portfolio").agg(
        F.sum(F.when(v > 0, v).otherwise(0.0)).alias("long_exposure"), F.sum(F.when(v < 0, -v).otherwise(0.0)).alias("short_exposure"),
        F.sum(v).alias("net_exposure"), F.sum(a).alias("gross_exposure"), F.max(a).alias("largest_position"), F.sum(a * a).alias("_ss"), F.count(F.lit(1)).alias("n"))
    t5 = top_n(pos.withColumn("_a", a), "_a", 5, ["portfolio"], ["symbol"]).groupBy("portfolio").agg(F.sum("_a").alias("_t5"))
    g = g.join(t5, "portfolio")
    return g.withColumns({"leverage": F.col("gross_exposure") / capital, "top5_share": div("_t5", "gross_exposure"),
                          "hhi": div("_ss", F.col("gross_exposure") * F.col("gross_exposure")), "largest_share": div("largest_position", "gross_exposure")}).drop("_ss", "_t5")


# fixed values: limit, warning share
LIMITS = {"leverage": 0.4, "largest_share": 0.35, "hhi": 0.3, "top5_share": 0.95}


def limit_check(metrics: DataFrame, limits: dict | None = None, key="portfolio") -> DataFrame:
    lim = limits or LIMITS
    arr = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"), F.lit(v).alias("limit_value")) for m, v in lim.items()])
    d = metrics.select(key, F.explode(arr).alias("_m")).select(key, "_m.*")
    r = F.col("value") / F.col("limit_value")
    return d.withColumns({"utilization": r, "breach": flag(r > 1), "level": ladder([(r > 1.2, "critical"), (r > 1, "high"), (r > 0.8, "warning")], "normal")})


def pretrade_check(trades: DataFrame, positions: DataFrame, max_position=8000.0, max_trade=60000.0) -> DataFrame:
    d = trades.join(positions.select("symbol", "market_value"), "symbol", "left").withColumn("notional", F.col("size") * F.col("price"))
    after = F.abs(F.coalesce("market_value", F.lit(0.0))) + F.col("notional")
    return d.withColumns({"exposure_after": after, "approved": flag((F.col("notional") <= max_trade) & (after <= max_position + max_trade * 0.5)),
                          "reason": ladder([(F.col("notional") > max_trade, "trade size"), (after > max_position + max_trade * 0.5, "position limit")], "ok")})


def position_size(df: DataFrame, target_vol=0.15, max_size=0.1, s: Series = S) -> DataFrame:
    """Half-Kelly share and volatility-target share, both capped."""
    d = daily_returns(df, s).withColumns({"_m": s.mean("ret", 20), "_s": s.std("ret", 20)})
    kelly = div("_m", F.col("_s") * F.col("_s")) * 0.5
    vol = F.lit(target_vol) / (F.col("_s") * YEAR + 1e-8)
    ok = F.col("_s").isNotNull()
    return d.withColumns({"kelly_size": F.when(ok, F.least(F.greatest(kelly, F.lit(0.0)), F.lit(max_size))),
                          "vol_target_size": F.when(ok, F.least(vol, F.lit(max_size)))}).drop("_m", "_s")


def vol_regime(df: DataFrame, window=30, s: Series = S) -> DataFrame:
    d = daily_returns(df, s).withColumn("vol", s.std("ret", window))
    d = with_group_stats(d, list(s.by), {"_q": F.percentile("vol", [0.25, 0.75])})
    v = F.col("vol")
    return d.withColumn("regime", ladder([(v.isNull(), "unknown"), (v < F.col("_q")[0], "low_vol"), (v > F.col("_q")[1], "high_vol")], "normal_vol")).drop("_q")


def market_regime(df: DataFrame, lookback=60, s: Series = S) -> DataFrame:
    """Regime label from annualised volatility and scaled slope, with fuzzy membership shares.

    The window holds ``lookback`` prices and therefore lookback - 1 returns.
    """
    d = with_pos(daily_returns(df, s), s)
    d = d.withColumns({"volatility": s.std("ret", lookback - 1) * YEAR, "trend": div(s.slope("close", lookback), s.mean("close", lookback))})
    v, t = F.col("volatility"), F.col("trend")
    d = d.withColumn("regime", ladder([(t.isNull() | v.isNull(), "unknown"), (v > 0.25, "high_vol"), (v < 0.10, "low_vol"), (t > 0.001, "bull"), (t < -0.001, "bear")], "sideways"))

    def unit(x):
        return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    d = d.withColumns({"_bull": unit((t + 0.002) / 0.004), "_bear": unit((-t + 0.002) / 0.004), "_hv": unit((v - 0.15) / 0.20), "_lv": unit((0.20 - v) / 0.15)})
    d = d.withColumn("_sw", 1 - F.col("_bull") - F.col("_bear"))
    tot = F.col("_bull") + F.col("_bear") + F.col("_sw") + F.col("_hv") + F.col("_lv")
    ok = t.isNotNull() & v.isNotNull()
    return d.withColumns({f"p_{k}": F.when(ok, div(F.col(c), tot)).otherwise(0.2) for k, c in
                          (("bull", "_bull"), ("bear", "_bear"), ("sideways", "_sw"), ("high_vol", "_hv"), ("low_vol", "_lv"))}
                         ).drop("_bull", "_bear", "_hv", "_lv", "_sw", "_pos")


def stress_indicator(df: DataFrame, s: Series = S) -> DataFrame:
    d = daily_returns(df, s).withColumn("_a", F.abs("ret"))
    sma = s.mean("close", 20)
    d = d.withColumns({"vol_ratio": div(s.std("ret", 5), s.std("ret", 20)), "trend_strength": div(F.col("close") - sma, sma),
                       "vix_proxy": s.quantile("_a", 20, 0.95) * YEAR * 100})
    return d.withColumn("stress", F.col("vol_ratio") * 0.3 + F.abs("trend_strength") * 0.3 + F.col("vix_proxy") / 50 * 0.4).drop("_a")
