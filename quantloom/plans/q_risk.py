"""Queries of risk factors, risk metrics and portfolio risk."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from quantloom.functions.series import S, div
from quantloom.operators import risk as R
from quantloom.plans.registry import query
from quantloom.plans.sql import Q, Sql, chain, draw_stages, unit
from quantloom.session import materialise
from quantloom.sources import io

K = "symbol date"
Y = "sqrt(252::DOUBLE)"


@query("daily_returns", K, "ret", sql="SELECT * FROM returns", tables="returns")
def daily_returns(t):
    return R.daily_returns(t.closes())


@query("volatility_ann", K, "volatility", sql=chain("returns", {"volatility": f"{Q.std('ret', 20)} * {Y}"}), tables="returns")
def volatility_ann(t):
    return R.volatility(t.closes())


DDS = chain("returns", {"f": "1 + coalesce(ret, 0)"}, {"equity": Q.cum("product(f)")}, {"drawdown": f"equity / {Q.cum('max(equity)')} - 1"})


@query("drawdown_series", K, "equity drawdown", sql=DDS, tables="returns")
def drawdown_series(t):
    return R.drawdown(t.closes())


@query("rolling_var", K, "var", sql=chain("returns", {"var": f"-{Q.quantile('ret', 252, 0.05)} * {Y}"}), tables="returns")
def rolling_var(t):
    return R.rolling_var(t.closes())


@query("rolling_beta_bench", K, "beta", sql=chain("returns_market", {"beta": Q.beta("ret", "mret", 60)}), tables="returns_market")
def rolling_beta_bench(t):
    return t.returns_with_market().withColumn("beta", S.beta("ret", "mret", 60))


def cf(z):
    return f"({z!r} + ({z * z - 1!r}) * skew / 6 + ({z ** 3 - 3 * z!r}) * kurt / 24 - ({2 * z ** 3 - 5 * z!r}) * skew * skew / 36)"


MOM = "SELECT symbol, avg(ret) AS mu, stddev_samp(ret) AS sd, skewness(ret) AS skew, kurtosis(ret) AS kurt, " + ", ".join(
    f"quantile_cont(ret, {p / 100}) AS hist_var_{p}" for p in (1, 5, 10)) + " FROM returns GROUP BY symbol"
VAR = f"SELECT *, " + ", ".join(f"mu + ({R.Z[p]!r}) * sd AS param_var_{p}, mu + {cf(R.Z[p])} * sd AS modified_var_{p}" for p in (1, 5, 10)) + f" FROM ({MOM})"


@query("var_historical_parametric_cf", "symbol", " ".join(f"hist_var_{p} param_var_{p} modified_var_{p}" for p in (1, 5, 10)), sql=VAR, tables="returns")
def var_historical_parametric_cf(t):
    return R.var_table(t.returns())


DRAWN = chain("(SELECT range AS id FROM range(10000))", *draw_stages("u", "7", ["1", "id"]), *draw_stages("v", "7", ["2", "id"]), {"z": f"sqrt(-2 * ln({unit('u')})) * cos(2 * pi() * {unit('v')})"})


@query("var_montecarlo", "symbol", "mc_var_1 mc_var_5 mc_var_10",
       sql=f"WITH zs AS (SELECT " + ", ".join(f"quantile_cont(z, {n / 100}) AS z{n}" for n in (1, 5, 10)) + f" FROM ({DRAWN})), g AS (SELECT symbol, avg(ret) AS mu, stddev_samp(ret) AS sd FROM returns GROUP BY 1) SELECT symbol, " + ", ".join(f"mu + sd * z{n} AS mc_var_{n}" for n in (1, 5, 10)) + " FROM g, zs", tables="returns")
def var_montecarlo(t):
    return R.monte_carlo_var(t.returns())


CVAR = f"SELECT r.symbol, " + ", ".join(
    f"avg(CASE WHEN ret <= hist_var_{p} THEN ret END) AS hist_cvar_{p}, max(mu) - max(sd) * {math.exp(-R.Z[p] ** 2 / 2) / math.sqrt(2 * math.pi) / (p / 100)!r} AS param_cvar_{p}" for p in (1, 5, 10)
) + f" FROM returns r JOIN ({MOM}) m USING (symbol) GROUP BY r.symbol"


@query("cvar_historical_parametric", "symbol", " ".join(f"hist_cvar_{p} param_cvar_{p}" for p in (1, 5, 10)), sql=CVAR, tables="returns")
def cvar_historical_parametric(t):
    return R.cvar_table(t.returns())


GARCH = ("WITH RECURSIVE v AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, count(*) OVER (PARTITION BY symbol) AS n, "
         "var_pop(ret) OVER (PARTITION BY symbol) AS v0 FROM returns WHERE ret IS NOT NULL), "
         "g AS (SELECT symbol, k, n, v0 AS h, ret FROM v WHERE k = 1 UNION ALL SELECT v.symbol, v.k, v.n, 0.01::DOUBLE + 0.1::DOUBLE * g.ret * g.ret + 0.8::DOUBLE * g.h, v.ret FROM g JOIN v ON v.symbol = g.symbol AND v.k = g.k + 1), "
         f"e AS (SELECT symbol, sqrt(sum(pow(0.94::DOUBLE, n - k) * ret * ret) / sum(pow(0.94::DOUBLE, n - k))) * {Y} AS ewma_vol FROM v GROUP BY symbol) "
         f"SELECT g.symbol, sqrt(h) * {Y} AS garch_vol, ewma_vol FROM g JOIN e USING (symbol) WHERE k = n")


@query("vol_ewma_garch", "symbol", "ewma_vol garch_vol", sql=GARCH, tables="returns")
def vol_ewma_garch(t):
    return R.ewma_garch(t.returns())


DDT = ("WITH p AS (SELECT symbol, date, close, max(close) OVER (PARTITION BY symbol ORDER BY date) AS peak, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars), "
       "d AS (SELECT *, (close - peak) / peak AS dd FROM p), w AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dd, date) = 1), "
       "l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) "
       "SELECT w.symbol, abs(w.dd) AS max_drawdown, (SELECT min(b.date) FROM bars b WHERE b.symbol = w.symbol AND b.close = w.peak) AS peak_date, w.date AS trough_date, "
       "(l.peak - l.close) / l.peak AS current_drawdown, l.k - (SELECT max(x.k) FROM d x WHERE x.symbol = w.symbol AND x.close = x.peak) AS duration FROM w JOIN l USING (symbol)")


@query("max_drawdown_peak_trough", "symbol peak_date trough_date", "max_drawdown current_drawdown", "duration", sql=DDT, tables="bars")
def max_drawdown_peak_trough(t):
    return R.drawdown_table(t.closes())


BETA = "SELECT symbol, coalesce(covar_samp(ret, mret) / nullif(var_samp(mret), 0), 1) AS beta FROM returns_market WHERE ret IS NOT NULL AND mret IS NOT NULL GROUP BY symbol"


@query("beta_market", "symbol", "beta", sql=BETA, tables="returns_market")
def beta_market(t):
    return R.beta_market(t.returns_with_market())


RAT = (f"SELECT symbol, coalesce((avg(ret) * 252 - 0.02) / nullif(stddev_samp(ret) * {Y}, 0), 0) AS sharpe, "
       f"coalesce((avg(ret) * 252 - 0.02) / nullif(stddev_samp(CASE WHEN ret < 0 THEN ret END) * {Y}, 0), 0) AS sortino, avg(ret) * 252 AS annual_return FROM returns GROUP BY symbol")
RATS = f"SELECT a.*, annual_return / nullif(max_drawdown, 0) AS calmar FROM ({RAT}) a JOIN ({DDT}) USING (symbol)"


@query("sharpe_sortino_calmar", "symbol", "sharpe sortino calmar annual_return", sql=RATS, tables="returns")
def sharpe_sortino_calmar(t):
    return R.ratios(t.returns())


COMP = (f"WITH v AS ({VAR}), c AS ({CVAR}), g AS ({GARCH}), d AS ({DDT}), r AS ({RATS}), b AS ({BETA}), "
        "w AS (SELECT * FROM v JOIN c USING (symbol) JOIN g USING (symbol) JOIN d USING (symbol) JOIN r USING (symbol) JOIN b USING (symbol)) " + " UNION ALL ".join(
            [f"SELECT symbol, '{m}' AS metric, {c}_{p} AS value, {p} AS level, '{k}' AS method FROM w" for p in (1, 5, 10) for m, c, k in
             (("Historical VaR", "hist_var", "Historical"), ("Parametric VaR", "param_var", "Normal"), ("Modified VaR", "modified_var", "Cornish-Fisher"), ("CVaR", "hist_cvar", "Historical"))] +
            [f"SELECT symbol, '{m}', {c}, 0, '{k}' FROM w" for m, c, k in (("Volatility", f"sd * {Y}", "Simple"), ("EWMA Volatility", "ewma_vol", "EWMA"), ("Maximum Drawdown", "max_drawdown", "Historical"),
             ("Current Drawdown", "current_drawdown", "Current"), ("Sharpe", "sharpe", "Standard"), ("Sortino", "sortino", "Downside"), ("Calmar", "calmar", "Return/Drawdown"), ("Beta", "beta", "Regression"))]))


@query("risk_metrics_comprehensive", "symbol metric method", "value", "level", sql=COMP, tables="returns_market", staged=True)
def risk_metrics_comprehensive(t):
    return R.comprehensive(t.returns_with_market())


PR = "SELECT w.portfolio, r.date, sum(w.weight * r.ret) AS pret FROM weights w JOIN returns r USING (symbol) WHERE r.ret IS NOT NULL GROUP BY 1, 2"
QP = Sql("portfolio")


@query("portfolio_returns", "portfolio date", "pret log_index", sql=chain(f"({PR})", {"f": "1 + pret"}, {"log_index": "ln(" + QP.cum("product(f)") + ")"}), tables="weights returns")
def portfolio_returns(t):
    return R.portfolio_returns(t.weights(), t.returns()).withColumn("log_index", F.log(R.P.cumprod(1 + F.col("pret"))))


PVH = (f"WITH p AS (SELECT * FROM ({PR}) QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY date DESC) <= 252), "
       "q AS (SELECT portfolio, quantile_cont(pret, 0.05) AS q5, quantile_cont(pret, 0.01) AS q1 FROM p GROUP BY 1) "
       f"SELECT p.portfolio, -max(q5) AS var_5, -max(q1) AS var_1, -avg(CASE WHEN pret <= q5 THEN pret END) AS cvar_5, -max(q5) * sqrt(10::DOUBLE) AS var_5_h, stddev_samp(pret) * {Y} AS volatility FROM p JOIN q USING (portfolio) GROUP BY 1")


@query("portfolio_var_horizon", "portfolio", "var_5 var_1 cvar_5 var_5_h volatility", sql=PVH, tables="weights returns")
def portfolio_var_horizon(t):
    return R.portfolio_var(R.portfolio_returns(t.weights(), t.returns()))


SECTORS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]  # fixed values: the sector dimension
SR = "SELECT sector, date, avg(ret) AS ret FROM returns JOIN sector USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2"


def sector_wide(t):
    g = t.returns().where(F.col("ret").isNotNull()).join(t.sector(), "symbol")
    return g.groupBy("date").pivot("sector", SECTORS).agg(F.avg("ret"))


# weights age with the calendar; a pair uses the dates on which both sectors are present
COVE = (f"WITH s AS ({SR}), ds AS (SELECT date, row_number() OVER (ORDER BY date DESC) - 1 AS age FROM (SELECT DISTINCT date FROM s)), a AS (SELECT a.sector AS a, b.sector AS b, a.ret AS x, b.ret AS y, pow(0.94::DOUBLE, age) AS w FROM s a JOIN s b ON a.date = b.date AND a.sector <= b.sector JOIN ds ON ds.date = a.date), "
        "c AS (SELECT a, b, covar_samp(x, y) * 252 AS sample, (sum(w * x * y) - sum(w * x) * sum(w * y) / sum(w)) / (sum(w) - sum(w * w) / sum(w)) * 252 AS ewma FROM a GROUP BY 1, 2), "
        "m AS (SELECT avg(sample) AS av FROM c WHERE a = b) SELECT a, b, sample, ewma, 0.8 * sample + CASE WHEN a = b THEN 0.2 * av ELSE 0 END AS shrunk FROM c CROSS JOIN m")


@query("cov_matrix_estimators", "a b", "sample ewma shrunk", sql=COVE, tables="returns sector")
def cov_matrix_estimators(t):
    """Sample, shrunk and EWMA covariance of a short list of columns, from one aggregation."""
    from pyspark.sql import Window
    w = sector_wide(t).withColumn("_w", F.pow(F.lit(0.94), F.row_number().over(Window.orderBy(F.desc("date"))) - 1))  # one row per week
    aggs = []
    for i, a in enumerate(SECTORS):
        for b in SECTORS[i:]:
            x, y = F.col(f"`{a}`"), F.col(f"`{b}`")
            k = F.when(x.isNotNull() & y.isNotNull(), F.col("_w"))
            ew = div(F.sum(k * x * y) - div(F.sum(k * x) * F.sum(k * y), F.sum(k)), F.sum(k) - div(F.sum(k * k), F.sum(k))) * 252
            aggs.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.covar_samp(x, y) * 252).alias("sample"), ew.alias("ewma")))
    row = w.agg(F.array(*aggs).alias("p"))
    trace = F.aggregate(F.filter("p", lambda q: q["a"] == q["b"]), F.lit(0.0), lambda s, q: s + q["sample"]) / len(SECTORS)
    d = row.select(F.explode("p").alias("q"), trace.alias("av")).select("q.*", "av")
    return d.withColumn("shrunk", F.col("sample") * 0.8 + F.when(F.col("a") == F.col("b"), F.col("av") * 0.2).otherwise(0.0))


@query("portfolio_variance_parametric", "portfolio", "variance volatility var_normal_5 var_normal_1 var_t_5 var_t_1",
       sql=f"SELECT portfolio, var_samp(pret) * 252 AS variance, stddev_samp(pret) * {Y} AS volatility, " + ", ".join(
           f"{-z!r} * stddev_samp(pret) * {Y} AS var_{n}_{p}" for n, zz in (("normal", R.Z), ("t", R.T6)) for p, z in zz.items() if p != 10) + f" FROM ({PR}) GROUP BY 1", tables="weights returns")
def portfolio_variance_parametric(t):
    return R.portfolio_parametric(R.portfolio_returns(t.weights(), t.returns()))


EXPO = (chain("returns_market", {"market": Q.beta("ret", "mret", 60), "momentum": Q.pct("close", 20), "volatility": Q.std("ret", 60), "size": "ln(close * volume)"},
              "SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1",
              final="SELECT symbol, factor, exposure FROM (SELECT symbol, market, (momentum - avg(momentum) OVER ()) / stddev_samp(momentum) OVER () AS momentum, "
                    "(volatility - avg(volatility) OVER ()) / stddev_samp(volatility) OVER () AS volatility, (size - avg(size) OVER ()) / stddev_samp(size) OVER () AS size FROM {src}) "
                    "UNPIVOT (exposure FOR factor IN (market, momentum, volatility, size))"))


def exposures(t):
    """(symbol, factor, exposure): last beta, and cross-sectional z-scores of momentum, volatility and size."""
    from quantloom.functions.exact import unpivot, with_group_stats
    d = t.returns_with_market().withColumns({"market": S.beta("ret", "mret", 60), "momentum": S.pct("close", 20), "volatility": S.std("ret", 60), "size": F.log(F.col("close") * F.col("volume"))})
    d = io.latest(d.select("symbol", "date", "market", "momentum", "volatility", "size"))
    zs = ("momentum", "volatility", "size")
    d = with_group_stats(d, [], {f"{k}_{c}": a(c) for c in zs for k, a in (("m", F.avg), ("s", F.stddev_samp))})
    d = d.withColumns({c: div(F.col(c) - F.col(f"m_{c}"), f"s_{c}") for c in zs})
    return unpivot(d, ["symbol"], ["market", *zs], "factor", "exposure").where(F.col("exposure").isNotNull())


SCN = " UNION ALL ".join(f"SELECT '{n}' AS scenario, {p} AS probability, '{f}' AS factor, {s}::DOUBLE AS shock" for n, (p, sh) in R.SCENARIOS.items() for f, s in sh.items())


@query("stress_test_scenarios", "portfolio scenario", "probability impact best_factor worst_factor", "n_factors",
       sql=f"WITH e AS ({EXPO}), sc AS ({SCN}), pe AS (SELECT portfolio, factor, sum(weight * exposure) AS x FROM weights JOIN e USING (symbol) GROUP BY 1, 2) "
           "SELECT portfolio, scenario, probability, sum(x * shock) AS impact, max(x * shock) AS best_factor, min(x * shock) AS worst_factor, count(*) AS n_factors FROM pe JOIN sc USING (factor) GROUP BY 1, 2, 3", tables="weights returns_market")
def stress_test_scenarios(t):
    return R.stress_test(t.weights(), exposures(t), R.scenario_rows(t.spark))


FRET = f"SELECT r.date, e.factor, avg(e.exposure * r.ret) AS fret FROM ({EXPO}) e JOIN returns r USING (symbol) WHERE r.ret IS NOT NULL GROUP BY 1, 2"
FACTORS = ["market", "momentum", "size", "volatility"]  # fixed values: the exposure columns


def factor_covariance(t, ex):
    """(a, b, cov) over exposure-weighted factor returns, a <= b, including the diagonal."""
    fr = (ex.join(t.returns().where(F.col("ret").isNotNull()).select("symbol", "date", "ret"), "symbol")
          .groupBy("date").pivot("factor", FACTORS).agg(F.avg(F.col("exposure") * F.col("ret"))))
    aggs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(a, b).alias("cov")) for i, a in enumerate(FACTORS) for b in FACTORS[i:]]
    return fr.agg(F.array(*aggs).alias("p")).select(F.explode("p").alias("q")).select("q.*")


@query("factor_risk_attribution", "portfolio source", "contribution share",
       sql=f"WITH e AS ({EXPO}), fr AS ({FRET}), fc AS (SELECT x.factor AS a, y.factor AS b, covar_samp(x.fret, y.fret) AS cov FROM fr x JOIN fr y ON x.date = y.date AND x.factor <= y.factor GROUP BY 1, 2), "
           "pe AS (SELECT portfolio, factor, sum(weight * exposure) AS x FROM weights JOIN e USING (symbol) GROUP BY 1, 2), "
           "f AS (SELECT p.portfolio, CASE WHEN a = b THEN a ELSE a || '_' || b END AS source, CASE WHEN a = b THEN 1 ELSE 2 END * p.x * q.x * cov AS contribution FROM fc JOIN pe p ON p.factor = a JOIN pe q ON q.factor = b AND q.portfolio = p.portfolio), "
           "s AS (SELECT symbol, stddev_samp(ret) AS specific FROM returns GROUP BY 1), u AS (SELECT * FROM f UNION ALL SELECT portfolio, 'specific', sum(weight * weight * specific * specific) FROM weights JOIN s USING (symbol) GROUP BY 1) "
           "SELECT *, contribution / sum(contribution) OVER (PARTITION BY portfolio) * 100 AS share FROM u", tables="weights returns_market", staged=True)
def factor_risk_attribution(t):
    specific = t.returns().groupBy("symbol").agg(F.stddev_samp("ret").alias("specific"))
    ex = materialise(exposures(t), "exposures")
    return R.factor_attribution(t.weights(), ex, factor_covariance(t, ex), specific)


MCR = (f"WITH p AS ({PR}), full_ AS (SELECT w.portfolio, w.symbol, w.weight, p.date, p.pret, coalesce(r.ret, 0) AS ret FROM weights w JOIN p USING (portfolio) LEFT JOIN returns r ON r.symbol = w.symbol AND r.date = p.date), "
       "s AS (SELECT portfolio, stddev_samp(pret) AS sg FROM p GROUP BY 1) "
       f"SELECT portfolio, symbol, max(weight) AS weight, covar_samp(ret, pret) / max(sg) * {Y} AS marginal, max(weight) * covar_samp(ret, pret) / max(sg) * {Y} AS component FROM full_ JOIN s USING (portfolio) GROUP BY 1, 2")


@query("marginal_component_risk", "portfolio symbol", "weight marginal component", sql=MCR, tables="weights returns", staged=True)
def marginal_component_risk(t):
    return R.risk_contributions(t.weights(), t.returns())


EXM = ("SELECT portfolio, sum(CASE WHEN market_value > 0 THEN market_value ELSE 0 END) AS long_exposure, sum(CASE WHEN market_value < 0 THEN -market_value ELSE 0 END) AS short_exposure, sum(market_value) AS net_exposure, "
       "sum(abs(market_value)) AS gross_exposure, max(abs(market_value)) AS largest_position, count(*) AS n, sum(abs(market_value)) / 100000.0::DOUBLE AS leverage, sum(CASE WHEN rn <= 5 THEN abs(market_value) END) / sum(abs(market_value)) AS top5_share, "
       "sum(market_value * market_value) / pow(sum(abs(market_value)), 2) AS hhi, max(abs(market_value)) / sum(abs(market_value)) AS largest_share FROM (SELECT *, row_number() OVER (PARTITION BY portfolio ORDER BY abs(market_value) DESC, symbol) AS rn FROM positions) GROUP BY 1")


@query("exposure_metrics", "portfolio", "long_exposure short_exposure net_exposure gross_exposure largest_position leverage top5_share hhi largest_share", "n", sql=EXM, tables="positions")
def exposure_metrics(t):
    return R.exposure_metrics(t.positions())


@query("risk_limit_check", "portfolio metric level", "value limit_value utilization", "breach",
       sql=f"WITH m AS ({EXM}), l AS (" + " UNION ALL ".join(f"SELECT portfolio, '{m}' AS metric, {m} AS value, {v}::DOUBLE AS limit_value FROM m" for m, v in R.LIMITS.items()) +
           ") SELECT *, value / limit_value AS utilization, CASE WHEN value / limit_value > 1 THEN 1 ELSE 0 END AS breach, CASE WHEN value / limit_value > 1.2 THEN 'critical' WHEN value / limit_value > 1 THEN 'high' WHEN value / limit_value > 0.8 THEN 'warning' ELSE 'normal' END AS level FROM l", tables="positions")
def risk_limit_check(t):
    return R.limit_check(R.exposure_metrics(t.positions()))


@query("pretrade_check", "symbol date reason", "notional exposure_after", "approved",
       sql="WITH d AS (SELECT tr.*, size * price AS notional, abs(coalesce(market_value, 0)) + size * price AS exposure_after FROM trades tr LEFT JOIN positions USING (symbol)) "
           "SELECT *, CASE WHEN notional <= 60000 AND exposure_after <= 38000 THEN 1 ELSE 0 END AS approved, CASE WHEN notional > 60000 THEN 'trade size' WHEN exposure_after > 38000 THEN 'position limit' ELSE 'ok' END AS reason FROM d", tables="trades positions")
def pretrade_check(t):
    return R.pretrade_check(t.trades(), t.positions())


@query("position_size_kelly_vol", K, "kelly_size vol_target_size",
       sql=chain("returns", {"m": Q.mean("ret", 20), "sd": Q.std("ret", 20)}, {"kelly_size": "CASE WHEN sd IS NOT NULL THEN least(greatest(m / nullif(sd * sd, 0) * 0.5, 0.0), 0.1) END", "vol_target_size": f"CASE WHEN sd IS NOT NULL THEN least(0.15 / (sd * {Y} + 1e-8::DOUBLE), 0.1) END"}), tables="returns")
def position_size_kelly_vol(t):
    return R.position_size(t.closes())


@query("vol_regime_label", "symbol date regime", "vol",
       sql=chain("returns", {"vol": Q.std("ret", 30)}, {"q25": "quantile_cont(vol, 0.25) OVER (PARTITION BY symbol)", "q75": "quantile_cont(vol, 0.75) OVER (PARTITION BY symbol)"},
                 {"regime": "CASE WHEN vol IS NULL THEN 'unknown' WHEN vol < q25 THEN 'low_vol' WHEN vol > q75 THEN 'high_vol' ELSE 'normal_vol' END"}), tables="returns")
def vol_regime_label(t):
    return R.vol_regime(t.closes())


def unit(x):
    return f"least(greatest({x}, 0.0::DOUBLE), 1.0::DOUBLE)"


@query("market_regime_label", "symbol date regime", "volatility trend p_bull p_bear p_sideways p_high_vol p_low_vol",
       sql=chain("returns", {"pos": Q.pos(), "volatility": f"{Q.std('ret', 59)} * {Y}"}, {"trend": f"{Q.slope('close', 60)} / nullif({Q.mean('close', 60)}, 0)"},
                 {"regime": "CASE WHEN trend IS NULL OR volatility IS NULL THEN 'unknown' WHEN volatility > 0.25 THEN 'high_vol' WHEN volatility < 0.10 THEN 'low_vol' WHEN trend > 0.001 THEN 'bull' WHEN trend < -0.001 THEN 'bear' ELSE 'sideways' END",
                  "bu": unit("(trend + 0.002::DOUBLE) / 0.004::DOUBLE"), "be": unit("(-trend + 0.002::DOUBLE) / 0.004::DOUBLE"), "hv": unit("(volatility - 0.15::DOUBLE) / 0.2::DOUBLE"), "lv": unit("(0.2::DOUBLE - volatility) / 0.15::DOUBLE")},
                 {"sw": "1 - bu - be"}, {"tot": "bu + be + sw + hv + lv"},
                 {f"p_{k}": f"CASE WHEN trend IS NULL OR volatility IS NULL THEN 0.2 ELSE {c} / nullif(tot, 0) END" for k, c in (("bull", "bu"), ("bear", "be"), ("sideways", "sw"), ("high_vol", "hv"), ("low_vol", "lv"))}), tables="returns")
def market_regime_label(t):
    return R.market_regime(t.closes())


@query("stress_indicator", K, "vol_ratio trend_strength vix_proxy stress",
       sql=chain("returns", {"a": "abs(ret)", "vol_ratio": f"{Q.std('ret', 5)} / nullif({Q.std('ret', 20)}, 0)", "trend_strength": f"(close - {Q.mean('close', 20)}) / nullif({Q.mean('close', 20)}, 0)"},
                 {"vix_proxy": f"{Q.quantile('a', 20, 0.95)} * {Y} * 100"}, {"stress": "vol_ratio * 0.3 + abs(trend_strength) * 0.3 + vix_proxy / 50 * 0.4"}), tables="returns")
def stress_indicator(t):
    return R.stress_indicator(t.closes())
