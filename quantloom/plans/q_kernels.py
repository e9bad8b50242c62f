"""Queries of the rolling numeric kernels and the sequential indicators."""
from __future__ import annotations


from quantloom.functions import numeric as N
from quantloom.functions.kernels import apply_frame, rolling_apply, rolling_apply_pair
from quantloom.functions.series import S
from quantloom.plans.q_basics import K
from quantloom.plans.registry import query
from quantloom.plans.sql import Q

# name -> (kernel, outputs, window, input); half a window is enough, as for the plain factors
KERNELS = {
    "fractal_dimension": (N.box_dimension, ["fractal"], 50, "close"), "hurst_rs": (N.hurst_rs, ["hurst"], 50, "close"),
    "shannon_entropy": (N.shannon, ["entropy"], 50, "close"),
    "distribution_tests": (N.distribution_tests, ["ks_normal", "ks_laplace", "jarque_bera", "anderson"], 50, "ret"), "extreme_value": (N.extreme_value, ["hill", "frequency", "max_to_mean"], 50, "ret"),
    "kalman_local_level": (N.kalman_level, ["smoothness", "innovation_variance"], 50, "ret"), "changepoint_bayes": (N.changepoint, ["strength", "bic_gain"], 50, "ret"), "info_theory": (N.info_theory, ["entropy", "kl", "mutual"], 50, "ret"),
}


def register(name, fn, outs, n, col):
    @query(name, K, " ".join(outs))
    def run(t):
        d = t.closes() if col == "close" else t.returns()
        return rolling_apply(d, col, n, {"k": fn}, {"k": outs}, min_periods=n // 2)


for _name, (_fn, _outs, _n, _col) in KERNELS.items():
    register(_name, _fn, _outs, _n, _col)


W = Q.frame(-100, -1)
# the check side uses the closed forms of both regressions instead of residual arrays
COI = ("WITH m AS (SELECT b.symbol, b.date, mclose AS p1, close AS p2 FROM bars b JOIN market_index USING (date)), "
       f"w AS (SELECT symbol, date, list(p1) OVER {W} AS a, list(p2) OVER {W} AS c, regr_slope(p2, p1) OVER {W} AS b, regr_intercept(p2, p1) OVER {W} AS i0, count(*) OVER {W} AS n FROM m), "
       "r AS (SELECT symbol, date, unnest(range(1, 100)) AS k, a, c, b, i0 FROM w WHERE n = 100), e AS (SELECT symbol, date, c[k] - i0 - b * a[k] AS lag_, c[k + 1] - i0 - b * a[k + 1] AS cur FROM r), "
       "g AS (SELECT symbol, date, regr_slope(cur - lag_, lag_) AS adf FROM e GROUP BY 1, 2) SELECT w.symbol, w.date, adf, CASE WHEN adf < 0 THEN -ln(2) / adf END AS half_life FROM w LEFT JOIN g USING (symbol, date)")


@query("cointegration_pair", K, "adf half_life", sql=COI, tables="market_index")
def cointegration_pair(t):
    """Every symbol against the index, over the hundred rows before each date."""
    d = t.closes().join(t.market_index(), "date")
    return rolling_apply_pair(d, "mclose", "close", 100, {"k": N.cointegration}, {"k": ["adf", "half_life"]}, lo=-100, hi=-1)


@query("granger_pair", K, "volume_to_price price_to_volume")
def granger_pair(t):
    d = t.returns().withColumn("vc", S.pct("volume"))
    return rolling_apply_pair(d, "vc", "ret", 50, {"volume_to_price": N.granger, "price_to_volume": lambda x, y: N.granger(y, x)}, lo=-50, hi=-1)


SAR = ("WITH RECURSIVE v AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS k FROM bars), r AS (SELECT symbol, date, k, low AS sar, 1 AS side, high AS ep, 0.02::DOUBLE AS af FROM v WHERE k = 1 UNION ALL "
       "SELECT symbol, date, k, CASE WHEN turned THEN ep ELSE nxt END, CASE WHEN turned THEN -side ELSE side END, CASE WHEN turned THEN (CASE WHEN side = 1 THEN low ELSE high END) WHEN side = 1 THEN greatest(ep, high) ELSE least(ep, low) END, "
       "CASE WHEN turned THEN 0.02::DOUBLE WHEN (side = 1 AND high > ep) OR (side = -1 AND low < ep) THEN least(af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE af END "
       "FROM (SELECT v.symbol, v.date, v.k, v.high, v.low, r.side, r.ep, r.af, r.sar + r.af * (r.ep - r.sar) AS nxt, CASE WHEN r.side = 1 THEN v.low <= r.sar + r.af * (r.ep - r.sar) ELSE v.high >= r.sar + r.af * (r.ep - r.sar) END AS turned FROM r JOIN v ON v.symbol = r.symbol AND v.k = r.k + 1)) "
       "SELECT symbol, date, sar, side FROM r")


@query("parabolic_sar", K, "sar", "side", sql=SAR, tables="bars")
def parabolic_sar(t):
    return apply_frame(t.bars(), N.parabolic_sar, ["high", "low"], ["sar", "side"])
