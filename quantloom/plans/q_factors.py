"""Queries of factor processing, evaluation, combination, the factor model and portfolio construction."""
from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.exact import unpivot, with_group_stats
from quantloom.functions.series import S, Series
from quantloom.operators import factors as FA
from quantloom.operators import portfolio as PO
from quantloom.operators import relational as REL
from quantloom.plans.q_risk import EXPO, FRET, SECTORS, SR, exposures, factor_covariance, sector_wide
from quantloom.plans.q_sentiment import ncdf
from quantloom.plans.q_state_fund import QI
from quantloom.plans.registry import query
from quantloom.plans.sql import Q, Sql, chain
from quantloom.session import materialise

KF = "symbol date factor"
FC = ["momentum", "volatility", "reversal", "liquidity"]  # fixed values: the factor panel
FP = chain("returns", {"momentum": Q.pct("close", 20), "volatility": Q.std("ret", 20), "reversal": f"-{Q.pct('close', 5)}", "liquidity": f"volume / nullif({Q.mean('volume', 20)}, 0)", "fwd": f"{Q.lead('close')} / nullif(close, 0) - 1"})
FL = f"SELECT symbol, date, fwd, factor, value FROM ({FP}) UNPIVOT INCLUDE NULLS (value FOR factor IN ({', '.join(FC)}))"
CL = f"(SELECT * FROM ({FL}) WHERE value IS NOT NULL AND fwd IS NOT NULL)"
QF = Sql("factor", "date")


def panel(t):
    return t.returns().withColumns({"momentum": S.pct("close", 20), "volatility": S.std("ret", 20), "reversal": -S.pct("close", 5), "liquidity": F.try_divide("volume", S.mean("volume", 20)), "fwd": F.try_divide(S.lead("close"), "close") - 1})


def long(t):
    return panel(t).select("symbol", "date", "fwd", *FC).unpivot(["symbol", "date", "fwd"], FC, "factor", "value")


def long_by_date(t):
    """The factor rows by date, moved there wide, a row for all factors, and unfolded after that."""
    d = panel(t).select("date", "fwd", *FC).where(F.col("fwd").isNotNull()).repartition("date")
    return d.select("date", "fwd", F.inline(F.array(*[F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("value")) for c in FC])))


def rnk(c, by):
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2)"


DFW = "PARTITION BY date, factor"
WIN = f"SELECT *, CASE WHEN value IS NOT NULL THEN least(greatest(value, quantile_cont(value, 0.05) OVER w), quantile_cont(value, 0.95) OVER w) END AS clipped FROM ({FL}) WINDOW w AS ({DFW})"


@query("winsorize_quantile", KF, "clipped", sql=WIN, tables="returns")
def winsorize_quantile(t):
    return FA.winsorize(long(t), out="clipped")


@query("clip_sigma", KF, "value", sql=f"SELECT symbol, date, factor, CASE WHEN value IS NOT NULL THEN least(greatest(value, avg(value) OVER w - 3 * stddev_samp(value) OVER w), avg(value) OVER w + 3 * stddev_samp(value) OVER w) END AS value FROM ({FL}) WINDOW w AS (PARTITION BY factor)", tables="returns")
def clip_sigma(t):
    d = FA.clip_sigma(long(t).withColumn("_v", F.col("value")))
    return d.withColumn("value", F.when(F.col("_v").isNotNull(), F.col("value")))


STZ = (f"WITH m AS (SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z, (value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0) AS mm, abs(value - quantile_cont(value, 0.5) OVER w) AS ad, value - quantile_cont(value, 0.5) OVER w AS dv FROM ({FL}) WINDOW w AS ({DFW})) "
       f"SELECT *, dv / nullif(1.4826::DOUBLE * quantile_cont(ad, 0.5) OVER ({DFW}), 0) AS rz FROM m")


@query("standardize_zscore_minmax_robust", KF, "z mm rz", sql=STZ, tables="returns", staged=True)
def standardize_zscore_minmax_robust(t):
    return FA.robust_z(FA.minmax(FA.zscore(long(t))))


NI = f"(SELECT * FROM ({FL}) JOIN (SELECT symbol, industry FROM sector) USING (symbol))"


@query("neutralize_industry_zscore", KF, "neutral", sql=f"SELECT *, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS neutral FROM {NI} WINDOW w AS (PARTITION BY date, factor, industry)", tables="returns sector")
def neutralize_industry_zscore(t):
    return FA.neutralize(long(t), t.sector().select("symbol", "industry"))


@query("neutralize_industry_ols", KF, "neutral", sql=f"SELECT *, CASE WHEN count(value) OVER ({DFW}) > 10 THEN value - avg(value) OVER (PARTITION BY date, factor, industry) ELSE value END AS neutral FROM {NI}", tables="returns sector")
def neutralize_industry_ols(t):
    return FA.neutralize(long(t), t.sector().select("symbol", "industry"), how="ols")


CONFIG = {"momentum": {"neutralize": True}, "volatility": {"standardize": False}, "reversal": {"winsorize": False}, "liquidity": {}}
PRC = (f"WITH a AS (SELECT *, CASE WHEN factor = 'reversal' THEN value WHEN value IS NOT NULL THEN least(greatest(value, quantile_cont(value, 0.01) OVER w), quantile_cont(value, 0.99) OVER w) END AS x FROM ({FL}) WINDOW w AS ({DFW})), "
       f"b AS (SELECT *, CASE WHEN factor = 'volatility' THEN x ELSE (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) END AS y FROM a WINDOW w AS ({DFW})), c AS (SELECT b.*, industry FROM b JOIN (SELECT symbol, industry FROM sector) USING (symbol)) "
       f"SELECT *, CASE WHEN factor = 'momentum' AND count(y) OVER ({DFW}) > 10 THEN y - avg(y) OVER (PARTITION BY date, factor, industry) ELSE y END AS processed FROM c")


@query("process_factors_config", KF, "processed", sql=PRC, tables="returns sector", staged=True)
def process_factors_config(t):
    return FA.process(long(t), t.sector().select("symbol", "industry"), CONFIG)


WTS = {"momentum": 0.4, "volatility": -0.3, "reversal": 0.2, "liquidity": 0.1}
FSW = (f"WITH a AS (SELECT *, CASE WHEN value IS NOT NULL THEN least(greatest(value, quantile_cont(value, 0.05) OVER w), quantile_cont(value, 0.95) OVER w) END AS x FROM ({FL}) WINDOW w AS (PARTITION BY factor)), "
       "b AS (SELECT *, (x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0) AS z FROM a WINDOW w AS (PARTITION BY factor)) SELECT symbol, date, sum(coalesce(z, 0) * CASE factor " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in WTS.items()) + " END) AS score FROM b GROUP BY 1, 2")


@query("factor_score_weighted", "symbol date", "score", sql=FSW, tables="returns", staged=True)
def factor_score_weighted(t):
    return FA.weighted_score(long(t), WTS)


ICT = (f"WITH c AS (SELECT *, {rnk('value', 'factor')} AS rv, {rnk('fwd', 'factor')} AS rf FROM {CL}), g AS (SELECT factor, corr(value, fwd) AS ic, corr(rv, rf) AS rank_ic, count(*) AS n FROM c GROUP BY 1), t AS (SELECT *, ic * sqrt((n - 2) / (1 - ic * ic)) AS t_stat FROM g) "
       f"SELECT *, 2 * (1 - {ncdf('abs(t_stat)')}) AS p_value FROM t")


@query("ic_pearson_spearman", "factor", "ic rank_ic t_stat p_value", "n", sql=ICT, tables="returns")
def ic_pearson_spearman(t):
    return FA.ic_total(long(t))


ICD = f"SELECT date, factor, covar_samp(value, fwd) / nullif(stddev_samp(value) * stddev_samp(fwd), 0) AS ic, covar_samp(rv, rf) / nullif(stddev_samp(rv) * stddev_samp(rf), 0) AS rank_ic, count(*) AS n FROM (SELECT *, {rnk('value', 'date, factor')} AS rv, {rnk('fwd', 'date, factor')} AS rf FROM {CL}) GROUP BY 1, 2 HAVING count(*) >= 3"


@query("xs_ic_series", "date factor", "ic rank_ic", "n", sql=ICD, tables="returns")
def xs_ic_series(t):
    return FA.ic_by_date(long_by_date(t))


ICS = f"SELECT factor, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN ic > 0 THEN 1 WHEN ic IS NOT NULL THEN 0 END) AS positive_ratio, count(ic) AS n, avg(ic) / nullif(stddev_samp(ic), 0) AS ir FROM ({ICD}) GROUP BY factor"


def horizons(t):
    d = panel(t).withColumns({f"h{h}": F.try_divide(S.lead("close", h), "close") - 1 for h in (1, 5, 10, 20)})
    return d.select("symbol", "date", F.col("momentum").alias("value"), *[f"h{h}" for h in (1, 5, 10, 20)]).unpivot(["symbol", "date", "value"], [f"h{h}" for h in (1, 5, 10, 20)], "factor", "fwd")


HL = f"(SELECT symbol, date, value, factor, fwd FROM (SELECT symbol, date, momentum AS value, " + ", ".join(f"lead(close, {h}) OVER (PARTITION BY symbol ORDER BY date) / nullif(close, 0) - 1 AS h{h}" for h in (1, 5, 10, 20)) + f" FROM ({FP})) UNPIVOT (fwd FOR factor IN (h1, h5, h10, h20)) WHERE value IS NOT NULL)"
ICP = (f"WITH i AS (SELECT date, factor, covar_samp(value, fwd) / nullif(stddev_samp(value) * stddev_samp(fwd), 0) AS ic, count(*) AS n FROM {HL} GROUP BY 1, 2 HAVING count(*) >= 3), s AS (SELECT factor, avg(ic) AS ic_mean, stddev_samp(ic) AS ic_std, avg(CASE WHEN ic > 0 THEN 1 WHEN ic IS NOT NULL THEN 0 END) AS positive_ratio, count(ic) AS n, avg(ic) / nullif(stddev_samp(ic), 0) AS ir FROM i GROUP BY 1), "
       f"b AS (SELECT factor, floor((rank() OVER (PARTITION BY date, factor ORDER BY value) - 1) * 5 / count(*) OVER (PARTITION BY date, factor)) + 1 AS bucket, fwd FROM {HL}), q AS (SELECT factor, avg(CASE WHEN bucket = 5 THEN fwd END) - avg(CASE WHEN bucket = 1 THEN fwd END) AS spread FROM b GROUP BY 1) SELECT s.*, spread, abs(ic_mean) * 0.4 + abs(ir) * 0.3 + positive_ratio * 0.3 AS score FROM s JOIN q USING (factor)")


@query("ic_by_forward_period", "factor", "ic_mean ic_std positive_ratio ir spread score", "n", sql=ICP, tables="returns")
def ic_by_forward_period(t):
    """One factor against four horizons; the horizon takes the factor column's place."""
    h = horizons(t)
    s = FA.ic_summary(FA.ic_by_date(h))
    d = s.join(FA.long_short(FA.quantile_returns(h)), "factor")
    return d.withColumn("score", F.abs("ic_mean") * 0.4 + F.abs("ir") * 0.3 + F.col("positive_ratio") * 0.3)


QSF = Sql("symbol, factor", "date")


@query("rolling_ic", KF, "rolling_ic", sql=chain(f"({FL})", {"rolling_ic": QSF.corr("value", "fwd", 20, lo=-20, hi=-1)}), tables="returns")
def rolling_ic(t):
    return FA.rolling_ic(long(t))


BK = f"SELECT *, CAST(floor((rank() OVER ({DFW} ORDER BY value) - 1) * 5 / count(*) OVER ({DFW})) + 1 AS INTEGER) AS bucket FROM {CL}"


@query("quantile_returns", "factor bucket", "mean_fwd", "n", sql=f"SELECT factor, bucket, avg(fwd) AS mean_fwd, count(*) AS n FROM ({BK}) GROUP BY 1, 2", tables="returns")
def quantile_returns(t):
    return FA.quantile_returns(long(t))


LAY = (f"WITH b AS ({BK}), dd AS (SELECT date, row_number() OVER (ORDER BY date) AS dp FROM (SELECT DISTINCT date FROM b)), x AS (SELECT b.*, dp FROM b JOIN dd USING (date)), "
       "g AS (SELECT c.factor, c.date, c.bucket, avg(c.fwd) AS raw, count(*) AS n, count(p.symbol) AS kept, max(c.dp) AS dp FROM x c LEFT JOIN x p ON p.symbol = c.symbol AND p.factor = c.factor AND p.dp = c.dp - 1 AND p.bucket = c.bucket GROUP BY 1, 2, 3), "
       "h AS (SELECT g.*, (SELECT q.n FROM g q WHERE q.factor = g.factor AND q.bucket = g.bucket AND q.dp = g.dp - 1) AS pn FROM g), t AS (SELECT *, CASE WHEN pn IS NULL THEN 1 ELSE 1 - kept / pn END AS turnover FROM h) SELECT *, raw - turnover * 0.001::DOUBLE AS net FROM t")


@query("layer_returns_with_cost", "factor date bucket", "raw turnover net", "n", sql=LAY, tables="returns")
def layer_returns_with_cost(t):
    return FA.layer_returns(long(t))


TCV = (f"WITH dd AS (SELECT date, row_number() OVER (ORDER BY date) AS dp FROM (SELECT DISTINCT date FROM returns)), x AS (SELECT l.*, dp FROM ({FL}) l JOIN dd USING (date)), cov AS (SELECT date, factor, count(value) / count(*) AS coverage FROM x GROUP BY 1, 2), "
       "j AS (SELECT c.date, c.factor, c.value, p.value AS pv FROM x c JOIN x p ON p.symbol = c.symbol AND p.factor = c.factor AND p.dp = c.dp - 1 WHERE c.value IS NOT NULL AND p.value IS NOT NULL), "
       f"r AS (SELECT date, factor, {rnk('value', 'date, factor')} AS a, {rnk('pv', 'date, factor')} AS b FROM j), g AS (SELECT date, factor, covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0) AS c, count(*) AS n FROM r GROUP BY 1, 2) "
       "SELECT cov.*, coalesce(CASE WHEN n >= 5 THEN least(greatest(1 - coalesce(c, 0), 0), 1) ELSE 0 END, 0) AS turnover FROM cov LEFT JOIN g USING (date, factor)")


@query("factor_turnover_coverage", "date factor", "coverage turnover", sql=TCV, tables="returns", staged=True)
def factor_turnover_coverage(t):
    return FA.turnover_coverage(long(t))


STB = (f"WITH i AS (SELECT *, row_number() OVER (PARTITION BY factor ORDER BY date DESC) - 1 AS age FROM ({ICD})), g AS (SELECT factor, avg(ic) AS m, stddev_pop(ic) AS s, regr_slope(abs(ic), age) AS slope, count(ic) AS n FROM i WHERE age < 20 GROUP BY 1) "
       "SELECT factor, n, slope, CASE WHEN n >= 3 THEN least(greatest(1 - s / nullif(abs(m), 0), 0), 1) ELSE 0 END AS stability, CASE WHEN n >= 10 AND slope < -0.001 THEN 1 ELSE 0 END AS decaying FROM g")


@query("factor_stability_decay", "factor", "slope stability", "n decaying", sql=STB, tables="returns")
def factor_stability_decay(t):
    return FA.stability_decay(FA.ic_by_date(long(t)))


def pairs_sql(thr):
    cs = sorted(FC)
    u = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS corr, count(*) AS n FROM p WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for i, a in enumerate(cs) for b in cs[i + 1:])
    return f"WITH p AS ({FP}), u AS ({u}) SELECT * FROM u WHERE abs(corr) > {thr}"


@query("factor_correlation_risk", "a b", "corr", "n", sql=pairs_sql(0.05), tables="returns")
def factor_correlation_risk(t):
    return REL.column_pairs(panel(t), FC).where(F.abs("corr") > 0.05)


ALQ = (f"WITH ic AS ({ICT}), st AS ({STB}), cv AS (SELECT factor, count(value) / count(*) AS coverage FROM ({FL}) GROUP BY 1), pr AS ({pairs_sql(0)}) SELECT factor, 'low_ic' AS alert, 'medium' AS level, abs(ic) AS value, 0.02 AS threshold FROM ic WHERE abs(ic) < 0.02 "
       "UNION ALL SELECT factor, 'unstable', 'high', stability, 0.5 FROM st WHERE stability < 0.5 UNION ALL SELECT factor, 'decay', CASE WHEN abs(slope) > 0.01 THEN 'critical' ELSE 'high' END, abs(slope), 0.001 FROM st WHERE decaying = 1 "
       "UNION ALL SELECT factor, 'low_coverage', 'medium', coverage, 0.95 FROM cv WHERE coverage < 0.95 UNION ALL SELECT a || '-' || b, 'correlated', 'medium', abs(corr), 0.2 FROM pr WHERE abs(corr) > 0.2")


@query("factor_alerts", "factor alert level", "value threshold", sql=ALQ, tables="returns")
def factor_alerts(t):
    fl = long(t)
    cover = fl.groupBy("factor").agg((F.count("value") / F.count(F.lit(1))).alias("coverage"))
    return FA.alerts(FA.ic_total(fl), FA.stability_decay(FA.ic_by_date(fl)), cover, REL.column_pairs(panel(t), FC), cover_min=0.95)


@query("filter_by_performance", "factor", "ic_mean ir positive_ratio", sql=f"SELECT * FROM ({ICS}) WHERE abs(ic_mean) > 0.005 AND abs(ir) > 0.05 AND positive_ratio > 0.3", tables="returns")
def filter_by_performance(t):
    return FA.ic_summary(FA.ic_by_date(long(t))).where((F.abs("ic_mean") > 0.005) & (F.abs("ir") > 0.05) & (F.col("positive_ratio") > 0.3))


@query("factor_weights_ic_ir_equal", "factor", "w_equal w_ic w_ir", sql=f"SELECT factor, 1.0 / count(*) OVER () AS w_equal, abs(ic_mean) / sum(abs(ic_mean)) OVER () AS w_ic, abs(ir) / sum(abs(ir)) OVER () AS w_ir FROM ({ICS})", tables="returns")
def factor_weights_ic_ir_equal(t):
    return FA.simple_weights(FA.ic_summary(FA.ic_by_date(long(t))))


@query("greedy_correlation_filter", "factor", "", "kept")
def greedy_correlation_filter(t):
    """Pair correlations come from Spark; the pass over the short list of column names runs on the driver."""
    pairs = [(r["a"], r["b"], r["corr"]) for r in REL.column_pairs(panel(t), FC).collect()]
    kept = FA.greedy_filter(pairs, FC, 0.3)
    return long(t).select("factor").distinct().withColumn("kept", F.col("factor").isin(kept).cast("int"))


PERF = f"SELECT date, factor, avg(z * fwd) AS perf FROM (SELECT *, (value - avg(value) OVER ({DFW})) / nullif(stddev_samp(value) OVER ({DFW}), 0) AS z FROM {CL}) GROUP BY 1, 2"


CMB = (f"WITH w AS (SELECT factor, abs(ic_mean) / sum(abs(ic_mean)) OVER () AS w FROM ({ICS})), z AS (SELECT *, (value - avg(value) OVER ({DFW})) / nullif(stddev_samp(value) OVER ({DFW}), 0) AS z FROM ({FL})) SELECT symbol, date, sum(coalesce(z, 0) * w) AS combined FROM z JOIN w USING (factor) GROUP BY 1, 2")


@query("combine_factors", "symbol date", "combined", sql=CMB, tables="returns")
def combine_factors(t):
    fl = long(t)
    return FA.combine(fl, FA.simple_weights(FA.ic_summary(FA.ic_by_date(fl))))


REG = "SELECT date, CASE WHEN mret > 0 THEN 'up' ELSE 'down' END AS regime FROM market_returns"


def npos(c):
    return f"CASE WHEN sum(greatest(coalesce({c}, 0), 0)) OVER () > 0 THEN greatest(coalesce({c}, 0), 0) / sum(greatest(coalesce({c}, 0), 0)) OVER () ELSE 1.0 / count(*) OVER () END"


ADW = (f"WITH p AS ({PERF}), r AS ({REG}), c AS (SELECT arg_max(regime, date) AS cur FROM r), d AS (SELECT p.*, r.regime, c.cur, row_number() OVER (PARTITION BY factor ORDER BY date DESC) AS age FROM p JOIN r USING (date) CROSS JOIN c), "
       "g AS (SELECT factor, avg(CASE WHEN regime = cur THEN perf END) AS rg, 0.6 * avg(CASE WHEN age <= 20 THEN perf END) + 0.4 * avg(CASE WHEN age <= 60 THEN perf END) AS mo, avg(perf) / (stddev_samp(perf) + 1e-8::DOUBLE) AS sh FROM d GROUP BY 1), "
       f"w AS (SELECT factor, {npos('rg')} AS w_regime, {npos('mo')} AS w_momentum, {npos('sh')} AS w_risk FROM g) SELECT *, 0.4 * w_regime + 0.3 * w_momentum + 0.3 * w_risk AS weight FROM w")


@query("adaptive_weights_regime_momentum_risk", "factor", "w_regime w_momentum w_risk weight", sql=ADW, tables="returns market_returns", staged=True)
def adaptive_weights_regime_momentum_risk(t):
    reg = t.market_returns().select("date", F.when(F.col("mret") > 0, "up").otherwise("down").alias("regime"))
    return FA.adaptive_weights(FA.factor_performance(long(t)), reg)


ROT = chain(f"({PERF})", {"momentum": QF.mean("perf", 20)}, {"z": f"(momentum - {QF.mean('momentum', 60)}) / nullif({QF.std('momentum', 60)}, 0)"}, {"signal": "CASE WHEN z > 0.1 THEN 1.0 WHEN z < -0.1 THEN -1.0 ELSE 0.0 END"},
            {"raw_weight": "coalesce(signal / nullif(sum(abs(signal)) OVER (PARTITION BY date), 0), 0)"}, {"sd": "stddev_samp(raw_weight) OVER (PARTITION BY date)"}, {"weight": "raw_weight * coalesce(CASE WHEN sd IS NOT NULL THEN least(greatest(0.15 / (sd + 1e-8::DOUBLE), 0.5), 2.0) END, 2.0)"})


@query("factor_rotation", "date factor", "momentum z signal raw_weight weight", sql=ROT, tables="returns")
def factor_rotation(t):
    return FA.rotation(FA.factor_performance(long(t)))


MTF = chain("returns", {"sh": Q.pct("close", 5), "me": Q.pct("close", 20), "lo": Q.pct("close", 60)}, {k: f"({c} - avg({c}) OVER (PARTITION BY date)) / nullif(stddev_samp({c}) OVER (PARTITION BY date), 0)" for k, c in (("a", "sh"), ("b", "me"), ("c", "lo"))},
            {"blend": "0.2 * coalesce(a, 0) + 0.5 * coalesce(b, 0) + 0.3 * coalesce(c, 0)", "agreement": "abs(coalesce(sign(a), 0) + coalesce(sign(b), 0) + coalesce(sign(c), 0)) / 3.0"})


@query("multi_timeframe_blend", "symbol date", "blend agreement", sql=MTF, tables="returns")
def multi_timeframe_blend(t):
    d = t.returns().withColumns({"short": S.pct("close", 5), "medium": S.pct("close", 20), "long_": S.pct("close", 60)})
    z = FA.zscore(unpivot(d, ["symbol", "date"], ["short", "medium", "long_"], "factor", "value"))
    return FA.multi_timeframe(z)


TSI = (f"WITH sc AS ({FSW}), tm AS ({chain('market_returns', {'mo': QI.mean('mret', 20), 'sd': QI.std('mret', 20)}, final='SELECT date, 1 + coalesce(mo / nullif(sd, 0), 0) AS timing FROM {src}')}), d AS (SELECT sc.*, timing, score * timing AS integrated FROM sc JOIN tm USING (date)), "
       "c AS (SELECT *, least(greatest(integrated, 0.001::DOUBLE), 0.05::DOUBLE) AS c FROM d) SELECT symbol, date, integrated, c / nullif(sum(c) OVER (PARTITION BY date), 0) AS weight FROM c")


@query("timing_selection_integration", "symbol date", "integrated weight", sql=TSI, tables="returns market_returns", staged=True)
def timing_selection_integration(t):
    s = Series((), ("date",))
    tm = t.market_returns().select("date", (1 + F.coalesce(F.try_divide(s.mean("mret", 20), s.std("mret", 20)), F.lit(0.0))).alias("timing"))
    return FA.timing_selection(FA.weighted_score(long(t), WTS), tm)


# --- U ----------------------------------------------------------------------------------------
def exposure_panel(t):
    """Per-date z-scores of the factor panel, wide, with the forward return."""
    z = FA.zscore(FA.complete(long(t)))
    return z.groupBy("symbol", "date").pivot("factor", FC).agg(F.first("z")).join(panel(t).select("symbol", "date", "fwd"), ["symbol", "date"])


def elimination(src: str, names: list[str], keep: str) -> str:
    """Solution of the systems a, b of a table by Gaussian elimination, one CTE per pivot."""
    k = len(names)
    ctes, cur = [], src
    for p in range(k):
        cols = [f"a{i}{j} - a{i}{p} / a{p}{p} * a{p}{j} AS a{i}{j}" if i > p else f"a{i}{j}" for i in range(k) for j in range(k)]
        cols += [f"b{i} - a{i}{p} / a{p}{p} * b{p} AS b{i}" if i > p else f"b{i}" for i in range(k)]
        ctes.append(f"g{p}_ AS (SELECT {keep}, {', '.join(cols)} FROM {cur})")
        cur = f"g{p}_"
    for p in reversed(range(k)):
        known = "".join(f" - a{p}{j} * x{j}" for j in range(p + 1, k))
        ctes.append(f"h{p}_ AS (SELECT *, (b{p}{known}) / a{p}{p} AS x{p} FROM {cur})")
        cur = f"h{p}_"
    return f"{', '.join(ctes)} SELECT {keep}, {', '.join(f'x{i} AS {n}' for i, n in enumerate(names))} FROM {cur}"


K4 = range(len(FC))
CSR = (f"WITH z AS (SELECT *, (value - avg(value) OVER ({DFW})) / nullif(stddev_samp(value) OVER ({DFW}), 0) AS z FROM {CL}), "
       f"e AS (SELECT symbol, date, max(fwd) AS y, {', '.join(f'max(z) FILTER (WHERE factor = {chr(39)}{f}{chr(39)}) AS x{i}' for i, f in enumerate(FC))} FROM z GROUP BY 1, 2), "
       f"s AS (SELECT date, count(*) AS n, {', '.join(f'sum(x{i} * x{j}) AS a{i}{j}' for i in K4 for j in K4)}, {', '.join(f'sum(x{i} * y) AS b{i}' for i in K4)} FROM e "
       f"WHERE y IS NOT NULL AND {' AND '.join(f'x{i} IS NOT NULL' for i in K4)} GROUP BY 1 HAVING count(*) >= 10), " + elimination("s", FC, "date, n"))


@query("factor_returns_cross_sectional", "date", " ".join(FC), "n", sql=CSR, tables="returns")
def factor_returns_cross_sectional(t):
    return PO.cross_sectional_returns(exposure_panel(t), FC)


DCV = (f"WITH p AS ({PERF}), m AS (SELECT *, perf - avg(perf) OVER (PARTITION BY factor) AS c, count(*) OVER (PARTITION BY factor) - row_number() OVER (PARTITION BY factor ORDER BY date) AS age FROM p) "
       "SELECT x.factor AS a, y.factor AS b, sum(pow(0.94::DOUBLE, x.age) * x.c * y.c) / sum(pow(0.94::DOUBLE, x.age)) AS cov FROM m x JOIN m y ON x.date = y.date AND x.factor <= y.factor GROUP BY 1, 2")


def perf_wide(t):
    return FA.factor_performance(long(t)).groupBy("date").pivot("factor", FC).agg(F.first("perf"))


@query("factor_covariance_decay", "a b", "cov", sql=DCV.replace(f"({PERF})", f"(SELECT * FROM ({PERF}) WHERE date IN (SELECT date FROM ({PERF}) GROUP BY date HAVING count(*) = 4))"), tables="returns")
def factor_covariance_decay(t):
    w = perf_wide(t)
    return PO.decay_covariance(w.dropna(), sorted(FC))


RES = f"WITH p AS ({PERF}), z AS (SELECT *, (value - avg(value) OVER ({DFW})) / nullif(stddev_samp(value) OVER ({DFW}), 0) AS z FROM {CL}) SELECT z.symbol, z.date, max(fwd) - sum(z * perf) AS residual FROM z JOIN p USING (date, factor) GROUP BY 1, 2"
SPR = f"WITH r AS (SELECT *, count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY date) AS age FROM ({RES}) WHERE residual IS NOT NULL) SELECT symbol, stddev_samp(residual) AS residual_std, sqrt(sum(pow(0.94::DOUBLE, age) * residual * residual) / sum(pow(0.94::DOUBLE, age))) AS decay_risk, count(*) AS n FROM r GROUP BY 1"


@query("specific_risk", "symbol", "residual_std decay_risk", "n", sql=SPR, tables="returns")
def specific_risk(t):
    fl = FA.complete(long(t))
    z = FA.zscore(fl).select("symbol", "date", "factor", F.col("z").alias("value"), "fwd")
    return PO.specific_risk(PO.residuals(z, FA.factor_performance(fl).withColumnRenamed("perf", "fret")))


FMR = (f"WITH e AS ({EXPO}), fr AS ({FRET}), fc AS (SELECT x.factor AS a, y.factor AS b, covar_samp(x.fret, y.fret) AS cov FROM fr x JOIN fr y ON x.date = y.date AND x.factor <= y.factor GROUP BY 1, 2), pe AS (SELECT portfolio, factor, sum(weight * exposure) AS x FROM weights JOIN e USING (symbol) GROUP BY 1, 2), "
       "f AS (SELECT p.portfolio, sum(CASE WHEN a = b THEN 1 ELSE 2 END * p.x * q.x * cov) AS factor_risk FROM fc JOIN pe p ON p.factor = a JOIN pe q ON q.factor = b AND q.portfolio = p.portfolio GROUP BY 1), s AS (SELECT portfolio, sum(weight * weight * sp * sp) AS specific_risk FROM weights JOIN (SELECT symbol, stddev_samp(ret) AS sp FROM returns GROUP BY 1) USING (symbol) GROUP BY 1) "
       "SELECT *, sqrt((factor_risk + specific_risk) * 252) AS total_risk FROM f JOIN s USING (portfolio)")


@query("factor_model_portfolio_risk", "portfolio", "factor_risk specific_risk total_risk", sql=FMR, tables="weights returns_market", staged=True)
def factor_model_portfolio_risk(t):
    sp = t.returns().groupBy("symbol").agg(F.stddev_samp("ret").alias("specific"))
    ex = materialise(exposures(t), "exposures")
    return PO.model_risk(t.weights(), ex, factor_covariance(t, ex), sp)


TNW = (f"WITH d AS (SELECT symbol, date, momentum AS score, volatility AS vol FROM ({FP}) WHERE momentum IS NOT NULL AND volatility IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY momentum DESC, symbol) <= 10), "
       "e AS (SELECT *, 1.0 / count(*) OVER w AS w_equal, score - min(score) OVER w + 1e-8::DOUBLE AS s, (1 / nullif(vol, 0)) / sum(1 / nullif(vol, 0)) OVER w AS iv FROM d WINDOW w AS (PARTITION BY date)), c AS (SELECT *, least(greatest(iv, 0.02::DOUBLE), 0.2::DOUBLE) AS c FROM e) "
       "SELECT symbol, date, score, w_equal, s / sum(s) OVER (PARTITION BY date) AS w_score, c / sum(c) OVER (PARTITION BY date) AS w_inverse_vol FROM c")


def top_weights(t):
    d = panel(t).select("symbol", "date", F.col("momentum").alias("score"), F.col("volatility").alias("vol")).where(F.col("score").isNotNull() & F.col("vol").isNotNull())
    return PO.top_n_weights(d)


@query("portfolio_top_n_weights", "symbol date", "score w_equal w_score w_inverse_vol", sql=TNW, tables="returns")
def portfolio_top_n_weights(t):
    return top_weights(t)


@query("portfolio_weights_metrics", "portfolio", "total max_weight min_weight hhi gross effective_n", "n", sql="SELECT portfolio, sum(weight) AS total, max(weight) AS max_weight, min(weight) AS min_weight, sum(weight * weight) AS hhi, sum(abs(weight)) AS gross, 1 / sum(weight * weight) AS effective_n, count(*) AS n FROM weights GROUP BY 1", tables="weights")
def portfolio_weights_metrics(t):
    return PO.weight_metrics(t.weights())


GRD = ("WITH w AS (SELECT symbol AS id, " + ", ".join(f"(symbol * {p} + {i}) % 7 + 1 AS c{i}" for i, p in enumerate((1, 3, 5, 2, 4))) + " FROM (SELECT DISTINCT symbol FROM bars)), g AS (" + " UNION ALL ".join(f"SELECT id, '{s}' AS asset, c{i}::DOUBLE / (c0 + c1 + c2 + c3 + c4) AS weight FROM w" for i, s in enumerate(SECTORS)) +
       f"), s AS ({SR}), st AS (SELECT sector AS asset, avg(ret) AS mu FROM s GROUP BY 1), cv AS (SELECT a.sector AS a, b.sector AS b, covar_samp(a.ret, b.ret) AS cov FROM s a JOIN s b ON a.date = b.date AND a.sector <= b.sector GROUP BY 1, 2), "
       "r AS (SELECT id, sum(weight * mu) AS ret FROM g JOIN st USING (asset) GROUP BY 1), v AS (SELECT x.id, sum(CASE WHEN a = b THEN 1 ELSE 2 END * x.weight * y.weight * cov) AS var FROM g x JOIN cv ON x.asset = a JOIN g y ON y.asset = b AND y.id = x.id GROUP BY 1), "
       "d AS (SELECT id, ret, sqrt(var) AS risk, ret / nullif(sqrt(var), 0) AS sharpe, CAST(floor(sqrt(var) * 20) AS BIGINT) AS risk_bucket FROM r JOIN v USING (id)) SELECT *, CASE WHEN row_number() OVER (PARTITION BY risk_bucket ORDER BY round(ret, 9) DESC, id) = 1 THEN 1 ELSE 0 END AS efficient FROM d")


@query("portfolio_grid_evaluate", "id", "ret risk sharpe", "risk_bucket efficient", sql=GRD, tables="returns sector")
def portfolio_grid_evaluate(t):
    """One candidate weight vector over the five sectors per symbol id."""
    ids = t.bars().select(F.col("symbol").alias("id")).distinct()
    c = [((F.col("id") * p + i) % 7 + 1).cast("double") for i, p in enumerate((1, 3, 5, 2, 4))]
    tot = c[0] + c[1] + c[2] + c[3] + c[4]
    grid = ids.select("id", F.explode(F.array(*[F.struct(F.lit(s).alias("asset"), (x / tot).alias("weight")) for s, x in zip(SECTORS, c)])).alias("g")).select("id", "g.*")
    wide = sector_wide(t)
    row = wide.agg(F.array(*[F.struct(F.lit(s).alias("asset"), F.avg(F.col(f"`{s}`")).alias("mu")) for s in SECTORS]).alias("m"),
                   F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.covar_samp(F.col(f"`{a}`"), F.col(f"`{b}`")).alias("cov")) for i, a in enumerate(SECTORS) for b in SECTORS[i:]]).alias("c"))
    stats = row.select(F.explode("m").alias("x")).select("x.*")
    cov = row.select(F.explode("c").alias("x")).select("x.*")
    return PO.grid_evaluate(grid, stats, cov)


@query("constraint_checks", "portfolio", "total lowest turnover max_sector", "sum_violation long_only_violation sector_violation turnover_violation",
       sql="WITH w AS (SELECT p.portfolio, p.symbol, p.sector, weight, 1.0 / count(*) OVER (PARTITION BY p.portfolio) AS old_weight FROM weights JOIN positions p USING (portfolio, symbol)), s AS (SELECT portfolio, max(sw) AS max_sector FROM (SELECT portfolio, sector, sum(weight) AS sw FROM w GROUP BY 1, 2) GROUP BY 1), "
           "g AS (SELECT portfolio, sum(weight) AS total, min(weight) AS lowest, sum(abs(weight - old_weight)) / 2 AS turnover FROM w GROUP BY 1) SELECT *, CASE WHEN abs(total - 1) > 1e-6 THEN 1 ELSE 0 END AS sum_violation, CASE WHEN lowest < 0 THEN 1 ELSE 0 END AS long_only_violation, CASE WHEN max_sector > 0.5 THEN 1 ELSE 0 END AS sector_violation, CASE WHEN turnover > 0.3 THEN 1 ELSE 0 END AS turnover_violation FROM g JOIN s USING (portfolio)", tables="weights positions")
def constraint_checks(t):
    w = with_group_stats(t.weights(), ["portfolio"], {"_n": F.count(F.lit(1))}).withColumn("old_weight", F.lit(1.0) / F.col("_n"))
    return PO.constraint_checks(w, t.sector().select("symbol", "sector"))


@query("rebalance_dates", "date", "", "monthly weekly daily",
       sql="WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders) SELECT date, CASE WHEN date = max(date) OVER (PARTITION BY date_trunc('month', date)) THEN 1 ELSE 0 END AS monthly, CASE WHEN isodow(date) = 5 THEN 1 ELSE 0 END AS weekly, 1 AS daily FROM d")
def rebalance_dates(t):
    return PO.rebalance_dates(t.read("orders").select(F.to_date("o_orderdate").alias("date")))


@query("performance_attribution", "portfolio date factor", "contribution",
       sql=f"WITH e AS ({EXPO}), fr AS ({FRET}), pe AS (SELECT portfolio, factor, sum(weight * exposure) AS x FROM weights JOIN e USING (symbol) GROUP BY 1, 2) SELECT portfolio, date, factor, x * fret AS contribution FROM pe JOIN fr USING (factor)", tables="weights returns_market", staged=True)
def performance_attribution(t):
    ex = materialise(exposures(t), "exposures")
    fr = ex.join(t.returns().where(F.col("ret").isNotNull()).select("symbol", "date", "ret"), "symbol").groupBy("date", "factor").agg(F.avg(F.col("exposure") * F.col("ret")).alias("fret"))
    pe = t.weights().join(ex, "symbol").groupBy("portfolio", "factor").agg(F.sum(F.col("weight") * F.col("exposure")).alias("x"))
    return pe.join(fr, "factor").withColumn("contribution", F.col("x") * F.col("fret"))


@query("portfolio_turnover", "portfolio date", "turnover", "n",
       sql=f"WITH w AS (SELECT 0 AS portfolio, date, symbol, w_equal AS weight FROM ({TNW})), d AS (SELECT date, lag(date) OVER (ORDER BY date) AS prv FROM (SELECT DISTINCT date FROM w)), u AS (SELECT d.date, w.symbol, w.weight AS w1, 0 AS w0 FROM d JOIN w ON w.date = d.date WHERE prv IS NOT NULL UNION ALL SELECT d.date, w.symbol, 0, w.weight FROM d JOIN w ON w.date = d.prv), "
           "p AS (SELECT date, symbol, sum(w1) AS w1, sum(w0) AS w0 FROM u GROUP BY 1, 2) SELECT CAST(0 AS BIGINT) AS portfolio, date, sum(abs(w1 - w0)) / 2 AS turnover, count(*) AS n FROM p GROUP BY date", tables="returns")
def portfolio_turnover(t):
    w = top_weights(t).select(F.lit(0).cast("long").alias("portfolio"), "date", "symbol", F.col("w_equal").alias("weight"))
    return PO.turnover(w)

