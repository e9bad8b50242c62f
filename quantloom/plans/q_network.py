"""Queries of networks, data quality and feature bundles."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from quantloom.functions.series import Series
from quantloom.operators import features as FE
from quantloom.operators import network as NW
from quantloom.operators import quality as DQ
from quantloom.operators import relational as REL
from quantloom.plans.q_basics import DED, SUPPLY
from quantloom.plans.q_state_fund import aligned
from quantloom.plans.q_technical import GL, rsi
from quantloom.plans.registry import query
from quantloom.plans.sql import Q, chain, flag

K = "symbol date"
TH = 0.2
IDX = ("ix AS (SELECT date, row_number() OVER (ORDER BY date) AS dp FROM (SELECT DISTINCT date FROM industry_panel)), p AS (SELECT i.*, dp FROM industry_panel i JOIN ix USING (date)), "
       "c AS (SELECT e.date, a.symbol AS a, b.symbol AS b, corr(a.ret, b.ret) AS corr, count(*) AS n FROM ix e JOIN p a ON a.dp BETWEEN e.dp - 59 AND e.dp JOIN p b ON b.dp = a.dp AND a.symbol < b.symbol WHERE e.dp >= 60 GROUP BY 1, 2, 3 HAVING count(*) >= 30), "
       "nd AS (SELECT e.date, count(DISTINCT a.symbol) AS k FROM ix e JOIN p a ON a.dp BETWEEN e.dp - 59 AND e.dp WHERE e.dp >= 60 GROUP BY 1), ed AS (SELECT * FROM c WHERE abs(corr) > 0.2), sy AS (SELECT date, a, b FROM ed UNION ALL SELECT date, b, a FROM ed)")


@query("corr_network_edges", "date a b", "corr", sql=f"WITH {IDX} SELECT * FROM ed", tables="industry_panel")
def corr_network_edges(t):
    return NW.edges(t.industry_panel(), 60, TH)


@query("network_density_degree", "date", "density avg_degree max_degree avg_corr max_corr std_corr", "nodes",
       sql=f"WITH {IDX}, dg AS (SELECT date, a, count(*) AS d FROM sy GROUP BY 1, 2), g AS (SELECT date, avg(corr) AS avg_corr, max(corr) AS max_corr, stddev_pop(corr) AS std_corr, count(*) FILTER (WHERE abs(corr) > 0.2) AS e FROM c GROUP BY 1), m AS (SELECT date, max(d) AS max_degree FROM dg GROUP BY 1) "
           "SELECT g.date, k AS nodes, e * 2 / (k * (k - 1)) AS density, e * 2 / k AS avg_degree, coalesce(max_degree, 0) AS max_degree, avg_corr, max_corr, std_corr FROM g JOIN nd USING (date) LEFT JOIN m USING (date)", tables="industry_panel")
def network_density_degree(t):
    return NW.density_degree(t.industry_panel(), 60, TH)


@query("network_clustering", "date node", "clustering degree",
       sql=f"WITH {IDX}, nds AS (SELECT DISTINCT e.date, a.symbol AS node FROM ix e JOIN p a ON a.dp BETWEEN e.dp - 59 AND e.dp WHERE e.dp >= 60), dg AS (SELECT date, a AS node, count(*) AS d FROM sy GROUP BY 1, 2), "
           "tr AS (SELECT x.date, x.a AS node, count(*) AS t FROM sy x JOIN sy y ON y.date = x.date AND y.a = x.a AND x.b < y.b JOIN sy z ON z.date = x.date AND z.a = x.b AND z.b = y.b GROUP BY 1, 2) "
           "SELECT n.date, n.node, coalesce(d, 0) AS degree, CASE WHEN d > 1 THEN coalesce(t, 0) / (d * (d - 1) / 2) ELSE 0 END AS clustering FROM nds n LEFT JOIN dg USING (date, node) LEFT JOIN tr USING (date, node)", tables="industry_panel")
def network_clustering(t):
    return NW.clustering(t.industry_panel(), 60, TH)


@query("network_components", "date", "", "components largest",
       sql=f"WITH RECURSIVE {IDX}, nds AS (SELECT DISTINCT e.date, a.symbol AS node FROM ix e JOIN p a ON a.dp BETWEEN e.dp - 59 AND e.dp WHERE e.dp >= 60), "
           "rc AS (SELECT date, node AS s, node FROM nds UNION SELECT rc.date, rc.s, sy.b FROM rc JOIN sy ON sy.date = rc.date AND sy.a = rc.node), lb AS (SELECT date, node, min(s) AS label FROM rc GROUP BY 1, 2), z AS (SELECT date, label, count(*) AS n FROM lb GROUP BY 1, 2) SELECT date, count(*) AS components, max(n) AS largest FROM z GROUP BY 1", tables="industry_panel")
def network_components(t):
    corr, nodes = NW.windowed_network(t.industry_panel(), 60)
    lab = NW.connected_components(NW.over(corr, TH), nodes)
    return lab.groupBy("date", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("date").agg(F.count(F.lit(1)).alias("components"), F.max("n").alias("largest"))


CON = chain("(SELECT *, (sum(ret) OVER (PARTITION BY date) - ret) / nullif(count(*) OVER (PARTITION BY date) - 1, 0) AS rest FROM returns WHERE ret IS NOT NULL)", {"corr_now": Q.corr("ret", "rest", 60), "corr_before": Q.corr("ret", "rest", 60, lo=-119, hi=-60)}, {"contagion": "corr_now - corr_before"})


@query("network_contagion", K, "corr_now corr_before contagion", sql=CON, tables="returns")
def network_contagion(t):
    return NW.contagion(t.returns())


@query("industry_network", K, "inter_corr", sql=f"SELECT symbol, date, mean_corr AS inter_corr FROM ({aligned('(SELECT * FROM industry_panel WHERE ret IS NOT NULL)', 30, 0)})", tables="industry_panel")
def industry_network(t):
    return NW.group_mean_correlation(t.industry_panel(), 30).withColumnRenamed("mean_corr", "inter_corr")


@query("industry_intra_network", K, "mean_corr", sql=aligned("(SELECT r.*, industry FROM returns r JOIN sector USING (symbol) WHERE ret IS NOT NULL)", 30, 0, "industry"), tables="returns sector")
def industry_intra_network(t):
    d = t.returns().where(F.col("ret").isNotNull()).join(t.sector().select("symbol", "industry"), "symbol").select("symbol", "date", "ret", "industry")
    return NW.group_mean_correlation(d, 30, ("industry",))


@query("supply_chain_factors", "symbol", "supplier_corr supplier_vol", "n",
       sql=f"WITH {SUPPLY}, g AS (SELECT s.symbol, s.supplier, corr(a.ret, b.ret) AS c, stddev_samp(b.ret) AS v, count(*) AS n FROM supply s JOIN returns a ON a.symbol = s.symbol JOIN returns b ON b.symbol = s.supplier AND b.date = a.date WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2) "
           "SELECT symbol, avg(abs(c)) AS supplier_corr, avg(v) AS supplier_vol, sum(n) AS n FROM g GROUP BY 1", tables="returns")
def supply_chain_factors(t):
    return NW.supply_chain(REL.supply_links(t.bars().select("symbol").distinct()), t.returns())


MVS = "SELECT date, mret, lag(mret) OVER (ORDER BY date) AS mlag, mv / nullif(lag(mv) OVER (ORDER BY date), 0) - 1 AS mvol FROM market_returns JOIN (SELECT date, sum(volume) AS mv FROM bars GROUP BY 1) USING (date)"


@query("market_structure", "symbol", "synchronicity lead_lag liquidity_corr",
       sql=f"WITH m AS ({MVS}), d AS (SELECT r.*, m.mret, m.mlag, m.mvol, {Q.pct('volume')} AS vc FROM returns r JOIN m USING (date)) SELECT symbol, pow(corr(ret, mret), 2) AS synchronicity, corr(ret, mlag) AS lead_lag, corr(vc, mvol) AS liquidity_corr FROM d GROUP BY 1", tables="returns market_returns")
def market_structure(t):
    s = Series((), ("date",))
    m = t.market_returns().join(t.bars().groupBy("date").agg(F.sum("volume").alias("mv")), "date").select("date", "mret", s.lag("mret").alias("mlag"), s.pct("mv").alias("mvol"))
    return NW.market_structure(t.returns().join(m, "date"))


MSS = ("WITH ix AS (SELECT date, row_number() OVER (ORDER BY date) AS dp FROM (SELECT DISTINCT date FROM returns)), r AS (SELECT symbol, dp, ret, volume, avg(ret) OVER (PARTITION BY dp) AS m FROM returns JOIN ix USING (date)), "
       "c AS (SELECT e.dp AS ep, corr(a.volume, b.volume) AS vc, count(*) AS vn, corr(a.ret, b.ret) AS rc, count(*) FILTER (WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL) AS rn FROM ix e JOIN r a ON a.dp BETWEEN e.dp - 51 AND e.dp JOIN r b ON b.dp = a.dp AND a.symbol < b.symbol WHERE e.dp >= 52 GROUP BY e.dp, a.symbol, b.symbol), "
       "l AS (SELECT e.dp AS ep, corr(a.ret, b.ret) AS lc FROM ix e JOIN r a ON a.dp BETWEEN e.dp - 50 AND e.dp JOIN r b ON b.dp = a.dp - 1 AND a.symbol <> b.symbol WHERE e.dp >= 52 AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY e.dp, a.symbol, b.symbol HAVING count(*) >= 26), "
       "f AS (SELECT e.dp AS ep, corr(ret, m) AS fc, count(ret) AS fn FROM ix e JOIN r a ON a.dp BETWEEN e.dp - 51 AND e.dp WHERE e.dp >= 52 GROUP BY e.dp, symbol), "
       "c2 AS (SELECT ep, count(*) FILTER (WHERE vn >= 26 AND abs(vc) > 0.3) AS edges, 1 - avg(CASE WHEN rn >= 26 THEN rc END) AS segmentation FROM c GROUP BY 1), l2 AS (SELECT ep, avg(abs(lc)) AS lg FROM l GROUP BY 1), "
       "f2 AS (SELECT ep, count(*) AS nodes, coalesce(avg(CASE WHEN fn >= 26 THEN fc * fc END), 0) AS price_discovery FROM f GROUP BY 1) "
       "SELECT date, nodes, coalesce(edges, 0) AS edges, coalesce(2 * coalesce(edges, 0) / nullif(nodes * (nodes - 1), 0), 0) AS liquidity_density, price_discovery, segmentation, 1 - coalesce(lg, 0) AS propagation FROM f2 JOIN ix ON dp = ep LEFT JOIN c2 USING (ep) LEFT JOIN l2 USING (ep)")


@query("market_structure_series", "date", "liquidity_density price_discovery segmentation propagation", "nodes edges", sql=MSS, tables="returns", staged=True)
def market_structure_series(t):
    return NW.structure_series(t.returns())


FC4 = ["close", "high", "low", "volume"]
PR4 = list(combinations(FC4, 2))


def e4(a, b):
    return f"e{[frozenset(x) for x in PR4].index(frozenset((a, b)))}"


def local4():
    parts = []
    for x in FC4:
        r = [c for c in FC4 if c != x]
        deg = " + ".join(e4(x, c) for c in r)
        tri = " + ".join(f"{e4(x, b)} * {e4(x, c)} * {e4(b, c)}" for b, c in combinations(r, 2))
        parts.append(f"CASE WHEN {deg} > 1 THEN ({tri}) / (({deg}) * ({deg} - 1) / 2) ELSE 0 END")
    return "(" + " + ".join(parts) + ") / 4"


#: every graph of four nodes is a mask of six edges; walks give the distances of all of them
GRAPHS = ("pr AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, {FC4.index(a)}, {FC4.index(b)})" for i, (a, b) in enumerate(PR4)) + ") v(i, a, b)), gr AS (SELECT CAST(range AS INTEGER) AS mask FROM range(64)), one AS (SELECT mask, a, b FROM gr, pr WHERE (mask >> i) & 1 = 1), ed AS (SELECT * FROM one UNION ALL SELECT mask, b, a FROM one), "
          "wk AS (SELECT mask, CAST(n.range AS INTEGER) AS s, CAST(n.range AS INTEGER) AS t, 0 AS d FROM gr, range(4) n UNION SELECT wk.mask, s, ed.b, d + 1 FROM wk JOIN ed ON ed.mask = wk.mask AND ed.a = t WHERE d < 3), "
          "sp AS (SELECT mask, s, t, min(d) AS d FROM wk GROUP BY 1, 2, 3), sz AS (SELECT mask, s, count(*) AS k, sum(d) AS tot FROM sp GROUP BY 1, 2), rt AS (SELECT mask, s, k FROM sz QUALIFY row_number() OVER (PARTITION BY mask ORDER BY k DESC, s) = 1), "
          "pl AS (SELECT rt.mask, sum(sz.tot) / nullif(any_value(rt.k) * (any_value(rt.k) - 1), 0) AS path_length FROM rt JOIN sp ON sp.mask = rt.mask AND sp.s = rt.s JOIN sz ON sz.mask = rt.mask AND sz.s = sp.t GROUP BY 1), ce AS (SELECT mask, count(*) / (count(DISTINCT a) * (count(DISTINCT a) - 1)) AS centrality FROM ed GROUP BY 1)")
MFN = chain("bars", {f"c{i}": Q.corr(a, b, 50) for i, (a, b) in enumerate(PR4)}, {f"e{i}": flag(f"abs(c{i}) > 0.5") for i in range(6)},
            {"density": "CASE WHEN c0 IS NOT NULL THEN (e0 + e1 + e2 + e3 + e4 + e5) / 6 END", "mean_abs_corr": "(abs(c0) + abs(c1) + abs(c2) + abs(c3) + abs(c4) + abs(c5)) / 6", "clustering": f"CASE WHEN c0 IS NOT NULL THEN {local4()} END",
             "mask": "CASE WHEN c0 IS NOT NULL THEN e0 + 2 * e1 + 4 * e2 + 8 * e3 + 16 * e4 + 32 * e5 END"})


@query("multi_feature_corr_network", K, "density mean_abs_corr clustering centrality path_length",
       sql=f"WITH RECURSIVE {GRAPHS}, fn AS ({MFN}) SELECT fn.*, CASE WHEN fn.mask IS NOT NULL THEN coalesce(centrality, 0) END AS centrality, path_length FROM fn LEFT JOIN ce ON ce.mask = fn.mask LEFT JOIN pl ON pl.mask = fn.mask", tables="bars")
def multi_feature_corr_network(t):
    return NW.feature_network(t.bars(), FC4)


# --- quality ----------------------------------------------------------------------------------
OHLCV = ["open", "high", "low", "close", "volume"]


def rules_sql(src, rules):
    return f"WITH d AS (SELECT count(*) AS n, {', '.join(f'count(*) FILTER (WHERE {c}) AS {k}' for k, c in rules.items())} FROM {src}) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, {k} AS violations, n AS rows FROM d" for k in rules)


SCH = {**{k: v for c in ("symbol", "date", "close") for k, v in {f"missing_column_{c}": "false", f"null_{c}": f"{c} IS NULL"}.items()}, **{f"not_numeric_{c}": "false" for c in ("open", "close")}, **{f"not_positive_{c}": f"{c} <= 0" for c in ("close", "volume")}}


@query("dq_schema_rules", "rule level", "", "violations rows", sql=f"SELECT *, CASE WHEN violations = 0 THEN 'ok' WHEN rule LIKE 'not_positive%' THEN 'warning' ELSE 'error' END AS level FROM ({rules_sql('dirty_bars', SCH)})", tables="dirty_bars")
def dq_schema_rules(t):
    return DQ.schema_rules(t.dirty_bars(), ["symbol", "date", "close"], ["open", "close"], ["close", "volume"])


PCR = {"high_below_low": "high < low", "close_outside": "close > high OR close < low", "open_outside": "open > high OR open < low", "zero_volume": "volume = 0", "missing_close": "close IS NULL"}


@query("dq_price_consistency", "rule", "", "violations rows", sql=rules_sql("dirty_bars", PCR), tables="dirty_bars")
def dq_price_consistency(t):
    return DQ.price_consistency(t.dirty_bars())


@query("dq_fundamental_consistency", "rule", "", "violations rows", sql=rules_sql("reports", {"negative_equity": "equity < 0", "extreme_margin": "abs(net_income / nullif(revenue, 0)) > 0.5", "liabilities_above_assets": "total_liabilities > total_assets", "zero_income": "net_income = 0"}), tables="reports")
def dq_fundamental_consistency(t):
    return DQ.fundamental_consistency(t.reports())


def out_sql(c):
    return (f"SELECT '{c}' AS name, count(*) AS n, count(*) FILTER (WHERE {c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS iqr_outliers, count(*) FILTER (WHERE abs(({c} - m) / nullif(s, 0)) > 3) AS z_outliers, count(*) FILTER (WHERE abs(0.6745 * ({c} - md) / nullif(mad, 0)) > 3.5) AS mz_outliers "
            f"FROM (SELECT *, quantile_cont(abs({c} - md), 0.5) OVER () AS mad FROM (SELECT {c}, quantile_cont({c}, 0.25) OVER () AS q1, quantile_cont({c}, 0.5) OVER () AS md, quantile_cont({c}, 0.75) OVER () AS q3, avg({c}) OVER () AS m, stddev_samp({c}) OVER () AS s FROM dirty_bars WHERE {c} IS NOT NULL))")


@query("dq_outliers", "name", "iqr_share", "iqr_outliers z_outliers mz_outliers n", sql="SELECT *, iqr_outliers / n AS iqr_share FROM (" + " UNION ALL ".join(out_sql(c) for c in OHLCV) + ")", tables="dirty_bars")
def dq_outliers(t):
    return DQ.outliers(t.dirty_bars(), OHLCV)


CLEAN = (f"WITH d AS ({DED}), q AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.25) AS {c}1, quantile_cont({c}, 0.75) AS {c}3" for c in ("close", "volume")) + " FROM d) SELECT d.* FROM d CROSS JOIN q WHERE " +
         " AND ".join(f"coalesce({c} BETWEEN {c}1 - 1.5 * ({c}3 - {c}1) AND {c}3 + 1.5 * ({c}3 - {c}1), true)" for c in ("close", "volume")))


@query("dq_clean", K, "close volume", sql=CLEAN, tables="dirty_bars")
def dq_clean(t):
    return DQ.clean(t.dirty_bars(), ["close", "volume"])


@query("dq_report", "name type advice", "null_share", "nulls distinct_values rows duplicates",
       sql="SELECT *, (SELECT (SELECT count(*) FROM dirty_bars) - count(*) FROM (SELECT DISTINCT * FROM dirty_bars)) AS duplicates, nulls / rows AS null_share, CASE WHEN nulls / rows > 0.5 THEN 'drop column' WHEN nulls / rows > 0.1 THEN 'interpolate' WHEN nulls > 0 THEN 'fill' WHEN distinct_values = 1 THEN 'constant' ELSE 'keep' END AS advice FROM (" + " UNION ALL ".join(
           f"SELECT '{c}' AS name, '{ty}' AS type, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, count(*) AS rows FROM dirty_bars" for c, ty in (("symbol", "bigint"), ("date", "date"), *[(c, "double") for c in OHLCV])) + ")", tables="dirty_bars")
def dq_report(t):
    return DQ.report(t.dirty_bars(), ["symbol", "date", *OHLCV])


@query("dq_completeness", "symbol first_date last_date", "completeness", "records expected",
       sql="WITH g AS (SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS records FROM bars GROUP BY 1), c AS (SELECT DISTINCT date FROM bars) SELECT g.*, n AS expected, records / n * 100 AS completeness FROM g JOIN (SELECT g.symbol, count(*) AS n FROM g JOIN c ON c.date BETWEEN first_date AND last_date GROUP BY 1) USING (symbol)", tables="bars")
def dq_completeness(t):
    return DQ.completeness(t.bars(), t.bars())


@query("dq_source_consistency", "symbol grade", "corr mean_diff_pct max_diff_pct", "common",
       sql="WITH p AS (SELECT b.symbol, b.close AS c1, s.close AS c2 FROM bars b JOIN second_source s USING (symbol, date)), g AS (SELECT symbol, count(*) AS common, corr(c1, c2) AS corr, avg(abs((c2 - c1) / c1) * 100) AS mean_diff_pct, max(abs((c2 - c1) / c1) * 100) AS max_diff_pct FROM p GROUP BY 1) "
           "SELECT *, CASE WHEN corr > 0.999 AND mean_diff_pct < 0.2 THEN 'excellent' WHEN corr > 0.99 AND mean_diff_pct < 1 THEN 'good' WHEN corr > 0.95 AND mean_diff_pct < 5 THEN 'fair' ELSE 'poor' END AS grade FROM g", tables="second_source")
def dq_source_consistency(t):
    from quantloom.plans.q_basics import source_pair_join
    return DQ.source_consistency(source_pair_join(t))


THRS = {"high_below_low": (0, 100), "close_outside": (0, 5000), "open_outside": (0, 10), "zero_volume": (0, 10000), "missing_close": (100, 1000000)}


@query("dq_metric_table", "metric status", "value warn_at fail_at",
       sql=f"WITH r AS ({rules_sql('dirty_bars', PCR)}), t AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in THRS.items()) + ") v(metric, warn_at, fail_at)) SELECT metric, violations AS value, warn_at, fail_at, CASE WHEN violations > fail_at THEN 'fail' WHEN violations > warn_at THEN 'warning' ELSE 'pass' END AS status FROM r JOIN t ON rule = metric", tables="dirty_bars")
def dq_metric_table(t):
    return DQ.metric_table(DQ.price_consistency(t.dirty_bars()).select(F.col("rule").alias("metric"), F.col("violations").cast("double").alias("value")), THRS)


# --- features ---------------------------------------------------------------------------------
TSB = {**{f"close_lag_{n}": Q.lag("close", n) for n in (1, 5)}, **{f"close_mean_{n}": Q.mean("close", n) for n in (5, 20)}, **{f"close_std_{n}": Q.std("close", n) for n in (5, 20)}, **{f"close_diff_{n}": Q.diff("close", n) for n in (1, 5)},
       "close_x_volume": "close * volume", "close_div_volume": "close / (volume + 1e-8::DOUBLE)", "ret_pow_2": "ret * ret"}


@query("feat_time_series_bundle", K, " ".join(TSB), "month dayofweek quarter", sql=chain("returns", {**TSB, "month": "month(date)", "dayofweek": "isodow(date) - 1", "quarter": "quarter(date)"}), tables="returns")
def feat_time_series_bundle(t):
    return FE.time_series_bundle(t.bars())


@query("feat_regime", K, "", "trend_5 trend_20 trend_50 high_vol momentum_regime", sql=chain("returns", {"v": Q.std("ret", 20), "m": Q.pct("close", 20)}, {**{f"trend_{n}": flag(f"close > {Q.mean('close', n)}") for n in (5, 20, 50)}, "high_vol": flag(f"v > {Q.quantile('v', 60, 0.75)}"), "momentum_regime": "CASE WHEN m > 0.1 THEN 1 WHEN m < -0.1 THEN -1 ELSE 0 END"}), tables="returns")
def feat_regime(t):
    return FE.regimes(t.closes())


@query("feat_seasonal_detrend", K, "seasonal_12 seasonal_52 residual_12 residual_52", sql=chain("bars", {f"seasonal_{p}": Q.mean("close", p) for p in (12, 52)}, {f"residual_{p}": f"close - seasonal_{p}" for p in (12, 52)}), tables="bars")
def feat_seasonal_detrend(t):
    return FE.seasonal(t.closes())


@query("feat_market_micro", K, "mid spread_pct imbalance basis basis_ma volume_ma momentum acceleration",
       sql=chain("bars", {"mid": "(high + low) / 2", "spread_pct": "(high - low) / nullif((high + low) / 2, 0) * 100", "imbalance": "(2 * close - high - low) / nullif(high - low, 0)", "basis": "(open - close) / nullif(close, 0)"}, {"basis_ma": Q.mean("basis", 20), "volume_ma": Q.mean("volume", 20), "momentum": Q.pct("mid", 5), "m1": Q.diff("mid")}, {"acceleration": Q.diff("m1")}), tables="bars")
def feat_market_micro(t):
    return FE.market_micro(t.bars())


FI = {"f_ret_5": Q.pct("close", 5), "f_ret_20": Q.pct("close", 20), "f_vol_20": Q.std("ret", 20), "f_pos_20": f"(close - {Q.min('close', 20)}) / nullif({Q.max('close', 20)} - {Q.min('close', 20)}, 0)", "f_rsi": rsi(Q.mean("g", 14), Q.mean("l", 14)),
      "f_ma_ratio": f"{Q.mean('close', 5)} / nullif({Q.mean('close', 20)}, 0)", "f_vol_ratio": f"volume / nullif({Q.mean('volume', 20)}, 0)"}
FIQ = chain("returns", {"d": Q.diff("close")}, GL, FI)


@query("feat_ml_inputs", K, " ".join(FI), sql=FIQ, tables="returns")
def feat_ml_inputs(t):
    return FE.ml_inputs(t.bars())


def prof_sql(name, cond, c):
    return f"SELECT '{name}' AS frame, '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS nulls, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, skewness({c}) AS skew FROM returns WHERE {cond}"


@query("frame_profile", "frame name", "mean std min max skew", "rows nulls", sql=" UNION ALL ".join(prof_sql(n, f"date {op} DATE '2000-01-01'", c) for n, op in (("train", "<"), ("test", ">=")) for c in ("close", "volume", "ret")), tables="returns")
def frame_profile(t):
    r = t.returns()
    return FE.frame_profile({"train": r.where(F.col("date") < "2000-01-01"), "test": r.where(F.col("date") >= "2000-01-01")}, ["close", "volume", "ret"])
