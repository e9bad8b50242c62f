"""Queries of models and model checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.series import S
from quantloom.operators import features as FE
from quantloom.operators import learning as L
from quantloom.plans.q_factors import CL, FC, FL, FP, elimination, long, panel
from quantloom.plans.q_network import FIQ
from quantloom.plans.registry import query
from quantloom.plans.sql import Q, chain, draw_stages, unit

K = "symbol date"


def model_frame(t):
    return FE.ml_inputs(t.bars()).select("symbol", "date", "ret", *FE.FEATURES, (F.try_divide(S.lead("close"), "close") - 1).alias("fwd"))


@query("pca_factors", K, "pc_1 pc_2 pc_3")
def pca_factors(t):
    return L.pca_factors(model_frame(t), FE.FEATURES)


@query("kmeans_cluster", K, "distance", "cluster")
def kmeans_cluster(t):
    return L.kmeans_cluster(model_frame(t), FE.FEATURES)


@query("ensemble_prediction", K, "p_linear p_forest p_boost p_mean p_median")
def ensemble_prediction(t):
    return L.ensemble(model_frame(t), FE.FEATURES)


@query("predict_returns_linear", K, "p_ols p_ridge p_lasso p_forest p_importance", staged=True)
def predict_returns_linear(t):
    return L.linear_predictions(panel(t), FC, forest=True)


LAGS = range(3)
MPS = (f"WITH d AS (SELECT symbol, date, fwd, ret AS x0, lag(ret) OVER w AS x1, lag(ret, 2) OVER w AS x2 FROM ({FP}) WINDOW w AS (PARTITION BY symbol ORDER BY date)), v AS (SELECT * FROM d WHERE fwd IS NOT NULL AND x0 IS NOT NULL AND x1 IS NOT NULL AND x2 IS NOT NULL), "
       "ds AS (SELECT date, percent_rank() OVER (ORDER BY date) < 0.7 AS tr FROM (SELECT DISTINCT date FROM v)), "
       f"m AS (SELECT avg(fwd) AS my, {', '.join(f'avg(x{i}) AS m{i}, covar_pop(x{i}, fwd) AS b{i}' for i in LAGS)}, {', '.join(f'covar_pop(x{i}, x{j}) AS a{i}{j}' for i in LAGS for j in LAGS)} FROM v JOIN ds USING (date) WHERE tr), "
       f"w AS (WITH {elimination('m', ['w0', 'w1', 'w2'], 'my, m0, m1, m2')}), p AS (SELECT symbol, date, my + {' + '.join(f'w{i} * (x{i} - m{i})' for i in LAGS)} AS p_ols FROM v JOIN ds USING (date), w WHERE NOT tr) "
       "SELECT *, CASE WHEN p_ols > 0.02 THEN 1 WHEN p_ols < -0.02 THEN -1 ELSE 0 END AS signal FROM p")


@query("ml_prediction_signal", K, "p_ols", "signal", sql=MPS, tables="returns", staged=True)
def ml_prediction_signal(t):
    return L.prediction_signal(panel(t))


BL = (chain("returns", {"fwd": f"{Q.lead('close')} / nullif(close, 0) - 1", "a": Q.mean("ret", 5), "b": Q.mean("ret", 20), "c": "-ret"}, "SELECT * FROM {src} WHERE fwd IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL",
            {f"e{x}": f"avg(pow({x} - fwd, 2)) OVER ()" for x in "abc"}, {"ti": "1 / ea + 1 / eb + 1 / ec", "be": "least(ea, eb, ec)"}, {"ts": "exp(-(ea - be)) + exp(-(eb - be)) + exp(-(ec - be))"},
            {"blend_inverse": "(a / ea + b / eb + c / ec) / ti", "blend_softmax": "(a * exp(-(ea - be)) + b * exp(-(eb - be)) + c * exp(-(ec - be))) / ts"}))


@query("stack_blend_predictions", K, "blend_inverse blend_softmax", sql=BL, tables="returns")
def stack_blend_predictions(t):
    d = t.returns().withColumns({"fwd": F.try_divide(S.lead("close"), "close") - 1, "a": S.mean("ret", 5), "b": S.mean("ret", 20), "c": -F.col("ret")})
    return L.blend(d, ["a", "b", "c"], "fwd")


@query("feature_importance", "feature", "corr_importance forest_importance lasso_importance consensus", staged=True)
def feature_importance(t):
    return L.importance(model_frame(t), FE.FEATURES)


def wb(x, lo, hi):
    return f"greatest(least(ceil(({x} - {lo}) * 10 / nullif({hi} - {lo}, 0)) - 1, 9), 0)"


MI = (f"WITH d AS (SELECT *, min(value) OVER w AS a, max(value) OVER w AS b, min(fwd) OVER w AS c, max(fwd) OVER w AS e, count(*) OVER w AS tot FROM {CL} WINDOW w AS (PARTITION BY factor)), g AS (SELECT factor, tot, {wb('value', 'a', 'b')} AS x, {wb('fwd', 'c', 'e')} AS y FROM d), "
      "j AS (SELECT factor, x, y, max(tot) AS tot, count(*) AS n FROM g GROUP BY 1, 2, 3), m AS (SELECT *, sum(n) OVER (PARTITION BY factor, x) AS nx, sum(n) OVER (PARTITION BY factor, y) AS ny FROM j) SELECT factor, sum(n / tot * ln(n * tot / (nx * ny))) AS mutual_information, sum(n) AS n FROM m GROUP BY 1")


@query("mutual_information_binned", "factor", "mutual_information", "n", sql=MI, tables="returns")
def mutual_information_binned(t):
    return L.mutual_information(long(t))


@query("selection_vote", "factor", "", "votes selected",
       sql=f"WITH m AS ({MI}), g AS (SELECT factor, corr(value, fwd) AS c, var_samp(value) AS v FROM {CL} GROUP BY 1), x AS (SELECT factor, CASE WHEN abs(c) > 0.01 THEN 1 ELSE 0 END + CASE WHEN mutual_information > 0.005 THEN 1 ELSE 0 END + CASE WHEN v > 0.05 THEN 1 ELSE 0 END AS votes FROM g JOIN m USING (factor)) "
           "SELECT *, CASE WHEN votes >= 2 THEN 1 ELSE 0 END AS selected FROM x", tables="returns")
def selection_vote(t):
    return L.selection_vote(long(t))


STS = chain(f"(SELECT symbol, date, factor, value, fwd, date_diff('day', DATE '1970-01-01', date) AS day FROM {CL})", *draw_stages("h", "17", ["symbol", "day"]), "SELECT *, r.range AS replicate FROM {src}, range(1, 21) r", *draw_stages("k", "h", ["replicate"]),
            f"SELECT factor, replicate, corr(value, fwd) AS c FROM {{src}} WHERE {unit('k')} < 0.5 GROUP BY 1, 2", final="SELECT factor, avg(CASE WHEN abs(c) > 0.01 THEN 1 ELSE 0 END) AS frequency, avg(c) AS mean_corr, count(*) AS replicates FROM {src} GROUP BY 1")


@query("stability_selection", "factor", "frequency mean_corr", "replicates", sql=STS, tables="returns")
def stability_selection(t):
    return L.stability_selection(long(t))


FST = (f"WITH d AS (SELECT * FROM ({FL}) WHERE value IS NOT NULL), ds AS (SELECT date, floor((row_number() OVER (ORDER BY date) - 1) * 5 / count(*) OVER ()) + 1 AS period FROM (SELECT DISTINCT date FROM d)), x AS (SELECT d.*, period FROM d JOIN ds USING (date)), p AS (SELECT factor, period, avg(value) AS m, stddev_samp(value) AS s FROM x GROUP BY 1, 2), "
       "g AS (SELECT factor, stddev_samp(m) / nullif(abs(avg(m)), 0) AS mean_cv, stddev_samp(s) / nullif(abs(avg(s)), 0) AS std_cv, regr_slope(m, period) AS trend FROM p GROUP BY 1), c AS (SELECT factor, value, sum(CASE WHEN period <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY factor ORDER BY value) / sum(CASE WHEN period <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY factor) AS fa, "
       "sum(CASE WHEN period > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY factor ORDER BY value) / sum(CASE WHEN period > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY factor) AS fb FROM x), k AS (SELECT factor, max(abs(fa - fb)) AS ks FROM c GROUP BY 1) SELECT *, greatest(100 - 50 * least(mean_cv, 1) - 50 * ks, 0) AS score FROM g JOIN k USING (factor)")


@query("feature_stability", "factor", "mean_cv std_cv trend ks score", sql=FST, tables="returns")
def feature_stability(t):
    return L.feature_stability(panel(t), FC)


LEAK = (f"WITH d AS (SELECT *, lead(fwd) OVER w AS f, lag(value) OVER w AS l1, lag(value, 7) OVER w AS l7 FROM ({FL}) WINDOW w AS (PARTITION BY symbol, factor ORDER BY date)), g AS (SELECT factor, corr(value, fwd) AS target_corr, corr(value, f) AS future_corr, corr(value, l1) AS autocorr_1, corr(value, l7) AS autocorr_7 FROM d GROUP BY 1) "
        "SELECT *, CASE WHEN abs(target_corr) > 0.9 THEN 50 ELSE 0 END + CASE WHEN abs(future_corr) > 0.5 THEN 30 ELSE 0 END + CASE WHEN abs(autocorr_1) > 0.99 THEN 20 ELSE 0 END AS risk_score FROM g")


@query("leakage_detection", "factor", "target_corr future_corr autocorr_1 autocorr_7", "risk_score", sql=LEAK, tables="returns")
def leakage_detection(t):
    return L.leakage(long(t))


KSR = ("WITH d AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) <= floor(count(*) OVER (PARTITION BY symbol) / 2) AS a FROM returns WHERE ret IS NOT NULL), c AS (SELECT symbol, abs(count(*) FILTER (WHERE a) OVER w / count(*) FILTER (WHERE a) OVER (PARTITION BY symbol) - count(*) FILTER (WHERE NOT a) OVER w / count(*) FILTER (WHERE NOT a) OVER (PARTITION BY symbol)) AS k FROM d WINDOW w AS (PARTITION BY symbol ORDER BY ret)), "
       "g AS (SELECT symbol, max(k) AS ks FROM c GROUP BY 1), m AS (SELECT symbol, count(*) AS n, avg(ret) * sqrt(count(*)) / stddev_samp(ret) AS t_stat FROM d GROUP BY 1) SELECT *, CASE WHEN ks > 1.36 * sqrt(4 / n) THEN 1 ELSE 0 END AS changed FROM g JOIN m USING (symbol)")


@query("two_sample_ks_regime", "symbol", "ks t_stat", "n changed", sql=KSR, tables="returns")
def two_sample_ks_regime(t):
    return L.regime_change(t.returns())


@query("ts_cv_split", "symbol date part", "", "fold pos",
       sql="WITH d AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos, floor(count(*) OVER (PARTITION BY symbol) / 5) AS sz FROM bars), f AS (SELECT *, CASE WHEN pos <= fold * sz - 5 THEN 'train' WHEN pos > fold * sz AND pos <= fold * sz + sz THEN 'test' END AS part FROM d CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS fold)) SELECT * FROM f WHERE part IS NOT NULL", tables="bars")
def ts_cv_split(t):
    return L.cv_folds(t.closes())


NF = range(len(FE.FEATURES))
ANM = (f"WITH f AS (SELECT symbol, date, {', '.join(f'{c} AS x{i}' for i, c in enumerate(FE.FEATURES))} FROM ({FIQ})), v AS (SELECT * FROM f WHERE {' AND '.join(f'x{i} IS NOT NULL' for i in NF)}), "
       f"q AS (SELECT {', '.join(f'quantile_cont(x{i}, 0.5) AS d{i}, avg(x{i}) AS m{i}' for i in NF)}, {', '.join(f'covar_samp(x{i}, x{j}) AS a{i}{j}' for i in NF for j in NF)} FROM v), "
       f"h AS (SELECT {', '.join(f'quantile_cont(abs(x{i} - d{i}), 0.5) AS h{i}' for i in NF)} FROM v, q), "
       f"y AS (SELECT symbol, date, {', '.join(f'x{i} - m{i} AS b{i}, x{i} - m{i} AS c{i}' for i in NF)}, {', '.join(f'a{i}{j}' for i in NF for j in NF)}, greatest({', '.join(f'abs(0.6745::DOUBLE * (x{i} - d{i}) / nullif(h{i}, 0))' for i in NF)}) AS robust_z FROM v, q, h), "
       f"w AS (WITH {elimination('y', [f'w{i}' for i in NF], 'symbol, date, robust_z, ' + ', '.join(f'c{i}' for i in NF))}), "
       f"g AS (SELECT symbol, date, robust_z, sqrt(greatest({' + '.join(f'c{i} * w{i}' for i in NF)}, 0)) AS mahalanobis FROM w) "
       "SELECT f.symbol, f.date, robust_z, mahalanobis, CASE WHEN g.symbol IS NULL THEN NULL WHEN robust_z > 3.5 THEN 1 ELSE 0 END AS anomaly FROM f LEFT JOIN g ON g.symbol = f.symbol AND g.date = f.date")


@query("anomaly_scores", K, "robust_z mahalanobis", "anomaly", sql=ANM, tables="returns", staged=True)
def anomaly_scores(t):
    return L.anomaly_scores(model_frame(t), FE.FEATURES)


@query("impute_scale_select", K, "x_1 x_2 x_3 x_4")
def impute_scale_select(t):
    return L.impute_scale_select(model_frame(t), FE.FEATURES)
