"""Queries of signals, backtests and validation."""
from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.exact import quantiles, unpivot
from quantloom.functions.series import S, Series
from quantloom.operators import backtest as B
from quantloom.operators import signals as G
from quantloom.operators.relational import top_n
from quantloom.plans.q_state_fund import rk
from quantloom.plans.q_technical import GL, MACD_STEPS, TR, rsi
from quantloom.plans.registry import query
from quantloom.plans.sql import Q, Sql, chain, draw_stages, ewm, flag, unit

K = "symbol date"
Y = "sqrt(252::DOUBLE)"

EMAX = chain("bars", ewm("{src}", "close", "f", 2 / 13, False), ewm("{src}", "close", "s", 2 / 27, False), {"signal": flag("f > s")})


@query("sig_momentum_ema", K, "", "signal", sql=EMAX, tables="bars")
def sig_momentum_ema(t):
    return G.momentum_ema(t.closes())


MRZ = chain("bars", {"z": f"(close - {Q.mean('close', 20)}) / ({Q.std('close', 20)} + 1e-12::DOUBLE)"}, {"signal": "CASE WHEN z <= -1 AND z < 0 THEN 1 ELSE 0 END"})


@query("sig_mean_reversion_z", K, "z", "signal", sql=MRZ, tables="bars")
def sig_mean_reversion_z(t):
    return G.mean_reversion(t.closes())


RSIG = chain("bars", {"d": Q.diff("close")}, GL, {"rsi": f"100 - 100 / (1 + {Q.mean('g', 14)} / ({Q.mean('l', 14)} + 1e-12::DOUBLE))"}, {"signal": flag("rsi <= 30 AND rsi < 70")})


@query("sig_rsi", K, "rsi", "signal", sql=RSIG, tables="bars")
def sig_rsi(t):
    return G.rsi_signal(t.closes())


@query("sig_bollinger", K, "", "mean_reversion breakout",
       sql=chain("bars", {"m": Q.mean("close", 20), "sd": Q.std("close", 20)}, {"mean_reversion": flag("close <= m - 2 * sd AND close < m + 2 * sd"), "breakout": flag("close >= m + 2 * sd AND close > m - 2 * sd")}), tables="bars")
def sig_bollinger(t):
    return G.bollinger_signal(t.closes())


@query("sig_macd", K, "", "signal", sql=chain("bars", *MACD_STEPS, {"signal": flag("macd_line > macd_signal")}), tables="bars")
def sig_macd(t):
    return G.macd_signal(t.closes())


@query("sig_pairs", K, "z signal",
       sql=chain("(SELECT b.symbol, b.date, b.close AS c1, m.mclose AS c2 FROM bars b JOIN market_index m USING (date))", {"r": "ln(c1 / nullif(c2, 0))"}, {"z": f"(r - {Q.mean('r', 60)}) / ({Q.std('r', 60)} + 1e-12::DOUBLE)"},
                 {"signal": "CASE WHEN abs(z) >= 2 AND abs(z) > 0.5 THEN sign(-z) ELSE 0 END"}), tables="market_index")
def sig_pairs(t):
    """Every symbol paired with the index."""
    d = t.closes().join(t.market_index(), "date").select("symbol", "date", F.col("close").alias("close1"), F.col("mclose").alias("close2"))
    return G.pairs_signal(d)


@query("sig_vol_breakout", K, "", "signal", sql=chain("bars", {"tr": TR, "pc": Q.lag("close")}, {"b": f"{Q.mean('tr', 20)} * 1.5"}, {"signal": flag("close >= pc + b AND close > pc - b")}), tables="bars")
def sig_vol_breakout(t):
    return G.vol_breakout(t.bars())


@query("sig_basis_momentum_meanrev", K, "basis", "basis_signal momentum_signal meanrev_signal",
       sql=chain("bars", {"basis": "(open - close) / nullif(close, 0)", "m": Q.mean("close", 20), "sd": Q.std("close", 20), "m5": Q.mean("close", 5)}, {"bm": Q.mean("basis", 20)},
                 {"basis_signal": "CASE WHEN basis - bm > 0.1 THEN -1 WHEN basis - bm < -0.1 THEN 1 ELSE 0 END", "momentum_signal": "CASE WHEN m5 > m THEN 1 WHEN m5 < m THEN -1 ELSE 0 END", "meanrev_signal": "CASE WHEN close > m + 2 * sd THEN -1 WHEN close < m - 2 * sd THEN 1 ELSE 0 END"}), tables="bars")
def sig_basis_momentum_meanrev(t):
    return G.basis_momentum_meanrev(t.bars())


SC = ("momentum_score", "reversion_score", "volatility_score", "volume_score", "micro_score")


@query("sig_scored_composite", K, "score " + " ".join(SC), "signal",
       sql=chain("returns", {"z": f"(close - {Q.mean('close', 20)}) / nullif({Q.std('close', 20)}, 0)", "v": f"{Q.std('ret', 10)} / nullif({Q.std('ret', 60)}, 0)", "vr": f"volume / nullif({Q.mean('volume', 20)}, 0)", "p": "(close - low) / nullif(high - low, 0)", "m": Q.pct("close", 10)},
                 {"momentum_score": "CASE WHEN m > 0.1 THEN 1.0 WHEN m > 0.02 THEN 0.5 WHEN m < -0.1 THEN -1 WHEN m < -0.02 THEN -0.5 ELSE 0 END", "reversion_score": "CASE WHEN z < -2 THEN 1.0 WHEN z < -1 THEN 0.5 WHEN z > 2 THEN -1 WHEN z > 1 THEN -0.5 ELSE 0 END",
                  "volatility_score": "CASE WHEN v < 0.8 THEN 0.5 WHEN v > 1.5 THEN -0.5 ELSE 0 END", "volume_score": "CASE WHEN vr > 1.5 THEN 1.0 WHEN vr < 0.5 THEN -0.5 ELSE 0 END", "micro_score": "CASE WHEN p > 0.8 THEN 0.5 WHEN p < 0.2 THEN -0.5 ELSE 0 END"},
                 {"score": "round(CAST(0.3 * momentum_score + 0.2 * reversion_score + 0.2 * volatility_score + 0.15 * volume_score + 0.15 * micro_score AS DOUBLE), 9)"}, {"signal": "CASE WHEN score > 0.3 THEN 1 WHEN score < -0.3 THEN -1 ELSE 0 END"}), tables="returns")
def sig_scored_composite(t):
    return G.scored_composite(t.bars())


SF = {**{f"momentum_{n}": Q.pct("close", n) for n in (5, 10, 20)}, **{f"rsi_{n}": rsi(Q.mean("g", n), Q.mean("l", n)) for n in (5, 10, 20)},
      **{k: v for n in (10, 20, 50) for k, v in {f"bollinger_{n}": f"(close - {Q.mean('close', n)}) / nullif(2 * {Q.std('close', n)}, 0)", f"zscore_{n}": f"(close - {Q.mean('close', n)}) / nullif({Q.std('close', n)}, 0)",
         f"price_position_{n}": f"(close - {Q.min('low', n)}) / nullif({Q.max('high', n)} - {Q.min('low', n)}, 0)"}.items()},
      **{k: v for n in (10, 20) for k, v in {f"atr_{n}": Q.mean("tr", n), f"vol_breakout_{n}": f"volatility_{n} / nullif({Q.mean(f'volatility_{n}', n)}, 0) - 1"}.items()},
      "volume_ma_ratio": f"volume / nullif({Q.mean('volume', 20)}, 0)", "vwap": f"{Q.cum('sum(cv)')} / nullif({Q.cum('sum(volume)')}, 0)", "price_volume_trend": "ret * volume"}


@query("signal_families", K, " ".join(SF) + " volatility_10 volatility_20", "price_jump",
       sql=chain("returns", {"d": Q.diff("close"), "tr": TR, "cv": "close * volume", **{f"volatility_{n}": f"{Q.std('ret', n)} * {Y}" for n in (10, 20)}}, GL, {**SF, "price_jump": flag(f"abs(ret) > 3 * {Q.std('ret', 20)}")}), tables="returns")
def signal_families(t):
    return G.signal_families(t.bars())


@query("signal_normalize_smooth", K, "zscore minmax rank sma ema median",
       sql=chain("(SELECT * FROM returns WHERE ret IS NOT NULL)", ewm("{src}", "ret", "ema", 2 / 6, True), {"zscore": "(ret - avg(ret) OVER (PARTITION BY symbol)) / stddev_samp(ret) OVER (PARTITION BY symbol)", "minmax": "(ret - min(ret) OVER (PARTITION BY symbol)) / (max(ret) OVER (PARTITION BY symbol) - min(ret) OVER (PARTITION BY symbol))",
                 "rank": rk("ret", "symbol", "avg"), "sma": Q.mean("ret", 5), "median": Q.median("ret", 5)}), tables="returns")
def signal_normalize_smooth(t):
    return G.normalize_smooth(t.returns().where(F.col("ret").isNotNull()), "ret")


FU = chain("returns", {"a": Q.pct("close", 10), "b": f"-{Q.pct('close', 5)}", "c": f"volume / nullif({Q.mean('volume', 20)}, 0)"}, {f"z{x}": f"({x} - avg({x}) OVER (PARTITION BY symbol)) / nullif(stddev_samp({x}) OVER (PARTITION BY symbol), 0)" for x in "abc"} | {f"r{x}": rk(x, "symbol", "avg") for x in "abc"},
           {"weighted": "0.5 * coalesce(za, 0) + 0.3 * coalesce(zb, 0) + 0.2 * coalesce(zc, 0)", "rank_mean": "list_avg(list_filter([ra, rb, rc], lambda x: x IS NOT NULL))", "median": "list_median(list_filter([a, b, c], lambda x: x IS NOT NULL))"},
           {f"x{x}": f"coalesce({x}, 0)" for x in "abc"}, {f"y{x}": f"coalesce((x{x} - avg(x{x}) OVER (PARTITION BY symbol)) / nullif(stddev_pop(x{x}) OVER (PARTITION BY symbol), 0), 0)" for x in "abc"})
# the first component: the correlation matrix squared until only its leading vector v is left, as v times v
UP = ["aa", "ab", "ac", "bb", "bc", "cc"]
SQUARE = [{f"n{i}{j}": " + ".join(f"m{''.join(sorted(i + k))} * m{''.join(sorted(k + j))}" for k in "abc") for i, j in UP}, f"SELECT symbol, {', '.join(f'n{u} / nullif(naa + nbb + ncc, 0) AS m{u}' for u in UP)} FROM {{src}}"]
LEAD = chain(f"(SELECT symbol, {', '.join(f'avg(y{i} * y{j}) AS m{i}{j}' for i, j in UP)} FROM f GROUP BY 1)", *SQUARE * 20, {"top": "greatest(maa, mbb, mcc) - 1e-9::DOUBLE"},
             final="SELECT symbol, " + ", ".join("CASE " + " ".join(f"WHEN m{k}{k} >= top THEN m{''.join(sorted(k + x))} / sqrt(m{k}{k})" for k in "abc") + f" END AS v{x}" for x in "abc") + " FROM {src}")
FUP = f"WITH f AS ({FU}), v AS ({LEAD}) SELECT f.*, coalesce(va * ya + vb * yb + vc * yc, 0) AS pca FROM f JOIN v USING (symbol)"


@query("signal_fusion", K, "weighted rank_mean median pca", sql=FUP, tables="returns")
def signal_fusion(t):
    d = t.returns().withColumns({"a": S.pct("close", 10), "b": -S.pct("close", 5), "c": F.try_divide("volume", S.mean("volume", 20))})
    return G.fuse(d, ["a", "b", "c"], [0.5, 0.3, 0.2])


VOTE = (f"WITH l AS (SELECT symbol, date, signal, 0.5::DOUBLE AS weight FROM ({EMAX}) UNION ALL SELECT symbol, date, signal, 0.3 FROM ({MRZ}) UNION ALL SELECT symbol, date, CASE WHEN rsi > 70 THEN -1 ELSE signal END, 0.2 FROM ({RSIG})), "
        "g AS (SELECT symbol, date, sum(signal * weight) / nullif(sum(weight), 0) AS net_strength, count(*) FILTER (WHERE signal > 0) AS buys, count(*) FILTER (WHERE signal < 0) AS sells, count(*) AS n FROM l GROUP BY 1, 2) "
        "SELECT *, CASE WHEN buys > sells AND buys > 0 THEN 'BUY' WHEN sells > buys THEN 'SELL' ELSE 'HOLD' END AS majority, greatest(buys, sells) / n AS confidence, CASE WHEN abs(net_strength) >= 0.2 AND greatest(buys, sells) / n >= 0.5 THEN 1 ELSE 0 END AS accepted FROM g")


@query("signal_vote_aggregate", "symbol date majority", "net_strength confidence", "buys sells n accepted", sql=VOTE, tables="bars")
def signal_vote_aggregate(t):
    b = t.closes()
    r = G.rsi_signal(b).withColumn("signal", F.when(F.col("rsi") > 70, -1).otherwise(F.col("signal")))
    parts = [(G.momentum_ema(b), 0.5), (G.mean_reversion(b), 0.3), (r, 0.2)]
    long = None
    for d, w in parts:
        x = d.select("symbol", "date", "signal", F.lit(w).alias("weight"))
        long = x if long is None else long.unionByName(x)
    return G.vote(long)


SDG = ("WITH l AS (SELECT symbol, date, 'a' AS name, ret AS value FROM returns UNION ALL SELECT symbol, date, 'b', close / nullif(open, 0) - 1 FROM returns), v AS (SELECT *, lag(value) OVER w AS pv, avg(value) OVER p AS m, stddev_samp(value) OVER p AS sd FROM l WHERE value IS NOT NULL WINDOW w AS (PARTITION BY symbol, name ORDER BY date), p AS (PARTITION BY symbol, name)), "
       "g AS (SELECT symbol, name, max(m) AS mean, max(sd) AS std, max(value) - min(value) AS range, avg(CASE WHEN abs(value - m) > 3 * sd THEN 1 ELSE 0 END) AS outlier_ratio, corr(value, pv) AS autocorr, count(*) AS n FROM v GROUP BY 1, 2) "
       "SELECT *, coalesce(abs(mean) / nullif(std, 0), 0) AS strength, CASE WHEN coalesce(abs(mean) / nullif(std, 0), 0) < 0.5 THEN 1 ELSE 0 END AS weak, CASE WHEN outlier_ratio > 0.1 THEN 1 ELSE 0 END AS many_outliers, CASE WHEN abs(autocorr) > 0.8 THEN 1 ELSE 0 END AS persistent FROM g")


@query("signal_diagnostics", "symbol name", "mean std range outlier_ratio autocorr strength", "n weak many_outliers persistent", sql=SDG, tables="returns")
def signal_diagnostics(t):
    d = t.returns().withColumns({"a": F.col("ret"), "b": F.try_divide("close", "open") - 1})
    return G.signal_diagnostics(unpivot(d, ["symbol", "date"], ["a", "b"]), Series(("symbol", "name"), ("date",)))


# --- W ----------------------------------------------------------------------------------------
def vec(src, by="symbol"):
    q = Sql(by)
    return chain(src, {"ret0": f"coalesce({q.pct('close')}, 0)", "position": f"coalesce({q.lag('signal')}, 0)::DOUBLE"}, {"turnover": f"abs(position - coalesce({q.lag('position')}, 0))"},
                 {"strategy_ret": "position * ret0 - turnover * 0.001"}, {"f_eq": "1 + strategy_ret"}, {"equity": q.cum("product(f_eq)")})


@query("vectorized_backtest", K, "position turnover strategy_ret log_equity", sql=f"SELECT *, ln(equity) AS log_equity FROM ({vec(f'({EMAX})')})", tables="bars")
def vectorized_backtest(t):
    return B.vectorized(G.momentum_ema(t.closes())).withColumn("log_equity", F.log("equity"))


def perf(src, r, by):
    q = Sql(by)
    return (chain(f"(SELECT * FROM {src} WHERE {r} IS NOT NULL)", {"f": f"1 + {r}"}, {"eq": q.cum("product(f)")}, {"dd": f"eq / greatest({q.cum('max(eq)')}, 1) - 1"},
                  final=f"SELECT {by}, count({r}) AS n, avg({r}) * 252 AS annual_return, stddev_samp({r}) * {Y} AS volatility, coalesce(avg({r}) * 252 / nullif(stddev_samp({r}) * {Y}, 0), 0) AS sharpe, "
                        f"coalesce(avg({r}) * 252 / nullif(stddev_samp(CASE WHEN {r} < 0 THEN {r} END) * {Y}, 0), 0) AS sortino, avg(CASE WHEN {r} > 0 THEN 1 ELSE 0 END) AS hit_rate, min(dd) AS max_drawdown, ln(arg_max(eq, date)) AS log_growth, "
                        f"coalesce(avg({r}) * 252 / nullif(abs(min(dd)), 0), 0) AS calmar FROM {{src}} GROUP BY {by}"))


@query("performance_metrics", "symbol", "annual_return volatility sharpe sortino hit_rate max_drawdown log_growth calmar", "n", sql=perf("returns", "ret", "symbol"), tables="returns")
def performance_metrics(t):
    return B.performance(t.returns())


@query("diagnose_returns", "symbol", "var_95 var_99 cvar_95 skew kurt avg_win avg_loss profit_factor win_rate win_loss_ratio",
       sql="WITH q AS (SELECT symbol, quantile_cont(ret, 0.05) AS q5, quantile_cont(ret, 0.01) AS q1 FROM returns GROUP BY 1) SELECT r.symbol, max(q5) AS var_95, max(q1) AS var_99, avg(CASE WHEN ret <= q5 THEN ret END) AS cvar_95, skewness(ret) AS skew, kurtosis(ret) AS kurt, avg(CASE WHEN ret > 0 THEN ret END) AS avg_win, "
           "avg(CASE WHEN ret < 0 THEN ret END) AS avg_loss, sum(CASE WHEN ret > 0 THEN ret END) / abs(sum(CASE WHEN ret < 0 THEN ret END)) AS profit_factor, avg(CASE WHEN ret > 0 THEN 1 WHEN ret IS NOT NULL THEN 0 END) AS win_rate, "
           "avg(CASE WHEN ret > 0 THEN ret END) / abs(avg(CASE WHEN ret < 0 THEN ret END)) AS win_loss_ratio FROM returns r JOIN q USING (symbol) GROUP BY 1", tables="returns")
def diagnose_returns(t):
    return B.diagnose(t.returns())


@query("benchmark_comparison", "symbol", "excess_return tracking_error information_ratio alpha beta up_capture down_capture",
       sql=f"WITH d AS (SELECT * FROM returns_market WHERE ret IS NOT NULL AND mret IS NOT NULL), g AS (SELECT symbol, avg(ret - mret) * 252 AS excess_return, stddev_samp(ret - mret) * {Y} AS tracking_error, covar_samp(ret, mret) / var_pop(mret) AS beta, avg(ret) AS mx, avg(mret) AS my, "
           "avg(CASE WHEN mret > 0 THEN ret END) / avg(CASE WHEN mret > 0 THEN mret END) AS up_capture, avg(CASE WHEN mret < 0 THEN ret END) / avg(CASE WHEN mret < 0 THEN mret END) AS down_capture FROM d GROUP BY 1) SELECT *, excess_return / tracking_error AS information_ratio, (mx - beta * my) * 252 AS alpha FROM g", tables="returns_market")
def benchmark_comparison(t):
    return B.benchmark_comparison(t.returns_with_market())


@query("trade_statistics", "symbol", "win_rate avg_win avg_loss largest_win largest_loss volume profit_factor avg_slippage latency_p50 latency_p95", "n",
       sql="SELECT symbol, count(*) AS n, avg(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS win_rate, avg(CASE WHEN pnl > 0 THEN pnl END) AS avg_win, avg(CASE WHEN pnl < 0 THEN pnl END) AS avg_loss, max(pnl) AS largest_win, min(pnl) AS largest_loss, sum(size * price) AS volume, "
           "sum(CASE WHEN pnl > 0 THEN pnl END) / abs(sum(CASE WHEN pnl < 0 THEN pnl END)) AS profit_factor, avg(slippage) AS avg_slippage, quantile_cont(latency, 0.5) AS latency_p50, quantile_cont(latency, 0.95) AS latency_p95 FROM trades GROUP BY 1", tables="trades")
def trade_statistics(t):
    tr = t.trades()
    return B.trade_statistics(tr).join(quantiles(tr, ["symbol"], "latency", [0.5, 0.95], ["latency_p50", "latency_p95"]), "symbol")


WF = (f"WITH b AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ({vec(f'({EMAX})')})), w AS (SELECT symbol, unnest(generate_series(0, CAST(floor((max(n) - 130) / 20) AS BIGINT))) AS win FROM b GROUP BY symbol HAVING max(n) >= 130), "
      "j AS (SELECT b.symbol, w.win AS fold, strategy_ret AS r, b.i - w.win * 20 < 100 AS tr FROM b JOIN w ON b.symbol = w.symbol AND b.i BETWEEN w.win * 20 AND w.win * 20 + 129) "
      f"SELECT symbol, fold, coalesce(avg(CASE WHEN tr THEN r END) * 252 / nullif(stddev_samp(CASE WHEN tr THEN r END) * {Y}, 0), 0) AS train_sharpe, coalesce(avg(CASE WHEN NOT tr THEN r END) * 252 / nullif(stddev_samp(CASE WHEN NOT tr THEN r END) * {Y}, 0), 0) AS test_sharpe, "
      "avg(CASE WHEN tr THEN r END) * 252 AS train_return, avg(CASE WHEN NOT tr THEN r END) * 252 AS test_return, avg(CASE WHEN NOT tr THEN (CASE WHEN r > 0 THEN 1 ELSE 0 END) END) AS test_win_rate, count(*) FILTER (WHERE tr) AS n_train, count(*) FILTER (WHERE NOT tr) AS n_test FROM j GROUP BY 1, 2")


def _wf(t):
    return B.walk_forward(B.vectorized(G.momentum_ema(t.closes())))


@query("walk_forward", "symbol fold", "train_sharpe test_sharpe train_return test_return test_win_rate", "n_train n_test", sql=WF, tables="bars")
def walk_forward(t):
    return _wf(t)


MSC = ("WITH l AS (" + " UNION ALL ".join(f"SELECT '{n}' AS strategy, symbol, date, strategy_ret FROM ({vec(f'({s})')})" for n, s in (("ema", EMAX), ("meanrev", MRZ), ("rsi", RSIG))) +
       f"), p AS ({perf('l', 'strategy_ret', 'strategy, symbol')}) SELECT strategy, avg(sharpe) AS sharpe, avg(annual_return) AS annual_return, avg(max_drawdown) AS max_drawdown, avg(hit_rate) AS hit_rate, count(*) AS n FROM p GROUP BY strategy")
BUILDERS = {"ema": G.momentum_ema, "meanrev": G.mean_reversion, "rsi": G.rsi_signal}


@query("multi_strategy_compare", "strategy", "sharpe annual_return max_drawdown hit_rate", "n", sql=MSC, tables="bars")
def multi_strategy_compare(t):
    return B.compare_strategies(B.strategies_long(t.closes(), BUILDERS))


@query("strategy_registry", "strategy symbol", "sharpe annual_return", "n", sql=MSC.replace("SELECT strategy, avg(sharpe) AS sharpe, avg(annual_return) AS annual_return, avg(max_drawdown) AS max_drawdown, avg(hit_rate) AS hit_rate, count(*) AS n FROM p GROUP BY strategy", "SELECT * FROM p"), tables="bars")
def strategy_registry(t):
    """Named signal builders, run over one bars table."""
    return B.performance(B.strategies_long(t.closes(), BUILDERS), "strategy_ret", ("strategy", "symbol"))


PSW = (chain("bars", {**{f"m{n}": Q.mean("close", n) for n in (5, 10, 15, 20, 30, 40)}, "ret0": f"coalesce({Q.pct('close')}, 0)"},
             "SELECT *, f AS fast, s AS slow, CASE WHEN (CASE f WHEN 5 THEN m5 WHEN 10 THEN m10 ELSE m15 END) > (CASE s WHEN 20 THEN m20 WHEN 30 THEN m30 ELSE m40 END) THEN 1 ELSE 0 END AS sg FROM {src} CROSS JOIN (SELECT unnest([5, 10, 15]) AS f) CROSS JOIN (SELECT unnest([20, 30, 40]) AS s)",
             {"p": "coalesce(lag(sg) OVER (PARTITION BY symbol, fast, slow ORDER BY date), 0)"}, {"r": "p * ret0 - abs(p - coalesce(lag(p) OVER (PARTITION BY symbol, fast, slow ORDER BY date), 0)) * 0.001::DOUBLE"},
             f"SELECT symbol, fast, slow, coalesce(avg(r) * 252 / nullif(stddev_samp(r) * {Y}, 0), 0) AS sharpe FROM {{src}} GROUP BY 1, 2, 3",
             {"rn": "row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 9) DESC, fast, slow)"}, {"best": "CASE WHEN rn = 1 THEN 1 ELSE 0 END"}))


@query("param_sweep", "symbol fast slow", "sharpe", "best", sql=PSW, tables="bars")
def param_sweep(t):
    return B.param_sweep(t.closes())


PAR = (f"WITH p AS (SELECT symbol, fast * 100 + slow AS combo, round(sharpe, 9) AS sharpe, -CAST(fast AS DOUBLE) AS speed, CAST(slow AS DOUBLE) AS reach FROM ({PSW})) "
       "SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.symbol = a.symbol AND b.sharpe >= a.sharpe AND b.speed >= a.speed AND b.reach >= a.reach AND (b.sharpe > a.sharpe OR b.speed > a.speed OR b.reach > a.reach))")


@query("pareto_front", "symbol combo", "sharpe speed reach", sql=PAR, tables="bars")
def pareto_front(t):
    g = B.param_sweep(t.closes()).select("symbol", (F.col("fast") * 100 + F.col("slow")).alias("combo"), F.round("sharpe", 9).alias("sharpe"), (-F.col("fast").cast("double")).alias("speed"), F.col("slow").cast("double").alias("reach"))
    return B.pareto(g, "combo", ["sharpe", "speed", "reach"], "symbol")


BST = chain(f"(SELECT symbol, date, strategy_ret, date_diff('day', DATE '1970-01-01', date) AS day FROM ({vec(f'({EMAX})')}) WHERE strategy_ret IS NOT NULL)", *draw_stages("h", "11", ["symbol", "day"]), "SELECT *, r.range AS replicate FROM {src}, range(1, 51) r", *draw_stages("d", "h", ["replicate"]),
            {"u": unit("d")}, {"k": "CASE WHEN u < 0.36787944117144233 THEN 0 WHEN u < 0.7357588823428847 THEN 1 WHEN u < 0.9196986029286058 THEN 2 WHEN u < 0.9810118431238462 THEN 3 WHEN u < 0.9963401531726563 THEN 4 WHEN u < 0.9994058151824183 THEN 5 ELSE 6 END"},
            "SELECT symbol, replicate, sum(k * strategy_ret) / nullif(sum(k), 0) AS m FROM {src} GROUP BY 1, 2", final="SELECT symbol, avg(m) AS boot_mean, stddev_samp(m) AS boot_std, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM {src} GROUP BY 1")


@query("bootstrap_validation", "symbol", "boot_mean boot_std ci_low ci_high", sql=BST, tables="bars")
def bootstrap_validation(t):
    return B.bootstrap(B.vectorized(G.momentum_ema(t.closes())))


@query("overfit_sensitivity_stability", "symbol", "win_share test_train_ratio stability sharpe_std sharpe_mean sharpe_best sensitivity", "windows overfit",
       sql=f"WITH w AS ({WF}), g AS (SELECT symbol, avg(train_sharpe) AS tr, avg(test_sharpe) AS te, stddev_samp(test_sharpe) AS sd, avg(CASE WHEN test_return > 0 THEN 1 ELSE 0 END) AS win_share, count(*) AS windows FROM w GROUP BY 1), "
           f"s AS (SELECT symbol, stddev_samp(sharpe) AS sharpe_std, avg(sharpe) AS sharpe_mean, max(sharpe) AS sharpe_best FROM ({PSW}) GROUP BY 1) SELECT g.symbol, windows, win_share, te / nullif(tr, 0) AS test_train_ratio, 1 - sd / nullif(abs(te), 0) AS stability, CASE WHEN tr > 0 AND te < 0.5 * tr THEN 1 ELSE 0 END AS overfit, "
           "sharpe_std, sharpe_mean, sharpe_best, sharpe_std / nullif(abs(sharpe_mean), 0) AS sensitivity FROM g JOIN s USING (symbol)", tables="bars")
def overfit_sensitivity_stability(t):
    return B.robustness(_wf(t)).join(B.sensitivity(B.param_sweep(t.closes())), "symbol")


@query("equity_heatmap_tables", "symbol year month", "monthly_return", "n", sql="SELECT symbol, year(date) AS year, month(date) AS month, product(1 + ret) - 1 AS monthly_return, count(*) AS n FROM returns WHERE ret IS NOT NULL GROUP BY 1, 2, 3", tables="returns")
def equity_heatmap_tables(t):
    return B.heatmap(t.returns())


@query("udf_indicator_callable", K, "value", sql=f"SELECT symbol, date, {Q.mean('close', 10)} AS value FROM bars", tables="bars")
def udf_indicator_callable(t):
    """A user's pandas function applied to every (calendar bounded) series."""
    from quantloom.functions.kernels import apply_series
    return apply_series(t.closes(), lambda x: x.rolling(10).mean(), "close")


@query("udaf_window_callable", K, "value", sql=f"SELECT symbol, date, {Q.std0('close', 10)} AS value FROM bars", tables="bars")
def udaf_window_callable(t):
    """A user's numpy function applied to every full window of ten rows."""
    import numpy as np

    from quantloom.functions.kernels import rolling_apply
    return rolling_apply(t.closes(), "close", 10, {"value": lambda w: w.std(axis=1)})


@query("best_by_objective", "symbol combo", "sharpe", sql=f"SELECT symbol, fast * 100 + slow AS combo, round(sharpe, 9) AS sharpe FROM ({PSW}) QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY round(sharpe, 9) DESC, fast * 100 + slow) <= 3", tables="bars")
def best_by_objective(t):
    g = B.param_sweep(t.closes()).select("symbol", (F.col("fast") * 100 + F.col("slow")).alias("combo"), F.round("sharpe", 9).alias("sharpe"))
    return top_n(g, "sharpe", 3, ["symbol"], ["combo"])
