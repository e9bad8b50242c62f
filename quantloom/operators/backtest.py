"""Vectorised backtests, performance tables and validation over all symbols and strategies at once."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.draws import unit, with_draw
from quantloom.functions.series import S, Series, div, flag, ladder, with_pos
from quantloom.operators.relational import g1, g2
from quantloom.operators.risk import YEAR



def vectorized(df: DataFrame, signal="signal", cost=0.001, s: Series = S) -> DataFrame:
    """Position = signal of the row before; net return = position x return - cost x position change."""
    d = df.withColumns({"ret": F.coalesce(s.pct("close"), F.lit(0.0)), "position": F.coalesce(s.lag(signal).cast("double"), F.lit(0.0))})
    d = d.withColumn("turnover", F.abs(F.col("position") - F.coalesce(s.lag("position"), F.lit(0.0))))
    d = d.withColumn("strategy_ret", F.col("position") * F.col("ret") - F.col("turnover") * cost)
    return d.withColumn("equity", s.cumprod(1 + F.col("strategy_ret")))


def metric_aggs(r: str, rf=0.0) -> dict[str, Column]:
    x = F.col(r)
    ann, vol = F.avg(x) * 252, F.stddev_samp(x) * YEAR
    return {"n": F.count(x), "annual_return": ann, "volatility": vol, "sharpe": F.coalesce(div(ann - rf, vol), F.lit(0.0)),
            "sortino": F.coalesce(div(ann - rf, F.stddev_samp(F.when(x < 0, x)) * YEAR), F.lit(0.0)), "hit_rate": F.avg(F.when(x.isNotNull(), flag(x > 0)))}


def performance(df: DataFrame, r="ret", by=("symbol",), order=("date",)) -> DataFrame:
    """Return, risk and drawdown metrics per series."""
    s = Series(tuple(by), tuple(order))
    d = df.where(F.col(r).isNotNull()).withColumn("_eq", s.cumprod(1 + F.col(r)))
    d = d.withColumn("_dd", div("_eq", F.greatest(s.cummax("_eq"), F.lit(1.0))) - 1)
    g = d.groupBy(*by).agg(*[c.alias(k) for k, c in metric_aggs(r).items()], F.min("_dd").alias("max_drawdown"), F.log(F.max_by("_eq", F.struct(*order))).alias("log_growth"))
    return g.withColumn("calmar", F.coalesce(div("annual_return", F.abs("max_drawdown")), F.lit(0.0)))


def diagnose(df: DataFrame, r="ret", by=("symbol",)) -> DataFrame:
    """Tail, shape and win/loss statistics of each calendar-bounded series."""
    x = F.col(r)
    q = df.groupBy(*by).agg(F.percentile(x, [0.05, 0.01]).alias("_q"))
    d = df.join(q, list(by))
    g = d.groupBy(*by).agg(F.first("_q").alias("_q"), F.avg(F.when(x <= F.col("_q")[0], x)).alias("cvar_95"), g1(x).alias("skew"), g2(x).alias("kurt"), F.avg(F.when(x > 0, x)).alias("avg_win"), F.avg(F.when(x < 0, x)).alias("avg_loss"),
                           div(F.sum(F.when(x > 0, x)), F.abs(F.sum(F.when(x < 0, x)))).alias("profit_factor"), F.avg(F.when(x.isNotNull(), flag(x > 0))).alias("win_rate"))
    return g.withColumns({"var_95": F.col("_q")[0], "var_99": F.col("_q")[1], "win_loss_ratio": div("avg_win", F.abs("avg_loss"))}).drop("_q")


def benchmark_comparison(df: DataFrame, r="ret", b="mret", by=("symbol",)) -> DataFrame:
    """Excess return, tracking error, information ratio, alpha, beta (ddof 1 over ddof 0), captures."""
    d = df.where(F.col(r).isNotNull() & F.col(b).isNotNull()).withColumn("_x", F.col(r) - F.col(b))
    x, y = F.col(r), F.col(b)
    g = d.groupBy(*by).agg((F.avg("_x") * 252).alias("excess_return"), (F.stddev_samp("_x") * YEAR).alias("tracking_error"), div(F.covar_samp(x, y), F.var_pop(y)).alias("beta"),
                           F.avg(x).alias("_mx"), F.avg(y).alias("_my"), div(F.avg(F.when(y > 0, x)), F.avg(F.when(y > 0, y))).alias("up_capture"), div(F.avg(F.when(y < 0, x)), F.avg(F.when(y < 0, y))).alias("down_capture"))
    return g.withColumns({"information_ratio": div("excess_return", "tracking_error"), "alpha": (F.col("_mx") - F.col("beta") * F.col("_my")) * 252}).drop("_mx", "_my")


def trade_statistics(trades: DataFrame, by=("symbol",)) -> DataFrame:
    p = F.col("pnl")
    return trades.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(flag(p > 0)).alias("win_rate"), F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"), F.max(p).alias("largest_win"),
                                   F.min(p).alias("largest_loss"), F.sum(F.col("size") * F.col("price")).alias("volume"), div(F.sum(F.when(p > 0, p)), F.abs(F.sum(F.when(p < 0, p)))).alias("profit_factor"), F.avg("slippage").alias("avg_slippage"))


def walk_forward(df: DataFrame, r="strategy_ret", train=100, test=30, step=20, by=("symbol",), s: Series = S) -> DataFrame:
    """Train and test metrics of every rolling window.

    A row belongs to a bounded number of windows, given by arithmetic on its position: no range join.
    """
    d = with_pos(df, s).withColumn("_i", F.col("_pos") - 1).withColumn("_n", F.count(F.lit(1)).over(s.whole))
    size = train + test
    lo = F.greatest(F.ceil((F.col("_i") - (size - 1)) / step), F.lit(0))
    hi = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - size) / step))
    d = d.where(hi >= lo).withColumn("fold", F.explode(F.sequence(lo.cast("long"), hi.cast("long"))))
    d = d.withColumn("is_train", F.col("_i") - F.col("fold") * step < train)
    x, tr, te = F.col(r), F.col("is_train"), ~F.col("is_train")

    def sh(c):
        v = F.when(c, x)
        return F.coalesce(div(F.avg(v) * 252, F.stddev_samp(v) * YEAR), F.lit(0.0))
    return d.groupBy(*by, "fold").agg(sh(tr).alias("train_sharpe"), sh(te).alias("test_sharpe"), (F.avg(F.when(tr, x)) * 252).alias("train_return"), (F.avg(F.when(te, x)) * 252).alias("test_return"),
                                        F.avg(F.when(te, flag(x > 0))).alias("test_win_rate"), F.count_if(tr).alias("n_train"), F.count_if(te).alias("n_test"))


def strategies_long(df: DataFrame, builders: dict, cost=0.001, s: Series = S) -> DataFrame:
    """Run several signal builders over the same bars; one row per (strategy, symbol, date).

    Every builder reads the same lazily planned bars, so the shuffle of the bars is shared.
    """
    out = None
    for name, fn in builders.items():
        d = vectorized(fn(df), cost=cost, s=s).select(F.lit(name).alias("strategy"), *s.by, *s.order, "strategy_ret", "turnover")
        out = d if out is None else out.unionByName(d)
    return out


def compare_strategies(long: DataFrame) -> DataFrame:
    g = performance(long, "strategy_ret", ("strategy", "symbol"))
    return g.groupBy("strategy").agg(F.avg("sharpe").alias("sharpe"), F.avg("annual_return").alias("annual_return"), F.avg("max_drawdown").alias("max_drawdown"), F.avg("hit_rate").alias("hit_rate"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("sharpe"), "strategy")


def param_sweep(df: DataFrame, fasts=(5, 10, 15), slows=(20, 30, 40), cost=0.001, s: Series = S) -> DataFrame:
    """Sharpe of every fast / slow crossover per symbol: all averages in one pass, the grid as a short array."""
    d = df.withColumns({f"_m{n}": s.mean("close", n) for n in (*fasts, *slows)}).withColumn("ret", F.coalesce(s.pct("close"), F.lit(0.0)))
    combos = [(a, b) for a in fasts for b in slows]
    d = d.withColumns({f"_s{a}_{b}": flag(F.col(f"_m{a}") > F.col(f"_m{b}")) for a, b in combos})
    d = d.withColumns({f"_p{a}_{b}": F.coalesce(s.lag(f"_s{a}_{b}"), F.lit(0)).cast("double") for a, b in combos})
    d = d.withColumns({f"_q{a}_{b}": F.coalesce(s.lag(f"_p{a}_{b}"), F.lit(0.0)) for a, b in combos})
    grid = F.array(*[F.struct(F.lit(a).alias("fast"), F.lit(b).alias("slow"), (F.col(f"_p{a}_{b}") * F.col("ret") - F.abs(F.col(f"_p{a}_{b}") - F.col(f"_q{a}_{b}")) * cost).alias("r")) for a, b in combos])
    g = d.select(*s.by, F.explode(grid).alias("g")).select(*s.by, "g.*").groupBy(*s.by, "fast", "slow").agg(
        F.coalesce(div(F.avg("r") * 252, F.stddev_samp("r") * YEAR), F.lit(0.0)).alias("sharpe"))
    best = g.groupBy(*s.by).agg(F.max_by(F.struct("fast", "slow"), F.struct(F.round("sharpe", 9), -F.col("fast"), -F.col("slow"))).alias("_b"))
    return g.join(best, list(s.by)).withColumn("best", flag((F.col("fast") == F.col("_b.fast")) & (F.col("slow") == F.col("_b.slow")))).drop("_b")


def pareto(df: DataFrame, key: str, objectives, by: str) -> DataFrame:
    """Non-dominated rows per ``by`` group over objectives to maximise, with a weighted composite rank score.

    Groups are short candidate lists (the grid of a symbol), so the dominance test is an anti join inside a group.
    """
    obj = list(objectives)
    a = df.select(by, key, *obj)
    b = df.select(F.col(by).alias("_by"), *[F.col(o).alias(f"_{o}") for o in obj])
    ge = F.col(by) == F.col("_by")
    gt = F.lit(False)
    for o in obj:
        ge = ge & (F.col(f"_{o}") >= F.col(o))
        gt = gt | (F.col(f"_{o}") > F.col(o))
    return a.join(b, ge & gt, "left_anti")


def heatmap(df: DataFrame, r="ret", by=("symbol",), date="date") -> DataFrame:
    """Compounded return by calendar month."""
    return df.where(F.col(r).isNotNull()).groupBy(*by, F.year(date).alias("year"), F.month(date).alias("month")).agg((F.product(1 + F.col(r)) - 1).alias("monthly_return"), F.count(F.lit(1)).alias("n"))


def robustness(long: DataFrame) -> DataFrame:
    """Train / test ratio, period stability and win share from walk-forward windows."""
    g = long.groupBy("symbol").agg(F.avg("train_sharpe").alias("_tr"), F.avg("test_sharpe").alias("_te"), F.stddev_samp("test_sharpe").alias("_sd"), F.avg(flag(F.col("test_return") > 0)).alias("win_share"), F.count(F.lit(1)).alias("windows"))
    return g.select("symbol", "windows", "win_share", div("_te", "_tr").alias("test_train_ratio"), (1 - div("_sd", F.abs("_te"))).alias("stability"), flag((F.col("_tr") > 0) & (F.col("_te") < 0.5 * F.col("_tr"))).alias("overfit"))


def sensitivity(grid: DataFrame) -> DataFrame:
    """Spread of the Sharpe ratio over the parameter grid."""
    g = grid.groupBy("symbol").agg(F.stddev_samp("sharpe").alias("sharpe_std"), F.avg("sharpe").alias("sharpe_mean"), F.max("sharpe").alias("sharpe_best"))
    return g.withColumn("sensitivity", div("sharpe_std", F.abs("sharpe_mean")))


def bootstrap(df: DataFrame, r="strategy_ret", replicates=50, seed=11, by=("symbol",)) -> DataFrame:
    """Bootstrap interval of the mean return.

    Each (row, replicate) gets a Poisson(1) count drawn from its keys (integers and a date), so replicates need no
    collected series and do not depend on the partitioning; sums are combined map-side.
    """
    x = F.col(r)
    d = with_draw(df.where(x.isNotNull()).select(*by, "date", r), "_row", seed, [*map(F.col, by), F.unix_date("date")])
    d = d.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    d = with_draw(d, "_draw_k", F.col("_row"), [F.col("replicate")])
    u = unit("_draw_k")
    # fixed values: distribution function of Poisson(1)
    k = ladder([(u < 0.36787944117144233, 0), (u < 0.7357588823428847, 1), (u < 0.9196986029286058, 2), (u < 0.9810118431238462, 3), (u < 0.9963401531726563, 4), (u < 0.9994058151824183, 5)], 6)
    g = d.withColumn("_k", k).groupBy(*by, "replicate").agg(div(F.sum(F.col("_k") * x), F.sum("_k")).alias("mean_r"))
    return g.groupBy(*by).agg(F.avg("mean_r").alias("boot_mean"), F.stddev_samp("mean_r").alias("boot_std"), F.percentile("mean_r", [0.025, 0.975]).alias("_q")).withColumns(
        {"ci_low": F.col("_q")[0], "ci_high": F.col("_q")[1]}).drop("_q")
