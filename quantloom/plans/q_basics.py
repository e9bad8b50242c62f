"""Queries of sources, filters, joins, aggregates, windows, top-k, sets and scalar features."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quantloom.functions.exact import quantiles, unpivot, with_group_stats, with_ranks
from quantloom.functions.series import S, div, flag, ladder, span, with_pos
from quantloom.operators import relational as R
from quantloom.plans.registry import query
from quantloom.plans.sql import Q, chain, ewm
from quantloom.plans.sql import flag as qflag
from quantloom.session import shared_folder
from quantloom.sources import io

K = "symbol date"
OHLCV = "open high low close volume"


# --- A: sources and sinks ---------------------------------------------------------------------
@query("read_ohlcv_files", K, OHLCV, sql="SELECT * FROM bars", tables="bars")
def read_ohlcv_files(t):
    path = io.write_bars(t.bars(), shared_folder(t.spark, "bars"))
    return io.read_bars(t.spark, path)


@query("write_bars_parquet_csv", "symbol date", "close", sql="SELECT * FROM bars", tables="bars")
def write_bars_parquet_csv(t):
    path = io.write_bars(t.bars(), shared_folder(t.spark, "bars-csv"), "csv")
    return io.read_bars(t.spark, path, "csv")


@query("bars_table_append", K, OHLCV, sql="SELECT * FROM bars", tables="bars")
def bars_table_append(t):
    """First half written, then the whole appended: the overlap is not stored twice."""
    b = t.bars()
    path = io.write_bars(b.where(F.col("date") < "1999-01-01"), shared_folder(t.spark, "append"))
    return io.append_bars(b, path)


@query("factor_table_append", "symbol date factor_name", "factor_value",
       sql="SELECT symbol, date, 'ret' AS factor_name, ret AS factor_value FROM returns WHERE ret IS NOT NULL UNION ALL "
           "SELECT symbol, date, 'close', close FROM returns", tables="returns")
def factor_table_append(t):
    path = shared_folder(t.spark, "factors")
    long = unpivot(t.returns(), ["symbol", "date"], ["ret", "close"], "factor_name", "factor_value")
    io.append_factors(long.where(F.col("factor_value").isNotNull()), path)
    return t.spark.read.schema("symbol long, date date, factor_value double, factor_name string").parquet(path)


@query("report_sink_json_csv", "date", "avg_close avg_volume", "n", sql="SELECT date, avg(close) AS avg_close, avg(volume) AS avg_volume, count(*) AS n FROM bars GROUP BY 1", tables="bars")
def report_sink_json_csv(t):
    """A report written as JSON and as CSV, read back from both."""
    rep = t.bars().groupBy("date").agg(F.avg("close").alias("avg_close"), F.avg("volume").alias("avg_volume"), F.count(F.lit(1)).alias("n"))
    js, cs = shared_folder(t.spark, "report-json"), shared_folder(t.spark, "report-csv")
    io.report_rows_json(rep.select("date", "avg_close", "n"), js)
    io.report_rows_csv(rep.select("date", "avg_volume"), cs)
    a = t.spark.read.schema("date date, avg_close double, n long").json(js)
    return a.join(t.spark.read.schema("date date, avg_volume double").option("header", "true").csv(cs), "date")


PERF = ("SELECT sector AS strategy_name, date, avg(ret) AS returns, count(*) AS n FROM returns JOIN sector USING (symbol) "
        "WHERE ret IS NOT NULL GROUP BY 1, 2")


def strategy_rows(t):
    return (t.returns().where(F.col("ret").isNotNull()).join(t.sector(), "symbol")
            .groupBy(F.col("sector").alias("strategy_name"), "date").agg(F.avg("ret").alias("returns"), F.count(F.lit(1)).alias("n")))


@query("strategy_perf_append", "strategy_name date", "returns", "held", sql=f"SELECT *, n AS held FROM ({PERF})", tables="returns sector")
def strategy_perf_append(t):
    path = shared_folder(t.spark, "perf")
    rows = strategy_rows(t).withColumn("positions", F.create_map(F.lit("held"), F.col("n"))).drop("n")
    io.append_strategy_performance(rows, path)
    return t.spark.read.parquet(path).withColumn("held", F.get_json_object("positions", "$.held").cast("long"))


@query("upsert_by_key", K, "close", "version",
       sql="SELECT b.symbol, b.date, CASE WHEN s.symbol IS NULL THEN b.close ELSE s.close END AS close, "
           "CASE WHEN s.symbol IS NULL THEN 1 ELSE 2 END AS version FROM bars b LEFT JOIN second_source s USING (symbol, date)",
       tables="second_source")
def upsert_by_key(t):
    base = t.closes().withColumn("version", F.lit(1))
    upd = t.second_source().select("symbol", "date", "close").withColumn("version", F.lit(2))
    return io.upsert(base, upd, ["symbol", "date"], "version")


@query("delete_by_key_or_age", K, "close", sql="SELECT * FROM bars WHERE NOT (date < DATE '1999-01-01' OR volume < 20)", tables="bars")
def delete_by_key_or_age(t):
    return io.delete_where(t.bars(), (F.col("date") < "1999-01-01") | (F.col("volume") < 20))


@query("source_precedence_union", K, "close", "source_rank",
       sql="WITH main AS (SELECT * FROM bars WHERE symbol IN (SELECT symbol FROM positions WHERE market_value > 0)) "
           "SELECT symbol, date, close, 0 AS source_rank FROM main UNION ALL SELECT symbol, date, close, 1 FROM second_source "
           "WHERE symbol NOT IN (SELECT symbol FROM main)", tables="second_source positions")
def source_precedence_union(t):
    return io.first_source_per_symbol([t.main_listing(), t.second_source()])


@query("standardize_ohlcv_columns", K, OHLCV, sql="SELECT * FROM bars", tables="bars")
def standardize_ohlcv_columns(t):
    raw = t.bars().withColumnsRenamed({"symbol": "Ticker", "open": "Open", "high": "High", "low": "L", "close": "CLOSE_PRICE", "volume": "Vol"})
    return io.standardize_columns(raw)


@query("symbol_universe_read", "symbol",
       sql="SELECT DISTINCT p_type AS symbol FROM part WHERE p_type = upper(p_type) ORDER BY 1")
def symbol_universe_read(t):
    return io.symbol_universe(t.read("part"), "p_type")


@query("availability_report", "symbol first_date last_date", "", "records has_data",
       sql="SELECT s_suppkey AS symbol, first_date, last_date, coalesce(records, 0) AS records, CASE WHEN first_date IS NOT NULL THEN 1 ELSE 0 END AS has_data "
           "FROM supplier LEFT JOIN (SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS records FROM bars GROUP BY symbol) "
           "ON s_suppkey = symbol", tables="bars")
def availability_report(t):
    return io.availability(t.read("supplier").select(F.col("s_suppkey").alias("symbol")), t.bars())


# --- B: filters and fills ---------------------------------------------------------------------
@query("filter_symbol_date_range", K, OHLCV, sql="SELECT * FROM bars WHERE symbol = 7 AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", tables="bars")
def filter_symbol_date_range(t):
    return R.date_range(t.bars(), "1996-01-01", "1998-12-31", symbol=7)


@query("filter_factor_date_range", "symbol date factor_name", "factor_value",
       sql="SELECT symbol, date, 'ret' AS factor_name, ret AS factor_value FROM returns WHERE date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31' AND symbol = 7",
       tables="returns")
def filter_factor_date_range(t):
    long = unpivot(t.returns(), ["symbol", "date"], ["ret", "close"], "factor_name", "factor_value")
    return R.date_range(long, "1996-01-01", "1998-12-31", symbol=7, factor_name="ret")


@query("filter_strategy_date_range", "strategy_name date", "returns",
       sql=f"SELECT * FROM ({PERF}) WHERE strategy_name = 'ASIA' AND date BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'", tables="returns sector")
def filter_strategy_date_range(t):
    return R.date_range(strategy_rows(t), "1996-01-01", "1998-12-31", strategy_name="ASIA")


@query("positive_price_filter", K, OHLCV,
       sql="SELECT DISTINCT * FROM dirty_bars WHERE open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume IS NOT NULL", tables="dirty_bars")
def positive_price_filter(t):
    d = t.dirty_bars()
    return R.positive_prices(d.withColumns({c: F.col(c).cast("string") for c in OHLCV.split()}))


DED = "SELECT DISTINCT * FROM dirty_bars"
FFB = f"coalesce(last_value(close IGNORE NULLS) OVER {Q.frame(None, 0)}, first_value(close IGNORE NULLS) OVER {Q.frame(0, None)})"


@query("fill_forward_backward", K, "close", sql=f"SELECT symbol, date, {FFB} AS close FROM ({DED})", tables="dirty_bars")
def fill_forward_backward(t):
    return R.fill_forward_backward(t.dirty_bars().dropDuplicates(), ["close"])


INTERP = chain(f"({DED})", {"p": Q.pos()}, {"kp": "CASE WHEN close IS NOT NULL THEN p END"},
               {"a": f"last_value(kp IGNORE NULLS) OVER {Q.frame(None, 0)}", "b": f"first_value(kp IGNORE NULLS) OVER {Q.frame(0, None)}",
                "va": f"last_value(close IGNORE NULLS) OVER {Q.frame(None, 0)}", "vb": f"first_value(close IGNORE NULLS) OVER {Q.frame(0, None)}"},
               {"lin": "CASE WHEN close IS NOT NULL THEN close WHEN b IS NULL THEN va ELSE va + (vb - va) * (p - a) / nullif(b - a, 0) END",
                "m": "avg(CASE WHEN close IS NULL THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY symbol)"})


@query("fill_interpolate", K, "close", sql=f"SELECT symbol, date, lin AS close FROM ({INTERP})", tables="dirty_bars")
def fill_interpolate(t):
    return R.fill_interpolate(t.dirty_bars().dropDuplicates(), ["close"])


@query("fill_constant_stat", K, "close_mean close_median close_zero",
       sql=f"SELECT symbol, date, coalesce(close, avg(close) OVER w) AS close_mean, coalesce(close, quantile_cont(close, 0.5) OVER w) AS close_median, "
           f"coalesce(close, 0) AS close_zero FROM ({DED}) WINDOW w AS (PARTITION BY symbol)", tables="dirty_bars")
def fill_constant_stat(t):
    d = t.dirty_bars().dropDuplicates().select("symbol", "date", *[F.col("close").alias(f"close_{k}") for k in ("mean", "median", "zero")])
    d = R.fill_stat(d, ["close_mean"])
    return R.fill_stat(R.fill_stat(d, ["close_median"], "median"), ["close_zero"], "zero")


@query("missing_value_auto_strategy", "symbol date close_strategy", "close",
       sql=f"SELECT symbol, date, CASE WHEN m > 0.5 THEN 'drop' WHEN m > 0.1 THEN 'interpolate' ELSE 'ffill' END AS close_strategy, "
           f"CASE WHEN m > 0.5 THEN NULL WHEN m > 0.1 THEN lin ELSE coalesce(va, vb) END AS close FROM ({INTERP})", tables="dirty_bars")
def missing_value_auto_strategy(t):
    return R.missing_strategy(t.dirty_bars().dropDuplicates(), ["close"])


@query("replace_inf", K, "ratio",
       sql=chain(f"({DED})", {"x": "open / nullif(volume, 0)"}, final=f"SELECT symbol, date, coalesce(last_value(x IGNORE NULLS) OVER {Q.frame(None, 0)}, 0) AS ratio FROM {{src}}"),
       tables="dirty_bars")
def replace_inf(t):
    inf = F.lit(float("inf"))
    d = t.dirty_bars().dropDuplicates().withColumn("ratio", F.when(F.col("volume") == 0, inf).otherwise(F.try_divide("open", "volume")))
    return R.replace_inf(d, ["ratio"])


@query("column_clip", K, "ret", sql="SELECT symbol, date, CASE WHEN ret IS NOT NULL THEN least(greatest(ret, -0.1), 0.1) END AS ret FROM returns", tables="returns")
def column_clip(t):
    return R.clip(t.returns(), "ret", -0.1, 0.1)


FAC = chain("returns", {"m20": Q.mean("close", 20), "v60": Q.std("ret", 60), "m252": Q.pct("close", 252)})
FACS = ["m20", "v60", "m252", "close"]


def factor_frame(t):
    return t.returns().withColumns({"m20": S.mean("close", 20), "v60": S.std("ret", 60), "m252": S.pct("close", 252)})


@query("adaptive_column_selection", "name", "valid_ratio", "keep",
       sql=" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) / count(*) AS valid_ratio, CASE WHEN count({c}) / count(*) >= 0.5 THEN 1 ELSE 0 END AS keep FROM f" for c in FACS).join(
           [f"WITH f AS ({FAC}) ", ""]), tables="returns")
def adaptive_column_selection(t):
    return R.valid_ratio(factor_frame(t), FACS)


@query("variance_threshold_select", "name", "variance", "keep",
       sql=f"WITH f AS ({FAC}) " + " UNION ALL ".join(f"SELECT '{c}' AS name, var_samp({c}) AS variance, CASE WHEN var_samp({c}) > 1.0 THEN 1 ELSE 0 END AS keep FROM f" for c in FACS),
       tables="returns")
def variance_threshold_select(t):
    return R.variances(factor_frame(t), FACS, 1.0)


# --- C: joins ---------------------------------------------------------------------------------
@query("inner_align", K, "close other", sql="SELECT symbol, date, d.close, s.close AS other FROM dirty_bars d JOIN second_source s USING (symbol, date) WHERE d.close IS NOT NULL",
       tables="dirty_bars second_source")
def inner_align(t):
    return R.inner_align(t.dirty_bars().select("symbol", "date", "close"), t.second_source().select("symbol", "date", F.col("close").alias("other")))


@query("left_join_panel", K, "close mret m5", sql=chain("market_returns", {"m5": "avg(mret) OVER (ORDER BY date ROWS 4 PRECEDING)"},
       final="SELECT b.symbol, b.date, b.close, m.mret, m.m5 FROM bars b LEFT JOIN {src} m USING (date)"), tables="market_returns")
def left_join_panel(t):
    macro = t.market_returns().withColumn("m5", F.avg("mret").over(Window.orderBy("date").rowsBetween(-4, 0)))
    return t.closes().join(macro, "date", "left")


@query("asof_ffill_join", K, "close sparse",
       sql="SELECT b.symbol, b.date, b.close, s.volume AS sparse FROM bars b ASOF LEFT JOIN second_source s "
           "ON b.symbol = s.symbol AND b.date >= s.date", tables="second_source")
def asof_ffill_join(t):
    sparse = t.second_source().select("symbol", "date", F.col("volume").alias("sparse"))
    return R.asof_ffill(t.closes(), sparse, ["sparse"])


@query("asof_latest_on_or_before", "symbol as_of", "close",
       sql="SELECT symbol, arg_max(close, date) AS close, max(date) AS as_of FROM bars WHERE date <= DATE '1999-06-30' GROUP BY symbol", tables="bars")
def asof_latest_on_or_before(t):
    return R.latest_on_or_before(t.bars(), "1999-06-30", "close")


@query("reindex_fill_value", "symbol date", "close",
       sql="SELECT k.symbol, k.date, coalesce(s.close, 0) AS close FROM bars k LEFT JOIN second_source s USING (symbol, date)", tables="second_source")
def reindex_fill_value(t):
    return R.reindex_fill(t.second_source().select("symbol", "date", "close"), t.bars().select("symbol", "date"), ["symbol", "date"], ["close"])


def pair_sql(cols, src, by=""):
    cols, g = sorted(cols), f"{by}, " if by else ""
    return " UNION ALL ".join(
        f"SELECT {g}'{a}' AS a, '{b}' AS b, count(*) AS n, covar_samp({a}, {b}) AS cov, covar_samp({a}, {b}) / nullif(stddev_samp({a}) * stddev_samp({b}), 0) AS corr "
        f"FROM {src} WHERE {a} IS NOT NULL AND {b} IS NOT NULL {'GROUP BY ' + by if by else ''}" for i, a in enumerate(cols) for b in cols[i + 1:])


@query("pairwise_self_join", "a b", "cov corr", "n", sql=f"WITH f AS ({FAC}) {pair_sql(FACS, 'f')}", tables="returns")
def pairwise_self_join(t):
    return R.column_pairs(factor_frame(t), FACS)


@query("correlation_matrix", "symbol a b", "cov corr", "n", sql=f"WITH f AS ({FAC}) {pair_sql(FACS, 'f', 'symbol')}", tables="returns")
def correlation_matrix(t):
    return R.column_pairs(factor_frame(t), FACS, ["symbol"])


@query("broadcast_dimension_join", "symbol date industry sector", "close", sql="SELECT * FROM bars JOIN sector USING (symbol)", tables="bars sector")
def broadcast_dimension_join(t):
    return t.closes().join(t.sector(), "symbol")


@query("benchmark_join", K, "ret mret", sql="SELECT * FROM returns_market", tables="returns_market")
def benchmark_join(t):
    return t.returns_with_market()


@query("semi_join_universe", K, "close", sql="SELECT * FROM bars WHERE symbol IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)", tables="bars")
def semi_join_universe(t):
    u = t.read("supplier").where(F.col("s_acctbal") > 0).select(F.col("s_suppkey").alias("symbol"))
    return t.closes().join(u, "symbol", "left_semi")


@query("anti_join_missing", "symbol", sql="SELECT c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT symbol FROM bars)", tables="bars")
def anti_join_missing(t):
    return t.read("customer").select(F.col("c_custkey").alias("symbol")).join(t.bars(), "symbol", "left_anti")


def lead_lag_sql():
    return ("WITH l AS (SELECT *, lag(ret) OVER (PARTITION BY symbol ORDER BY date) AS lret FROM industry_panel) "
            "SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, covar_samp(a.ret, b.lret) / nullif(stddev_samp(a.ret) * stddev_samp(b.lret), 0) AS corr "
            "FROM l a JOIN l b ON a.date = b.date AND a.symbol <> b.symbol WHERE b.lret IS NOT NULL AND a.ret IS NOT NULL GROUP BY 1, 2")


@query("lag_lead_cross_join", "a b", "corr", "n", sql=lead_lag_sql(), tables="industry_panel")
def lag_lead_cross_join(t):
    """Ordered industry pairs, one side lagged a week; nodes are a fixed dimension of 25."""
    lagged = t.industry_panel().withColumn("lret", S.lag("ret"))
    a = lagged.select(F.col("symbol").alias("a"), "date", "ret")
    b = lagged.where(F.col("lret").isNotNull()).select(F.col("symbol").alias("b"), "date", "lret")
    return (a.join(b, "date").where(F.col("a") != F.col("b")).groupBy("a", "b")
            .agg(R.corr_agg("ret", "lret").alias("corr"), F.count(F.lit(1)).alias("n")))


@query("param_grid_cross_join", "symbol short long_", "gap", "n",
       sql="SELECT symbol, p.s AS short, p.l AS long_, avg(CASE WHEN p.s = 5 THEN m5 WHEN p.s = 10 THEN m10 END / (CASE WHEN p.l = 20 THEN m20 ELSE m60 END) - 1) AS gap, count(*) AS n "
           f"FROM ({chain('bars', {f'm{n}': Q.mean('close', n) for n in (5, 10, 20, 60)})}) CROSS JOIN (VALUES (5, 20), (5, 60), (10, 20), (10, 60)) p(s, l) GROUP BY 1, 2, 3",
       tables="bars")
def param_grid_cross_join(t):
    """Every parameter pair against every series: one pass computes all lengths, a short array spreads the grid."""
    d = t.closes().withColumns({f"m{n}": S.mean("close", n) for n in (5, 10, 20, 60)})
    grid = F.array(*[F.struct(F.lit(s).alias("short"), F.lit(lg).alias("long_"), (div(f"m{s}", f"m{lg}") - 1).alias("g"))
                     for s in (5, 10) for lg in (20, 60)])
    return (d.select("symbol", F.explode(grid).alias("p")).select("symbol", "p.*")
            .groupBy("symbol", "short", "long_").agg(F.avg("g").alias("gap"), F.count(F.lit(1)).alias("n")))


@query("source_pair_join", K, "close1 close2 diff_pct",
       sql="SELECT b.symbol, b.date, b.close AS close1, s.close AS close2, (s.close - b.close) / b.close * 100 AS diff_pct FROM bars b JOIN second_source s USING (symbol, date)",
       tables="second_source")
def source_pair_join(t):
    a = t.closes().withColumnRenamed("close", "close1")
    b = t.second_source().select("symbol", F.to_date(F.col("date").cast("timestamp")).alias("date"), F.col("close").alias("close2"))
    return a.join(b, ["symbol", "date"]).withColumn("diff_pct", div(F.col("close2") - F.col("close1"), "close1") * 100)


SUPPLY = ("links AS (SELECT symbol, unnest([1, 2, 3]) AS k FROM (SELECT DISTINCT symbol FROM bars)), "
          "supply AS (SELECT symbol, ((symbol - a + k) % (m - a + 1)) + a AS supplier FROM links CROSS JOIN (SELECT max(symbol) AS m, min(symbol) AS a FROM bars))")


@query("supply_chain_join", K, "supplier_ret", "n",
       sql=f"WITH {SUPPLY} SELECT s.symbol, r.date, avg(r.ret) AS supplier_ret, count(r.ret) AS n FROM supply s JOIN returns r ON s.supplier = r.symbol GROUP BY 1, 2", tables="returns")
def supply_chain_join(t):
    links = R.supply_links(t.bars().select("symbol").distinct())
    r = t.returns().select(F.col("symbol").alias("supplier"), "date", "ret")
    return links.join(r, "supplier").groupBy("symbol", "date").agg(F.avg("ret").alias("supplier_ret"), F.count("ret").alias("n"))


# --- D: aggregates ----------------------------------------------------------------------------
@query("hash_agg_basic", "date", "avg_close sum_volume std_close", "n",
       sql="SELECT date, avg(close) AS avg_close, sum(volume) AS sum_volume, stddev_samp(close) AS std_close, count(*) AS n FROM bars GROUP BY date", tables="bars")
def hash_agg_basic(t):
    return t.bars().groupBy("date").agg(F.avg("close").alias("avg_close"), F.sum("volume").alias("sum_volume"),
                                        F.stddev_samp("close").alias("std_close"), F.count(F.lit(1)).alias("n"))


@query("distinct_values", "symbol industry", sql="SELECT DISTINCT symbol, industry FROM bars JOIN sector USING (symbol)", tables="bars sector")
def distinct_values(t):
    return t.bars().select("symbol").distinct().join(t.sector(), "symbol").select("symbol", "industry")


DESC = "count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS std, min({c}) AS min, max({c}) AS max, skewness({c}) AS skew, kurtosis({c}) AS kurt, 1 - count({c}) / count(*) AS null_ratio"


@query("column_statistics", "name", "mean std min max skew kurt null_ratio", "n",
       sql=f"WITH f AS ({FAC}) " + " UNION ALL ".join(f"SELECT '{c}' AS name, {DESC.format(c=c)} FROM f" for c in FACS), tables="returns")
def column_statistics(t):
    return R.describe_columns(factor_frame(t), FACS)


@query("quantiles_exact", "name", "q05 q25 q50 q75 q95",
       sql=" UNION ALL ".join(f"SELECT '{c}' AS name, " + ", ".join(f"quantile_cont({c}, 0.{p}) AS q{p}" for p in ("05", "25", "50", "75", "95")) + " FROM bars" for c in ("close", "volume")),
       tables="bars")
def quantiles_exact(t):
    long = unpivot(t.bars(), ["symbol", "date"], ["close", "volume"])
    return quantiles(long, ["name"], "value", [0.05, 0.25, 0.5, 0.75, 0.95], ["q05", "q25", "q50", "q75", "q95"])


@query("unbiased_skew_kurt", "symbol", "skew kurt", sql="SELECT symbol, skewness(ret) AS skew, kurtosis(ret) AS kurt FROM returns GROUP BY symbol", tables="returns")
def unbiased_skew_kurt(t):
    return t.returns().groupBy("symbol").agg(R.g1(F.col("ret")).alias("skew"), R.g2(F.col("ret")).alias("kurt"))


@query("pearson_corr_agg", "symbol", "corr", sql="SELECT symbol, corr(ret, mret) AS corr FROM returns_market GROUP BY symbol", tables="returns_market")
def pearson_corr_agg(t):
    return t.returns_with_market().groupBy("symbol").agg(R.corr_agg("ret", "mret").alias("corr"))


def rank_cols(cols, by):
    return {f"r_{c}": f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2" for c in cols}


@query("spearman_corr_agg", "symbol", "spearman", "n",
       sql=chain("(SELECT * FROM returns_market WHERE ret IS NOT NULL AND mret IS NOT NULL)", rank_cols(["ret", "mret"], "symbol"),
                 final="SELECT symbol, corr(r_ret, r_mret) AS spearman, count(*) AS n FROM {src} GROUP BY symbol"), tables="returns_market")
def spearman_corr_agg(t):
    return R.spearman(t.returns_with_market(), "ret", "mret")


@query("kendall_corr_agg", "symbol", "kendall", "n",
       sql="WITH v AS (SELECT * FROM returns_market WHERE ret IS NOT NULL AND mret IS NOT NULL) SELECT a.symbol, sum(sign(a.ret - b.ret) * sign(a.mret - b.mret)) / "
           "nullif(sqrt(sum(abs(sign(a.ret - b.ret)))::DOUBLE * sum(abs(sign(a.mret - b.mret)))), 0) AS kendall, max(n) AS n "
           "FROM v a JOIN v b ON a.symbol = b.symbol AND a.date < b.date JOIN (SELECT symbol, count(*) AS n FROM v GROUP BY symbol) c ON c.symbol = a.symbol GROUP BY a.symbol", tables="returns_market")
def kendall_corr_agg(t):
    return R.kendall(t.returns_with_market(), "ret", "mret")


@query("ols_slope_r2", "symbol", "slope intercept r2",
       sql=chain("bars", {"p": Q.pos()}, final="SELECT symbol, regr_slope(close, p) AS slope, regr_intercept(close, p) AS intercept, regr_r2(close, p) AS r2 FROM {src} GROUP BY symbol"), tables="bars")
def ols_slope_r2(t):
    return with_pos(t.closes()).groupBy("symbol").agg(F.regr_slope("close", "_pos").alias("slope"), F.regr_intercept("close", "_pos").alias("intercept"),
                                                      F.regr_r2("close", "_pos").alias("r2"))


@query("hourly_profile", "hour", "avg_size price_std spread", "n",
       sql="SELECT hour(ts) AS hour, avg(size) AS avg_size, stddev_samp(price) AS price_std, max(price) - min(price) AS spread, count(*) AS n FROM ticks GROUP BY 1", tables="ticks")
def hourly_profile(t):
    return t.ticks().groupBy(F.hour("ts").alias("hour")).agg(F.avg("size").alias("avg_size"), F.stddev_samp("price").alias("price_std"),
                                                             (F.max("price") - F.min("price")).alias("spread"), F.count(F.lit(1)).alias("n"))


@query("hourly_rollup", "hour", "total average slow_rate", "n slow",
       sql="SELECT date_trunc('hour', ts) AS hour, count(*) AS n, count(*) FILTER (WHERE value > 50) AS slow, sum(value) AS total, avg(value) AS average, "
           "count(*) FILTER (WHERE value > 50) / count(*) AS slow_rate FROM metrics GROUP BY 1", tables="metrics")
def hourly_rollup(t):
    slow = F.count_if(F.col("value") > 50)
    return t.metrics().groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), slow.alias("slow"), F.sum("value").alias("total"), F.avg("value").alias("average"), (slow / F.count(F.lit(1))).alias("slow_rate"))


@query("latency_percentiles", "metric trend", "mean max p95 p99",
       sql="SELECT m.metric, avg(value) AS mean, max(value) AS max, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99, "
           "CASE WHEN regr_slope(value, epoch(ts) / 86400) > 0.01 THEN 'up' WHEN regr_slope(value, epoch(ts) / 86400) < -0.01 THEN 'down' ELSE 'flat' END AS trend FROM metrics m GROUP BY m.metric",
       tables="metrics")
def latency_percentiles(t):
    m = t.metrics().withColumn("_d", F.unix_micros("ts") / 86400e6)
    base = m.groupBy("metric").agg(F.avg("value").alias("mean"), F.max("value").alias("max"), F.regr_slope("value", "_d").alias("_s"))
    base = base.withColumn("trend", ladder([(F.col("_s") > 0.01, "up"), (F.col("_s") < -0.01, "down")], "flat"))
    return base.join(quantiles(m, ["metric"], "value", [0.95, 0.99], ["p95", "p99"]), "metric")


@query("resample_daily_mean", "symbol day", "price",
       sql="SELECT symbol, CAST(ts AS DATE) AS day, avg(price) AS price FROM ticks GROUP BY 1, 2", tables="ticks")
def resample_daily_mean(t):
    return t.ticks().groupBy("symbol", F.to_date("ts").alias("day")).agg(F.avg("price").alias("price"))


TB = ("SELECT symbol, date_trunc('hour', ts) AS bar_start, arg_min(price, struct_pack(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, struct_pack(ts, event_id)) AS close, "
      "sum(size) AS volume, sum(price * size) / nullif(sum(size), 0) AS vwap, count(*) AS n FROM ticks GROUP BY 1, 2")


@query("ticks_to_bars", "symbol bar_start", "open high low close vwap", "volume n", sql=TB, tables="ticks")
def ticks_to_bars(t):
    from quantloom.streaming.ticks import bars_from_ticks
    return bars_from_ticks(t.ticks(), "1 hour").withColumn("bar_start", F.col("bar_start").cast("timestamp_ntz"))


@query("seasonal_month_effect", "symbol month", "effect", "n", sql="SELECT symbol, month(date) AS month, avg(ret) AS effect, count(ret) AS n FROM returns GROUP BY 1, 2", tables="returns")
def seasonal_month_effect(t):
    return t.returns().groupBy("symbol", F.month("date").alias("month")).agg(F.avg("ret").alias("effect"), F.count("ret").alias("n"))


@query("normalized_text_group", "pattern", "mean_len max_len", "n",
       sql="SELECT regexp_replace(regexp_replace(p_name, '''[^'']*''', '?', 'g'), '[0-9]+', 'N', 'g') || ' ' || regexp_replace(p_brand, '[0-9]+', 'N', 'g') AS pattern, "
           "count(*) AS n, avg(p_retailprice) AS mean_len, max(p_retailprice) AS max_len FROM part GROUP BY 1")
def normalized_text_group(t):
    def norm(c):
        return F.regexp_replace(F.regexp_replace(c, "'[^']*'", "?"), "[0-9]+", "N")
    return t.read("part").groupBy(F.concat_ws(" ", norm(F.col("p_name")), norm(F.col("p_brand"))).alias("pattern")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("p_retailprice").alias("mean_len"), F.max("p_retailprice").alias("max_len"))


@query("weighted_mean_agg", "date", "vw_close", sql="SELECT date, sum(close * volume) / nullif(sum(volume), 0) AS vw_close FROM bars GROUP BY date", tables="bars")
def weighted_mean_agg(t):
    return t.bars().groupBy("date").agg(div(F.sum(F.col("close") * F.col("volume")), F.sum("volume")).alias("vw_close"))


HHI = ("WITH w AS (SELECT portfolio, symbol, weight, row_number() OVER (PARTITION BY portfolio ORDER BY weight DESC, symbol) AS rn FROM weights) "
       "SELECT portfolio, sum(weight * weight) AS hhi, 1 / sum(weight * weight) AS effective_n, max(weight) AS largest, sum(weight) FILTER (WHERE rn <= 5) AS top5, count(*) AS n FROM w GROUP BY portfolio")


@query("herfindahl_concentration", "portfolio", "hhi effective_n largest top5", "n", sql=HHI, tables="weights")
def herfindahl_concentration(t):
    return R.concentration(t.positions())


# --- E: windows -------------------------------------------------------------------------------
@query("pct_change", K, "p1 p5 p10", sql=chain("bars", {f"p{n}": Q.pct("close", n) for n in (1, 5, 10)}), tables="bars")
def pct_change(t):
    return t.closes().withColumns({f"p{n}": S.pct("close", n) for n in (1, 5, 10)})


@query("diff", K, "d1 d5 d10", sql=chain("bars", {f"d{n}": Q.diff("close", n) for n in (1, 5, 10)}), tables="bars")
def diff(t):
    return t.closes().withColumns({f"d{n}": S.diff("close", n) for n in (1, 5, 10)})


@query("lag_features", K, "close_lag_1 close_lag_5 volume_lag_1 volume_lag_5", sql=chain("bars", {f"{c}_lag_{n}": Q.lag(c, n) for c in ("close", "volume") for n in (1, 5)}), tables="bars")
def lag_features(t):
    return t.bars().withColumns({f"{c}_lag_{n}": S.lag(c, n) for c in ("close", "volume") for n in (1, 5)})


@query("rolling_mean_std_min_max", K, " ".join(f"{a}_{n}" for a in ("mean", "std", "min", "max") for n in (5, 20)),
       sql=chain("bars", {f"{a}_{n}": getattr(Q, a)("close", n) for a in ("mean", "std", "min", "max") for n in (5, 20)}), tables="bars")
def rolling_mean_std_min_max(t):
    return t.closes().withColumns({f"{a}_{n}": getattr(S, a)("close", n) for a in ("mean", "std", "min", "max") for n in (5, 20)})


@query("rolling_skew_kurt", K, "skew_20 kurt_20", sql=chain("returns", {"skew_20": Q.skew("ret", 20), "kurt_20": Q.kurt("ret", 20)}), tables="returns")
def rolling_skew_kurt(t):
    return t.returns().withColumns({"skew_20": S.skew("ret", 20), "kurt_20": S.kurt("ret", 20)})


@query("rolling_median", K, "median_5 median_20", sql=chain("bars", {"median_5": Q.median("close", 5), "median_20": Q.median("close", 20)}), tables="bars")
def rolling_median(t):
    return t.closes().withColumns({"median_5": S.median("close", 5), "median_20": S.median("close", 20)})


@query("rolling_quantile", K, "q25_20 q75_20 iqr_20", sql=chain("bars", {"q25_20": Q.quantile("close", 20, 0.25), "q75_20": Q.quantile("close", 20, 0.75)}, {"iqr_20": "q75_20 - q25_20"}), tables="bars")
def rolling_quantile(t):
    return t.closes().withColumns({"q25_20": S.quantile("close", 20, 0.25), "q75_20": S.quantile("close", 20, 0.75)}).withColumn("iqr_20", F.col("q75_20") - F.col("q25_20"))


def rank_pct(x, n):
    a = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {Q.frame(-(n - 1))}"
    return (f"(CASE WHEN count({x}) OVER {Q.frame(-(n - 1))} >= {n} AND {x} IS NOT NULL THEN (len(list_filter({a}, lambda z_: z_ < {x})) + "
            f"(len(list_filter({a}, lambda z_: z_ = {x})) + 1) / 2.0::DOUBLE) / {n} END)")


@query("rolling_rank_pct", K, "rank_20", sql=chain("bars", {"rank_20": rank_pct("close", 20)}), tables="bars")
def rolling_rank_pct(t):
    return t.closes().withColumn("rank_20", S.rank_pct("close", 20))


def score_pct(x, n):
    f = Q.frame(-(n - 1), -1)
    a = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {f}"
    return (f"(CASE WHEN count({x}) OVER {f} >= {n - 1} AND {x} IS NOT NULL THEN (len(list_filter({a}, lambda z_: z_ < {x})) + "
            f"len(list_filter({a}, lambda z_: z_ <= {x}))) / 2.0::DOUBLE / {n - 1} END)")


@query("rolling_percentile_of_score", K, "pos_20", sql=chain("bars", {"pos_20": score_pct("close", 20)}), tables="bars")
def rolling_percentile_of_score(t):
    return t.closes().withColumn("pos_20", S.score_pct("close", 20))


@query("rolling_corr_cov_beta", K, "corr_30 cov_30 beta_60", sql=chain("returns_market", {"corr_30": Q.corr("ret", "mret", 30), "cov_30": Q.over("covar_samp(ret, mret)", "ret", 30), "beta_60": Q.beta("ret", "mret", 60)}), tables="returns_market")
def rolling_corr_cov_beta(t):
    return t.returns_with_market().withColumns({"corr_30": S.corr("ret", "mret", 30), "cov_30": S.cov("ret", "mret", 30), "beta_60": S.beta("ret", "mret", 60)})


@query("rolling_autocorr", K, "ac_20", sql=chain("returns", {"rl": Q.lag("ret")}, {"ac_20": Q.corr("ret", "rl", 19)}), tables="returns")
def rolling_autocorr(t):
    return t.returns().withColumn("_l", S.lag("ret")).withColumn("ac_20", S.corr("ret", "_l", 19))


@query("rolling_slope", K, "slope_20", sql=chain("bars", {"pos": Q.pos()}, {"slope_20": Q.slope("close", 20)}), tables="bars")
def rolling_slope(t):
    return with_pos(t.closes()).withColumn("slope_20", S.slope("close", 20))


@query("ewm_mean", K, "ema_adj ema_rec", sql=chain("bars", ewm("{src}", "close", "ema_adj", 2 / 21, True), ewm("{src}", "close", "ema_rec", 2 / 6, False)), tables="bars")
def ewm_mean(t):
    return S.ewm(t.closes(), {"ema_adj": ("close", span(20), True), "ema_rec": ("close", span(5), False)})


# decay by row position over all rows; the recursion row by row
GAPS = ("SELECT symbol, date, CASE WHEN (symbol * 3 + (date - DATE '1970-01-05') // 7) % 5 IN (0, 3) THEN NULL ELSE close END AS close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM bars")
EWG = (f"WITH RECURSIVE g AS MATERIALIZED ({GAPS}), adj AS (SELECT a.symbol, a.n, sum(pow(19/21::DOUBLE, a.n - b.n) * b.close) / sum(pow(19/21::DOUBLE, a.n - b.n)) AS y FROM g a JOIN g b ON a.symbol = b.symbol AND b.n <= a.n WHERE b.close IS NOT NULL GROUP BY 1, 2), "
       "rec(symbol, n, y, w) AS (SELECT symbol, 0::BIGINT, NULL::DOUBLE, 1::DOUBLE FROM g GROUP BY 1 UNION ALL "
       "SELECT g.symbol, g.n, CASE WHEN g.close IS NULL THEN r.y WHEN r.y IS NULL THEN g.close ELSE (r.w * 2 / 3 * r.y + g.close / 3) / (r.w * 2 / 3 + 1 / 3::DOUBLE) END, CASE WHEN g.close IS NULL THEN r.w * 2 / 3 ELSE 1 END "
       "FROM rec r JOIN g ON g.symbol = r.symbol AND g.n = r.n + 1) "
       "SELECT g.symbol, g.date, adj.y AS ema_adj, rec.y AS ema_rec FROM g LEFT JOIN adj USING (symbol, n) LEFT JOIN rec USING (symbol, n)")


@query("ewm_mean_gaps", K, "ema_adj ema_rec", sql=EWG, tables="bars")
def ewm_mean_gaps(t):
    """Exponential means over closes with holes, single and in a row, at the start, inside and at the end."""
    week = (F.datediff("date", F.lit("1970-01-05")) / 7).cast("long")
    holed = t.closes().withColumn("close", F.when(~((F.col("symbol") * 3 + week) % 5).isin(0, 3), F.col("close")))
    return S.ewm(holed, {"ema_adj": ("close", span(20), True), "ema_rec": ("close", span(5), False)})


@query("ewm_cov", "symbol", "cov", sql=chain("returns_market",
       {"w": "CASE WHEN ret IS NOT NULL AND mret IS NOT NULL THEN pow(0.94::DOUBLE, count(*) OVER (PARTITION BY symbol) - row_number() OVER (PARTITION BY symbol ORDER BY date)) END"},
       final="SELECT symbol, (sum(w * ret * mret) - sum(w * ret) * sum(w * mret) / sum(w)) / (sum(w) - sum(w * w) / sum(w)) AS cov FROM {src} GROUP BY symbol HAVING count(w) > 0"), tables="returns_market")
def ewm_cov(t):
    return S.ewm_cov(t.returns_with_market(), "ret", "mret", 0.06).withColumnRenamed("ewm_cov", "cov")


@query("expanding_max_cummax", K, "peak trough drawdown", sql=chain("bars", {"peak": Q.cum("max(close)"), "trough": Q.cum("min(close)")}, {"drawdown": "close / peak - 1"}), tables="bars")
def expanding_max_cummax(t):
    return t.closes().withColumns({"peak": S.cummax("close"), "trough": S.cummin("close")}).withColumn("drawdown", div("close", "peak") - 1)


@query("cumulative_sum_product", K, "cum_volume growth", sql=chain("returns", {"g1": "1 + coalesce(ret, 0)"}, {"cum_volume": Q.cum("sum(volume)"), "growth": Q.cum("product(g1)")}), tables="returns")
def cumulative_sum_product(t):
    return t.returns().withColumns({"cum_volume": S.cumsum("volume"), "growth": S.cumprod(1 + F.coalesce("ret", F.lit(0.0)))})


@query("streak_length", K, "", "consecutive_up_days consecutive_down_days",
       sql=chain("bars", {"d": Q.diff("close")}, {"u": qflag("d > 0"), "n": qflag("d < 0")},
                 {"gu": f"CASE WHEN u IS DISTINCT FROM lag(u) OVER ({Q.w}) THEN 1 ELSE 0 END", "gn": f"CASE WHEN n IS DISTINCT FROM lag(n) OVER ({Q.w}) THEN 1 ELSE 0 END"},
                 {"iu": Q.cum("sum(gu)"), "i_n": Q.cum("sum(gn)")},
                 {"consecutive_up_days": "u * row_number() OVER (PARTITION BY symbol, iu ORDER BY date)", "consecutive_down_days": "n * row_number() OVER (PARTITION BY symbol, i_n ORDER BY date)"}), tables="bars")
def streak_length(t):
    from quantloom.operators.technical import streaks
    return streaks(t.closes())


@query("row_number_rank_by_date", "symbol date", "close", "position", sql="SELECT *, rank() OVER (PARTITION BY date ORDER BY close DESC) AS position FROM bars", tables="bars")
def row_number_rank_by_date(t):
    return R.rank_by_date(t.closes(), "close")


@query("cross_sectional_pct_rank", K, "rank_min rank_avg",
       sql="SELECT symbol, date, rank() OVER (PARTITION BY date ORDER BY volume) / count(*) OVER (PARTITION BY date) AS rank_min, "
           "(rank() OVER (PARTITION BY date ORDER BY volume) + (count(*) OVER (PARTITION BY date, volume) - 1) / 2) / count(*) OVER (PARTITION BY date) AS rank_avg FROM bars", tables="bars")
def cross_sectional_pct_rank(t):
    return with_ranks(t.bars(), ["symbol", "date"], ["date"], {"rank_min": ("volume", "min"), "rank_avg": ("volume", "avg")})


@query("centered_rolling_extrema", K, "", "local_max local_min", sql=chain("bars", {"local_max": qflag(f"{Q.max('close', 20, lo=-10, hi=9)} = close"), "local_min": qflag(f"{Q.min('close', 20, lo=-10, hi=9)} = close")}), tables="bars")
def centered_rolling_extrema(t):
    return t.closes().withColumns({"local_max": flag(S.max("close", 20, lo=-10, hi=9) == F.col("close")), "local_min": flag(S.min("close", 20, lo=-10, hi=9) == F.col("close"))})


@query("ntile_qcut", K, "volume", "bucket", sql="SELECT symbol, date, volume, floor((rank() OVER (PARTITION BY date ORDER BY volume) - 1) * 5 / count(*) OVER (PARTITION BY date)) + 1 AS bucket FROM bars", tables="bars")
def ntile_qcut(t):
    return R.bucketize(t.bars(), "volume", 5, ["date"])


@query("intraday_cumulative", "symbol ts", "cum_change", sql=chain("ticks", {"day": "CAST(ts AS DATE)"}, {"cum_change": "price / first_value(price) OVER (PARTITION BY symbol, day ORDER BY ts, event_id) - 1"}), tables="ticks")
def intraday_cumulative(t):
    # the first price of a day is an aggregate, so a hot symbol's ticks never meet in one window
    d = with_group_stats(t.ticks().withColumn("day", F.to_date("ts")), ["symbol", "day"], {"_first": F.min_by("price", F.struct("ts", "event_id"))})
    return d.withColumn("cum_change", div("price", "_first") - 1).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("time_position", "symbol", "first_close last_close back_5 back_20",
       sql=chain("bars", {"b5": Q.lag("close", 5), "b20": Q.lag("close", 20)}, final="SELECT symbol, arg_min(close, date) AS first_close, arg_max(close, date) AS last_close, arg_max(b5, date) AS back_5, arg_max(b20, date) AS back_20 FROM {src} GROUP BY symbol"), tables="bars")
def time_position(t):
    d = t.closes().withColumns({"b5": S.lag("close", 5), "b20": S.lag("close", 20)})
    return d.groupBy("symbol").agg(F.min_by("close", "date").alias("first_close"), F.max_by("close", "date").alias("last_close"), F.max_by("b5", "date").alias("back_5"), F.max_by("b20", "date").alias("back_20"))


@query("lead_forward_return", K, "fwd_1 fwd_5 fwd_10 fwd_20", sql=chain("bars", {f"fwd_{h}": f"{Q.lead('close', h)} / close - 1" for h in (1, 5, 10, 20)}), tables="bars")
def lead_forward_return(t):
    return t.closes().withColumns({f"fwd_{h}": div(S.lead("close", h), "close") - 1 for h in (1, 5, 10, 20)})


@query("forward_reversal_flag", K, "", "top bottom", sql=chain("bars", {"top": qflag(f"close > {Q.lag('close')} AND close > {Q.lead('close')}"), "bottom": qflag(f"close < {Q.lag('close')} AND close < {Q.lead('close')}")}), tables="bars")
def forward_reversal_flag(t):
    c = F.col("close")
    return t.closes().withColumns({"top": flag((c > S.lag(c)) & (c > S.lead(c))), "bottom": flag((c < S.lag(c)) & (c < S.lead(c)))})


@query("expanding_split_index", "symbol date split", "", "pos", sql=chain("bars", {"pos": Q.pos(), "n": "count(*) OVER (PARTITION BY symbol)"}, {"split": "CASE WHEN pos <= floor(n * 0.7) THEN 'train' ELSE 'test' END"}), tables="bars")
def expanding_split_index(t):
    d = with_pos(t.closes(), name="pos").withColumn("n", F.count(F.lit(1)).over(S.whole))
    return d.withColumn("split", F.when(F.col("pos") <= F.floor(F.col("n") * 0.7), "train").otherwise("test"))


# --- F, G: top-k and sets -----------------------------------------------------------------------
@query("latest_by_symbol", K, OHLCV, sql="SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1", tables="bars")
def latest_by_symbol(t):
    return io.latest(t.bars())


@query("top_fraction", K, "close", sql="SELECT *, rank() OVER (PARTITION BY date ORDER BY close DESC) AS rk, count(*) OVER (PARTITION BY date) AS n FROM bars QUALIFY rk <= greatest(floor(n * 0.2), 1)", tables="bars")
def top_fraction(t):
    return R.top_fraction(t.closes(), "close", 0.2)


@query("nlargest_by_score", K, "close", sql="SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY date ORDER BY close DESC, symbol) <= 10", tables="bars")
def nlargest_by_score(t):
    return R.top_n(t.closes(), "close", 10, ["date"], ["symbol"])


LEAD = ("WITH l AS (SELECT symbol, date, close / nullif(lag(close, 20) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS m FROM bars), "
        "z AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) ")


@query("head_tail_leaders", "symbol side", "m",
       sql=LEAD + "SELECT * FROM (SELECT symbol, m, 'leader' AS side FROM z WHERE m > 0 ORDER BY m DESC, symbol LIMIT 5) UNION ALL SELECT * FROM (SELECT symbol, m, 'laggard' FROM z WHERE m < 0 ORDER BY m, symbol LIMIT 5)", tables="bars")
def head_tail_leaders(t):
    d = io.latest(t.closes().withColumn("m", S.pct("close", 20)))
    a = R.top_n(d.where(F.col("m") > 0), "m", 5, tie=["symbol"]).withColumn("side", F.lit("leader"))
    return a.unionByName(R.top_n(d.where(F.col("m") < 0), "m", 5, tie=["symbol"], desc=False).withColumn("side", F.lit("laggard")))


@query("order_by_metric", "symbol", "vol", "position", sql="SELECT symbol, stddev_samp(ret) AS vol, rank() OVER (ORDER BY stddev_samp(ret) DESC) AS position FROM returns GROUP BY symbol", tables="returns")
def order_by_metric(t):
    d = t.returns().groupBy("symbol").agg(F.stddev_samp("ret").alias("vol"))
    return R.rank_by_date(d, "vol", ["symbol"], []).orderBy(F.desc("vol"), "symbol")


@query("slow_items_topk", "event_id metric", "value", sql="SELECT * FROM metrics ORDER BY value DESC, event_id LIMIT 50", tables="metrics")
def slow_items_topk(t):
    return R.top_n(t.metrics(), "value", 50, tie=["event_id"])


@query("union_train_test", "symbol date part", "close extra", sql="SELECT symbol, date, 'train' AS part, close, NULL AS extra FROM bars WHERE date < DATE '2000-01-01' UNION ALL SELECT symbol, date, 'test', close, volume FROM bars WHERE date >= DATE '2000-01-01'", tables="bars")
def union_train_test(t):
    b = t.bars()
    tr = b.where(F.col("date") < "2000-01-01").select("symbol", "date", "close").withColumn("part", F.lit("train"))
    te = b.where(F.col("date") >= "2000-01-01").select("symbol", "date", "close", F.col("volume").alias("extra")).withColumn("part", F.lit("test"))
    return tr.unionByName(te, allowMissingColumns=True)


@query("intersect_keys", K, sql="SELECT symbol, date FROM bars INTERSECT SELECT symbol, date FROM second_source", tables="second_source")
def intersect_keys(t):
    return t.bars().select("symbol", "date").intersect(t.second_source().select("symbol", "date"))


@query("except_keys", K, sql="SELECT symbol, date FROM bars EXCEPT SELECT symbol, date FROM second_source", tables="second_source")
def except_keys(t):
    return t.bars().select("symbol", "date").subtract(t.second_source().select("symbol", "date"))


@query("drop_duplicates", K, "close", "copies", sql="SELECT symbol, date, close, count(*) AS copies FROM dirty_bars GROUP BY symbol, date, open, high, low, close, volume", tables="dirty_bars")
def drop_duplicates(t):
    return t.dirty_bars().groupBy("symbol", "date", *OHLCV.split()).agg(F.count(F.lit(1)).alias("copies"))


@query("wide_long_reshape", "date name", "value", sql="SELECT date, sector AS name, avg(ret) AS value FROM returns JOIN sector USING (symbol) WHERE ret IS NOT NULL GROUP BY 1, 2", tables="returns sector")
def wide_long_reshape(t):
    """Long to a wide panel (five fixed sectors) and back."""
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]  # fixed values: the sector dimension
    wide = strategy_rows(t).groupBy("date").pivot("strategy_name", names).agg(F.first("returns"))
    return unpivot(wide, ["date"], names).where(F.col("value").isNotNull())


# --- H: scalar --------------------------------------------------------------------------------
@query("calendar_fields", K, "", "year month day dayofweek dayofyear quarter weekofyear",
       sql="SELECT symbol, date, year(date) AS year, month(date) AS month, day(date) AS day, isodow(date) - 1 AS dayofweek, dayofyear(date) AS dayofyear, quarter(date) AS quarter, weekofyear(date) AS weekofyear FROM bars", tables="bars")
def calendar_fields(t):
    return R.calendar_fields(t.closes())


@query("cyclic_encoding", K, "month_sin month_cos day_sin day_cos weekday_sin weekday_cos",
       sql="SELECT symbol, date, " + ", ".join(f"{f}(2 * pi() * {e} / {n}) AS {k}_{f}" for k, e, n in (("month", "month(date)", 12), ("day", "day(date)", 31), ("weekday", "(isodow(date) - 1)", 7)) for f in ("sin", "cos")) + " FROM bars", tables="bars")
def cyclic_encoding(t):
    return R.cyclic_encoding(t.closes())


@query("period_edge_flags", "o_orderkey date", "", "is_month_start is_month_end is_quarter_start is_quarter_end",
       sql="SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date, CASE WHEN day(o_orderdate) = 1 THEN 1 ELSE 0 END AS is_month_start, CASE WHEN last_day(o_orderdate) = CAST(o_orderdate AS DATE) THEN 1 ELSE 0 END AS is_month_end, "
           "CASE WHEN day(o_orderdate) = 1 AND month(o_orderdate) IN (1, 4, 7, 10) THEN 1 ELSE 0 END AS is_quarter_start, CASE WHEN last_day(o_orderdate) = CAST(o_orderdate AS DATE) AND month(o_orderdate) IN (3, 6, 9, 12) THEN 1 ELSE 0 END AS is_quarter_end FROM orders")
def period_edge_flags(t):
    return R.period_edges(t.read("orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")))


def cal_sql():
    nth = "month({d}) = {m} AND isodow({d}) = {w} AND ceil(day({d}) / 7) = {n}"
    def obs(m, d):
        def mv(b): return f"(CASE WHEN isodow({b}) = 6 THEN {b} - INTERVAL 1 DAY WHEN isodow({b}) = 7 THEN {b} + INTERVAL 1 DAY ELSE {b} END)"
        return f"(date = {mv(f'make_date(year(date), {m}, {d})')} OR date = {mv(f'make_date(year(date) + 1, {m}, {d})')})"
    # good fridays as a list: an independent check of the computus
    gf = "'1995-04-14','1996-04-05','1997-03-28','1998-04-10','1999-04-02','2000-04-21','2001-04-13','2002-03-29'"
    hol = " OR ".join([obs(1, 1), nth.format(d="date", m=1, w=1, n=3), nth.format(d="date", m=2, w=1, n=3), f"CAST(date AS VARCHAR) IN ({gf})",
                       "(month(date) = 5 AND isodow(date) = 1 AND day(date) > 24)", obs(7, 4), nth.format(d="date", m=9, w=1, n=1), nth.format(d="date", m=11, w=4, n=4), obs(12, 25)])
    prev = "(date - INTERVAL 1 DAY)"
    return (f"WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders), h AS (SELECT date, CASE WHEN {hol} THEN 1 ELSE 0 END AS is_holiday FROM d), "
            "t AS (SELECT *, CASE WHEN isodow(date) < 6 AND is_holiday = 0 THEN 1 ELSE 0 END AS is_trading_day FROM h) "
            f"SELECT *, CASE WHEN is_trading_day = 1 AND (({nth.format(d=prev, m=11, w=4, n=4)}) OR (month(date) = 12 AND day(date) = 24) OR (month(date) = 7 AND day(date) = 3)) THEN 1 ELSE 0 END AS is_early_close FROM t")


@query("trading_calendar", "date", "", "is_holiday is_trading_day is_early_close", sql=cal_sql())
def trading_calendar(t):
    return R.trading_calendar(t.read("orders").select(F.to_date("o_orderdate").alias("date")).distinct())


@query("trading_hours_flag", "event_id session", "", "local_minute",
       sql="WITH l AS (SELECT event_id, ts - INTERVAL 5 HOUR AS lt FROM events) SELECT event_id, hour(lt) * 60 + minute(lt) AS local_minute, CASE WHEN isodow(lt) > 5 THEN 'closed' "
           "WHEN hour(lt) * 60 + minute(lt) BETWEEN 240 AND 569 THEN 'premarket' WHEN hour(lt) * 60 + minute(lt) BETWEEN 570 AND 959 THEN 'regular' WHEN hour(lt) * 60 + minute(lt) BETWEEN 960 AND 1199 THEN 'afterhours' ELSE 'closed' END AS session FROM l")
def trading_hours_flag(t):
    """The sample times lie in January, when the exchange is five hours behind UTC."""
    return R.session_label(t.ticks())


@query("log_math", K, "log_close log1p_ret log_ret ann_vol pow_ratio",
       sql=chain("returns", {"log_close": "ln(close)", "log1p_ret": "ln(1 + ret)", "log_ret": f"ln(close) - ln({Q.lag('close')})", "ann_vol": f"{Q.std('ret', 20)} * sqrt(252::DOUBLE)", "pow_ratio": "pow(close / open, 0.25::DOUBLE) - 1"}), tables="returns")
def log_math(t):
    return t.returns().withColumns({"log_close": F.log("close"), "log1p_ret": F.log1p("ret"), "log_ret": F.log("close") - F.log(S.lag("close")),
                                    "ann_vol": S.std("ret", 20) * F.sqrt(F.lit(252.0)), "pow_ratio": F.pow(div("close", "open"), F.lit(0.25)) - 1})


@query("sign_where", "symbol date size_class", "", "direction", sql="SELECT symbol, date, CAST(sign(ret) AS BIGINT) AS direction, CASE WHEN abs(ret) > 0.5 THEN 'large' WHEN abs(ret) > 0.1 THEN 'medium' ELSE 'small' END AS size_class FROM returns WHERE ret IS NOT NULL", tables="returns")
def sign_where(t):
    a = F.abs("ret")
    return t.returns().where(F.col("ret").isNotNull()).withColumns({"direction": F.signum("ret"), "size_class": ladder([(a > 0.5, "large"), (a > 0.1, "medium")], "small")})


@query("safe_divide", K, "plain guarded", sql="SELECT DISTINCT symbol, date, close / nullif(volume, 0) AS plain, close / (volume + 1e-8::DOUBLE) AS guarded FROM dirty_bars", tables="dirty_bars")
def safe_divide(t):
    return t.dirty_bars().dropDuplicates().withColumns({"plain": div("close", "volume"), "guarded": F.col("close") / (F.col("volume") + 1e-8)})


@query("interaction_features", K, "close_x_volume close_div_volume high_x_low high_div_low",
       sql="SELECT symbol, date, close * volume AS close_x_volume, close / (volume + 1e-8::DOUBLE) AS close_div_volume, high * low AS high_x_low, high / (low + 1e-8::DOUBLE) AS high_div_low FROM bars", tables="bars")
def interaction_features(t):
    cols = {}
    for a, b in (("close", "volume"), ("high", "low")):
        cols[f"{a}_x_{b}"] = F.col(a) * F.col(b)
        cols[f"{a}_div_{b}"] = F.col(a) / (F.col(b) + 1e-8)
    return t.bars().withColumns(cols)


@query("polynomial_features", K, "ret_pow_2 ret_pow_3", sql="SELECT symbol, date, ret * ret AS ret_pow_2, ret * ret * ret AS ret_pow_3 FROM returns", tables="returns")
def polynomial_features(t):
    return t.returns().withColumns({f"ret_pow_{d}": F.pow("ret", F.lit(float(d))) for d in (2, 3)})


@query("row_wise_stats", K, "row_sum row_mean row_std row_max row_min row_max_min_ratio",
       sql="SELECT symbol, date, open + high + low + close AS row_sum, (open + high + low + close) / 4 AS row_mean, list_stddev_samp([open, high, low, close]) AS row_std, greatest(open, high, low, close) AS row_max, "
           "least(open, high, low, close) AS row_min, greatest(open, high, low, close) / (least(open, high, low, close) + 1e-8::DOUBLE) AS row_max_min_ratio FROM bars", tables="bars")
def row_wise_stats(t):
    return R.row_stats(t.bars(), R.OHLC)


@query("label_encode", "symbol industry", "", "code", sql="SELECT symbol, industry, dense_rank() OVER (ORDER BY industry) - 1 AS code FROM sector", tables="sector")
def label_encode(t):
    return R.label_encode(t.sector(), "industry", "code")


@query("one_hot_dummies", "symbol", "", "africa america asia europe middle_east",
       sql="SELECT symbol, " + ", ".join(f"CASE WHEN sector = '{s}' THEN 1 ELSE 0 END AS {s.lower().replace(' ', '_')}" for s in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM sector", tables="sector")
def one_hot_dummies(t):
    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]  # fixed values: the sector dimension
    return t.sector().select("symbol", *[flag(F.col("sector") == s).alias(s.lower().replace(" ", "_")) for s in names])


@query("value_binning", K, "close", "bin", sql="SELECT symbol, date, close, greatest(least(ceil((close - lo) * 5 / nullif(hi - lo, 0)) - 1, 4), 0) AS bin FROM bars JOIN (SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY symbol) USING (symbol)", tables="bars")
def value_binning(t):
    d = with_group_stats(t.closes(), ["symbol"], {"_lo": F.min("close"), "_hi": F.max("close")})
    return d.withColumn("bin", R.equal_width_bins(F.col("close"), F.col("_lo"), F.col("_hi"), 5))


@query("string_normalize", "p_partkey clean code", sql="SELECT p_partkey, upper(trim(replace(p_name, '.', '-'))) AS clean, regexp_replace(translate(upper(p_brand), '#', '_'), '[^A-Z0-9_]', '', 'g') AS code FROM part")
def string_normalize(t):
    return t.read("part").select("p_partkey", F.upper(F.trim(F.regexp_replace("p_name", r"\.", "-"))).alias("clean"),
                                 F.regexp_replace(F.translate(F.upper("p_brand"), "#", "_"), "[^A-Z0-9_]", "").alias("code"))


@query("json_columns", "event_id packed", "", "k", sql="SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, '{\"type\":\"' || event_type || '\",\"k\":' || json_extract_string(props, '$.k') || '}' AS packed FROM events")
def json_columns(t):
    d = t.read("events").withColumn("p", F.from_json("props", "k long"))
    return d.select("event_id", F.col("p.k").alias("k"), F.to_json(F.struct(F.col("event_type").alias("type"), F.col("p.k").alias("k"))).alias("packed"))


@query("map_columns", "portfolio sector", "exposure", sql="SELECT portfolio, sector, sum(market_value) AS exposure FROM positions GROUP BY 1, 2", tables="positions")
def map_columns(t):
    """Sector exposures packed into one map per portfolio and unpacked again; sectors are five."""
    g = t.positions().groupBy("portfolio", "sector").agg(F.sum("market_value").alias("exposure"))
    m = g.groupBy("portfolio").agg(F.map_from_entries(F.collect_list(F.struct("sector", "exposure"))).alias("m"))
    return m.select("portfolio", F.explode("m").alias("sector", "exposure"))


@query("array_columns", "symbol", "mean_supplier", "n first_supplier", sql=f"WITH {SUPPLY} SELECT symbol, count(*) AS n, min(supplier) AS first_supplier, avg(supplier) AS mean_supplier FROM supply GROUP BY symbol", tables="bars")
def array_columns(t):
    d = R.supply_links(t.bars().select("symbol").distinct()).groupBy("symbol").agg(F.array_sort(F.collect_list("supplier")).alias("s"))
    return d.select("symbol", F.size("s").alias("n"), F.element_at("s", 1).alias("first_supplier"), (F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("s")).alias("mean_supplier"))


@query("enum_threshold_label", "symbol date regime", "vol", sql=chain("returns", {"vol": Q.std("ret", 20), "m": Q.mean("ret", 20)}, {"regime": "CASE WHEN vol IS NULL THEN 'unknown' WHEN vol > 0.6 THEN 'high_vol' WHEN vol < 0.3 THEN 'low_vol' WHEN m > 0.05 THEN 'bull' WHEN m < -0.05 THEN 'bear' ELSE 'sideways' END"}), tables="returns")
def enum_threshold_label(t):
    d = t.returns().withColumns({"vol": S.std("ret", 20), "m": S.mean("ret", 20)})
    v, m = F.col("vol"), F.col("m")
    return d.withColumn("regime", ladder([(v.isNull(), "unknown"), (v > 0.6, "high_vol"), (v < 0.3, "low_vol"), (m > 0.05, "bull"), (m < -0.05, "bear")], "sideways"))


@query("udtf_param_grid", "symbol fast slow", "last_gap",
       sql="WITH g AS (SELECT f AS fast, s AS slow FROM (SELECT unnest([5, 10, 15]) AS f) CROSS JOIN (SELECT unnest([20, 30, 40]) AS s)), " + f"m AS ({chain('bars', {f'm{n}': Q.mean('close', n) for n in (5, 10, 15, 20, 30, 40)})}), "
           "z AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1) SELECT symbol, fast, slow, (CASE fast WHEN 5 THEN m5 WHEN 10 THEN m10 ELSE m15 END) / (CASE slow WHEN 20 THEN m20 WHEN 30 THEN m30 ELSE m40 END) - 1 AS last_gap FROM z CROSS JOIN g", tables="bars")
def udtf_param_grid(t):
    d = io.latest(t.closes().withColumns({f"m{n}": S.mean("close", n) for n in (5, 10, 15, 20, 30, 40)}))
    means = F.create_map(*[x for n in (5, 10, 15, 20, 30, 40) for x in (F.lit(n), F.col(f"m{n}"))])
    d = d.withColumn("fast", F.explode(F.sequence(F.lit(5), F.lit(15), F.lit(5)))).withColumn("slow", F.explode(F.sequence(F.lit(20), F.lit(40), F.lit(10))))
    return d.withColumn("_m", means).withColumn("last_gap", div(F.element_at("_m", F.col("fast")), F.element_at("_m", F.col("slow"))) - 1)
