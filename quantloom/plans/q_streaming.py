"""Streaming queries: the stream drains the event file; the check side computes the same from the table."""
from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.functions.series import flag
from quantloom.plans.registry import query
from quantloom.session import materialise
from quantloom.sources.tables import Tables
from quantloom.streaming import operators as ST
from quantloom.streaming import ticks as TK
from quantloom.streaming.runner import run_append, run_decided, run_sessions, run_two_levels, run_upsert, run_windows

DONE = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"  # final watermark: later windows stay open


def ticks(t: Tables):
    return TK.with_event_time(TK.read_tick_stream(t.spark, t.folder))


def metrics(t: Tables):
    return ticks(t).select("ts", F.col("event_type").alias("metric"), F.col("price").alias("value"), "event_id")


def ntz(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("stream_tick_ingest", "event_id symbol ts event_type", "price", "size", sql="SELECT * FROM ticks", tables="ticks")
def stream_tick_ingest(t):
    return ntz(run_append(ticks(t), "ingest"), "ts")


@query("stream_tumbling_bars", "symbol bar_start", "open high low close vwap", "volume n is_final",
       sql=f"SELECT symbol, date_trunc('hour', ts) AS bar_start, arg_min(price, struct_pack(ts, event_id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, struct_pack(ts, event_id)) AS close, sum(size) AS volume, sum(price * size) / nullif(sum(size), 0) AS vwap, count(*) AS n, "
           f"CASE WHEN date_trunc('hour', max(ts)) + INTERVAL 1 HOUR <= {DONE} THEN 1 ELSE 0 END AS is_final FROM ticks GROUP BY 1, 2", tables="ticks")
def stream_tumbling_bars(t):
    return ntz(run_windows(TK.bars_from_ticks(ticks(t), "1 hour"), "bars", ["symbol", "bar_start"], "bar_start", "1 hour"), "bar_start")


@query("stream_sliding_stats", "symbol start", "mean volatility", "volume n is_final",
       sql=f"WITH w AS (SELECT *, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * CAST(k AS INTEGER) AS start FROM ticks CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS k)) SELECT symbol, start, avg(price) AS mean, stddev_samp(price) AS volatility, sum(size) AS volume, count(*) AS n, CASE WHEN start + INTERVAL 1 HOUR <= {DONE} THEN 1 ELSE 0 END AS is_final FROM w GROUP BY 1, 2", tables="ticks")
def stream_sliding_stats(t):
    return ntz(run_windows(ST.sliding_stats(ticks(t)), "sliding", ["symbol", "start"], "start", "1 hour"), "start")


@query("stream_last_value", "symbol ts", "price", "size", sql="SELECT symbol, ts, price, size FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) = 1", tables="ticks")
def stream_last_value(t):
    return ntz(run_upsert(ST.last_value(ticks(t)), "last", ["symbol"]), "ts")


LN = ("WITH o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY symbol) AS n, price - lead(price) OVER (PARTITION BY symbol ORDER BY ts DESC, event_id DESC) AS d FROM ticks), "
      "g AS (SELECT symbol, max(n) AS n, max(CASE WHEN rn = 1 THEN price END) AS price, CASE WHEN max(n) >= 5 THEN avg(CASE WHEN rn <= 5 THEN price END) END AS sma_5, CASE WHEN max(n) >= 20 THEN avg(CASE WHEN rn <= 20 THEN price END) END AS sma_20, "
      "max(CASE WHEN rn = 1 THEN price END) / max(CASE WHEN rn = 6 THEN price END) - 1 AS momentum, sum(CASE WHEN rn <= 14 AND d > 0 THEN d ELSE 0 END) / 14 AS gain, sum(CASE WHEN rn <= 14 AND d < 0 THEN -d ELSE 0 END) / 14 AS loss, stddev_samp(CASE WHEN rn <= 20 THEN price END) AS sd FROM o GROUP BY 1), "
      "f AS (SELECT *, CASE WHEN n <= 14 THEN NULL WHEN loss = 0 THEN (CASE WHEN gain > 0 THEN 100 END) ELSE 100 - 100 / (1 + gain / loss) END AS rsi, CASE WHEN n >= 20 THEN (price - sma_20) / nullif(sd, 0) END AS zscore FROM g) ")


@query("stream_lastn_features", "symbol", "price sma_5 sma_20 momentum rsi zscore", "n", sql=LN + "SELECT * FROM f", tables="ticks")
def stream_lastn_features(t):
    return run_upsert(ST.lastn_features(ticks(t)), "lastn", ["symbol"])


@query("stream_signal_momentum_meanrev", "symbol momentum_signal meanrev_signal", sql=LN + "SELECT symbol, CASE WHEN sma_5 / nullif(sma_20, 0) - 1 > 0.02 THEN 'BUY' WHEN sma_5 / nullif(sma_20, 0) - 1 < -0.02 THEN 'SELL' ELSE 'HOLD' END AS momentum_signal, CASE WHEN zscore < -2 THEN 'BUY' WHEN zscore > 2 THEN 'SELL' ELSE 'HOLD' END AS meanrev_signal FROM f", tables="ticks")
def stream_signal_momentum_meanrev(t):
    return run_upsert(ST.live_signals(ST.lastn_features(ticks(t))), "signals", ["symbol"])


@query("stream_signal_dedup", "symbol side bucket", sql="SELECT DISTINCT symbol, CASE WHEN event_type = 'purchase' THEN 'BUY' ELSE 'SELL' END AS side, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket FROM ticks", tables="ticks")
def stream_signal_dedup(t):
    return ntz(run_append(ST.signal_dedup(ticks(t)), "dedup"), "bucket")


RULES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in ST.ALERT_RULES)


@query("stream_alert_rules", "name metric start", "peak", "duration_s hits is_final",
       sql=f"WITH r AS (SELECT name, metric, op, lim::DOUBLE AS lim, dur, coalesce(need, ceil(dur / 60)) AS need FROM (VALUES {RULES}) v(name, metric, op, lim, dur, need, enabled) WHERE enabled), "
           "e AS (SELECT *, make_timestamp(CAST(floor(epoch(ts) / dur) * dur * 1000000 AS BIGINT)) AS start, CASE op WHEN '>' THEN value > lim WHEN '<' THEN value < lim WHEN '>=' THEN value >= lim WHEN '<=' THEN value <= lim WHEN '==' THEN value = lim ELSE value <> lim END AS hit FROM metrics JOIN r USING (metric)), "
           "g AS (SELECT name, metric, start, dur AS duration_s, max(need) AS need, count(*) FILTER (WHERE hit) AS hits, max(value) FILTER (WHERE hit) AS peak FROM e GROUP BY 1, 2, 3, 4) "
           f"SELECT *, CASE WHEN start + to_seconds(duration_s) <= {DONE} THEN 1 ELSE 0 END AS is_final FROM g WHERE hits >= need", tables="metrics")
def stream_alert_rules(t):
    rules = t.spark.createDataFrame(ST.ALERT_RULES, ST.RULE_SCHEMA)
    return ntz(run_windows(ST.alert_rules(metrics(t), rules), "alerts", ["name", "start"], "start", "1 second * duration_s"), "start")


@query("stream_position_limits", "symbol level", "gross peak", "position gross_breach position_breach",
       sql="WITH p AS (SELECT symbol, sum(CASE WHEN event_type = 'purchase' THEN size ELSE -size END) AS position, sum(abs(price * size)) AS gross, max(price) AS peak FROM ticks GROUP BY 1) SELECT *, CASE WHEN gross > 120000 THEN 1 ELSE 0 END AS gross_breach, CASE WHEN abs(position) > 1500 THEN 1 ELSE 0 END AS position_breach, "
           "CASE WHEN gross > 120000 AND abs(position) > 1500 THEN 'critical' WHEN gross > 120000 OR abs(position) > 1500 THEN 'high' WHEN gross > 96000 THEN 'warning' ELSE 'normal' END AS level FROM p", tables="ticks")
def stream_position_limits(t):
    """The running positions are the state; every micro-batch runs the batch limit operator on the snapshot."""
    return run_upsert(ST.positions_from_ticks(ticks(t)), "positions", ["symbol"], transform=ST.risk_limits)


RISK = ("WITH d AS (SELECT symbol % 10 AS portfolio, symbol, CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'purchase' THEN size ELSE -size END) AS traded, arg_max(price, struct_pack(ts, event_id)) AS close, sum(size) AS volume FROM ticks GROUP BY 1, 2, 3), "
        "h AS (SELECT portfolio, symbol, sum(traded) * arg_max(close, day) AS value, avg(volume) / (avg(volume) + abs(sum(traded))) AS liquidity FROM d GROUP BY 1, 2), "
        "p AS (SELECT portfolio, sum(value) AS total_value, sum(greatest(value, 0)) AS long_exposure, sum(least(value, 0)) AS short_exposure, max(abs(value)) AS top, avg(liquidity) AS avg_liquidity FROM h GROUP BY 1), "
        "m AS (SELECT portfolio, sum(abs(value)) AS most FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY portfolio ORDER BY abs(value) DESC, symbol) <= 5) GROUP BY 1), "
        "r AS (SELECT portfolio, symbol, day, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS r FROM d), "
        "e AS (SELECT portfolio, day, sum(CASE WHEN total_value > 0 THEN value / total_value ELSE 0 END * r) AS r FROM r JOIN h USING (portfolio, symbol) JOIN p USING (portfolio) WHERE r IS NOT NULL GROUP BY 1, 2), "
        "l AS (SELECT *, product(1 + r) OVER (PARTITION BY portfolio ORDER BY day) AS level FROM e), f AS (SELECT *, level / nullif(max(level) OVER (PARTITION BY portfolio ORDER BY day), 0) - 1 AS fall FROM l), "
        "g AS (SELECT portfolio, -quantile_cont(r, 0.05) AS var_1d, stddev_samp(r) * sqrt(252) AS volatility, abs(min(fall)) AS max_drawdown FROM f GROUP BY 1), "
        "x AS (SELECT portfolio, total_value, long_exposure, short_exposure, avg_liquidity, coalesce(var_1d, 0) AS var_1d, volatility, coalesce(max_drawdown, 0) AS max_drawdown, long_exposure + short_exposure AS net_exposure, "
        "(long_exposure - short_exposure) / greatest(total_value, 1) AS leverage, top / greatest(total_value, 1) AS largest_position, most / greatest(total_value, 1) AS concentration_ratio FROM p JOIN m USING (portfolio) LEFT JOIN g USING (portfolio)), "
        "y AS (SELECT *, CAST(var_1d > 0.02 AS INT) AS var_1d_breach, CAST(leverage > 3 AS INT) AS leverage_breach, CAST(max_drawdown > 0.15 AS INT) AS max_drawdown_breach, CAST(concentration_ratio > 0.2 AS INT) AS concentration_ratio_breach, CAST(avg_liquidity < 0.3 AS INT) AS avg_liquidity_breach FROM x) "
        "SELECT *, CASE WHEN max_drawdown_breach = 1 THEN 'critical' WHEN var_1d_breach + leverage_breach > 0 THEN 'high' WHEN concentration_ratio_breach + avg_liquidity_breach > 0 THEN 'medium' ELSE 'normal' END AS level FROM y")


@query("stream_risk_limits", "portfolio level", "total_value long_exposure short_exposure net_exposure avg_liquidity var_1d volatility max_drawdown leverage largest_position concentration_ratio",
       "var_1d_breach leverage_breach max_drawdown_breach concentration_ratio_breach avg_liquidity_breach", sql=RISK, tables="ticks")
def stream_risk_limits(t):
    """Daily book per symbol as stream state, risk and limits of the portfolios that a micro-batch changed."""
    book = ST.daily_book(ticks(t), F.col("symbol") % 10)
    return run_two_levels(book, "limits", ["portfolio", "symbol", "day"], ["portfolio"], ST.portfolio_risk)


ACT = ("WITH RECURSIVE e AS (SELECT metric, ts, value FROM metrics WHERE value > 60), a AS (SELECT metric, min(ts) AS ts FROM e GROUP BY 1 UNION ALL SELECT a.metric, (SELECT min(e.ts) FROM e WHERE e.metric = a.metric AND e.ts >= a.ts + INTERVAL 240 MINUTE) FROM a WHERE a.ts IS NOT NULL) "
       "SELECT a.metric, a.ts, e.value FROM a JOIN e ON e.metric = a.metric AND e.ts = a.ts")


@query("stream_auto_action_trigger", "metric ts", "value", sql=ACT, tables="metrics")
def stream_auto_action_trigger(t):
    return ntz(run_decided(ST.action_trigger(metrics(t), open_too=True), "actions", ["metric"]), "ts")


@query("stream_window_drift", "metric start", "mean std hit_rate mean_change std_change hit_change", "n is_final",
       sql=f"WITH b AS (SELECT metric, avg(value) AS bm, stddev_samp(value) AS bs, avg(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS bh FROM metrics GROUP BY 1), g AS (SELECT metric, date_trunc('day', ts) AS start, avg(value) AS mean, stddev_samp(value) AS std, avg(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS hit_rate, count(*) AS n FROM metrics GROUP BY 1, 2) "
           f"SELECT g.metric, CAST(start AS TIMESTAMP) AS start, mean, std, hit_rate, n, mean / bm - 1 AS mean_change, std / bs - 1 AS std_change, hit_rate - bh AS hit_change, CASE WHEN start + INTERVAL 1 DAY <= {DONE} THEN 1 ELSE 0 END AS is_final FROM g JOIN b USING (metric)", tables="metrics")
def stream_window_drift(t):
    return ntz(run_windows(ST.drift(metrics(t), ST.baseline_of(t.metrics())), "drift", ["metric", "start"], "start", "1 day"), "start")


# a metric's distance from 20 in thousandths stands in for a return
PERF = ("WITH x AS (SELECT metric, (value - 20) / 1000 AS ret, row_number() OVER (PARTITION BY metric ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY metric ORDER BY ts DESC, event_id DESC) AS j FROM metrics), "
        "l AS (SELECT metric, i, product(1 + ret) OVER (PARTITION BY metric ORDER BY i) AS l, j FROM x), w AS (SELECT metric, max(1 - l / p) AS dd FROM (SELECT metric, l, max(l) OVER (PARTITION BY metric ORDER BY i) AS p FROM l) GROUP BY 1), "
        "v AS (SELECT metric, max(1 - l / p) AS dd FROM (SELECT metric, l, max(l) OVER (PARTITION BY metric ORDER BY i) AS p FROM l WHERE j <= 10) GROUP BY 1), "
        "b AS (SELECT metric, avg(ret) AS m, stddev_pop(ret) AS s, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS h FROM x GROUP BY 1), "
        "r AS (SELECT metric, count(*) AS n, avg(ret) AS m, stddev_pop(ret) AS s, avg(CASE WHEN ret > 0 THEN 1 ELSE 0 END) AS h FROM x WHERE j <= 10 GROUP BY 1) "
        "SELECT r.metric, r.n, r.m AS avg_return, r.m / r.s AS sharpe, v.dd AS max_drawdown, r.h AS win_rate, r.s AS volatility, (r.m - b.m) / abs(b.m) AS return_change, (r.m / r.s - b.m / b.s) / abs(b.m / b.s) AS sharpe_change, "
        "(v.dd - w.dd) / abs(w.dd) AS drawdown_change, (r.h - b.h) / b.h AS win_rate_change, (r.s - b.s) / b.s AS volatility_change FROM r JOIN b USING (metric) JOIN v USING (metric) JOIN w USING (metric)")


@query("stream_performance_drift", "metric", "avg_return sharpe max_drawdown win_rate volatility return_change sharpe_change drawdown_change win_rate_change volatility_change", "n", sql=PERF, tables="metrics")
def stream_performance_drift(t):
    """The newest ten returns of each metric against the whole history."""
    ret = ((F.col("value") - 20) / 1000).alias("ret")
    recent = run_upsert(ST.recent_performance(metrics(t).select("metric", "ts", "event_id", ret)), "recent", ["metric"])
    return ST.performance_drift(recent, ST.performance_baseline(t.metrics().select("metric", "ts", "event_id", ret)))


@query("stream_late_data_policy", "event_type start", "", "n size late is_final", sql=f"SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, sum(size) AS size, 0 AS late, CASE WHEN date_trunc('hour', max(ts)) + INTERVAL 1 HOUR <= {DONE} THEN 1 ELSE 0 END AS is_final FROM ticks GROUP BY 1, 2", tables="ticks")
def stream_late_data_policy(t):
    """Event time with a ten-minute watermark: closed hours are final, later arrivals for them are dropped and counted; open hours are flagged."""
    accepted = run_windows(ST.hourly_counts(ticks(t)), "late", ["event_type", "start"], "start", "1 hour")
    arrived = run_upsert(ST.hourly_arrivals(TK.read_tick_stream(t.spark, t.folder)), "arrived", ["event_type", "start"])
    return ntz(ST.late_counts(accepted, arrived), "start")


SES = (f"WITH o AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS brk FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts)), s AS (SELECT *, sum(brk) OVER (PARTITION BY symbol ORDER BY ts) AS sid FROM o) "
       f"SELECT symbol, min(ts) AS start, max(ts) AS ended, count(*) AS n, sum(size) AS size, max(price) AS peak, CASE WHEN max(ts) + INTERVAL 30 MINUTE <= {DONE} THEN 1 ELSE 0 END AS is_final FROM s GROUP BY symbol, sid")


@query("stream_session_windows", "symbol start ended", "peak", "n size is_final", sql=SES, tables="ticks")
def stream_session_windows(t):
    """All sessions, those still open with ``is_final`` = 0."""
    return ntz(run_sessions(ST.session_parts(ticks(t)), "sessions", ["symbol", "part"], ST.sessions, "ended", "30 minutes"), "start", "ended")


# the weekly bars, 24 years on, stand in for versions of limits and fundamentals; they end before the last ticks for some symbols and go on for others
VERSIONS = "SELECT symbol, CAST(date AS TIMESTAMP) + INTERVAL 8766 DAY AS valid_from, close AS fair_value, volume * 10 AS size_limit FROM bars WHERE date <= DATE '2000-01-17' OR symbol % 2 = 0"


@query("stream_static_join", "event_id symbol sector", "price fair_value size_limit", "size over_limit",
       sql=f"WITH v AS ({VERSIONS}) SELECT k.event_id, k.symbol, sector, price, fair_value, size_limit, size, CASE WHEN size > size_limit THEN 1 ELSE 0 END AS over_limit FROM (SELECT * FROM ticks JOIN sector USING (symbol)) k "
           "ASOF LEFT JOIN v ON k.symbol = v.symbol AND k.ts >= v.valid_from", tables="ticks sector bars")
def stream_static_join(t):
    """Ticks with their sector and with the limit and fair value that were valid at their time."""
    v = t.bars().where((F.col("date") <= "2000-01-17") | (F.col("symbol") % 2 == 0)).select(
        "symbol", (F.col("date").cast("timestamp") + F.expr("INTERVAL 8766 DAYS")).alias("valid_from"), F.col("close").alias("fair_value"), (F.col("volume") * 10).alias("size_limit"))
    d = ST.asof_lookup(ticks(t).join(t.sector(), "symbol"), materialise(v, "versions"), "symbol", "valid_from", ["fair_value", "size_limit"])
    return run_append(d.select("event_id", "symbol", "sector", "price", "fair_value", "size_limit", "size", flag(F.col("size") > F.col("size_limit")).alias("over_limit")), "static")


@query("stream_sink_parquet", "event_id metric ts", "value", sql="SELECT * FROM metrics WHERE ts >= TIMESTAMP '2024-01-15'", tables="metrics")
def stream_sink_parquet(t):
    return ntz(run_append(metrics(t), "history").where(F.col("ts") >= "2024-01-15"), "ts")
