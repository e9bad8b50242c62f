"""Several micro-batches: late rows, state across batches, and equality with the batch result."""
import datetime as dt
import tempfile

from pyspark.sql import functions as F

from quantloom.streaming import operators as ST
from quantloom.streaming import ticks as TK
from quantloom.streaming.runner import run_append, run_decided, run_sessions, run_two_levels, run_upsert, run_windows

T0 = dt.datetime(2024, 1, 1)


def feed(spark, *batches):
    """One parquet file per micro-batch, in order of time written."""
    import time
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    i = 0
    for k, rows in enumerate(batches):
        data = []
        for minute, user, kind, value in rows:
            data.append((i, T0 + dt.timedelta(minutes=minute), user, kind, value, '{"k": 2}'))
            i += 1
        spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)
    return folder


def source(spark, folder):
    return TK.with_event_time(TK.read_tick_stream(spark, folder, "*.parquet"))


def test_late_rows_are_dropped_and_open_windows_wait(spark):
    f = feed(spark, [(0, 1, "click", 1.0), (200, 1, "click", 1.0)], [(210, 1, "click", 1.0)], [(5, 1, "click", 9.0), (400, 1, "click", 1.0)])
    got = run_append(ST.hourly_counts(source(spark, f)), "late").orderBy("start").collect()
    # the first batch closes hour 0; Spark filters late rows by the watermark of the batch before, so minute 5
    # is too late in the third batch; the hour of minute 400 stays open
    assert [(r["start"].hour, r["n"]) for r in got] == [(0, 1), (3, 2)]


def test_last_n_features_survive_batches_and_disorder(spark):
    rows = [(m, 1, "click", float(m % 7 + m / 50)) for m in range(60)] + [(m, 2, "view", float(m)) for m in range(4)]
    whole = feed(spark, rows)
    parts = feed(spark, rows[20:30] + rows[:10], rows[30:60] + rows[60:], rows[10:20])
    a = run_upsert(ST.lastn_features(source(spark, whole)), "one", ["symbol"]).where("symbol = 1").first()
    b = run_upsert(ST.lastn_features(source(spark, parts)), "many", ["symbol"]).where("symbol = 1").first()
    for c in ("n", "price", "sma_5", "sma_20", "momentum", "rsi", "zscore"):
        assert abs(a[c] - b[c]) < 1e-9, c


def test_cool_down_holds_across_batches(spark):
    f = feed(spark, [(0, 1, "error", 70.0), (30, 1, "error", 99.0)], [(100, 1, "error", 80.0), (239, 1, "error", 81.0)], [(240, 1, "error", 90.0), (241, 1, "error", 95.0)])
    m = source(spark, f).select("ts", F.col("event_type").alias("metric"), F.col("price").alias("value"))
    got = sorted((r["ts"].hour * 60 + r["ts"].minute, r["value"]) for r in run_append(ST.action_trigger(m), "act").collect())
    assert got == [(0, 70.0), (240, 90.0)]


def test_stream_bars_equal_batch_bars(spark):
    rows = [(m, u, "click", float(m * u % 11 + 1)) for m in range(0, 300, 7) for u in (1, 2)]
    f = feed(spark, rows[:40], rows[40:])
    stream = run_append(TK.bars_from_ticks(source(spark, f), "1 hour"), "bars")
    batch = TK.bars_from_ticks(spark.read.schema(TK.EVENTS_SCHEMA).parquet(f).select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(2).cast("long").alias("size"), "event_id"), "1 hour")
    done = batch.join(stream.select("symbol", "bar_start"), ["symbol", "bar_start"], "left_semi")
    assert stream.count() > 0 and stream.exceptAll(done.select(*stream.columns)).count() == 0


def test_snapshots_hold_every_symbol_over_many_batches(spark):
    """Eighteen files cut by symbol and by time (so the changes are folded once) give the batch answer for all symbols."""
    rows = [(m * 13 % 300, u, "purchase" if (m + u) % 3 else "view", float(m * u % 17 + 1)) for u in range(1, 10) for m in range(30)]
    parts = [[r for r in rows if r[1] % 3 == k and lo <= r[0] < lo + 50] for lo in range(0, 300, 50) for k in range(3)]
    many, one = feed(spark, *parts), feed(spark, sum(parts, []))
    for run in (lambda f: run_upsert(ST.last_value(source(spark, f)), "last", ["symbol"]),
                lambda f: run_upsert(ST.positions_from_ticks(source(spark, f)), "limits", ["symbol"], transform=ST.risk_limits),
                lambda f: run_upsert(ST.live_signals(ST.lastn_features(source(spark, f))), "signals", ["symbol"])):
        a, b = ({r["symbol"]: r.asDict() for r in run(f).collect()} for f in (many, one))
        assert set(a) == set(b) == set(range(1, 10))
        for k, r in a.items():
            assert all(x == b[k][c] or abs(x - b[k][c]) < 1e-9 for c, x in r.items()), (k, r, b[k])


def test_open_windows_are_there_and_flagged(spark):
    f = feed(spark, [(0, 1, "click", 1.0), (50, 1, "click", 1.0)], [(70, 1, "click", 1.0)], [(200, 1, "click", 1.0)], [(230, 1, "click", 5.0)])
    got = run_windows(ST.hourly_counts(source(spark, f)), "open", ["event_type", "start"], "start", "1 hour").orderBy("start").collect()
    assert [(r["start"].hour, r["n"], r["is_final"]) for r in got] == [(0, 2, 1), (1, 1, 1), (3, 2, 0)]


def test_registered_queries_read_a_table_of_part_files(spark):
    from quantloom.plans import q_streaming  # noqa: F401
    from quantloom.plans.registry import ENTRIES
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = [(i, T0 + dt.timedelta(minutes=i), i % 5, "click", float(i), '{"k": 2}') for i in range(90)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    events.repartition(3).write.parquet(f"{folder}/events.parquet")
    assert {r["event_id"] for r in ENTRIES["stream_tick_ingest"].run(spark, folder).collect()} == set(range(90))
    assert {r["symbol"]: r["price"] for r in ENTRIES["stream_last_value"].run(spark, folder).collect()} == {k: 85.0 + k for k in range(5)}


def test_actions_do_not_depend_on_the_order_of_files(spark):
    """Files within the watermark's delay in any order give the walk over all rows, the open tail included."""
    f = feed(spark, [(5, 1, "error", 70.0), (5, 1, "click", 65.0)], [(1, 1, "error", 99.0)], [(246, 1, "error", 80.0), (600, 1, "view", 1.0)],
             [(592, 1, "error", 77.0), (599, 1, "error", 75.0)], [(595, 1, "click", 90.0)], [(593, 1, "click", 91.0), (591, 1, "error", 76.0)])
    m = source(spark, f).select("ts", F.col("event_type").alias("metric"), F.col("price").alias("value"))
    got = sorted((r["metric"], (r["ts"] - T0).total_seconds() / 60, r["value"]) for r in run_decided(ST.action_trigger(m, open_too=True), "act", ["metric"]).collect())
    assert got == [("click", 5, 65.0), ("click", 593, 91.0), ("error", 1, 99.0), ("error", 246, 80.0), ("error", 591, 76.0)]
    closed = run_append(ST.action_trigger(m), "act").collect()
    assert {((r["ts"] - T0).total_seconds() / 60, r["metric"]) for r in closed} == {(1, "error"), (246, "error"), (5, "click")}


def scattered(seed, n=400, days=9, users=7):
    """Rows in no order of time over several days, for five files."""
    import random
    rng = random.Random(seed)
    rows = [(rng.randint(0, days * 1440 - 1), rng.randint(1, users), rng.choice(["purchase", "purchase", "click"]), round(rng.uniform(5, 9), 3)) for _ in range(n)]
    return rows, [rows[k::5] for k in range(5)]


def test_portfolio_risk_over_five_files_in_any_order(spark):
    rows, files = scattered(3)
    feed_of = feed(spark, *files)
    book = lambda df: ST.daily_book(df, F.col("symbol") % 2)
    live = run_two_levels(book(source(spark, feed_of)), "risk", ["portfolio", "symbol", "day"], ["portfolio"], ST.portfolio_risk)
    batch = ST.portfolio_risk(book(spark.read.parquet(feed_of).select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(2).alias("size"), "event_type", "event_id")))
    got, want = (sorted(d.select(*sorted(d.columns)).collect(), key=lambda r: r.portfolio) for d in (live, batch))
    assert len(got) == 2
    for a, b in zip(got, want):
        assert all(x == y or abs(x - y) < 1e-9 * max(1, abs(y)) for x, y in zip(a, b)), (a, b)
    # by hand: exposures of portfolio 0
    value, last = {}, {}
    for k, r in enumerate(sum(files, [])):
        if r[1] % 2 == 0:
            value[r[1]] = value.get(r[1], 0) + (2 if r[2] == "purchase" else -2)
            last[r[1]] = max(last.get(r[1], (-1, -1, 0)), (r[0], k, r[3]))
    mv = {u: q * last[u][2] for u, q in value.items()}
    total = sum(mv.values())
    assert abs(got[0].total_value - total) < 1e-9 and abs(got[0].leverage - sum(map(abs, mv.values())) / max(total, 1)) < 1e-9
    assert abs(got[0].concentration_ratio - sum(sorted(map(abs, mv.values()))[-5:]) / max(total, 1)) < 1e-9
    assert got[0].var_1d > 0 and got[0].level in ("critical", "high", "medium", "normal")


def minutes(t):
    return (t - T0).total_seconds() / 60


def batch(spark, folder):
    return spark.read.parquet(folder).select(F.col("user_id").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), F.lit(2).alias("size"), "event_type", "event_id")


def as_metrics(df):
    return df.select("ts", F.col("event_type").alias("metric"), F.col("price").alias("value"), "event_id")


def test_sessions_are_bridged_and_open_ones_are_kept(spark):
    """Ticks of a later file join two sessions of an earlier one; the newest session is open."""
    f = feed(spark, [(0, 1, "click", 1.0), (50, 1, "click", 5.0), (2, 2, "click", 1.0)], [(25, 1, "click", 9.0), (33, 2, "click", 1.0)], [(45, 1, "click", 2.0), (62, 2, "click", 1.0)],
             [(300, 1, "click", 1.0)], [(320, 1, "click", 1.0), (319, 2, "click", 1.0)])
    late = TK.read_tick_stream(spark, f, "*.parquet").withWatermark("ts", "6 hours")
    got = run_sessions(ST.session_parts(late), "sessions", ["symbol", "part"], ST.sessions, "ended", "30 minutes").collect()
    assert sorted((r.symbol, minutes(r.start), minutes(r.ended), r.n, r.peak) for r in got) == [
        (1, 0, 50, 4, 9.0), (1, 300, 320, 2, 1.0), (2, 2, 2, 1, 1.0), (2, 33, 62, 2, 1.0), (2, 319, 319, 1, 1.0)]
    assert {r.is_final for r in got} == {0}
    got = run_sessions(ST.session_parts(source(spark, f)), "sessions", ["symbol", "part"], ST.sessions, "ended", "30 minutes").collect()
    assert {(r.symbol, minutes(r.start)): r.is_final for r in got if r.start.hour > 4} == {(1, 300): 0, (2, 319): 0} and all(r.is_final for r in got if r.start.hour < 4)


def test_sessions_equal_session_windows(spark):
    rows, files = scattered(5, n=600, days=3)
    f = feed(spark, *files)
    d = batch(spark, f)
    want = d.groupBy("symbol", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("peak")).select("symbol", F.col("w.start"), "n", "peak").collect()
    got = run_sessions(ST.session_parts(TK.read_tick_stream(spark, f, "*.parquet").withWatermark("ts", "9 days")), "s", ["symbol", "part"], ST.sessions, "ended", "30 minutes").select("symbol", "start", "n", "peak").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 50


def test_alert_rules_have_operators_and_durations_of_their_own(spark):
    rules = [("gt", "a", ">", 5.0, 3600, 2, True), ("ge", "a", ">=", 5.0, 3600, 3, True), ("lt", "a", "<", 5.0, 21600, 1, True), ("le", "a", "<=", 5.0, 86400, 3, True), ("eq", "a", "==", 5.0, 86400, 2, True),
             ("ne", "a", "!=", 5.0, 21600, 3, True), ("per_minute", "a", ">", 0.0, 120, None, True), ("off", "a", ">", 0.0, 3600, 1, False), ("other", "b", ">", 0.0, 3600, 1, True)]
    table = spark.createDataFrame(rules, ST.RULE_SCHEMA)
    events = [(0, 5.0), (1, 6.0), (30, 7.0), (59, 4.0), (60, 5.0), (500, 8.0), (501, 9.0), (1300, 2.0)]
    f = feed(spark, *[[(m, 1, "a", v) for m, v in events[k::5]] for k in range(5)])
    late = TK.read_tick_stream(spark, f, "*.parquet").withWatermark("ts", "2 days")
    got = sorted((r.name, minutes(r.start), r.hits) for r in run_windows(ST.alert_rules(as_metrics(late), table), "alerts", ["name", "start"], "start", "1 second * duration_s").collect())
    test = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
    want = {}
    for name, metric, op, x, seconds, need, on in rules:
        for m, v in events:
            if on and metric == "a" and test[op](v, x):
                k = (name, m * 60 // seconds * seconds / 60, need or seconds / 60)
                want[k] = want.get(k, 0) + 1
    assert got == sorted((n, s, h) for (n, s, need), h in want.items() if h >= need) and {g[0] for g in got} == {"gt", "ge", "lt", "le", "eq", "ne", "per_minute"}


def test_lookup_is_the_version_of_the_time_of_the_tick(spark):
    """A report between two ticks shows in the second only; no version before the first, the last one has no end."""
    day = dt.datetime(2024, 1, 1)
    table = spark.createDataFrame([(1, day + dt.timedelta(minutes=10), 1.0), (1, day + dt.timedelta(minutes=20), 2.0), (1, day + dt.timedelta(days=40), 3.0), (2, day - dt.timedelta(days=400), 7.0)],
                                  "symbol long, since timestamp, eps double")
    f = feed(spark, [(9, 1, "a", 1.0), (10, 1, "a", 1.0), (19, 1, "a", 1.0)], [(20, 1, "a", 1.0), (0, 2, "a", 1.0)], [(1440 * 39, 1, "a", 1.0), (1440 * 40, 1, "a", 1.0), (1440 * 999, 1, "a", 1.0), (0, 3, "a", 1.0)])
    stream = TK.read_tick_stream(spark, f, "*.parquet").select("symbol", "ts")
    got = sorted((r.symbol, minutes(r.ts), r.eps) for r in run_append(ST.asof_lookup(stream, table, "symbol", "since", ["eps"]), "asof").collect())
    assert got == [(1, 9, None), (1, 10, 1.0), (1, 19, 1.0), (1, 20, 2.0), (1, 1440 * 39, 2.0), (1, 1440 * 40, 3.0), (1, 1440 * 999, 3.0), (2, 0, 7.0), (3, 0, None)]


def test_recent_performance_over_five_files_in_any_order(spark):
    import numpy as np
    rows, files = scattered(9)
    f = feed(spark, *files)
    ret = ((F.col("value") - 7) / 100).alias("ret")
    live = run_upsert(ST.recent_performance(as_metrics(source(spark, f)).select("metric", "ts", "event_id", ret)), "recent", ["metric"])
    whole = as_metrics(batch(spark, f)).select("metric", "ts", "event_id", ret)
    got = {r.metric: r for r in ST.performance_drift(live, ST.performance_baseline(whole)).collect()}
    pdf = whole.orderBy("ts", "event_id").toPandas()
    for k, g in pdf.groupby("metric"):
        def figures(x):
            level = np.cumprod(1 + x)
            return x.mean(), x.mean() / x.std(), (1 - level / np.maximum.accumulate(level)).max(), (x > 0).mean(), x.std()
        new, old = figures(g["ret"].to_numpy()[-10:]), figures(g["ret"].to_numpy())
        r = got[k]
        np.testing.assert_allclose((r.avg_return, r.sharpe, r.max_drawdown, r.win_rate, r.volatility), new, rtol=1e-9)
        np.testing.assert_allclose((r.return_change, r.sharpe_change, r.drawdown_change, r.win_rate_change, r.volatility_change), [(a - b) / abs(b) for a, b in zip(new, old)], rtol=1e-9)
    assert len(got) == 2


def test_late_rows_are_counted_by_window(spark):
    f = feed(spark, [(0, 1, "a", 1.0), (300, 1, "a", 1.0)], [(310, 1, "a", 1.0)], [(5, 1, "a", 1.0), (6, 1, "a", 1.0), (70, 1, "a", 1.0), (320, 1, "a", 1.0)], [(330, 1, "a", 1.0)], [(600, 1, "a", 1.0)])
    accepted = run_windows(ST.hourly_counts(source(spark, f)), "late", ["event_type", "start"], "start", "1 hour")
    arrived = run_upsert(ST.hourly_arrivals(TK.read_tick_stream(spark, f, "*.parquet")), "arrived", ["event_type", "start"])
    got = sorted((minutes(r.start), r.n, r.late, r.is_final) for r in ST.late_counts(accepted, arrived).collect())
    assert got == [(0, 1, 2, 1), (60, 0, 1, 1), (300, 4, 0, 1), (600, 1, 0, 0)]


def test_drawdown_of_a_level_beyond_double_precision(spark):
    """Two days of doubling, 1,500 times each, then half is lost; a second key loses everything."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [("up", t0 + dt.timedelta(minutes=i % 1440 + 1440 * (i // 1440)), i, 1.0) for i in range(3000)] + [("up", t0 + dt.timedelta(days=4), 3000, -0.5)]
    rows += [("out", t0 + dt.timedelta(minutes=i), i, r) for i, r in enumerate((0.1, -1.0, 0.2))]
    got = {r["metric"]: r["max_drawdown"] for r in ST.drawdown(spark.createDataFrame(rows, "metric string, ts timestamp, event_id long, ret double"), "metric").collect()}
    assert abs(got["up"] - 0.5) < 1e-9 and got["out"] == 1.0


def test_volatility_over_a_price_of_zero_is_undefined(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(s, t0 + dt.timedelta(seconds=i), i, 0.0 if s == 1 and i == 3 else 10.0 + i % 3, 5) for s in (1, 2) for i in range(30)]
    got = {r["symbol"]: r["volatility"] for r in TK.last_ticks_microstructure(spark.createDataFrame(rows, "symbol long, ts timestamp, event_id long, price double, size long")).collect()}
    assert (got[1] is None or got[1] != got[1]) and got[2] > 0
