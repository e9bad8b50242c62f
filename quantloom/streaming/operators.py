"""Stateful and windowed stream operators; each works on a batch DataFrame with the same meaning."""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.series import flag, ladder


def sliding_stats(ticks: DataFrame, width="1 hour", slide="15 minutes") -> DataFrame:
    g = ticks.groupBy("symbol", F.window("ts", width, slide).alias("_w")).agg(
        F.avg("price").alias("mean"), F.stddev_samp("price").alias("volatility"), F.sum("size").alias("volume"), F.count(F.lit(1)).alias("n"))
    return g.select("symbol", F.col("_w.start").alias("start"), "mean", "volatility", "volume", "n")


def last_value(ticks: DataFrame) -> DataFrame:
    """Newest tick per symbol."""
    return ticks.groupBy("symbol").agg(F.max_by(F.struct("ts", "price", "size"), F.struct("ts", "event_id")).alias("_r")).select("symbol", "_r.*")


FEATURE_SCHEMA = "symbol long, n long, price double, sma_5 double, sma_20 double, momentum double, rsi double, zscore double"


def lastn_features(ticks: DataFrame, keep: int = 21, rsi_n: int = 14) -> DataFrame:
    """Features of the newest ticks per symbol from a bounded, time-sorted state buffer.

    Before the shuffle each Arrow batch keeps only its newest ``keep`` ticks per symbol and a count,
    so a hot symbol reaches its state thinned.

    The buffer never holds more than ``keep`` ticks, however hot the symbol; arrivals are merged by
    (time, id), so order inside a micro-batch does not matter.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, chunks, state):
        seen, buf = (0, []) if not state.exists else (state.get[0], list(zip(state.get[1], state.get[2], state.get[3])))
        for pdf in chunks:
            seen += int(pdf["cnt"].sum())
            new = list(zip(pdf["ts"].astype("int64"), pdf["event_id"].astype("int64"), pdf["price"]))
            buf = sorted(buf + [(int(a), int(b), float(c)) for a, b, c in new])[-keep:]
        state.update((seen, [b[0] for b in buf], [b[1] for b in buf], [b[2] for b in buf]))
        p = pd.Series([b[2] for b in buf])
        d = p.diff().iloc[1:].tail(rsi_n)
        gain, loss = d.clip(lower=0).mean(), (-d.clip(upper=0)).mean()
        full = len(p) > rsi_n
        rsi = (100.0 if gain > 0 else None) if full and loss == 0 else (100 - 100 / (1 + gain / loss) if full else None)
        tail = p.tail(20)
        sd = tail.std()
        yield pd.DataFrame([[int(key[0]), seen, p.iloc[-1], p.tail(5).mean() if len(p) >= 5 else None, tail.mean() if len(p) >= 20 else None,
                             p.iloc[-1] / p.iloc[-6] - 1 if len(p) >= 6 else None, rsi, (p.iloc[-1] - tail.mean()) / sd if len(p) >= 20 and sd else None]],
                           columns=[c.split()[0] for c in FEATURE_SCHEMA.split(", ")])
    def thin(batches):
        for pdf in batches:
            d = pdf.sort_values(["symbol", "ts", "event_id"])
            d["cnt"] = d.groupby("symbol")["ts"].transform("size").where(~d.duplicated("symbol", keep="last"), 0)
            yield d.groupby("symbol").tail(keep)
    thinned = ticks.select("symbol", "ts", "event_id", "price").mapInPandas(thin, "symbol long, ts timestamp, event_id long, price double, cnt long")
    return thinned.groupBy("symbol").applyInPandasWithState(
        update, FEATURE_SCHEMA, "seen long, ts array<long>, id array<long>, price array<double>", "update", GroupStateTimeout.NoTimeout)


def live_signals(features: DataFrame, threshold=0.02, z=2.0) -> DataFrame:
    """BUY / SELL by the 5-tick against the 20-tick mean, and by the z-score."""
    r = F.try_divide("sma_5", "sma_20") - 1
    return features.withColumns({"momentum_signal": ladder([(r > threshold, "BUY"), (r < -threshold, "SELL")], "HOLD"),
                                 "meanrev_signal": ladder([(F.col("zscore") < -z, "BUY"), (F.col("zscore") > z, "SELL")], "HOLD")})


def signal_dedup(ticks: DataFrame, bucket="5 minutes", stream=True) -> DataFrame:
    """One signal per symbol, side and five-minute bucket."""
    d = ticks.withColumns({"side": F.when(F.col("event_type") == "purchase", "BUY").otherwise("SELL"), "bucket": F.window("ts", bucket)["start"]}).select("symbol", "side", "bucket", "ts")
    keys = ["symbol", "side", "bucket"]
    d = d.dropDuplicatesWithinWatermark(keys) if stream else d.dropDuplicates(keys)
    return d.select(*keys)


#: Name, metric, operator, threshold, duration in seconds, hits that fire (null: one a minute), enabled.
ALERT_RULES = [("errors_high", "error", ">", 60.0, 3600, 3, True), ("clicks_high", "click", ">=", 80.0, 3600, 2, True), ("purchases_low", "purchase", "<", 5.0, 21600, 6, True),
               ("views_low", "view", "<=", 2.0, 86400, 10, True), ("signups_odd", "signup", "!=", 0.0, 21600, 30, True), ("errors_zero", "error", "==", 0.0, 86400, 1, True),
               ("clicks_steady", "click", ">", 1.0, 3600, None, True), ("errors_any", "error", ">", 0.0, 3600, 1, False)]
RULE_SCHEMA = "name string, metric string, op string, threshold double, duration_s int, need int, enabled boolean"


def alert_rules(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Windows of a rule in which its condition held often enough; every rule has its own operator, threshold and window length.

    ``rules`` is a table of :data:`RULE_SCHEMA`.  Each row of a metric goes into one window of each of its rules; the
    windows of a rule divide a day, and the day is the event-time window by which a stream lets go of old state.
    """
    v, x = F.col("value"), F.col("threshold")
    holds = F.coalesce(F.when(F.col("op") == ">", v > x).when(F.col("op") == "<", v < x).when(F.col("op") == ">=", v >= x).when(F.col("op") == "<=", v <= x)
                       .when(F.col("op") == "==", v == x).when(F.col("op") == "!=", v != x), F.lit(False))
    active = rules.where("enabled").withColumn("need", F.coalesce("need", F.ceil(F.col("duration_s") / 60).cast("int")))
    start = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / F.col("duration_s")) * F.col("duration_s"))
    g = metrics.join(active, "metric").groupBy("name", "metric", "duration_s", "need", start.alias("start"), F.window("ts", "1 day").alias("_day")).agg(
        F.count_if(holds).alias("hits"), F.max(F.when(holds, v)).alias("peak"))
    return g.where(F.col("hits") >= F.col("need")).select("name", "metric", "start", "duration_s", "hits", "peak")


def positions_from_ticks(ticks: DataFrame) -> DataFrame:
    """Running signed position per symbol: purchases add, the rest subtract."""
    side = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return ticks.groupBy("symbol").agg(F.sum(side * F.col("size")).alias("position"), F.sum(F.abs(F.col("price") * F.col("size"))).alias("gross"), F.max("price").alias("peak"))


def risk_limits(pos: DataFrame, max_gross=120000.0, max_position=1500) -> DataFrame:
    g, p = F.col("gross"), F.abs("position")
    return pos.withColumns({"gross_breach": flag(g > max_gross), "position_breach": flag(p > max_position), "level": ladder([((g > max_gross) & (p > max_position), "critical"), ((g > max_gross) | (p > max_position), "high"), (g > 0.8 * max_gross, "warning")], "normal")})


def action_trigger(metrics: DataFrame, limit=60.0, cool_down_minutes=240, open_too=False) -> DataFrame:
    """An action row when the metric passes the limit and the last action is older than the cool-down.

    Rows over the limit wait in the state until the watermark passes them and are then walked in time
    order, so the order of files and micro-batches does not matter within the watermark's delay; one at
    the very end of the cool-down fires at once, as no earlier row can.  ``open_too`` (update mode) adds
    the actions of the rows still waiting, with ``final`` = false, and repeats them with every change.

    Any row over the limit can be the first after a cool-down, so none is thinned before the key.  The
    walk of a metric is sequential: it jumps from action to action by binary search, and the state holds
    the rows of the watermark's delay.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout
    gap = cool_down_minutes * 60 * 10 ** 6

    def update(key, chunks, state):
        last, t, v = state.get if state.exists else (None, [], [])
        new = [] if state.hasTimedOut else [(p["us"].to_numpy("int64"), p["value"].to_numpy("float64")) for p in chunks]
        t, v = (np.concatenate([np.asarray(old, kind), *[n[k] for n in new]]) for k, (old, kind) in enumerate(((t, "int64"), (v, "float64"))))
        order = np.lexsort((v, t))
        t, v = t[order], v[order]
        mark = state.getCurrentWatermarkMs() * 1000
        out, at, final = [], last, True
        while (i := 0 if at is None else int(np.searchsorted(t, at + gap))) < len(t):
            final = final and (t[i] <= mark or (at is not None and t[i] == at + gap))
            if not (final or open_too):
                break
            at = int(t[i])
            out.append((key[0], at, float(v[i]), final))
            last = at if final else last
        wait = t > mark if last is None else (t > mark) & (t >= last + gap)
        state.update((last, t[wait].tolist(), v[wait].tolist()))
        if wait.any():
            state.setTimeoutTimestamp(int(t[wait][0]) // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["metric", "us", "value", "final"])
    over = metrics.where(F.col("value") > limit).select("metric", "ts", F.unix_micros("ts").alias("us"), "value")
    fired = over.groupBy("metric").applyInPandasWithState(
        update, "metric string, us long, value double, final boolean", "last long, t array<long>, v array<double>", "update" if open_too else "append", GroupStateTimeout.EventTimeTimeout)
    return fired.select("metric", F.timestamp_micros("us").alias("ts"), "value", *(["final"] if open_too else []))


def daily_book(ticks: DataFrame, portfolio) -> DataFrame:
    """State of the book: signed size traded, last price and volume per (portfolio, symbol, day).

    Every part is a sum or the value at a largest (time, id), so files in any order give the same rows; the
    state is bounded by symbols and days.
    """
    side = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    return ticks.groupBy(portfolio.alias("portfolio"), "symbol", F.to_date("ts").alias("day")).agg(
        F.sum(side * F.col("size")).alias("traded"), F.max_by("price", F.struct("ts", "event_id")).alias("close"), F.sum("size").alias("volume"))


#: Limits of one-day value at risk, leverage, drawdown, concentration and liquidity.
PORTFOLIO_LIMITS = {"var_1d": 0.02, "leverage": 3.0, "max_drawdown": 0.15, "concentration_ratio": 0.2, "avg_liquidity": 0.3}


def portfolio_risk(book: DataFrame, limits: dict[str, float] | None = None, largest: int = 5) -> DataFrame:
    """One row per portfolio of a daily book: exposures, value at risk, leverage, concentration, drawdown, and which limits are broken.

    Returns are those of today's positions over the days of the book (symbols without a price on a day count
    as 0).  Positions are summed by symbol, days by portfolio; the exact quantile and the drawdown run
    over the days of a portfolio, the largest positions are cut before they meet.
    """
    lim = {**PORTFOLIO_LIMITS, **(limits or {})}
    by_day = Window.partitionBy("portfolio", "symbol").orderBy("day")
    held = book.groupBy("portfolio", "symbol").agg(F.sum("traded").alias("position"), F.max_by("close", "day").alias("last"), F.avg("volume").alias("adv"))
    held = held.select("portfolio", "symbol", (F.col("position") * F.col("last")).alias("value"), F.try_divide("adv", F.col("adv") + F.abs("position")).alias("liquidity"))
    total = held.groupBy("portfolio").agg(
        F.sum("value").alias("total_value"), F.sum(F.greatest("value", F.lit(0.0))).alias("long_exposure"), F.sum(F.least("value", F.lit(0.0))).alias("short_exposure"),
        F.max(F.abs("value")).alias("_top"), F.avg("liquidity").alias("avg_liquidity"))
    most = held.withColumn("_n", F.row_number().over(Window.partitionBy("portfolio").orderBy(F.desc(F.abs("value")), "symbol"))).where(F.col("_n") <= largest)
    most = most.groupBy("portfolio").agg(F.sum(F.abs("value")).alias("_most"))
    weight = held.join(total.select("portfolio", "total_value"), "portfolio").select(
        "portfolio", "symbol", F.when(F.col("total_value") > 0, F.col("value") / F.col("total_value")).otherwise(0.0).alias("_w"))
    ret = book.withColumn("_r", F.try_divide("close", F.lag("close").over(by_day)) - 1).where(F.col("_r").isNotNull())
    days = ret.join(weight, ["portfolio", "symbol"]).groupBy("portfolio", "day").agg(F.sum(F.col("_w") * F.col("_r")).alias("_r"))
    upto = Window.partitionBy("portfolio").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    days = days.withColumn("_level", F.product(1 + F.col("_r")).over(upto))
    days = days.withColumn("_fall", F.try_divide("_level", F.max("_level").over(upto)) - 1)
    path = days.groupBy("portfolio").agg((-F.percentile("_r", 0.05)).alias("var_1d"), (F.stddev_samp("_r") * 252 ** 0.5).alias("volatility"), F.abs(F.min("_fall")).alias("max_drawdown"))
    base = F.greatest(F.col("total_value"), F.lit(1.0))
    d = total.join(most, "portfolio").join(path, "portfolio", "left").fillna(0.0, ["var_1d", "max_drawdown"]).withColumns({
        "net_exposure": F.col("long_exposure") + F.col("short_exposure"), "leverage": (F.col("long_exposure") - F.col("short_exposure")) / base,
        "largest_position": F.col("_top") / base, "concentration_ratio": F.col("_most") / base}).drop("_top", "_most")
    broken = {f"{k}_breach": flag(F.col(k) < v if k == "avg_liquidity" else F.col(k) > v) for k, v in lim.items()}
    over = lambda *names: sum((F.col(f"{n}_breach") for n in names), F.lit(0)) > 0
    return d.withColumns(broken).withColumn("level", ladder([
        (over("max_drawdown"), "critical"), (over("var_1d", "leverage"), "high"), (over("concentration_ratio", "avg_liquidity"), "medium")], "normal"))


def drift(metrics: DataFrame, baseline: DataFrame, width="1 day") -> DataFrame:
    """Window mean, volatility and hit rate against a static baseline (one row per metric)."""
    g = metrics.groupBy("metric", F.window("ts", width).alias("_w")).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.avg(flag(F.col("value") > 20)).alias("hit_rate"), F.count(F.lit(1)).alias("n"))
    d = g.select("metric", F.col("_w.start").alias("start"), "mean", "std", "hit_rate", "n").join(baseline, "metric")
    return d.withColumns({"mean_change": F.try_divide("mean", "base_mean") - 1, "std_change": F.try_divide("std", "base_std") - 1, "hit_change": F.col("hit_rate") - F.col("base_hit")})


def baseline_of(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("metric").agg(F.avg("value").alias("base_mean"), F.stddev_samp("value").alias("base_std"), F.avg(flag(F.col("value") > 20)).alias("base_hit"))


def hourly_counts(ticks: DataFrame) -> DataFrame:
    g = ticks.groupBy("event_type", F.window("ts", "1 hour").alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    return g.select("event_type", F.col("_w.start").alias("start"), "n", "size")


def session_parts(ticks: DataFrame, gap="30 minutes") -> DataFrame:
    """Pieces of sessions, one per symbol and tumbling window as long as the gap.

    Two ticks of one such window are closer than the gap, so a window never holds parts of two sessions; the pieces
    are plain aggregates that merge in any order, which session windows in update mode are not.
    """
    g = ticks.groupBy("symbol", F.window("ts", gap).alias("_w")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max("price").alias("peak"))
    return g.select("symbol", F.col("_w.start").alias("part"), "first", "last", "n", "size", "peak")


def sessions(parts: DataFrame, gap="30 minutes") -> DataFrame:
    """Sessions from their pieces: neighbours no further than the gap apart belong together, as in a session window, so a late tick can bridge two sessions."""
    w = Window.partitionBy("symbol").orderBy("part")
    new = F.coalesce(F.col("first") > F.lag("last").over(w) + F.expr(f"INTERVAL {gap}"), F.lit(True))
    d = parts.withColumn("_s", F.sum(new.cast("int")).over(w))
    return d.groupBy("symbol", "_s").agg(F.min("first").alias("start"), F.max("last").alias("ended"), F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("peak").alias("peak")).drop("_s")


def versions(table: DataFrame, key: str, valid_from: str) -> DataFrame:
    """A table of versions with the end of each: the start of the next one of its key, null for the last."""
    return table.withColumn("_to", F.lead(valid_from).over(Window.partitionBy(key).orderBy(valid_from)))


def asof_lookup(ticks: DataFrame, table: DataFrame, key: str, valid_from: str, columns: list[str], bucket: str = "7 days") -> DataFrame:
    """Columns of the version of ``table`` that was valid at the time of each tick, null before the first.

    A stream-static join: the versions that have ended stand in every time bucket that they reach into, so a tick meets
    only those of its bucket; the last version of a key, which has no end, is joined by the key alone.
    """
    v = versions(table.select(F.col(key).alias("_key"), F.col(valid_from).alias("_from"), F.struct(*columns).alias("_v")), "_key", "_from")
    width = F.expr(f"unix_micros(timestamp_seconds(0) + INTERVAL {bucket})")
    spot = lambda t: F.floor(F.unix_micros(t) / width)
    closed = v.where("_to IS NOT NULL").select(F.col("_key").alias("_k1"), F.col("_from").alias("_f1"), "_to", F.col("_v").alias("_v1"),
                                               F.explode(F.sequence(spot(F.col("_from")), spot(F.col("_to")))).alias("_b1"))
    last = v.where("_to IS NULL").select(F.col("_key").alias("_k2"), F.col("_from").alias("_f2"), F.col("_v").alias("_v2"))
    d = ticks.withColumn("_b", spot(F.col("ts")))
    d = d.join(closed, (F.col(key) == F.col("_k1")) & (F.col("_b") == F.col("_b1")) & (F.col("ts") >= F.col("_f1")) & (F.col("ts") < F.col("_to")), "left")
    d = d.join(last, F.col(key) == F.col("_k2"), "left")
    valid = F.when(F.col("ts") >= F.col("_f2"), F.col("_v2")).otherwise(F.col("_v1"))
    return d.select(*ticks.columns, *[valid[c].alias(c) for c in columns])


RECENT_SCHEMA = "metric string, n long, avg_return double, sharpe double, max_drawdown double, win_rate double, volatility double"


def recent_performance(returns: DataFrame, keep: int = 10) -> DataFrame:
    """Mean, Sharpe ratio, drawdown, win rate and volatility of the newest ``keep`` returns per metric, from a ring buffer in state.

    The buffer is sorted by (time, id), so the order of files does not matter; each Arrow batch brings only its
    newest rows of a metric, so a hot metric reaches its state thinned.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    def update(key, chunks, state):
        buf = list(zip(*state.get)) if state.exists else []
        for pdf in chunks:
            buf += list(zip(pdf["ts"].astype("int64").tolist(), pdf["event_id"].tolist(), pdf["ret"].tolist()))
            buf = sorted(buf)[-keep:]
        state.update(tuple([b[k] for b in buf] for k in range(3)))
        r = np.array([b[2] for b in buf])
        level = np.cumprod(1 + r)
        sd = r.std()
        yield pd.DataFrame([(key[0], len(r), r.mean(), r.mean() / sd if sd > 0 else 0.0, (1 - level / np.maximum.accumulate(level)).max(), (r > 0).mean(), sd)],
                           columns=[c.split()[0] for c in RECENT_SCHEMA.split(", ")])

    def thin(batches):
        for pdf in batches:
            yield pdf.sort_values(["metric", "ts", "event_id"]).groupby("metric").tail(keep)
    thinned = returns.select("metric", "ts", "event_id", "ret").mapInPandas(thin, "metric string, ts timestamp, event_id long, ret double")
    return thinned.groupBy("metric").applyInPandasWithState(update, RECENT_SCHEMA, "t array<long>, id array<long>, r array<double>", "update", GroupStateTimeout.NoTimeout)


def drawdown(returns: DataFrame, key: str, part: str = "1 day") -> DataFrame:
    """(key, max_drawdown) of the compounded returns of each key in order of (ts, event_id).

    Stretches of time are scanned apart and combine: each has its last level, peak and trough against its start and its own worst
    fall; the worst fall over a seam is that from the highest peak before it to the trough after it.  No task holds a whole key.
    Levels are kept as logarithms, so a long history does not overflow; a loss of everything or more is a level of zero.
    """
    d = returns.withColumn("_p", F.window("ts", part)["start"])
    inside = Window.partitionBy(key, "_p").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    growth = F.when(F.col("ret") > -1, F.log1p("ret")).when(F.col("ret").isNotNull(), float("-inf"))
    d = d.withColumn("_l", F.sum(growth).over(inside)).withColumn("_f", 1 - F.exp(F.col("_l") - F.max("_l").over(inside)))
    parts = d.groupBy(key, "_p").agg(F.max_by("_l", F.struct("ts", "event_id")).alias("_last"), F.max("_l").alias("_peak"), F.min("_l").alias("_trough"), F.max("_f").alias("_worst"))
    before = Window.partitionBy(key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_start", F.coalesce(F.sum("_last").over(before), F.lit(0.0)))
    over = 1 - F.exp(F.col("_start") + F.col("_trough") - F.max(F.col("_start") + F.col("_peak")).over(before))
    return parts.withColumn("_worst", F.greatest("_worst", over)).groupBy(key).agg(F.max("_worst").alias("max_drawdown"))


def performance_baseline(returns: DataFrame) -> DataFrame:
    """The same figures over the whole history, as base_*."""
    g = returns.groupBy("metric").agg(F.avg("ret").alias("base_return"), F.stddev_pop("ret").alias("base_volatility"), F.avg(flag(F.col("ret") > 0)).alias("base_win_rate"))
    return g.withColumn("base_sharpe", F.coalesce(F.try_divide("base_return", "base_volatility"), F.lit(0.0))).join(
        drawdown(returns, "metric").withColumnRenamed("max_drawdown", "base_drawdown"), "metric")


def performance_drift(recent: DataFrame, baseline: DataFrame) -> DataFrame:
    """Changes of the newest returns against the baseline, relative to its size."""
    change = lambda x, base: F.try_divide(F.col(x) - F.col(base), F.abs(base))
    return recent.join(baseline, "metric").withColumns({
        "return_change": change("avg_return", "base_return"), "sharpe_change": change("sharpe", "base_sharpe"), "drawdown_change": change("max_drawdown", "base_drawdown"),
        "win_rate_change": change("win_rate", "base_win_rate"), "volatility_change": change("volatility", "base_volatility")})


def hourly_arrivals(ticks: DataFrame) -> DataFrame:
    """All rows that arrive per type and hour, late or not: the hour is a plain column, so no watermark applies to it."""
    return ticks.groupBy("event_type", F.date_trunc("hour", "ts").alias("start")).agg(F.count(F.lit(1)).alias("arrived"))


def late_counts(accepted: DataFrame, arrived: DataFrame) -> DataFrame:
    """Accepted hours with the number of rows that came too late for them; hours of late rows only have no accepted ones."""
    d = arrived.join(accepted, ["event_type", "start"], "left")
    return d.withColumns({"n": F.coalesce("n", F.lit(0)), "late": F.col("arrived") - F.coalesce("n", F.lit(0)), "is_final": F.coalesce("is_final", F.lit(1))}).drop("arrived")
