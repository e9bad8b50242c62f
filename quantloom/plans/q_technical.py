"""Queries of the technical factor family."""
from __future__ import annotations

from pyspark.sql import functions as F

from quantloom.operators import technical as T
from quantloom.plans.registry import query
from quantloom.plans.sql import Q, chain, div, ewm, flag

K = "symbol date"
Y = "sqrt(252::DOUBLE)"
DG = {"d": Q.diff("close")}
GL = {"g": "CASE WHEN d > 0 THEN d ELSE 0.0 END", "l": "CASE WHEN d < 0 THEN -d ELSE 0.0 END"}
TR = f"greatest(high - low, abs(high - {Q.lag('close')}), abs(low - {Q.lag('close')}))"


def rsi(g, lo):
    return f"(CASE WHEN {lo} = 0 THEN (CASE WHEN {g} > 0 THEN 100.0::DOUBLE END) ELSE 100 - 100 / (1 + {g} / nullif({lo}, 0)) END)"


def wilder(src, x, out, n):
    """SELECT text adding Wilder's average by its recursion, run as a recursive query over positions."""
    return (f"SELECT s.*, w.{out} FROM {src} s LEFT JOIN (WITH RECURSIVE v AS (SELECT symbol, date, {x} AS x, "
            f"row_number() OVER (PARTITION BY symbol ORDER BY date) AS k, avg({x}) OVER (PARTITION BY symbol ORDER BY date "
            f"ROWS {n - 1} PRECEDING) AS m FROM {src} WHERE {x} IS NOT NULL), "
            f"r AS (SELECT symbol, date, k, m AS y FROM v WHERE k = {n} UNION ALL SELECT v.symbol, v.date, v.k, "
            f"(r.y * {n - 1} + v.x) / {n} FROM r JOIN v ON v.symbol = r.symbol AND v.k = r.k + 1) "
            f"SELECT symbol AS ws, date AS wd, y AS {out} FROM r) w ON s.symbol = w.ws AND s.date = w.wd")


W5 = (5, 10, 20, 50, 200)
SMA = chain("bars", {f"sma_{n}": Q.mean("close", n, n // 2) for n in W5},
            {**{f"sma_{n}_slope": div(Q.diff(f"sma_{n}", 5), Q.lag(f"sma_{n}", 5)) for n in W5},
             **{f"price_to_sma_{n}": f"(close / nullif(sma_{n}, 0) - 1) * 100" for n in W5},
             **{f"sma_cross_{a}_{b}": flag(f"sma_{a} > sma_{b}") for a, b in zip(W5, W5[1:])}})


@query("sma_family", K, " ".join(f"sma_{n} sma_{n}_slope price_to_sma_{n}" for n in W5),
       " ".join(f"sma_cross_{a}_{b}" for a, b in zip(W5, W5[1:])), sql=SMA, tables="bars")
def sma_family(t):
    return T.sma_family(t.closes())


EMA = chain("bars", *[ewm("{src}", "close", f"ema_{n}", 2 / (n + 1), False) for n in (12, 26, 50)],
            {k: v for n in (12, 26, 50) for k, v in {
                f"ema_{n}_slope": div(Q.diff(f"ema_{n}", 3), Q.lag(f"ema_{n}", 3)),
                f"price_to_ema_{n}": f"(close / nullif(ema_{n}, 0) - 1) * 100"}.items()})


@query("ema_family", K, " ".join(f"ema_{n} ema_{n}_slope price_to_ema_{n}" for n in (12, 26, 50)), sql=EMA, tables="bars")
def ema_family(t):
    return T.ema_family(t.closes())


RSI = chain("bars", DG, GL, {f"rsi_{n}": rsi(Q.mean("g", n), Q.mean("l", n)) for n in (14, 21)},
            {k: v for n in (14, 21) for k, v in {
                f"rsi_{n}_overbought": flag(f"rsi_{n} > 70"), f"rsi_{n}_oversold": flag(f"rsi_{n} < 30"),
                f"rsi_{n}_momentum": Q.diff(f"rsi_{n}", 5)}.items()})


@query("rsi_sma", K, "rsi_14 rsi_21 rsi_14_momentum rsi_21_momentum",
       "rsi_14_overbought rsi_14_oversold rsi_21_overbought rsi_21_oversold", sql=RSI, tables="bars")
def rsi_sma(t):
    return T.rsi_sma(t.closes())


RSIW = chain("bars", DG, {"g": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0.0 END",
                          "l": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0.0 END"},
             *[wilder("{src}", x, f"{x}{n}", n) for n in (6, 14, 24, 30) for x in "gl"],
             {f"rsi_w{n}": f"CASE WHEN g{n} + l{n} = 0 THEN 0.0 ELSE 100 * g{n} / nullif(g{n} + l{n}, 0) END" for n in (6, 14, 24, 30)})


@query("rsi_wilder", K, "rsi_w6 rsi_w14 rsi_w24 rsi_w30", sql=RSIW, tables="bars")
def rsi_wilder(t):
    return T.rsi_wilder(t.closes())


MACD_STEPS = (ewm("{src}", "close", "ef", 2 / 13, True), ewm("{src}", "close", "es", 2 / 27, True), {"macd_line": "ef - es"},
              ewm("{src}", "macd_line", "macd_signal", 0.2, True), {"macd_histogram": "macd_line - macd_signal"})
MACD = chain("bars", *MACD_STEPS, {
    "macd_bullish_cross": flag(f"macd_line > macd_signal AND {Q.lag('macd_line')} <= {Q.lag('macd_signal')}"),
    "macd_bearish_cross": flag(f"macd_line < macd_signal AND {Q.lag('macd_line')} >= {Q.lag('macd_signal')}"),
    "macd_momentum": Q.diff("macd_histogram", 3),
    "macd_zero_cross": flag(f"macd_line > 0 AND {Q.lag('macd_line')} <= 0")})


@query("macd_family", K, "macd_line macd_signal macd_histogram macd_momentum",
       "macd_bullish_cross macd_bearish_cross macd_zero_cross", sql=MACD, tables="bars")
def macd_family(t):
    return T.macd_family(t.closes())


BB_STEPS = ({"bb_middle": Q.mean("close", 20), "sd": Q.std("close", 20)},
            {"bb_upper": "bb_middle + 2 * sd", "bb_lower": "bb_middle - 2 * sd"}, {"bw": "bb_upper - bb_lower"},
            {"bb_position": div("close - bb_lower", "bw"), "bb_width": div("bw", "bb_middle"),
             "bb_squeeze": flag(f"bw < {Q.mean('bw', 20)} * 0.8"), "bb_upper_break": flag("close > bb_upper"),
             "bb_lower_break": flag("close < bb_lower"), "bb_mean_reversion": flag("close > bb_upper OR close < bb_lower")})


@query("bollinger_family", K, "bb_upper bb_middle bb_lower bb_position bb_width",
       "bb_squeeze bb_upper_break bb_lower_break bb_mean_reversion", sql=chain("bars", *BB_STEPS), tables="bars")
def bollinger_family(t):
    return T.bollinger_family(t.closes())


MOM = chain("bars", {
    **{f"momentum_{n}d": f"{Q.pct('close', n)} * 100" for n in (1, 3, 5, 10, 20, 60)},
    "momentum_acceleration": f"{Q.pct('close', 5)} - {Q.pct('close', 20)}", "relative_strength_1y": Q.pct("close", 252),
    **{f"price_position_{n}d": div(f"close - {Q.min('close', n)}", f"({Q.max('close', n)} - {Q.min('close', n)})") for n in (20, 60, 252)},
    **{f"h{n}": Q.max("high", n) for n in (20, 60)}, **{f"l{n}": Q.min("low", n) for n in (20, 60)}},
    {f"breakout_momentum_{n}d": f"CASE WHEN close > {Q.lag(f'h{n}')} THEN 1 WHEN close < {Q.lag(f'l{n}')} THEN -1 ELSE 0 END" for n in (20, 60)})


@query("momentum_family", K, "momentum_1d momentum_3d momentum_5d momentum_10d momentum_20d momentum_60d momentum_acceleration "
       "relative_strength_1y price_position_20d price_position_60d price_position_252d",
       "breakout_momentum_20d breakout_momentum_60d", sql=MOM, tables="bars")
def momentum_family(t):
    return T.momentum_family(t.bars())


VOL = chain("bars", {"r": Q.pct("close"), "tr": f"abs({Q.diff('close')})"}, {f"v{n}": Q.std("r", n) for n in (5, 10, 20, 60)},
            {**{f"volatility_{n}d": f"v{n} * {Y}" for n in (5, 10, 20, 60)}, "volatility_ratio": div("v10", "v60"),
             "atr_14": Q.mean("tr", 14), "atr_ratio": div(Q.mean("tr", 14), "close"),
             **{f"volatility_breakout_{n}d": flag(f"v{n} > {Q.quantile(f'v{n}', n, 0.8)}") for n in (20, 60)}})


@query("volatility_family", K, "volatility_5d volatility_10d volatility_20d volatility_60d volatility_ratio atr_14 atr_ratio",
       "volatility_breakout_20d volatility_breakout_60d", sql=VOL, tables="bars")
def volatility_family(t):
    return T.volatility_family(t.closes())


VF = chain("bars", {"d": Q.diff("close"), "r": Q.pct("close"), **{f"volume_ma_{n}": Q.mean("volume", n) for n in (5, 10, 20, 60)}},
           {"up": "CASE WHEN d > 0 THEN close * volume ELSE 0.0 END", "dn": "CASE WHEN d < 0 THEN close * volume ELSE 0.0 END",
            "ov": "CASE WHEN d > 0 THEN volume WHEN d < 0 THEN -volume ELSE 0.0 END", "cv": "close * volume", "rv": "r * volume"},
           {**{f"volume_ratio_{n}": div("volume", f"volume_ma_{n}") for n in (5, 10, 20, 60)},
            "vpt": f"CASE WHEN r IS NOT NULL THEN {Q.cum('sum(rv)')} END", "obv": Q.cum("sum(ov)"),
            "vwap_20": div(Q.sum("cv", 20), Q.sum("volume", 20)),
            **{f"volume_breakout_{n}d": flag(f"volume > {Q.quantile('volume', n, 0.8)}") for n in (20, 60)},
            **{f"volume_trend_{n}d": flag(f"volume_ma_{n} > {Q.lag(f'volume_ma_{n}', 5)}") for n in (10, 20)},
            "su": Q.sum("up", 14), "sd": Q.sum("dn", 14)},
           {"price_to_vwap": "(close / nullif(vwap_20, 0) - 1) * 100", "mfi_14": rsi("su", "sd")})


@query("volume_family", K, "volume_ma_5 volume_ma_10 volume_ma_20 volume_ma_60 volume_ratio_5 volume_ratio_10 volume_ratio_20 "
       "volume_ratio_60 vpt obv vwap_20 price_to_vwap mfi_14",
       "volume_breakout_20d volume_breakout_60d volume_trend_10d volume_trend_20d", sql=VF, tables="bars")
def volume_family(t):
    return T.volume_family(t.bars())


def streak(cond, out):
    return [{f"{out}_f": flag(cond)}, {f"{out}_g": f"CASE WHEN {out}_f IS DISTINCT FROM lag({out}_f) OVER ({Q.w}) THEN 1 ELSE 0 END"},
            {f"{out}_i": Q.cum(f"sum({out}_g)")},
            {out: f"{out}_f * row_number() OVER (PARTITION BY symbol, {out}_i ORDER BY date)"}]


PAT = chain("bars", {"d": Q.diff("close"), "gap": Q.pct("close"), "prv": Q.lag("close"), "nxt": Q.lead("close")},
            *streak("d > 0", "consecutive_up_days"), *streak("d < 0", "consecutive_down_days"),
            {"gap_up": flag("gap > 0.02"), "gap_down": flag("gap < -0.02"),
             **{f"top_reversal_{n}d": flag(f"close = {Q.max('close', n)} AND prv < close AND nxt < close") for n in (3, 5, 10)},
             **{f"bottom_reversal_{n}d": flag(f"close = {Q.min('close', n)} AND prv > close AND nxt > close") for n in (3, 5, 10)},
             **{f"near_resistance_{n}d": flag(f"abs(close - {Q.max('close', n)}) / close < 0.02") for n in (20, 60)},
             **{f"near_support_{n}d": flag(f"abs(close - {Q.min('close', n)}) / close < 0.02") for n in (20, 60)}})


@query("pattern_family", K, "", "gap_up gap_down consecutive_up_days consecutive_down_days top_reversal_3d top_reversal_5d "
       "top_reversal_10d bottom_reversal_3d bottom_reversal_5d bottom_reversal_10d near_resistance_20d near_resistance_60d "
       "near_support_20d near_support_60d", sql=PAT, tables="bars")
def pattern_family(t):
    return T.pattern_family(t.closes())


CYC = chain("bars", {"r": Q.pct("close"), "m": f"month(max(date) OVER (PARTITION BY symbol))", "pos": Q.pos()},
            {"monthly_effect": "coalesce(avg(CASE WHEN month(date) = m THEN r END) OVER (PARTITION BY symbol), 0)",
             **{f"cycle_momentum_{n}d": f"CASE WHEN pos > {3 * n} THEN (close / {Q.lag('close', n)} - 1 + {Q.lag('close', n)} / {Q.lag('close', 2 * n)} - 1 "
                f"+ {Q.lag('close', 2 * n)} / {Q.lag('close', 3 * n)} - 1) / 3 ELSE 0 END" for n in (5, 10, 22)}})


@query("cycle_family", K, "monthly_effect cycle_momentum_5d cycle_momentum_10d cycle_momentum_22d", sql=CYC, tables="bars")
def cycle_family(t):
    return T.cycle_family(t.closes())


AMA = chain("bars", {"v": Q.std("close", 20)}, {"a": f"least(greatest(v / nullif({Q.mean('v', 20)}, 0), 0.1), 0.9)"},
            {"al": f"CASE WHEN v IS NULL OR {Q.mean('v', 20)} IS NULL THEN 1.0 ELSE a END", "k": Q.pos()},
            "WITH RECURSIVE r AS (SELECT symbol, date, k, close AS y FROM {src} WHERE k = 1 UNION ALL SELECT b.symbol, b.date, b.k, "
            "b.al * b.close + (1 - b.al) * r.y FROM r JOIN {src} b ON b.symbol = r.symbol AND b.k = r.k + 1) "
            "SELECT symbol, date, y AS adaptive_ma FROM r")


@query("adaptive_ma", K, "adaptive_ma", sql=AMA, tables="bars")
def adaptive_ma(t):
    return T.adaptive_ma(t.closes())


TSP = chain("bars", {"r": Q.pct("close")}, {"chg": flag(f"r * {Q.lag('r')} < 0"), "up": flag("r > 0")},
            {"trend_strength": f"coalesce(CASE WHEN count(r) OVER {Q.frame(-19)} >= 20 THEN (sum(up) OVER {Q.frame(-19)} / 20.0::DOUBLE - 0.5) * 2 END, 0)",
             "trend_persistence": f"1 - {Q.sum('chg', 20)} / 20.0::DOUBLE"})


@query("trend_strength_persistence", K, "trend_strength trend_persistence", sql=TSP, tables="bars")
def trend_strength_persistence(t):
    return T.trend_strength_persistence(t.closes())


DK = chain("bars", {"tr": TR, "tp": "(high + low + close) / 3", "donchian_upper": Q.max("high", 20), "donchian_lower": Q.min("low", 20)},
           {"ma": Q.mean("tp", 20), "atr": Q.mean("tr", 20)},
           {"donchian_middle": "(donchian_upper + donchian_lower) / 2",
            "donchian_position": div("close - donchian_lower", "(donchian_upper - donchian_lower)"),
            "keltner_upper": "ma + 2 * atr", "keltner_lower": "ma - 2 * atr"},
           {"keltner_position": div("close - keltner_lower", "(keltner_upper - keltner_lower)")})


@query("donchian_keltner_channels", K, "donchian_upper donchian_lower donchian_middle donchian_position keltner_upper keltner_lower keltner_position",
       sql=DK, tables="bars")
def donchian_keltner_channels(t):
    return T.donchian_keltner(t.bars())


SR = chain("bars", {"mx": flag(f"{Q.max('close', 20, lo=-10, hi=9)} = close"), "mn": flag(f"{Q.min('close', 20, lo=-10, hi=9)} = close")},
           {"resistance_strength": Q.sum("mx", 40), "support_strength": Q.sum("mn", 40)},
           {"sr_ratio": "resistance_strength / (support_strength + 1e-8::DOUBLE)"})


@query("support_resistance_strength", K, "resistance_strength support_strength sr_ratio", sql=SR, tables="bars")
def support_resistance_strength(t):
    return T.support_resistance_strength(t.closes())


MP = chain("bars", {"r": Q.pct("close"), "cv": "close * volume"}, {"rl": Q.lag("r"), "ar": "abs(r)", "vwap": div(Q.sum("cv", 20), Q.sum("volume", 20))},
           {"price_jumps": flag(f"abs(r / nullif({Q.std('r', 20)}, 0)) > 3"),
            "price_efficiency": f"abs({Q.diff('close', 20)}) / {Q.lag('close', 20)} / ({Q.sum('ar', 20)} + 1e-8::DOUBLE)",
            "amihud_illiquidity": "ar / (cv + 1e-8::DOUBLE)", "vwap_deviation": div("close - vwap", "vwap"),
            "liquidity_ratio": div("volume", Q.mean("volume", 20)), "market_impact": Q.corr("r", "rl", 5)})


@query("microstructure_price", K, "price_efficiency amihud_illiquidity vwap_deviation liquidity_ratio market_impact", "price_jumps",
       sql=MP, tables="bars")
def microstructure_price(t):
    return T.microstructure_price(t.bars())


ASW = chain("bars", {"tr": TR, "hh": Q.max("high", 14), "ll": Q.min("low", 14)}, {"stoch_k": "100 * (close - ll) / nullif(hh - ll, 0)"},
            {"stoch_d": Q.mean("stoch_k", 3), "atr": Q.mean("tr", 14), "williams_r": "-100 * (hh - close) / nullif(hh - ll, 0)"})


@query("atr_stoch_williams", K, "stoch_k stoch_d atr williams_r", sql=ASW, tables="bars")
def atr_stoch_williams(t):
    return T.atr_stoch_williams(t.bars())


DM = {"tr": TR, "up": Q.diff("high"), "dn": f"({Q.lag('low')} - low)"}
ADX_STEPS = (DM, {"p": "CASE WHEN up > dn THEN up ELSE 0.0 END", "m": "CASE WHEN dn > up THEN dn ELSE 0.0 END"},
             {"plus_di": f"{Q.mean('p', 14)} / nullif({Q.mean('tr', 14)}, 0) * 100", "minus_di": f"{Q.mean('m', 14)} / nullif({Q.mean('tr', 14)}, 0) * 100"},
             {"dx": "abs(plus_di - minus_di) / nullif(plus_di + minus_di + 1e-8::DOUBLE, 0) * 100"}, {"adx": Q.mean("dx", 14)})


@query("adx_di", K, "adx plus_di minus_di", sql=chain("bars", *ADX_STEPS), tables="bars")
def adx_di(t):
    return T.adx_di(t.bars())


ADXW = chain("bars", DM, {"p": "CASE WHEN up > dn AND up > 0 THEN up WHEN up IS NOT NULL THEN 0.0 END",
                          "m": "CASE WHEN dn > up AND dn > 0 THEN dn WHEN up IS NOT NULL THEN 0.0 END", "t": "CASE WHEN up IS NOT NULL THEN tr END"},
             wilder("{src}", "p", "ps", 14), wilder("{src}", "m", "ms", 14), wilder("{src}", "t", "ts", 14),
             {"plus_di_w": "100 * ps / nullif(ts, 0)", "minus_di_w": "100 * ms / nullif(ts, 0)"},
             {"dx": "CASE WHEN plus_di_w IS NOT NULL THEN coalesce(100 * abs(plus_di_w - minus_di_w) / nullif(plus_di_w + minus_di_w, 0), 0) END"},
             wilder("{src}", "dx", "adx_w", 14))


@query("adx_di_wilder", K, "adx_w plus_di_w minus_di_w", sql=ADXW, tables="bars")
def adx_di_wilder(t):
    return T.adx_di_wilder(t.bars())


CCI = chain("bars", {"tp": "(high + low + close) / 3"}, {"ma": Q.mean("tp", 14), "arr": f"list(tp) OVER {Q.frame(-13)}"},
            {"mad": "list_sum(list_transform(arr, lambda x: abs(x - ma))) / 14", "mom_10": Q.diff("close", 10), "mom_20": Q.diff("close", 20),
             "roc_10": f"{Q.pct('close', 10)} * 100", "roc_20": f"{Q.pct('close', 20)} * 100"},
            {"cci": "CASE WHEN ma IS NOT NULL THEN (tp - ma) / nullif(0.015::DOUBLE * mad, 0) END"},
            ewm("{src}", "close", "t1", 2 / 15, False), ewm("{src}", "t1", "t2", 2 / 15, False), ewm("{src}", "t2", "t3", 2 / 15, False),
            {"trix": f"{Q.pct('t3')} * 100"})


@query("cci_mom_roc_trix", K, "cci mom_10 mom_20 roc_10 roc_20 trix", sql=CCI, tables="bars")
def cci_mom_roc_trix(t):
    return T.cci_mom_roc_trix(t.bars())


LR = chain("bars", {"pos": Q.pos(), "hi": Q.max("high", 20), "lo": Q.min("low", 20)},
           {"trend_slope": Q.slope("close", 20), "trend_r2": Q.over("regr_r2(close, pos)", "close", 20),
            "price_channel_position": "CASE WHEN hi > lo THEN (close - lo) / (hi - lo) * 100 WHEN hi IS NOT NULL THEN 50 END"})


@query("linreg_channel", K, "trend_slope trend_r2 price_channel_position", sql=LR, tables="bars")
def linreg_channel(t):
    return T.linreg_channel(t.bars())


VLR = chain("bars", {"lr": f"ln(close) - ln({Q.lag('close')})", "tr": f"CASE WHEN {Q.lag('close')} IS NOT NULL THEN {TR} END", "k": Q.pos()},
            {**{f"log_vol_{n}": f"{Q.std0('lr', n)} * {Y} * 100" for n in (10, 20, 60)},
             **{f"price_range_{n}": f"({Q.max('high', n)} - {Q.min('low', n)}) / nullif({Q.min('low', n)}, 0) * 100" for n in (5, 10, 20)},
             "intraday_range": "(high - low) / nullif(close, 0) * 100",
             "c20": f"CASE WHEN k = 20 THEN avg(close) OVER {Q.frame(-19)} WHEN k > 20 THEN close END"},
            wilder("{src}", "tr", "atr", 20), ewm("{src}", "c20", "mid", 2 / 21, False),
            {"kc_position": "CASE WHEN mid + 2 * atr > mid - 2 * atr THEN (close - (mid - 2 * atr)) / (4 * atr) * 100 WHEN atr IS NOT NULL THEN 50 END"})


@query("volatility_log_range", K, "log_vol_10 log_vol_20 log_vol_60 price_range_5 price_range_10 price_range_20 intraday_range kc_position",
       sql=VLR, tables="bars")
def volatility_log_range(t):
    return T.volatility_log_range(t.bars())


OBV_STEPS = ({"d": Q.diff("close")},
             {"mfv": "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0) * volume",
              "ov": "CASE WHEN d > 0 THEN volume WHEN d < 0 THEN -volume WHEN d IS NULL THEN volume ELSE 0.0 END"},
             {"obv": Q.cum("sum(ov)"), "ad_line": Q.cum("sum(mfv)"), "cmf_20": div(Q.sum("mfv", 20), Q.sum("volume", 20)), "vroc": f"{Q.pct('volume', 10)} * 100"},
             ewm("{src}", "ad_line", "a3", 0.5, False), ewm("{src}", "ad_line", "a10", 2 / 11, False),
             {"adosc": "a3 - a10", "obv_change_10": f"{Q.diff('obv', 9)} / nullif(abs({Q.lag('obv', 9)}), 0) * 100"})


@query("obv_ad_cmf_adosc", K, "obv ad_line cmf_20 vroc adosc obv_change_10", sql=chain("bars", *OBV_STEPS), tables="bars")
def obv_ad_cmf_adosc(t):
    return T.obv_ad_cmf(t.bars())


CS = chain("bars", {"body": "abs(close - open)", "up": "high - greatest(open, close)", "dn": "least(open, close) - low", "rng": "high - low",
                    "po": Q.lag("open"), "pc": Q.lag("close"), "m": Q.mean("close", 10)},
           {"long_low": "dn >= 2 * body AND up <= 0.5 * body AND body > 0", "long_up": "up >= 2 * body AND dn <= 0.5 * body AND body > 0"},
           {"hammer": flag("long_low AND close < m"), "hanging_man": flag("long_low AND close > m"), "shooting_star": flag("long_up AND close > m"),
            "engulfing": flag("(close > open AND pc < po AND close >= po AND open <= pc) OR (close < open AND pc > po AND close <= po AND open >= pc)"),
            "doji": flag("body <= 0.1::DOUBLE * rng")})


@query("candlestick_patterns", K, "", "hammer hanging_man shooting_star engulfing doji", sql=CS, tables="bars")
def candlestick_patterns(t):
    return T.candlestick_patterns(t.bars())


P52 = chain("bars", {"hi52": Q.max("high", 252, 52), "lo52": Q.min("low", 252, 52), "pc": Q.lag("close")},
            {"distance_to_resistance": f"({Q.max('high', 20)} - close) / close * 100", "distance_to_support": f"(close - {Q.min('low', 20)}) / close * 100",
             "open_gap_up": "CASE WHEN pc IS NOT NULL THEN (CASE WHEN open > pc THEN (open - pc) / pc * 100 ELSE 0 END) END",
             "open_gap_down": "CASE WHEN pc IS NOT NULL THEN (CASE WHEN open < pc THEN (pc - open) / pc * 100 ELSE 0 END) END",
             "position_52w": "CASE WHEN hi52 > lo52 THEN (close - lo52) / (hi52 - lo52) * 100 WHEN hi52 IS NOT NULL THEN 50 END",
             "distance_to_52w_high": "(hi52 - close) / close * 100", "distance_to_52w_low": "(close - lo52) / close * 100",
             "breakout_up": flag(f"high > {Q.max('high', 19, lo=-19, hi=-1)}"), "breakout_down": flag(f"low < {Q.min('low', 19, lo=-19, hi=-1)}")})


@query("pattern_52w_breakout", K, "distance_to_resistance distance_to_support open_gap_up open_gap_down position_52w distance_to_52w_high distance_to_52w_low",
       "breakout_up breakout_down", sql=P52, tables="bars")
def pattern_52w_breakout(t):
    return T.pattern_52w_breakout(t.bars())


NATR = chain("bars", {"bb5_middle": Q.mean("close", 5), "sd": Q.std0("close", 5), "tr": f"CASE WHEN {Q.lag('close')} IS NOT NULL THEN {TR} END"},
             {"bb5_upper": "bb5_middle + 2 * sd", "bb5_lower": "bb5_middle - 2 * sd", "bb5_width": "4 * sd / nullif(bb5_middle, 0)",
              "bb5_position": "(close - (bb5_middle - 2 * sd)) / nullif(4 * sd, 0)"},
             wilder("{src}", "tr", "atr_w14", 14), {"natr_14": "atr_w14 / close * 100"})


@query("natr_bbands5", K, "bb5_upper bb5_middle bb5_lower bb5_width bb5_position atr_w14 natr_14", sql=NATR, tables="bars")
def natr_bbands5(t):
    return T.natr_bbands5(t.bars())


IP = chain("bars", ewm("{src}", "close", "ema_12", 2 / 13, True), ewm("{src}", "close", "ema_26", 2 / 27, True), {"macd": "ema_12 - ema_26", **DG},
           ewm("{src}", "macd", "macd_signal", 0.2, True), GL,
           {**{f"sma_{n}": Q.mean("close", n) for n in (5, 10, 20, 50)}, "macd_histogram": "macd - macd_signal",
            "rsi": rsi(Q.mean("g", 14), Q.mean("l", 14)), "bb_middle": Q.mean("close", 20), "bb_upper": f"{Q.mean('close', 20)} + 2 * {Q.std('close', 20)}",
            "bb_lower": f"{Q.mean('close', 20)} - 2 * {Q.std('close', 20)}", "volume_sma": Q.mean("volume", 20)})


@query("indicator_panel_backtest", K, "sma_5 sma_10 sma_20 sma_50 ema_12 ema_26 macd macd_signal macd_histogram rsi bb_middle bb_upper bb_lower volume_sma",
       sql=IP, tables="bars")
def indicator_panel_backtest(t):
    return T.indicator_panel(t.bars())


SNAP_STEPS = (*BB_STEPS, DG, GL, {"r14": rsi(Q.mean("g", 14), Q.mean("l", 14))}, *MACD_STEPS,
              "SELECT * EXCLUDE (d) FROM {src}", *OBV_STEPS)
SNAP = chain("bars", *SNAP_STEPS, {"vr": div("volume", Q.mean("volume", 20)), "rn": "row_number() OVER (PARTITION BY symbol ORDER BY date DESC)"})
ADXS = chain("bars", *ADX_STEPS)
SNAPQ = (f"SELECT a.symbol, a.date, coalesce(r14, 50) AS rsi_14, macd_line, macd_signal, coalesce(bb_position * 100, 50) AS bb_position_pct, "
         f"coalesce(b.adx, 0) AS adx, coalesce(vr, 1) AS volume_ratio_20, obv, cmf_20 FROM ({SNAP}) a JOIN ({ADXS}) b USING (symbol, date) WHERE rn = 1")
SNUM = "rsi_14 macd_line macd_signal bb_position_pct adx volume_ratio_20 obv cmf_20"


@query("factor_snapshot_last", K, SNUM, sql=SNAPQ, tables="bars")
def factor_snapshot_last(t):
    return T.factor_snapshot(t.bars())


SCQ = (f"SELECT *, CASE WHEN rsi_14 <= 30 THEN 100 WHEN rsi_14 >= 70 THEN 0 ELSE 50 END AS rsi_14_score, "
       f"CASE WHEN macd_line > macd_signal THEN 100 ELSE 0 END AS macd_score, "
       f"CASE WHEN bb_position_pct <= 20 THEN 100 WHEN bb_position_pct >= 80 THEN 0 ELSE 50 END AS bb_position_score, "
       f"CASE WHEN adx >= 25 THEN 100 WHEN adx >= 20 THEN 75 ELSE 25 END AS trend_strength_score, "
       f"CASE WHEN volume_ratio_20 >= 2 THEN 100 WHEN volume_ratio_20 >= 1.5 THEN 75 WHEN volume_ratio_20 >= 0.5 THEN 50 ELSE 25 END AS volume_score "
       f"FROM ({SNAPQ})")
SCORES = "rsi_14_score macd_score bb_position_score trend_strength_score volume_score"


@query("factor_scores_buckets", K, "", SCORES, sql=SCQ, tables="bars")
def factor_scores_buckets(t):
    return T.factor_scores(T.factor_snapshot(t.bars()))


@query("rank_symbols_by_score", K, "score", "position",
       sql=f"SELECT *, rank() OVER (ORDER BY score DESC) AS position FROM (SELECT symbol, date, "
           f"({' + '.join(SCORES.split())}) / 5.0::DOUBLE AS score FROM ({SCQ}))", tables="bars")
def rank_symbols_by_score(t):
    """Flagship: symbols ranked by their mean score on the last bar (exact rank without one big task)."""
    from quantloom.functions.exact import with_ranks
    from quantloom.session import checkpoint
    d = T.factor_scores(T.factor_snapshot(t.bars()))
    total = sum((F.col(c) for c in SCORES.split()), F.lit(0))
    # one short row per symbol, read several times by the ranking: computed once and written reliably
    d = checkpoint(d.select("symbol", "date", (total / F.lit(5.0)).alias("score"))).withColumn("_neg", -F.col("score"))
    return with_ranks(d, ["symbol", "date"], [], {"position": ("_neg", "row")})
