"""DuckDB text for the derived tables, and small text builders for the check queries.

The check side is written apart from the DataFrame side: other engine, plain windows, self joins
where the DataFrame side uses closed forms.
"""
from __future__ import annotations

BARS = """bars AS (
  SELECT symbol, date, arg_min(px, k) AS open, max(px) AS high, min(px) AS low, arg_max(px, k) AS close,
         sum(q) AS volume
  FROM (SELECT l_suppkey AS symbol, CAST(date_trunc('week', l_shipdate) AS DATE) AS date,
               l_extendedprice / l_quantity AS px, l_quantity AS q,
               row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k
        FROM lineitem) GROUP BY symbol, date)"""
RETURNS = """returns AS (
  SELECT *, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY date), 0) - 1 AS ret FROM bars)"""
SECTOR = """sector AS (
  SELECT s_suppkey AS symbol, n_name AS industry, r_name AS sector
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
INDEX = """market_index AS (SELECT date, avg(close) AS mclose FROM bars GROUP BY date)"""
MRET = """market_returns AS (
  SELECT *, mclose / nullif(lag(mclose) OVER (ORDER BY date), 0) - 1 AS mret FROM market_index)"""
RETMKT = """returns_market AS (SELECT r.*, m.mclose, m.mret FROM returns r LEFT JOIN market_returns m USING (date))"""
INDUSTRY = """industry_panel AS (
  SELECT industry AS symbol, date, avg(ret) AS ret, avg(close) AS close, sum(volume) AS volume
  FROM returns JOIN sector USING (symbol) WHERE ret IS NOT NULL GROUP BY industry, date)"""
MACRO = """macro AS (
  SELECT date, avg(CASE WHEN sector = 'AFRICA' THEN close END) / 400 AS rate3m, avg(CASE WHEN sector = 'AMERICA' THEN close END) / 400 AS rate5y,
         avg(CASE WHEN sector = 'ASIA' THEN close END) / 400 AS rate10y, avg(CASE WHEN sector = 'EUROPE' THEN close END) / 400 AS rate30y,
         stddev_samp(close) / 30 AS vix, avg(open) AS gold, avg(high) AS oil, avg(close) AS equity, sum(volume) AS volume, avg(low) AS usd
  FROM bars JOIN sector USING (symbol) GROUP BY date)"""
TICKS = """ticks AS (
  SELECT user_id AS symbol, ts, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size,
         event_type, event_id FROM events)"""
METRICS = """metrics AS (SELECT ts, event_type AS metric, value, event_id FROM events)"""
OPTIONS = """options AS (
  SELECT user_id AS symbol, CAST(date_trunc('week', ts) AS DATE) AS expiry, CAST(ts AS DATE) AS date,
         CASE WHEN event_type = 'click' THEN 'call' ELSE 'put' END AS side,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume,
         CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 + 1 AS open_interest, value / 100 AS iv
  FROM events WHERE event_type IN ('click', 'view'))"""
REPORTS = """reports AS (
  WITH q AS (
    SELECT CAST(c_nationkey AS BIGINT) AS symbol, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS report_date,
           sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount)) AS gross_profit,
           sum(l_extendedprice * (1 - l_discount) * (1 - l_tax)) AS operating_income,
           sum(CASE WHEN o_orderstatus = 'F' THEN l_extendedprice * (1 - l_discount) * (1 - l_tax) ELSE 0.0 END) AS net_income,
           sum(l_quantity) AS shares
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    GROUP BY 1, 2),
  b AS (SELECT *, sum(revenue) OVER w AS total_assets, sum(net_income) OVER w AS equity,
           sum(gross_profit) OVER w * 0.5::DOUBLE AS current_assets, sum(net_income) OVER w * 0.6::DOUBLE AS retained_earnings
    FROM q WINDOW w AS (PARTITION BY symbol ORDER BY report_date ROWS UNBOUNDED PRECEDING))
  SELECT *, total_assets - equity AS total_liabilities, (total_assets - equity) * 0.4::DOUBLE AS current_liabilities,
         (total_assets - equity) * 0.5::DOUBLE AS total_debt, current_assets * 0.2::DOUBLE AS cash,
         current_assets * 0.3::DOUBLE AS inventory, current_assets * 0.4::DOUBLE AS receivables,
         revenue - gross_profit + revenue * 0.4::DOUBLE AS cogs, (total_assets - equity) * 0.01::DOUBLE AS interest_expense,
         net_income * 0.9::DOUBLE + gross_profit * 0.05::DOUBLE AS operating_cash_flow, revenue * 0.1::DOUBLE AS capex,
         operating_income * 1.1::DOUBLE AS ebitda, net_income * 0.3::DOUBLE AS dividends, revenue / shares AS price
  FROM b)"""
POSITIONS = """positions AS (
  SELECT CAST(s_nationkey AS BIGINT) AS portfolio, symbol, s_acctbal AS market_value, sector
  FROM supplier JOIN sector ON s_suppkey = symbol)"""
WEIGHTS = """weights AS (
  SELECT portfolio, symbol, abs(market_value) / nullif(sum(abs(market_value)) OVER (PARTITION BY portfolio), 0) AS weight
  FROM positions)"""
TRADES = """trades AS (
  SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS date, l_quantity AS size, l_extendedprice / l_quantity AS price,
         CASE WHEN l_returnflag = 'R' THEN -l_extendedprice * l_discount ELSE l_extendedprice * l_tax END AS pnl,
         l_discount / 10 AS slippage, CAST(l_linenumber AS DOUBLE) AS latency FROM lineitem)"""
DIRTY = """dirty_k AS (
  SELECT symbol, date, open, CASE WHEN k = 1 THEN low - 1 ELSE high END AS high, low,
         CASE WHEN k IN (2, 3, 5) THEN NULL ELSE close END AS close, CASE WHEN k = 4 THEN 0.0 ELSE volume END AS volume, k
  FROM (SELECT *, (symbol * 7 + CAST(date_diff('day', DATE '1970-01-05', date) / 7 AS BIGINT) * 3) % 23 AS k FROM bars)),
dirty_bars AS (SELECT * EXCLUDE k FROM (SELECT * FROM dirty_k UNION ALL SELECT * FROM dirty_k WHERE k = 6))"""
SECOND = """second_source AS (
  SELECT symbol, date, open * (1 + (k - 5)::DOUBLE / 1000) AS open, high * (1 + (k - 5)::DOUBLE / 1000) AS high,
         low * (1 + (k - 5)::DOUBLE / 1000) AS low, close * (1 + (k - 5)::DOUBLE / 1000) AS close, volume
  FROM (SELECT *, (symbol * 5 + CAST(date_diff('day', DATE '1970-01-05', date) / 7 AS BIGINT)) % 11 AS k FROM bars)
  WHERE k <> 0)"""

TABLES = {  # name -> (text, needed names)
    "bars": (BARS, []), "returns": (RETURNS, ["bars"]), "sector": (SECTOR, []),
    "market_index": (INDEX, ["bars"]), "market_returns": (MRET, ["market_index"]),
    "returns_market": (RETMKT, ["returns", "market_returns"]), "industry_panel": (INDUSTRY, ["returns", "sector"]),
    "macro": (MACRO, ["bars", "sector"]), "ticks": (TICKS, []), "doc_sentiment": ("", []), "metrics": (METRICS, []), "options": (OPTIONS, []), "reports": (REPORTS, []),
    "positions": (POSITIONS, ["sector"]), "weights": (WEIGHTS, ["positions"]), "trades": (TRADES, []),
    "dirty_bars": (DIRTY, ["bars"]), "second_source": (SECOND, ["bars"]),
}


def lexicon_tables() -> str:
    from quantloom.operators.sentiment import LEXICON_WORDS
    return ("doc_tokens AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS token FROM documents), "
            "marks AS (SELECT doc_id, quality AS m FROM labels WHERE quality IS NOT NULL), "
            "kinds AS (SELECT count(*) FILTER (WHERE m = 1) AS good, count(*) FILTER (WHERE m = 0) AS bad FROM documents JOIN marks USING (doc_id)), "
            "seen AS (SELECT token, count(*) FILTER (WHERE m = 1) AS a, count(*) FILTER (WHERE m = 0) AS b FROM (SELECT DISTINCT doc_id, token FROM doc_tokens) JOIN marks USING (doc_id) GROUP BY 1 HAVING count(*) >= 5), "
            "scored AS (SELECT token, a + b AS n, (100 * (a * bad - b * good)) // nullif(a * bad + b * good, 0) AS pol FROM seen, kinds), "
            f"lexicon AS (SELECT token, pol, abs(pol) AS sub FROM scored WHERE pol <> 0 ORDER BY abs(pol) DESC, n DESC, token LIMIT {LEXICON_WORDS}), "
            "doc_sentiment AS (SELECT d.doc_id, d.source AS symbol, d.lang, d.n_chars, coalesce(sum(pol)::DOUBLE / nullif(100 * count(pol), 0), 0) AS polarity, coalesce(sum(sub)::DOUBLE / nullif(100 * count(sub), 0), 0) AS subjectivity, count(pol) AS hits, "
            "CASE WHEN coalesce(sum(pol)::DOUBLE / nullif(100 * count(pol), 0), 0) > 0.1 THEN 'positive' WHEN coalesce(sum(pol)::DOUBLE / nullif(100 * count(pol), 0), 0) < -0.1 THEN 'negative' ELSE 'neutral' END AS sentiment "
            "FROM documents d LEFT JOIN doc_tokens USING (doc_id) LEFT JOIN lexicon USING (token) GROUP BY 1, 2, 3, 4)")


def prelude(names: list[str]) -> list[str]:
    seen: dict[str, str] = {}

    def add(n):
        if n not in seen:
            text, deps = TABLES[n]
            text = text or lexicon_tables()
            for d in deps:
                add(d)
            seen[n] = text

    for n in names:
        add(n)
    return list(seen.values())


def snap(x: str) -> str:
    a = f"abs({x})"
    s = f"(CASE WHEN {a} < 1e-3 THEN 1e9 WHEN {a} < 1 THEN 1e6 WHEN {a} < 1e3 THEN 1e4 WHEN {a} < 1e6 THEN 1e2 WHEN {a} < 1e9 THEN 1.0::DOUBLE ELSE 1e-3 END)"
    return f"(CASE WHEN {x} IS NULL OR isnan({x}) OR isinf({x}) THEN NULL ELSE floor({x} * {s} + 0.37::DOUBLE) / {s} END)"


# --- text builders -------------------------------------------------------------------------
class Sql:  # noqa: D101
    """Text counterparts of the series builders, for one (by, order) pair."""

    def __init__(self, by="symbol", order="date"):
        self.by, self.order = by, order
        self.w = f"PARTITION BY {by} ORDER BY {order}" if by else f"ORDER BY {order}"

    def frame(self, lo, hi=0):
        def b(v, side):
            if v is None:
                return f"UNBOUNDED {side}"
            return "CURRENT ROW" if v == 0 else f"{abs(v)} {'PRECEDING' if v < 0 else 'FOLLOWING'}"
        return f"({self.w} ROWS BETWEEN {b(lo, 'PRECEDING')} AND {b(hi, 'FOLLOWING')})"

    def over(self, agg, x, n, mp=None, lo=None, hi=0):
        f = self.frame(-(n - 1) if lo is None else lo, hi)
        return f"(CASE WHEN count({x}) OVER {f} >= {n if mp is None else mp} THEN {agg} OVER {f} END)"

    def mean(self, x, n, mp=None, lo=None, hi=0): return self.over(f"avg({x})", x, n, mp, lo, hi)
    def sum(self, x, n, mp=None, lo=None, hi=0): return self.over(f"sum({x})", x, n, mp, lo, hi)
    def std(self, x, n, mp=None, lo=None, hi=0): return self.over(f"stddev_samp({x})", x, n, mp, lo, hi)
    def std0(self, x, n, lo=None, hi=0): return self.over(f"stddev_pop({x})", x, n, None, lo, hi)
    def var(self, x, n, lo=None, hi=0): return self.over(f"var_samp({x})", x, n, None, lo, hi)
    def max(self, x, n, mp=None, lo=None, hi=0): return self.over(f"max({x})", x, n, mp, lo, hi)
    def min(self, x, n, mp=None, lo=None, hi=0): return self.over(f"min({x})", x, n, mp, lo, hi)
    def quantile(self, x, n, q, lo=None, hi=0): return self.over(f"quantile_cont({x}, {q})", x, n, None, lo, hi)
    def median(self, x, n, lo=None, hi=0): return self.quantile(x, n, 0.5, lo, hi)
    def skew(self, x, n): return self.over(f"skewness({x})", x, n)
    def kurt(self, x, n): return self.over(f"kurtosis({x})", x, n)
    def slope(self, x, n, pos="pos"): return self.over(f"regr_slope({x}, {pos})", x, n)
    def lag(self, x, n=1): return f"lag({x}, {n}) OVER ({self.w})"
    def lead(self, x, n=1): return f"lead({x}, {n}) OVER ({self.w})"
    def diff(self, x, n=1): return f"({x} - lag({x}, {n}) OVER ({self.w}))"
    def pct(self, x, n=1): return f"({x} / nullif(lag({x}, {n}) OVER ({self.w}), 0) - 1)"
    def pos(self): return f"row_number() OVER ({self.w})"
    def cum(self, agg): return f"{agg} OVER {self.frame(None, 0)}"
    def whole(self, agg): return f"{agg} OVER (PARTITION BY {self.by})"

    def corr(self, x, y, n, mp=None, lo=None, hi=0):
        f = self.frame(-(n - 1) if lo is None else lo, hi)
        both = f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END)"
        xx, yy = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)", f"(CASE WHEN {x} IS NOT NULL THEN {y} END)"
        return (f"(CASE WHEN count({both}) OVER {f} >= {n if mp is None else mp} THEN covar_samp({x}, {y}) OVER {f} / "
                f"nullif(stddev_samp({xx}) OVER {f} * stddev_samp({yy}) OVER {f}, 0) END)")

    def beta(self, y, x, n):
        f = self.frame(-(n - 1))
        both = f"(CASE WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN 1 END)"
        xx = f"(CASE WHEN {y} IS NOT NULL THEN {x} END)"
        return f"(CASE WHEN count({both}) OVER {f} >= {n} THEN covar_samp({y}, {x}) OVER {f} / nullif(var_samp({xx}) OVER {f}, 0) END)"

    def rank_pct(self, x, n):
        f = self.frame(-(n - 1))
        a = f"list({x}) FILTER (WHERE {x} IS NOT NULL) OVER {f}"
        return (f"(CASE WHEN count({x}) OVER {f} >= {n} AND {x} IS NOT NULL THEN list_rank({a}, {x}) END)")


def ewm(src: str, x: str, out: str, alpha: float, adjust: bool, by="symbol", order="date") -> str:
    """CTE body adding an exponential mean by its definition: a weighted sum over all earlier rows."""
    q = 1 - alpha
    num = f"pow({q!r}::DOUBLE, a.n_ - b.n_)"
    if adjust:
        val = f"sum({num} * b.x_) / sum({num})"
    else:
        val = f"sum({num} * b.x_ * (CASE WHEN b.n_ = 1 THEN 1.0::DOUBLE ELSE {alpha!r}::DOUBLE END))"
    return (f"SELECT s.*, e.{out} FROM {src} s LEFT JOIN (WITH t_ AS (SELECT {by} AS k_, {order} AS o_, CAST({x} AS DOUBLE) AS x_, "
            f"row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS n_ FROM {src} WHERE {x} IS NOT NULL) "
            f"SELECT a.k_, a.o_, {val} AS {out} FROM t_ a JOIN t_ b ON a.k_ = b.k_ AND b.n_ <= a.n_ GROUP BY a.k_, a.o_) e "
            f"ON s.{by} = e.k_ AND s.{order} = e.o_")


Q = Sql()


def draw_stages(out: str, seed: str, keys: list[str]) -> list[dict[str, str]]:
    """Stages of ``chain`` that draw a residue below 2^31 - 1 from a seed and integer keys."""
    p, st, cur = 2 ** 31 - 1, [], f"({seed})::BIGINT"
    for i, k in enumerate([*keys, "0"]):
        a, b, c, d = (f"{out}_{i}{x}" for x in "abcd")
        st += [{a: f"({cur} + ((({k})::BIGINT % {p}) + {p}) % {p}) % {p}"}, {b: f"{a} * {a} % {p}"}, {c: f"{b} * {b} % {p}"}, {d: f"(({c} * {a} % {p}) * 48271 + 1013904223) % {p}"}]
        cur = d
    return [*st, {out: cur}]


def unit(draw: str) -> str:
    return f"(({draw} + 0.5::DOUBLE) / {2 ** 31 - 1}::DOUBLE)"


def flag(cond: str) -> str:
    return f"(CASE WHEN {cond} THEN 1 ELSE 0 END)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def chain(src: str, *stages, final: str | None = None) -> str:
    """Stages as CTEs; a stage is a dict of new columns or a SELECT text over {src}.  Ends in SELECT * ."""
    ctes, cur = [], src
    for i, st in enumerate(stages):
        name = f"s{i}_"
        if isinstance(st, dict):
            body = f"SELECT *, {', '.join(f'{e} AS {n}' for n, e in st.items())} FROM {cur}"
        else:
            body = st.replace("{src}", cur)
        ctes.append(f"{name} AS ({body})")
        cur = name
    tail = (final or "SELECT * FROM {src}").replace("{src}", cur)
    return (f"WITH {', '.join(ctes)} " if ctes else "") + tail
