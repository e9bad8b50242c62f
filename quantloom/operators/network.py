"""Correlation networks, contagion and market structure.

Nodes of a windowed network are a dimension (industries, features), not symbols: pairs of nodes are
joined per date and each pair is a series with a window frame.  Symbol-level measures use linear
forms (correlation with a sum) instead of pairs.  Where a measure is about pairs of symbols, pairs are
only counted and summed, in cells of two bounded blocks of symbols each.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.functions.exact import with_group_stats
from quantloom.functions.graph import component_labels
from quantloom.functions.kernels import rolling_frame
from quantloom.functions.series import S, Series, div, flag, spread
from quantloom.operators.cross_section import mean_correlation
from quantloom.operators.relational import corr_agg
from quantloom.session import materialise



def _dense(rows: DataFrame, keys: list[str], n: int) -> DataFrame:
    """A row for every calendar position at which the window of a key still holds one of its rows.

    A row is carried, without its values, over the positions up to the next one of its key: no grid, no join.
    """
    last = rows.agg(F.max("_p").alias("_last"))  # one row
    after = F.lead("_p").over(Window.partitionBy(*keys).orderBy("_p"))
    d = rows.crossJoin(F.broadcast(last)).withColumn("_end", F.least(F.coalesce(after - 1, "_last"), F.col("_p") + (n - 1)))
    d = d.withColumn("_q", F.explode(F.sequence("_p", "_end")))
    values = [c for c in rows.columns if c not in (*keys, "_p")]
    return d.select(*keys, F.col("_q").alias("_p"), *[F.when(F.col("_q") == F.col("_p"), F.col(c)).alias(c) for c in values])


def windowed_network(panel: DataFrame, n=60, value="ret", min_share=0.5) -> tuple[DataFrame, DataFrame]:
    """Pair correlations (date, a, b, corr) and nodes (date, node) of the windows of ``n`` calendar dates.

    Pairs are formed per date over a dimension, and every pair is a series of its own with one window
    frame; nothing gathers a date or the calendar.  A pair needs ``min_share`` of the dates in common.
    """
    p = panel.where(F.col(value).isNotNull()).select("date", F.col("symbol").alias("node"), F.col(value).alias("v"))
    calendar = p.select("date").distinct().withColumn("_p", F.row_number().over(Window.orderBy("date")))  # one row per date
    p = materialise(p.join(calendar, "date").select("_p", "node", "v"), "panel")
    x, y = p.select("_p", F.col("node").alias("a"), F.col("v").alias("x")), p.select("_p", F.col("node").alias("b"), F.col("v").alias("y"))
    both = x.join(y, "_p").where(F.col("a") < F.col("b"))
    w = Window.partitionBy("a", "b").orderBy("_p").rangeBetween(1 - n, 0)
    c = _dense(both, ["a", "b"], n).select("_p", "a", "b", F.corr("x", "y").over(w).alias("corr"), F.count("x").over(w).alias("_n"))
    c = c.where((F.col("_p") >= n) & (F.col("_n") >= min_share * n)).join(calendar, "_p").select("date", "a", "b", "corr")
    present = F.count("v").over(Window.partitionBy("node").orderBy("_p").rangeBetween(1 - n, 0))
    nodes = _dense(p, ["node"], n).withColumn("_n", present).where((F.col("_n") > 0) & (F.col("_p") >= n)).join(calendar, "_p").select("date", "node")
    return materialise(c, "correlations"), materialise(nodes, "nodes")


def over(corr: DataFrame, threshold: float) -> DataFrame:
    return corr.where(F.abs("corr") > threshold)


def edges(panel: DataFrame, n=60, threshold=0.2, value="ret") -> DataFrame:
    return over(windowed_network(panel, n, value)[0], threshold)


def degrees(edge: DataFrame) -> DataFrame:
    both = edge.select("date", F.col("a").alias("node")).unionByName(edge.select("date", F.col("b").alias("node")))
    return both.groupBy("date", "node").agg(F.count(F.lit(1)).alias("degree"))


def density_degree(panel: DataFrame, n=60, threshold=0.2, value="ret") -> DataFrame:
    corr, nodes = windowed_network(panel, n, value)
    hit = F.count_if(F.abs("corr") > threshold)
    g = corr.groupBy("date").agg(hit.alias("_e"), F.avg("corr").alias("avg_corr"), F.max("corr").alias("max_corr"), F.stddev_pop("corr").alias("std_corr"))
    k = nodes.groupBy("date").agg(F.count(F.lit(1)).alias("nodes"))
    top = degrees(over(corr, threshold)).groupBy("date").agg(F.max("degree").alias("max_degree"))
    d = g.join(k, "date").join(top, "date", "left")
    return d.select("date", "nodes", div(F.col("_e") * 2, F.col("nodes") * (F.col("nodes") - 1)).alias("density"), div(F.col("_e") * 2, "nodes").alias("avg_degree"),
                    F.coalesce("max_degree", F.lit(0)).alias("max_degree"), "avg_corr", "max_corr", "std_corr")


def clustering(panel: DataFrame, n=60, threshold=0.2, value="ret") -> DataFrame:
    """Local clustering coefficient per node (0 below two neighbours); every triangle is found once, from its smallest node."""
    corr, nodes = windowed_network(panel, n, value)
    e = over(corr, threshold).select("date", "a", "b")
    wedge = e.join(e.select("date", "a", F.col("b").alias("c")), ["date", "a"]).where(F.col("b") < F.col("c"))
    closed = wedge.join(e.select("date", F.col("a").alias("b"), F.col("b").alias("c")), ["date", "b", "c"])
    tri = closed.select("date", F.explode(F.array("a", "b", "c")).alias("node")).groupBy("date", "node").agg(F.count(F.lit(1)).alias("_t"))
    d = nodes.join(degrees(e), ["date", "node"], "left").join(tri, ["date", "node"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    most = F.col("degree") * (F.col("degree") - 1) / 2
    return d.select("date", "node", F.when(F.col("degree") > 1, F.coalesce("_t", F.lit(0)) / most).otherwise(0.0).alias("clustering"), "degree")


def connected_components(edge: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest reachable node name per (date, node), all dates at once, whatever the length of the paths."""
    ends = edge.select(F.struct("date", F.col("a").alias("node")).alias("a"), F.struct("date", F.col("b").alias("node")).alias("b"))
    lab = component_labels(ends).select("node.date", "node.node", F.col("label.node").alias("label"))
    return nodes.select("date", "node").join(lab, ["date", "node"], "left").withColumn("label", F.coalesce("label", "node"))


def contagion(df: DataFrame, n=60, s: Series = S) -> DataFrame:
    """Correlation with the rest of the market now minus in the window before."""
    d = with_group_stats(df.where(F.col("ret").isNotNull()), ["date"], {"_t": F.sum("ret"), "_k": F.count(F.lit(1))})
    d = d.withColumn("_rest", div(F.col("_t") - F.col("ret"), F.col("_k") - 1))
    return d.withColumns({"corr_now": s.corr("ret", "_rest", n), "corr_before": s.corr("ret", "_rest", n, lo=-(2 * n - 1), hi=-n)}).withColumn("contagion", F.col("corr_now") - F.col("corr_before")).drop("_t", "_k", "_rest")


def group_mean_correlation(returns: DataFrame, window=60, group=(), s: Series = S) -> DataFrame:
    """Mean correlation with the other members of the (date, group) over the dates up to each date, in linear form."""
    return mean_correlation(returns, window, s, group, ahead=0)


def supply_chain(links: DataFrame, returns: DataFrame) -> DataFrame:
    """Mean absolute correlation with the suppliers and their mean volatility; links are a few per symbol."""
    r = returns.where(F.col("ret").isNotNull()).select("symbol", "date", "ret")
    j = links.join(r, "symbol").join(r.select(F.col("symbol").alias("supplier"), "date", F.col("ret").alias("sret")), ["supplier", "date"])
    g = j.groupBy("symbol", "supplier").agg(corr_agg("ret", "sret").alias("c"), F.stddev_samp("sret").alias("v"), F.count(F.lit(1)).alias("n"))
    return g.groupBy("symbol").agg(F.avg(F.abs("c")).alias("supplier_corr"), F.avg("v").alias("supplier_vol"), F.sum("n").alias("n"))


def market_structure(df: DataFrame, s: Series = S) -> DataFrame:
    """Synchronicity, lead-lag and liquidity co-movement with the market per symbol."""
    d = df.withColumns({"_ml": F.col("mlag"), "_vc": s.pct("volume")})
    return d.groupBy(*s.by).agg(F.pow(corr_agg("ret", "mret"), F.lit(2.0)).alias("synchronicity"), corr_agg("ret", "_ml").alias("lead_lag"), corr_agg("_vc", "mvol").alias("liquidity_corr"))


def complete_corr(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Correlation of every row of ``x`` with every row of ``y`` over the positions that both hold, and their number."""
    def centred(v):
        held = ~np.isnan(v)
        k = np.maximum(held.sum(axis=1, keepdims=True), 1)
        return np.where(held, v - np.nansum(v, axis=1, keepdims=True) / k, 0.0), held.astype(float)
    (zx, hx), (zy, hy) = centred(x), centred(y)
    n = hx @ hy.T
    with np.errstate(all="ignore"):
        sx, sy, sxx, syy = zx @ hy.T, hx @ zy.T, (zx * zx) @ hy.T, hx @ (zy * zy).T
        vx, vy = sxx - sx * sx / n, syy - sy * sy / n
        c = (zx @ zy.T - sx * sy / n) / np.sqrt(vx * vy)
    return np.where((vx > 1e-12 * sxx) & (vy > 1e-12 * syy), c, np.nan), n  # no variance, no correlation


STRIP_SCHEMA = "chunk int, block int, first int, width int, ret binary, volume binary, mret binary"


def _strip(rows: pd.DataFrame, n: int, span: int) -> pd.DataFrame:
    """The rows of a block of symbols and a chunk of windows as matrices, symbols x dates, with holes as NaN."""
    chunk, block = int(rows["chunk"].iloc[0]), int(rows["block"].iloc[0])
    first = max(chunk * span - n + 1, 1)
    width = (chunk + 1) * span - first
    code, names = pd.factorize(rows["symbol"])
    at = rows["_p"].to_numpy() - first

    def packed(value):
        g = np.full((len(names), width), np.nan)
        g[code, at] = rows[value]
        return g.tobytes()
    market = np.full((1, width), np.nan)
    market[0, at] = rows["mret"]
    return pd.DataFrame([(chunk, block, first, width, packed("ret"), packed("volume"), market.tobytes())], columns=["chunk", "block", "first", "width", "ret", "volume", "mret"])


#: Side of the tiles in which the pairs of a cell are worked on (288 kilobytes a matrix), and windows that share the sums over their common dates.
TILE, SHARED = 192, 12


def _parts(v: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Distances from the centre, marks of the values that are there, and squares of the distances, 3 x rows x dates; a hole is 0."""
    held = ~np.isnan(v)
    z = np.where(held, v - centre, 0.0)
    return np.stack([z, held, z * z])


def _products(x: np.ndarray, y: np.ndarray, to: np.ndarray) -> None:
    """Sums over the dates for every pair of rows: of x, pairs, of squares of x, of products, of y, of squares of y."""
    k, p, q = x.shape[2], x.shape[1], y.shape[1]
    np.matmul(x.reshape(3 * p, k), y[1].T, out=to[:3].reshape(3 * p, q))
    np.matmul(x[:2].reshape(2 * p, k), y[0].T, out=to[3:5].reshape(2 * p, q))
    np.matmul(x[1], y[2].T, out=to[5])


def sliding_corr(x: np.ndarray, y: np.ndarray, n: int, least: float):
    """Yields, per window of ``n`` positions, the correlations of the rows of ``x`` with those of ``y`` and whether they count, 0 and False where not.

    As ``complete_corr``, window by window.  ``SHARED`` windows have most positions in common: their sums are taken once, and a
    window adds those of its few others; nothing is subtracted, so no window bears the rounding of values outside it.  The arrays are used again by the next window.
    """
    windows = x.shape[1] - n + 1
    shared = min(SHARED, max(1, n // 2))
    core, sums, c, t = (np.empty((k, len(x), len(y))) for k in (6, 6, 1, 1))
    c, t = c[0], t[0]
    for s in range(0, windows, shared):
        m = min(shared, windows - s)
        sides = []
        for v in (x, y):
            v = v[:, s:s + m + n - 1]
            inner = v[:, m - 1:n]
            centre = np.nansum(inner, axis=1, keepdims=True) / np.maximum((~np.isnan(inner)).sum(axis=1, keepdims=True), 1)
            sides.append(_parts(v, centre))
        _products(*(np.ascontiguousarray(v[:, :, m - 1:n]) for v in sides), core)
        for w in range(m):
            others = [*range(w, m - 1), *range(n, n + w)]
            _products(*(v[:, :, others] for v in sides), sums)
            sums += core
            sx, k, sxx, sxy, sy, syy = sums
            with np.errstate(all="ignore"):
                ok = k >= least
                np.divide(sx, k, out=t)
                np.multiply(t, sy, out=c)
                np.subtract(sxy, c, out=c)  # products less the means
                np.multiply(t, sx, out=t)
                np.subtract(sxx, t, out=t)  # variance of x
                sxx *= 1e-12
                ok &= t > sxx
                sy *= sy
                sy /= k
                np.subtract(syy, sy, out=sy)  # variance of y
                syy *= 1e-12
                ok &= sy > syy  # no variance, no correlation
                t *= sy
                np.sqrt(t, out=t)
                c /= t
            np.copyto(c, 0.0, where=~ok)
            yield c, ok


def _cell_sums(cell: dict, n: int, threshold: float, least: float, span: int) -> pd.DataFrame:
    """Counts and sums over the pairs of a cell, one row per window end of its chunk."""
    chunk, i, j, first, width = (int(cell[c]) for c in ("chunk", "i", "j", "first", "width"))
    ends = range(max(chunk * span, n), (chunk + 1) * span)
    if not ends:
        return pd.DataFrame([], columns=CELL_COLUMNS)
    begin = ends[0] - n + 1 - first

    def grid(data):
        return np.frombuffer(data).reshape(-1, width)[:, begin:]

    def tiles(ret, volume):
        return [(ret[k:k + TILE], volume[k:k + TILE]) for k in range(0, len(ret), TILE)]
    a = {"ret": grid(cell["ret"]), "volume": grid(cell["volume"])}
    ours = tiles(a["ret"], a["volume"])
    theirs = ours if i == j else tiles(grid(cell["ret_j"]), grid(cell["volume_j"]))
    edges, ret_n, lag_n = (np.zeros(len(ends), dtype=np.int64) for _ in range(3))
    ret_sum, lag_sum = np.zeros(len(ends)), np.zeros(len(ends))

    def pairs(x, y, size, keep=None):
        for w, (c, ok) in enumerate(sliding_corr(x, y, size, least)):
            if keep is not None:
                c *= keep
                ok &= keep
            yield w, c, ok
    for u, (ra, va) in enumerate(ours):
        for v, (rb, vb) in enumerate(theirs):
            if i == j and v < u:
                continue
            same = i == j and u == v
            once = np.triu(np.ones((len(ra), len(ra)), dtype=bool), 1) if same else None
            for w, c, _ in pairs(va, vb, n, once):
                edges[w] += np.count_nonzero(np.abs(c) > threshold)
            for w, c, ok in pairs(ra, rb, n, once):
                ret_sum[w] += c.sum()
                ret_n[w] += np.count_nonzero(ok)
            for now, before in [(ra, rb)] if same else [(ra, rb), (rb, ra)]:
                for w, c, ok in pairs(now[:, 1:], before[:, :-1], n - 1, ~np.eye(len(ra), dtype=bool) if same else None):
                    lag_sum[w] += np.abs(c).sum()
                    lag_n[w] += np.count_nonzero(ok)
    out = []
    for k, end in enumerate(ends):
        nodes, with_market = 0, np.empty(0)
        if i == j:
            nodes = int((~np.isnan(a["volume"][:, k:k + n])).any(axis=1).sum())
            c, held = complete_corr(a["ret"][:, k:k + n], grid(cell["mret"])[:, k:k + n])
            with_market = c[(held >= least) & ~np.isnan(c)]
        out.append((end, nodes, int(edges[k]), float(ret_sum[k]), int(ret_n[k]), float(lag_sum[k]), int(lag_n[k]), float((with_market ** 2).sum()), len(with_market)))
    return pd.DataFrame(out, columns=CELL_COLUMNS)


CELL_COLUMNS = ["_p", "nodes", "edges", "ret_sum", "ret_n", "lag_sum", "lag_n", "fit_sum", "fit_n"]
CELL_SCHEMA = "_p int, nodes long, edges long, ret_sum double, ret_n long, lag_sum double, lag_n long, fit_sum double, fit_n long"


#: Tasks among which the cells of a chunk are dealt; every strip is sent to all of them, so it bounds what is shuffled.
LANES = 8


def structure_series(panel: DataFrame, n=52, threshold=0.3, min_share=0.5, block=512, span=32) -> DataFrame:
    """Liquidity network density, price discovery, segmentation and propagation of the windows of ``n`` calendar dates.

    Density is the share of symbol pairs whose volumes correlate beyond the threshold, price discovery the mean
    squared correlation with the mean return, segmentation one minus the mean pair correlation of returns, and
    propagation one minus the mean absolute correlation with the return of another symbol one date before.  A pair
    counts with ``min_share`` of the dates in common; symbols without a row in the window are no nodes.

    Pairs are never rows.  Symbols are hashed into blocks of about ``block``, window ends are cut into chunks of
    ``span``, and a cell of two blocks and a chunk adds up its pairs by matrix products over at most
    2 x ``block`` x (``n`` + ``span``) values.  The rows of a block and a chunk are packed into one strip and written once;
    strips of a chunk meet by a join that deals the first of a pair to one of ``LANES`` tasks and the second to all of them,
    and the pairs are streamed into the sums.  So a strip is shuffled 1 + ``LANES`` times however many blocks there are.
    """
    p = panel.select("symbol", "date", "ret", "volume")
    days = p.groupBy("date").agg(F.avg("ret").alias("mret"))
    calendar = materialise(days.withColumn("_p", F.row_number().over(Window.orderBy("date"))), "calendar")  # one row per date
    blocks = max(1, -(-p.select("symbol").distinct().count() // block))
    last = calendar.agg(F.max("_p").alias("_last"))  # one row
    d = p.join(calendar, "date").crossJoin(F.broadcast(last)).withColumn("block", F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int"))
    ends = F.least(F.col("_p") + (n - 1), F.col("_last"))
    d = d.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("_p") / span).cast("int"), F.floor(ends / span).cast("int"))))
    strips = d.select("chunk", "block", "symbol", "_p", "ret", "volume", "mret").groupBy("chunk", "block").applyInPandas(lambda rows: _strip(rows, n, span), STRIP_SCHEMA)
    strips = materialise(strips, "strips")
    lanes = min(blocks, LANES)
    left = strips.withColumnRenamed("block", "i").withColumn("lane", F.col("i") % lanes).repartition(int(p.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chunk", "lane")
    right = strips.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.col("block").alias("j"), F.col("ret").alias("ret_j"), F.col("volume").alias("volume_j"))
    # a lane holds the cells (i, i), (i, i + 1) ... of its blocks, half of the circle: as many for each i
    ahead = F.pmod(F.col("j") - F.col("i"), F.lit(blocks))
    met = left.join(right, ["chunk", "lane"]).where((ahead * 2 < blocks) | ((ahead * 2 == blocks) & (F.col("i") < F.col("j"))))

    def sums(batches):
        for pdf in batches:
            for cell in pdf.to_dict("records"):
                yield _cell_sums(cell, n, threshold, min_share * n, span)
    cells = met.mapInPandas(sums, CELL_SCHEMA)
    g = cells.groupBy("_p").agg(*[F.sum(c).alias(c) for c in CELL_COLUMNS[1:]]).join(calendar, "_p")
    return g.select("date", "nodes", "edges", F.coalesce(div(F.col("edges") * 2, F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)).alias("liquidity_density"),
                    F.coalesce(div("fit_sum", "fit_n"), F.lit(0.0)).alias("price_discovery"), (1 - div("ret_sum", "ret_n")).alias("segmentation"),
                    (1 - F.coalesce(div("lag_sum", "lag_n"), F.lit(0.0))).alias("propagation"))


def hop_counts(edge_flags: Column, k: int) -> Column:
    """Fewest edges between the nodes of a small undirected graph: a flat k x k array, ``k`` where there is no path.

    ``edge_flags`` is the flat k x k adjacency array; the closure runs over it in the JVM, one node at a time.
    """
    cells, nodes = F.array(*[F.lit(c) for c in range(k * k)]), F.array(*[F.lit(m) for m in range(k)])

    def row(c):
        return F.floor(c / k).cast("int")
    start = F.transform(cells, lambda c: F.when(row(c) == c % k, 0).when(F.get(edge_flags, c) == 1, 1).otherwise(k))
    return F.aggregate(nodes, start, lambda d, m: F.transform(cells, lambda c: F.least(F.get(d, c), F.get(d, row(c) * k + m) + F.get(d, m * k + c % k))))


def path_length(hops: str, k: int) -> Column:
    """Mean distance inside the largest component (of equal ones that of the smallest node); infinite without an edge."""
    size = [F.size(F.filter(F.slice(hops, r * k + 1, k), lambda x: x < k)) for r in range(k)]
    largest = F.greatest(*size)
    root = F.coalesce(*[F.when(size[r] == largest, r) for r in range(k)])
    reach = F.slice(F.col(hops), root * k + 1, k)
    total = sum((F.when(F.get(reach, F.lit(r)) < k, F.aggregate(F.filter(F.slice(hops, r * k + 1, k), lambda x: x < k), F.lit(0), lambda a, x: a + x)).otherwise(0) for r in range(1, k)),
                F.when(F.get(reach, F.lit(0)) < k, F.aggregate(F.filter(F.slice(hops, 1, k), lambda x: x < k), F.lit(0), lambda a, x: a + x)).otherwise(0))
    return F.when(largest > 1, total / (largest * (largest - 1))).otherwise(float("inf"))


def graph_measures(cols, edge) -> dict[str, Column]:
    """Density, clustering, centrality and path length of the graph on ``cols``; ``edge(a, b)`` is its 0/1 flag."""
    pairs, k = list(combinations(cols, 2)), len(cols)
    total = sum((edge(a, b) for a, b in pairs[1:]), edge(*pairs[0]))
    local = F.lit(0.0)
    for x in cols:
        rest = [c for c in cols if c != x]
        deg = sum((edge(x, c) for c in rest[1:]), edge(x, rest[0]))
        tri = F.lit(0)
        for b, c in combinations(rest, 2):
            tri = tri + edge(x, b) * edge(x, c) * edge(b, c)
        local = local + F.when(deg > 1, div(tri, deg * (deg - 1) / 2)).otherwise(0.0)
    linked = sum((flag(sum((edge(x, c) for c in cols if c != x), F.lit(0)) > 0) for x in cols), F.lit(0))
    return {"density": total / len(pairs), "clustering": local / k, "centrality": F.coalesce(div(total * 2, linked * (linked - 1)), F.lit(0.0)), "path_length": path_length("_hops", k)}


#: Up to this many edges the graphs of a set of nodes are tabulated.
TABULATED = 12


def _window_correlations(*values: np.ndarray) -> list[np.ndarray]:
    """Correlation of every pair of variables in (windows x n) arrays, NaN where one is constant or has a hole."""
    # less the first value, so that a constant window is exactly zero
    z = [v - v[:, :1] for v in values]
    z = [v - v.mean(axis=1, keepdims=True) for v in z]
    size = [np.sqrt(np.einsum("ij,ij->i", v, v)) for v in z]
    return [np.einsum("ij,ij->i", z[a], z[b]) / (size[a] * size[b]) for a, b in combinations(range(len(z)), 2)]


def feature_network(df: DataFrame, cols, n=50, threshold=0.5, s: Series = S) -> DataFrame:
    """Density, mean absolute correlation, clustering, centrality and path length of the feature graph of each window.

    Centrality is the mean degree centrality of the features that have an edge, path length the mean distance
    inside the largest component.  The measures depend on the edges alone: those of all graphs of the features
    are tabulated once and looked up by the mask of the edges.
    """
    pairs = list(combinations(cols, 2))
    m, k = len(pairs), len(cols)
    at = {frozenset(p): i for i, p in enumerate(pairs)}

    def edge(a, b):
        return F.col(f"_e{at[frozenset((a, b))]}")

    def measured(rows):
        hops = hop_counts(F.array(*[F.lit(0) if a == b else edge(a, b) for a in cols for b in cols]), k)
        return rows.withColumn("_hops", hops).withColumns(graph_measures(cols, edge))
    d = rolling_frame(spread(df, s), list(cols), n, _window_correlations, [f"_c{i}" for i in range(m)], s)
    ok, edges = F.col("_c0").isNotNull(), {f"_e{i}": flag(F.abs(f"_c{i}") > threshold) for i in range(m)}
    names = ["density", "clustering", "centrality", "path_length"]
    if m <= TABULATED:
        bits = {f"_e{i}": F.shiftright("_mask", i).bitwiseAND(1).cast("int") for i in range(m)}
        graphs = measured(df.sparkSession.range(0, 1 << m, 1, 1).withColumnRenamed("id", "_mask").withColumns(bits)).select("_mask", *names)
        mask = sum((e.cast("long") * (1 << i) for i, e in enumerate(edges.values())), F.lit(0).cast("long"))
        d = d.withColumn("_mask", F.when(ok, mask)).join(F.broadcast(graphs), "_mask", "left").drop("_mask")  # 2^m rows
    else:
        d = measured(d.withColumns(edges)).withColumns({c: F.when(ok, F.col(c)) for c in names}).drop("_hops", *edges)
    mean = sum((F.abs(f"_c{i}") for i in range(1, m)), F.abs("_c0")) / m
    return d.withColumn("mean_abs_corr", mean).drop(*[f"_c{i}" for i in range(m)])
