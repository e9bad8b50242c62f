"""Array kernels for rolling windows: each takes (windows x values) arrays and returns a number per window, or a tuple of them.

A single window, given as a plain array, gives plain numbers.
"""
from __future__ import annotations

import functools
import math

import numpy as np

NAN = float("nan")


def windows(kernel):
    """Let a kernel of (windows x values) arrays take a single window too."""
    @functools.wraps(kernel)
    def run(*arrays, **options):
        one = np.ndim(arrays[0]) == 1
        with np.errstate(all="ignore"):
            out = kernel(*[np.atleast_2d(np.asarray(a, float)) for a in arrays], **options)
        if not one:
            return out
        return tuple(float(o[0]) for o in out) if isinstance(out, tuple) else float(out[0])
    return run


def log_returns(x):
    return np.diff(np.log(x + 1e-10), axis=1)


def line(x, y, ok=None):
    """Least-squares slope of y on x along the last axis, over the points marked ``ok``."""
    ok = np.ones(np.shape(y), bool) if ok is None else ok
    n = ok.sum(axis=1, keepdims=True)
    xc = np.where(ok, x - np.where(ok, x, 0.0).sum(axis=1, keepdims=True) / n, 0.0)
    yc = np.where(ok, y - np.where(ok, y, 0.0).sum(axis=1, keepdims=True) / n, 0.0)
    d = (xc * xc).sum(axis=1)
    return np.where(d > 0, (xc * yc).sum(axis=1) / d, NAN)


@windows
def box_dimension(x):
    """Slope of occupied value boxes over ten log-spaced scales."""
    lo = x.min(axis=1, keepdims=True)
    v = np.sort((x - lo) / (x.max(axis=1, keepdims=True) - lo + 1e-10), axis=1)
    inv, cnt = [], []
    for scale in np.logspace(-2, 0, 10):
        n = int(1 / scale)
        if n >= 2:
            box = np.minimum((v * n).astype(int), n - 1)
            inv.append(math.log(1 / scale))
            cnt.append(np.log(1 + (box[:, 1:] != box[:, :-1]).sum(axis=1)))
    return line(np.array(inv), np.stack(cnt, axis=1))


@windows
def hurst_rs(x):
    """Slope of log mean rescaled range over log segment length."""
    r, n = log_returns(x), x.shape[1]
    lags, vals = [], []
    for lag in range(2, min(n // 4, 20)):
        k = r.shape[1] // lag
        if k < 2:
            continue
        seg = r[:, :k * lag].reshape(-1, k, lag)
        dev = np.cumsum(seg - seg.mean(axis=2, keepdims=True), axis=2)
        sd = seg.std(axis=2)
        ok = sd > 0
        lags.append(math.log(lag))
        vals.append(np.log(np.where(ok, (dev.max(axis=2) - dev.min(axis=2)) / sd, 0.0).sum(axis=1) / ok.sum(axis=1)))
    if len(lags) < 3:
        return np.full(len(x), NAN)
    v = np.stack(vals, axis=1)
    ok = ~np.isnan(v)
    return np.where(ok.sum(axis=1) >= 3, line(np.array(lags), v, ok), NAN)


def histogram(x, bins):
    """Bin of every value and the edges of ``bins`` equal bins over the range of each row, as numpy cuts them."""
    lo, hi = x.min(axis=1, keepdims=True), x.max(axis=1, keepdims=True)
    flat = lo == hi
    lo, hi = np.where(flat, lo - 0.5, lo), np.where(flat, hi + 0.5, hi)
    edges = np.arange(bins + 1) * ((hi - lo) / bins) + lo
    edges[:, -1:] = hi
    k = np.clip(((x - lo) / (hi - lo) * bins).astype(int), 0, bins - 1)
    k -= x < np.take_along_axis(edges, k, axis=1)
    k += (x >= np.take_along_axis(edges, k + 1, axis=1)) & (k < bins - 1)
    return k, edges


def counts(cell, cells):
    """How often each of ``cells`` numbers stands in each row."""
    at = cell + np.arange(len(cell))[:, None] * cells
    return np.bincount(at.ravel(), minlength=len(cell) * cells).reshape(len(cell), cells)


@windows
def shannon(x, bins=10):
    r = log_returns(x)
    p = counts(histogram(r, bins)[0], bins) / r.shape[1]
    return -(p * np.log(p + 1e-10)).sum(axis=1)


def erf(z):
    return np.fromiter(map(math.erf, z.ravel().tolist()), float, z.size).reshape(z.shape)


def normal_cdf(x, mean, sd):
    return 0.5 * (1 + erf((x - mean) / (sd * math.sqrt(2))))


@windows
def distribution_tests(r):
    """Kolmogorov-Smirnov distances to fitted normal and Laplace laws, Jarque-Bera and Anderson-Darling."""
    x, n = np.sort(r, axis=1), r.shape[1]
    mean, sd = x.mean(axis=1, keepdims=True), x.std(axis=1, keepdims=True)
    up, lo = np.arange(1, n + 1) / n, np.arange(n) / n

    def ks(cdf):
        return np.maximum((up - cdf).max(axis=1), (cdf - lo).max(axis=1))
    cn = normal_cdf(x, mean, sd)
    med = np.median(x, axis=1, keepdims=True)
    z = (x - med) / np.abs(x - med).mean(axis=1, keepdims=True)
    half = 0.5 * np.exp(-np.abs(z))
    cl = np.where(z < 0, half, 1 - half)
    s = (x - mean) / sd
    jb = n / 6 * ((s ** 3).mean(axis=1) ** 2 + ((s ** 4).mean(axis=1) - 3) ** 2 / 4)
    ca = np.clip(normal_cdf(x, mean, x.std(axis=1, ddof=1, keepdims=True)), 1e-12, 1 - 1e-12)
    i = np.arange(1, n + 1)
    ad = -n - ((2 * i - 1) * (np.log(ca) + np.log(1 - ca[:, ::-1]))).mean(axis=1)
    return tuple(np.where(sd[:, 0] == 0, NAN, v) for v in (ks(cn), ks(cl), jb, ad))


@windows
def extreme_value(r, pct=90):
    """Hill estimator of the upper half of the exceedances, their share, and max over mean."""
    a = -np.sort(-np.abs(r), axis=1)
    n = (a > np.percentile(a, pct, axis=1, keepdims=True)).sum(axis=1)
    k = np.maximum(n // 2, 1)
    row = np.arange(len(a))
    logs = np.log(a)
    hill = np.cumsum(logs, axis=1)[row, k - 1] / k - logs[row, np.minimum(k, a.shape[1] - 1)]
    return tuple(np.where(n < 5, NAN, v) for v in (hill, n / a.shape[1], a[:, 0] / (a.mean(axis=1) + 1e-10)))


@windows
def kalman_level(r, q=0.01, rr=0.1):
    """Smoothness of the filtered level and variance of the innovations (state 0, covariance 1 at start)."""
    state, p = np.zeros(len(r)), 1.0
    states, inn = np.empty_like(r), np.empty_like(r)
    for t in range(r.shape[1]):
        pred = p + q
        gain = pred / (pred + rr)
        inn[:, t] = r[:, t] - state
        state = state + gain * inn[:, t]
        p = (1 - gain) * pred
        states[:, t] = state
    return np.diff(states, axis=1).std(axis=1), inn.var(axis=1)


@windows
def changepoint(r, edge=5):
    """Gain of the best split over the mean split, and the BIC improvement, from prefix sums."""
    n = r.shape[1]
    c1, c2 = np.cumsum(r, axis=1), np.cumsum(r * r, axis=1)
    k = np.arange(edge, n - edge)

    def ll(s, ss, m):
        v = np.maximum((ss - s * s / m) / (m - 1), 1e-300)
        return -0.5 * m * np.log(2 * np.pi * v) - 0.5 * (m - 1)
    a = ll(c1[:, k - 1], c2[:, k - 1], k) + ll(c1[:, -1:] - c1[:, k - 1], c2[:, -1:] - c2[:, k - 1], n - k)
    single = ll(c1[:, -1], c2[:, -1], n)
    best = a.max(axis=1)
    return best - a.mean(axis=1), (-2 * single + 2 * math.log(n)) - (-2 * best + 4 * math.log(n))


@windows
def info_theory(r, bins=10):
    """Histogram entropy, divergence from the fitted normal, lag-1 mutual information."""
    k, edges = histogram(r, bins)
    p = counts(k, bins) / r.shape[1]
    ent = -(p * np.log(p + 1e-10)).sum(axis=1)
    sd = r.std(axis=1, ddof=1, keepdims=True)
    t = np.diff(normal_cdf(edges, r.mean(axis=1, keepdims=True), sd), axis=1)
    t = t / t.sum(axis=1, keepdims=True)
    kl = (p * np.log((p + 1e-10) / (t + 1e-10))).sum(axis=1)
    cell = histogram(r[:, :-1], bins)[0] * bins + histogram(r[:, 1:], bins)[0]
    j = (counts(cell, bins * bins) / cell.shape[1]).reshape(-1, bins, bins)
    ratio = j / (j.sum(axis=2, keepdims=True) * j.sum(axis=1, keepdims=True))
    mutual = (j * np.log(np.where(j > 0, ratio, 1.0))).sum(axis=(1, 2))
    return ent, np.where(sd[:, 0] == 0, NAN, kl), np.where(sd[:, 0] == 0, NAN, mutual)


@windows
def cointegration(p1, p2):
    """Coefficient of the lagged residual in the residual's change, and the half-life."""
    b = line(p1, p2)
    res = p2 - p2.mean(axis=1, keepdims=True) - b[:, None] * (p1 - p1.mean(axis=1, keepdims=True))
    g = line(res[:, :-1], np.diff(res, axis=1))
    return g, np.where(g < 0, -math.log(2) / g, NAN)


@windows
def granger(x, y, lag=5):
    """F statistic of x helping to predict y.

    The regressors are made orthogonal one after the other, twice against rounding, and taken out of y; one that
    depends on those before it adds nothing.
    """
    n = y.shape[1] - lag
    rest = y[:, lag:].copy()
    basis = np.empty((len(y), 2 * lag + 1, n))
    squares = []
    cols = [np.ones_like(rest), *[v[:, lag - j - 1:v.shape[1] - j - 1] for v in (y, x) for j in range(lag)]]
    for k, col in enumerate(cols):
        c = col
        for _ in range(2):
            c = c - np.einsum("mk,mkn->mn", np.einsum("mkn,mn->mk", basis[:, :k], c), basis[:, :k])
        size = np.sqrt((c * c).sum(axis=1, keepdims=True))
        c = np.where(size > 1e-12 * np.sqrt((col * col).sum(axis=1, keepdims=True)), c / size, 0.0)
        basis[:, k] = c
        rest = rest - (c * rest).sum(axis=1, keepdims=True) * c
        squares.append((rest * rest).sum(axis=1))
    r0, r1 = squares[lag], squares[-1]
    df = n - 2 * lag - 1
    return np.where(r1 > 0, ((r0 - r1) / lag) / (r1 / df), NAN) if df > 0 else np.full(len(y), NAN)


def parabolic_sar(high, low, start=0.02, step=0.02, top=0.2):
    """Stop-and-reverse level and side (1 below the price, -1 above)."""
    n = len(high)
    sar, side = np.zeros(n), np.zeros(n)
    up, level, best, acc = True, low[0], high[0], start
    sar[0], side[0] = level, 1
    for i in range(1, n):
        level += acc * (best - level)
        turned = low[i] <= level if up else high[i] >= level
        if turned:
            up, level, acc = not up, best, start
            best = high[i] if up else low[i]
        else:
            far = high[i] > best if up else low[i] < best
            if far:
                best, acc = (high[i] if up else low[i]), min(acc + step, top)
        sar[i], side[i] = level, 1 if up else -1
    return sar, side


