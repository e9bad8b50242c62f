"""Kernels against plain loops and known shapes."""
import math

import numpy as np

from quantloom.functions import numeric as N

rng = np.random.default_rng(1)
X = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 50)))


def test_entropy_of_a_flat_histogram():
    logs = np.cumsum(np.r_[0, np.arange(40) % 10 + 0.5])
    assert abs(N.shannon(np.exp(logs / 50)) - math.log(10)) < 1e-6


def test_kalman_and_changepoint():
    st, p, out = 0.0, 1.0, []
    r = rng.normal(0, 1, 50)
    for v in r:
        p += 0.01
        k = p / (p + 0.1)
        st, p = st + k * (v - st), (1 - k) * p
        out.append(st)
    assert abs(N.kalman_level(r)[0] - np.std(np.diff(out))) < 1e-12
    step = np.r_[rng.normal(0, 0.1, 25), rng.normal(3, 0.1, 25)]
    assert N.changepoint(step)[1] > 50 > N.changepoint(rng.normal(0, 1, 50))[1]


def test_pairs_and_tails():
    x = rng.normal(0, 1, 60)
    y = np.r_[0.0, x[:-1]] + rng.normal(0, 0.1, 60)
    assert N.granger(x, y) > 20 > N.granger(y, x)
    walk = np.cumsum(rng.normal(0, 1, 100))
    g, half = N.cointegration(walk, 2 * walk + rng.normal(0, 0.5, 100))
    assert g < -0.5 and 0 < half < 2
    hill, freq, ratio = N.extreme_value(np.r_[rng.normal(0, 1, 60)])
    assert hill > 0 and 0.05 < freq < 0.15 and ratio > 1
    ks, kl, jb, ad = N.distribution_tests(rng.normal(0, 1, 500))
    assert ks < kl and jb < 15 and ad < 2


def test_hurst_and_box_count_ranges():
    trend = np.exp(np.cumsum(np.abs(rng.normal(0.01, 0.001, 60))))
    assert 0 < N.hurst_rs(X) < 1.2 and 0 < N.box_dimension(trend) <= 1.01


def test_sar_by_hand():
    high, low = np.array([10, 11, 12, 9.0, 8.0]), np.array([9, 10, 11, 7.0, 6.0])
    sar, side = N.parabolic_sar(high, low)
    # level: 9; 9 + .02 (10 - 9) = 9.02; 9.02 + .04 (11 - 9.02) = 9.0992; then 7 <= level: flip to the best high
    np.testing.assert_allclose(sar[:4], [9, 9.02, 9.0992, 12])
    assert list(side) == [1, 1, 1, -1, -1]
    np.testing.assert_allclose(sar[4], 12 + 0.02 * (7 - 12))


def test_stacked_windows_equal_single_ones():
    """A flat, a half flat and a coarse window among random ones; granger also against least squares."""
    r = rng.standard_t(3, (40, 50))
    r[0], r[1, :25], r[2] = 0.0, 0.0, np.round(r[2])
    px, other = np.exp(r), rng.normal(0, 1, r.shape)
    for kernel, *args in ((N.box_dimension, px), (N.hurst_rs, px), (N.shannon, px), (N.distribution_tests, r), (N.extreme_value, r), (N.kalman_level, r),
                          (N.changepoint, r), (N.info_theory, r), (N.cointegration, other, r), (N.granger, other, r)):
        stacked = np.atleast_2d(np.array(kernel(*args)))
        single = np.array([np.atleast_1d(kernel(*[a[i] for a in args])) for i in range(len(r))]).T
        np.testing.assert_allclose(stacked, single, rtol=1e-9, atol=1e-9)
    entropy = N.info_theory(r)[0]
    for i in range(len(r)):
        p = np.histogram(r[i], bins=10)[0] / 50
        assert abs(entropy[i] + (p * np.log(p + 1e-10)).sum()) < 1e-12

    def rss(cols, y):
        m = np.column_stack(cols)
        return ((y[5:] - m @ np.linalg.lstsq(m, y[5:], rcond=None)[0]) ** 2).sum()
    for i in range(2, 6):
        own = [np.ones(45), *[r[i, 4 - j:49 - j] for j in range(5)]]
        r0, r1 = rss(own, r[i]), rss([*own, *[other[i, 4 - j:49 - j] for j in range(5)]], r[i])
        assert abs(N.granger(other[i], r[i]) - (r0 - r1) / 5 / (r1 / 34)) < 1e-8
