"""Numeric kernels against closed forms."""

import numpy as np
import pytest

from sigweave.functions import kernels as K

RATE = 1000.0
T = np.arange(4000) / RATE


def gain(y, x):
    m = slice(1000, 3000)
    return np.sqrt(np.mean(y[m] ** 2) / np.mean(x[m] ** 2))


@pytest.mark.parametrize("kw,freq,want", [({"high": 100.0}, 100.0, 0.5), ({"high": 100.0}, 10.0, 1.0), ({"low": 100.0}, 100.0, 0.5), ({"low": 50.0, "high": 200.0}, 100.0, 1.0), ({"low": 50.0, "high": 200.0}, 50.0, 0.5), ({"low": 200.0, "high": 50.0}, 100.0, 0.0)])
def test_butterworth_gain_both_ways(kw, freq, want):
    x = np.sin(2 * np.pi * freq * T)
    assert gain(K.butter(x, RATE, **kw), x) == pytest.approx(want, abs=0.02)


def test_butterworth_causal_gain_is_minus_3_db():
    x = np.sin(2 * np.pi * 100 * T)
    assert gain(K.butter(x, RATE, high=100.0, causal=True), x) == pytest.approx(np.sqrt(0.5), abs=0.01)


def test_filtfilt_keeps_a_constant():
    assert np.allclose(K.butter(np.full(50, 3.0), RATE, high=100.0), 3.0)


def test_lfilter_forms():
    x = np.zeros(20)
    x[0] = 1
    assert np.allclose(K.lfilter([1, 2, 3], 1, x)[:4], [1, 2, 3, 0])
    assert np.allclose(K.lfilter([1.0], [1.0, -0.5], x), 0.5 ** np.arange(20))
    assert np.allclose(K.lfilter([1.0, 0, 0], [1.0, -0.5, 0], x), 0.5 ** np.arange(20))


def test_decimate_keeps_slow_removes_fast():
    slow, fast = np.sin(2 * np.pi * 5 * T), np.sin(2 * np.pi * 300 * T)
    y = K.decimate(slow + fast, 10)
    assert len(y) == 400 and np.allclose(y[50:350], slow[::10][50:350], atol=0.02)


def test_savgol_reproduces_a_cubic_to_the_borders():
    t = np.linspace(-1, 1, 40)
    x = 1 + 2 * t - t**2 + 3 * t**3
    assert np.allclose(K.savgol(x, 7, 3), x)
    assert np.allclose(K.savgol_coefficients(7, 3) * 21, [-2, 3, 6, 7, 6, 3, -2])
    assert len(K.savgol(np.ones(3), 7, 3)) == 3


def test_hilbert_of_a_sine_is_one():
    assert np.allclose(K.hilbert_magnitude(np.sin(2 * np.pi * 50 * T))[100:-100], 1, atol=1e-6)


def test_integrator_impulse():
    x = np.zeros(10)
    x[0] = 1
    assert np.allclose(K.integrator(x, 5.0), [0, *(0.2 * 0.8 ** np.arange(9))])


def test_teager_of_a_sine_is_constant():
    w = 2 * np.pi * 50 / RATE
    assert np.allclose(K.teager(np.sin(w * np.arange(100))), np.sin(w) ** 2)


def test_bins_are_nearly_equal():
    x = np.arange(100.0)
    assert K.bin_map(x, 35, len).tolist() == [50, 50] and len(K.bin_map(x[:10], 35, max)) == 0


@pytest.mark.parametrize("method", ["binmax", "binmin", "binabs", "binmap", "robust", "teager", "robust_teager", "log_robust_teager", "jarne", "mindlin", "absint"])
def test_every_envelope_of_short_and_long(method):
    a = {"cut_freq": 10.0} if method == "jarne" else {}
    y, r = K.envelope(np.sin(2 * np.pi * 50 * T), RATE, method, **a)
    assert len(y) and r > 0 and np.all(np.isfinite(y))
    K.envelope(np.array([1.0, 2.0, 1.0]), RATE, method, **a)


def test_envelopes_refuse_a_cut_they_cannot_make_and_keep_signs():
    with pytest.raises(ValueError):
        K.envelope(np.ones(5000), RATE, "jarne", cut_freq=100.0)
    x = np.tile([1.0, 2.0, 4.0, 8.0, 4.0, 2.0], 300)
    y, _ = K.envelope(x, RATE, "robust_teager", percentile=10)
    assert (y < 0).all() and np.isnan(K.envelope(x, RATE, "log_robust_teager", percentile=10)[0]).all()


@pytest.mark.parametrize("method", ["scipy", "scipy_praat", "mlab", "mlab_praat"])
def test_spectrogram_peaks_at_the_tone(method):
    x = np.sin(2 * np.pi * 1000 * np.arange(20_000) / 44150)
    f, t, p = K.log_spectrogram(x, 44150.0, method)
    assert abs(f[np.argmax(p.mean(axis=1))] - 1000) <= f[1] and p.shape == (len(f), len(t))


def test_spectrum_scaling_gives_the_power_of_a_sine():
    x = 2 * np.sin(2 * np.pi * 125 * T)
    _, _, p = K.spectrogram(x, RATE, 512, 448)
    assert p.max() == pytest.approx(2.0, rel=0.02)
    _, w = K.welch(x, RATE, 512)
    assert w.sum() * RATE / 512 == pytest.approx(2.0, rel=0.05)


def test_suppression():
    got = K.suppress(np.array([0, 0.5, 3, 3.2, 10]), np.array([0.9, 0.8, 0.75, 0.95, 0.6]), 1.0)
    assert [(s, round(c, 2)) for s, _, c in got] == [(0, 0.9), (3.2, 0.95)]
    assert K.suppress(np.array([]), np.array([]), 1.0) == []
    assert len(K.suppress(np.arange(300.0) * 5, np.full(300, 0.9), 1.0)) == 300


def test_warp_finds_a_delay():
    t = np.arange(400) / RATE
    x = np.exp(-((t - 0.20) ** 2) / 0.0005)
    to = np.exp(-((t - 0.21) ** 2) / 0.0005)
    knots, d, r = K.smooth_time_warp(x, to, RATE)
    assert r > 0.99 and abs(K.cubic(knots, d, np.array([0.205]))[0] + 0.01) < 0.003
    assert np.allclose(knots - knots.mean(), np.linspace(-0.25, 0.25, 6)) and knots.mean() == pytest.approx(0.2)
    with pytest.raises(ValueError):
        K.smooth_time_warp(x[:90], to, RATE)


def test_delays_in_every_form():
    knots = np.array([0.0, 0.1, 0.2])
    assert np.allclose(K.delays_at("[0.1 0.2\n 0.3]", knots), [0.1, 0.2, 0.3])
    assert np.allclose(K.delays_at(lambda t: 2 * t, knots), [0, 0.2, 0.4])
    assert np.allclose(K.delays_at("[[0 0.1 0.3 0.5] [1 1 1 1]]", knots), 1)
    for bad in ([1.0], "[1 2] [3]"):
        with pytest.raises(ValueError):
            K.delays_at(bad, knots)
    x = np.sin(np.arange(200) / 9)
    assert np.allclose(K.warp(x, RATE, K.warp_knots(200, RATE), np.zeros(4)), x) and np.isnan(K.warp(x, RATE, K.warp_knots(200, RATE), np.full(4, 0.05))[-1])


def test_spline_ends_like_a_cubic():
    t = np.array([0.0, 0.7, 1.5, 2.0, 3.1])
    cubic = lambda v: 1 - v + 2 * v**2 - 0.5 * v**3
    at = np.linspace(0, 3.1, 50)
    assert np.allclose(K.cubic(t, cubic(t), at), cubic(at))
    assert np.allclose(K.cubic(t[:3], t[:3] ** 2, at[:20]), at[:20] ** 2) and np.allclose(K.cubic(t[:2], t[:2], at[:5]), at[:5])


def test_cubic_goes_through_its_knots():
    k, y = np.array([0.0, 1, 2, 3.5]), np.array([1.0, -1, 0, 2])
    assert np.allclose(K.cubic(k, y, k), y)


def test_factorisation_of_a_known_product():
    rng = np.random.default_rng(1)
    a, x = rng.random((6, 2)), rng.random((2, 60))
    lag = np.array([[0, 1], [0, 0], [1, 0], [0, 0], [0, -1], [0, 0]])
    y = np.array([sum(a[i, k] * K.roll0(x[k], lag[i, k]) for k in range(2)) for i in range(6)])
    *_, model, d = K.nmf_lag(y, 2, lag=lag, seed=2, tol=1e-6, steps=3000)
    assert d < 0.01 * np.sum(y**2) and np.allclose(d, 0.5 * np.sum((np.where(y <= 0, K.EPS, y) - model) ** 2))
    assert K.nmf_lag(y, 2, lag=lag, seed=2, tol=1e-6, steps=3000)[4] == d
    # given factors are kept, their lags found
    got = K.nmf_lag(y, a=a, x=x, lags=(-1, 1), steps=50)
    assert np.array_equal(got[0], a) and np.array_equal(got[1], x) and np.mean(got[2] == lag) >= 0.9
    smooth = K.nmf_lag(y, a=a, x=x, lags=(-1, 1), steps=50, alpha_lag=1e6)[2]
    assert np.abs(np.diff(smooth, axis=1)).sum() <= np.abs(np.diff(got[2], axis=1)).sum()
    small = K.nmf_lag(y, 2, lag=lag, seed=2, a_range=(0.5, 0.9), steps=30)[0]
    assert small.max() <= 0.9 and not np.any((small > 0) & (small < 0.5))
    with pytest.raises(ValueError):
        K.nmf_lag(y)


def test_synthesis_is_bounded_seeded_and_shared():
    look = ([400.0, 900.0, 2000.0], [-0.4, -0.1, 0.05])
    beta = np.array([K.beta_of(np.full(200, 900.0), look), K.beta_of(np.full(200, 500.0), look)])
    env = np.ones((2, 200))
    both = K.finch(env, beta, 44150.0, seeds=[3, 4])
    assert np.all(np.isfinite(both["syn"])) and np.abs(both["syn"]).max() == 1
    alone = K.finch(env[1], beta[1], 44150.0, seeds=[4])
    assert np.allclose(alone["syn"][0], both["syn"][1]) and np.allclose(alone["labium_0"][0], both["labium_0"][1])
    two = K.finch(env, beta, 44150.0, np.full_like(beta, 0.9), seeds=[3, 4])
    assert {"labium_0", "labium_1"} <= set(two) and not np.allclose(two["syn"], both["syn"])
    assert np.allclose(K.beta_of(np.zeros(3), look), 0.15)


def test_runge_kutta_is_of_fourth_order():
    grow = lambda s, k: k * s
    err = []
    for n in (10, 20):
        y = np.ones(1)
        for _ in range(n):
            y = K.rk4(grow, y, 1 / n, 1.0)
        err.append(abs(y[0] - np.e))
    assert 14 < err[0] / err[1] < 18


def test_tract_filter_taps_follow_the_magnitude():
    f = np.linspace(0, 22075, 1001)
    g = K.tract_magnitude(f) * K.TRACT['rb']
    taps = K.fir_from_magnitude(f, g, 44150.0, 301)
    h = np.abs(np.fft.rfft(taps, 2000))
    assert abs(h[200] - np.interp(200 * 44150 / 2000, f, g)) < 0.1
