"""Dense numeric kernels on numpy arrays: filters, envelopes, spectra, warping, factorisation, synthesis. No Spark in here."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPS = float(np.finfo(float).eps)


# ---- linear filters ---------------------------------------------------------------------------------------------


def butter_sections(order: int, low: float | None, high: float | None, rate: float) -> tuple[np.ndarray, np.ndarray, float, str]:
    """Zeros, poles, gain and kind of a digital Butterworth filter (bilinear, prewarped).

    low alone: high-pass; high alone: low-pass; low < high: band-pass; low > high: band-stop.
    """
    k = np.arange(order)
    p = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
    warp = lambda f: 2 * rate * np.tan(np.pi * f / rate)
    z = np.array([], complex)
    gain = 1.0
    if low is not None and high is not None:
        kind = "bandpass" if low < high else "bandstop"
        a, b = warp(min(low, high)), warp(max(low, high))
        w0, bw = np.sqrt(a * b), b - a
        if kind == "bandpass":
            s = p * bw / 2
            p = np.concatenate([s + np.sqrt(s**2 - w0**2), s - np.sqrt(s**2 - w0**2)])
            z, gain = np.zeros(order, complex), bw**order
        else:
            s = (bw / 2) / p
            gain = np.real(1 / np.prod(-p))
            p = np.concatenate([s + np.sqrt(s**2 - w0**2), s - np.sqrt(s**2 - w0**2)])
            z = np.concatenate([np.full(order, 1j * w0), np.full(order, -1j * w0)])
    elif high is not None:
        kind, w = "lowpass", warp(high)
        p, gain = p * w, w**order
    elif low is not None:
        kind, w = "highpass", warp(low)
        gain = np.real(1 / np.prod(-p))
        p, z = w / p, np.zeros(order, complex)
    else:
        raise ValueError("low or high")
    f2 = 2 * rate
    degree = len(p) - len(z)
    gain = gain * np.real(np.prod(f2 - z) / np.prod(f2 - p))
    zd = np.concatenate([(f2 + z) / (f2 - z), -np.ones(degree)])
    return zd, (f2 + p) / (f2 - p), float(gain), kind


def chebyshev_lowpass(order: int, ripple_db: float, cut: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Digital Chebyshev type I low-pass; cut as a share of half the rate."""
    eps = np.sqrt(10 ** (ripple_db / 10) - 1)
    mu = np.arcsinh(1 / eps) / order
    theta = np.pi * np.arange(-order + 1, order, 2) / (2 * order)
    p = -np.sinh(mu + 1j * theta)
    gain = np.real(np.prod(-p))
    if order % 2 == 0:
        gain /= np.sqrt(1 + eps**2)
    w = 4 * np.tan(np.pi * cut / 2)
    p, gain = p * w, gain * w**order
    gain = gain * np.real(1 / np.prod(4 - p))
    return -np.ones(order, complex), (4 + p) / (4 - p), float(gain)


def sections(z: np.ndarray, p: np.ndarray, gain: float) -> np.ndarray:
    """Second-order sections (b0 b1 b2 1 a1 a2) by pairing conjugates; real roots pair among themselves."""

    def pairs(r: np.ndarray) -> list[tuple[complex, complex]]:
        r = np.asarray(r, complex)
        cplx = sorted(r[np.abs(r.imag) > 1e-9 * np.maximum(1, np.abs(r))], key=lambda x: (abs(x), x.real, abs(x.imag), x.imag))
        up = [x for x in cplx if x.imag > 0]
        real = sorted(x.real for x in r[np.abs(r.imag) <= 1e-9 * np.maximum(1, np.abs(r))])
        out = [(x, x.conjugate()) for x in up]
        while len(real) > 1:
            out.append((real.pop(), real.pop(0)))
        if real:
            out.append((real.pop(), 0.0))
        return out

    pp, zz = pairs(p), pairs(z)
    pp.sort(key=lambda t: -max(abs(t[0]), abs(t[1])))
    while len(zz) < len(pp):
        zz.append((0.0, 0.0))
    out = []
    for (p1, p2), (z1, z2) in zip(pp, zz, strict=True):
        out.append([1.0, -np.real(z1 + z2), np.real(z1 * z2), 1.0, -np.real(p1 + p2), np.real(p1 * p2)])
    sos = np.array(out)
    sos[0, :3] *= gain
    return sos


def memory(poles: np.ndarray, least: float = 1e-18) -> int | None:
    """Samples after which what a filter with these poles holds has shrunk to least; None if it never forgets."""
    r = float(np.max(np.abs(poles), initial=0.0))
    if r >= 1 - 1e-12:
        return None
    return 8 + int(np.ceil(1.25 * np.log(least) / np.log(r))) if r > 0 else 8


def butter_memory(rate: float, low: float | None = None, high: float | None = None, order: int = 4) -> int:
    """As memory, of the Butterworth filter."""
    n = memory(butter_sections(order, low, high, rate)[1])
    if n is None:
        raise ValueError("a cut too low for the rate")
    return n


def lfilter_state(b, a, x: np.ndarray, state: list[float]) -> tuple[np.ndarray, list[float]]:
    """Filtered x and the final state, from a state of max(len(a), len(b)) - 1 numbers: signals in pieces."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    b, a = b / a[0], a / a[0]
    n = max(len(a), len(b))
    bl, al = np.pad(b, (0, n - len(b))).tolist(), np.pad(a, (0, n - len(a))).tolist()
    z, out = [*state, 0.0], []
    for v in x.tolist():
        y = bl[0] * v + z[0]
        for k in range(n - 1):
            z[k] = bl[k + 1] * v - al[k + 1] * y + z[k + 1]
        out.append(y)
    return np.array(out), z[:-1]


def lfilter(b, a, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    """Direct-form II transposed; FIR filters by convolution."""
    b, a = np.atleast_1d(np.asarray(b, float)), np.atleast_1d(np.asarray(a, float))
    b, a = b / a[0], a / a[0]
    if len(a) == 1 and state is None:
        return np.convolve(x, b)[: len(x)]
    n = max(len(a), len(b))
    b, a = np.pad(b, (0, n - len(b))), np.pad(a, (0, n - len(a)))
    z = [0.0] * n if state is None else [*map(float, state), 0.0]
    bl, al, out = b.tolist(), a.tolist(), []
    if n == 3:
        b0, b1, b2 = bl
        _, a1, a2 = al
        z0, z1 = z[0], z[1]
        for v in x.tolist():
            y = b0 * v + z0
            z0 = b1 * v - a1 * y + z1
            z1 = b2 * v - a2 * y
            out.append(y)
        return np.array(out)
    for v in x.tolist():
        y = bl[0] * v + z[0]
        for k in range(n - 1):
            z[k] = bl[k + 1] * v - al[k + 1] * y + z[k + 1]
        out.append(y)
    return np.array(out)


def sos_filter(sos: np.ndarray, x: np.ndarray, steady: bool = False) -> np.ndarray:
    """Sections in series; steady starts each in the state of a constant input x[0]."""
    y = np.asarray(x, float)
    for s in sos:
        b, a = s[:3], s[3:]
        state = None
        if steady and len(y):
            g = b.sum() / a.sum()
            state = y[0] * np.array([g - b[0], b[2] - a[2] * g])
        y = lfilter(b, a, y, state)
    return y


def filtfilt(sos: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase: forwards and backwards, without padding, each from the steady state of its first value."""
    return sos_filter(sos, sos_filter(sos, x, True)[::-1], True)[::-1]


def butter(x: np.ndarray, rate: float, low: float | None = None, high: float | None = None, order: int = 4, causal: bool = False) -> np.ndarray:
    if len(x) == 0:
        return np.asarray(x, float)
    z, p, k, _ = butter_sections(order, low, high, rate)
    sos = sections(z, p, k)
    return sos_filter(sos, x) if causal else filtfilt(sos, x)


def decimate(x: np.ndarray, q: int = 10, zero_phase: bool = True) -> np.ndarray:
    """Every q-th sample after an order-8 Chebyshev low-pass (0.05 dB) at 0.8 / q."""
    if len(x) == 0:
        return np.asarray(x, float)
    sos = sections(*chebyshev_lowpass(8, 0.05, 0.8 / q))
    return (filtfilt(sos, x) if zero_phase else sos_filter(sos, x))[::q]


def savgol_coefficients(window: int, order: int, at: int = 0) -> np.ndarray:
    """Weights of the window's samples for the fitted polynomial's value at offset at from the centre."""
    half = window // 2
    a = np.vander(np.arange(-half, half + 1), order + 1, increasing=True).astype(float)
    return np.array([float(at) ** k for k in range(order + 1)]) @ np.linalg.pinv(a)


def savgol(x: np.ndarray, window: int = 7, order: int = 3) -> np.ndarray:
    """Savitzky-Golay; at the borders the polynomial of the first or last window."""
    n, half = len(x), window // 2
    if n < window:
        return np.asarray(x, float).copy()
    y = np.convolve(x, savgol_coefficients(window, order)[::-1], "same")
    for k in range(half):
        y[k] = savgol_coefficients(window, order, k - half) @ x[:window]
        y[n - 1 - k] = savgol_coefficients(window, order, half - k) @ x[-window:]
    return y


def hilbert_magnitude(x: np.ndarray) -> np.ndarray:
    n = len(x)
    if n == 0:
        return np.asarray(x, float)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def integrator(x: np.ndarray, tau: float) -> np.ndarray:
    """s[n+1] = (1 - 1/tau) s[n] + x[n]; y = s / tau: one sample late, from 0."""
    return lfilter([0.0, 1.0 / tau], [1.0, -(1 - 1.0 / tau)], np.asarray(x, float))


# ---- bins and envelopes -----------------------------------------------------------------------------------------


def bin_map(x: np.ndarray, size: int, f: Callable, repeat: int = 1) -> np.ndarray:
    """f over floor(n / size) nearly equal bins, each value repeated."""
    k = len(x) // size
    if k == 0:
        return np.array([])
    return np.repeat([f(c) for c in np.array_split(x, k)], repeat)


def teager(x: np.ndarray) -> np.ndarray:
    return x[1:-1] ** 2 - x[:-2] * x[2:]


# Bin sizes of the envelopes by bins.
BIN_SIZE = {"binmax": 35, "binmin": 35, "binabs": 35, "binmap": 35, "jarne": 35, "robust": 440, "robust_teager": 440, "log_robust_teager": 220}


def log10_of(y: np.ndarray) -> np.ndarray:
    """log10 with -inf of zero and NaN of negative values, without warnings."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.log10(y)


def low_pass(y: np.ndarray, rate: float, cut: float | None) -> np.ndarray:
    return y if cut is None else butter(y, rate, high=checked_cut(cut, rate))


def checked_cut(cut: float, rate: float) -> float:
    """cut, which must lie below half the rate of the envelope it smooths."""
    if not 0 < cut < rate / 2:
        raise ValueError(f"a cut of {cut} Hz does not lie below half the envelope's rate of {rate} Hz")
    return cut


def envelope(x: np.ndarray, rate: float, method: str = "jarne", **a) -> tuple[np.ndarray, float]:
    """An envelope of a whole signal and its rate.

    binmax, binmin, binabs, binmap, robust, teager, robust_teager, log_robust_teager, jarne, mindlin, absint.
    """
    if method == "teager":
        return teager(x), rate
    if method == "mindlin":
        y = integrator(hilbert_magnitude(x), a.get("tau", 100))
        return savgol(y, a.get("sg_window", 513), a.get("sg_order", 4)), rate
    if method == "absint":
        return integrator(np.abs(x), a.get("tau", 44)), rate
    if method not in BIN_SIZE:
        raise ValueError(f"no envelope {method}")
    size, repeat, percentile = a.get("bin_size", BIN_SIZE[method]), a.get("repeat", 1), a.get("percentile", 95)
    of_bin = {
        "binmax": np.max, "binmin": np.min, "binabs": lambda c: np.max(np.abs(c)), "jarne": lambda c: np.max(np.abs(c)), "binmap": a.get("func", np.mean),
        "robust": lambda c: np.percentile(np.abs(c), percentile), "robust_teager": lambda c: np.percentile(c, percentile), "log_robust_teager": lambda c: np.percentile(c, percentile),
    }[method]
    y, r = bin_map(teager(x) if method.endswith("teager") else x, size, of_bin, repeat), rate * repeat / size
    if method in ("jarne", "robust", "robust_teager", "log_robust_teager"):
        y = low_pass(y, r, a.get("cut_freq", 100 if method == "jarne" else None))
    return (log10_of(y) if method == "log_robust_teager" else y), r


# ---- spectra ----------------------------------------------------------------------------------------------------


def window_of(name: str, n: int, sigma: float | None = None) -> np.ndarray:
    """Periodic barthann, hann and gaussian, symmetric hanning, or boxes."""
    k = np.arange(n)
    if n == 1:
        return np.ones(1)
    if name == "barthann":
        f = np.abs(k / n - 0.5)
        return 0.62 - 0.48 * f + 0.38 * np.cos(2 * np.pi * f)
    if name == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * k / n)
    if name == "hanning":
        return np.hanning(n)
    if name == "gaussian":
        return np.exp(-0.5 * ((k - n / 2) / (sigma or n)) ** 2)
    if name == "boxcar":
        return np.ones(n)
    raise ValueError(name)


def spectrogram(x: np.ndarray, rate: float, nperseg: int = 512, noverlap: int = 448, window: str = "barthann", scaling: str = "spectrum", sigma: float | None = None, detrend: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Frequencies, segment centres and one-sided power (freq x segment); each segment's mean is removed when detrend."""
    hop = nperseg - noverlap
    freqs = np.fft.rfftfreq(nperseg, 1 / rate)
    if len(x) < nperseg:
        return freqs, np.array([]), np.zeros((len(freqs), 0))
    segs = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), nperseg)[::hop]
    w = window_of(window, nperseg, sigma)
    scale = 1 / w.sum() ** 2 if scaling == "spectrum" else 1 / (rate * (w * w).sum())
    s = segs - segs.mean(axis=1, keepdims=True) if detrend else segs
    p = np.abs(np.fft.rfft(s * w, axis=1)) ** 2 * scale
    p[:, 1 : -1 if nperseg % 2 == 0 else None] *= 2
    return freqs, (np.arange(len(segs)) * hop + nperseg / 2) / rate, p.T


def praat_segments(rate: float, n: int | None, window_length: float = 0.01, time_steps: float = 1000) -> tuple[int, int]:
    """Segment length of the praat settings of a rate, and the overlap for n samples (None: not needed)."""
    size = int(rate * window_length * 2)
    most = int(size * (1 - 1 / (8 * np.sqrt(np.pi))))
    return size, 0 if n is None else min(max(int(size - n / time_steps), 0), most)


def spectrogram_settings(method: str, rate: float, n: int | None = None, **a) -> dict:
    """Arguments of spectrogram for a method and a signal of n samples, and the range in dB under the top that is kept."""
    if method == "scipy":
        return {"nperseg": a.get("nperseg", 512), "noverlap": a.get("noverlap", 448), "window": a.get("window", "barthann"), "scaling": a.get("scaling", "spectrum"), "detrend": True, "keep": None}
    if method == "mlab":
        return {"nperseg": a.get("nfft", 256), "noverlap": a.get("noverlap", 128), "window": "hanning", "scaling": "density", "detrend": False, "keep": None}
    keep = abs(a.get("dynamic_range", 70))
    if method == "scipy_praat":
        size, lap = praat_segments(rate, n, a.get("window_length", 0.01), a.get("time_steps", 1000))
        return {"nperseg": size, "noverlap": lap, "window": "gaussian", "scaling": "density", "detrend": True, "keep": keep}
    if method == "mlab_praat":
        lap = int(rate * a.get("window_length", 0.01))
        return {"nperseg": 2 * lap, "noverlap": lap, "window": "hanning", "scaling": "density", "detrend": False, "keep": keep}
    raise ValueError(f"no spectrogram {method}")


def log_spectrogram(x: np.ndarray, rate: float, method: str = "scipy", **a) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 power, floored at machine epsilon: scipy, scipy_praat, mlab or mlab_praat settings."""
    given = spectrogram_settings(method, rate, len(x), **a)
    keep = given.pop("keep")
    f, t, p = spectrogram(x, rate, **given)
    if keep is not None:
        p = np.maximum(p, p.max(initial=0.0) * 10 ** (-keep / 10))
    return f, t, np.log10(np.maximum(p, EPS))


def welch(x: np.ndarray, rate: float, nperseg: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Mean power density over half-overlapping Hann segments; a signal shorter than one is a segment by itself."""
    nperseg = max(min(nperseg, len(x)), 1)
    f, _, p = spectrogram(x, rate, nperseg, nperseg // 2, "hann", "density")
    return f, (p.mean(axis=1) if p.shape[1] else np.full(len(f), np.nan))


# ---- matching ---------------------------------------------------------------------------------------------------


def suppress(at: np.ndarray, score: np.ndarray, duration: float, threshold: float = 0.7, allow_overlap: float = 0.0) -> list[tuple[float, float, float]]:
    """Greedy non-maximum suppression of candidates (start times, scores): (start, end, score) by start.

    Best first; a candidate whose overlap with the accepted ones exceeds allow_overlap (as a share of duration) is left
    out. Acceptance blanks half a duration around, refusal a quarter.
    """
    at, left, out = np.asarray(at, float), np.asarray(score, float).copy(), []
    left[~np.isfinite(left)] = -np.inf
    while len(left):
        k = int(np.argmax(left))
        if not left[k] > threshold:
            break
        s, e = at[k], at[k] + duration
        over = sum(max(0.0, min(e, b) - max(s, a)) for a, b, _ in out) / duration
        if over <= allow_overlap:
            out.append((s, e, float(score[k])))
            left[np.abs(at - s) <= duration / 2] = -np.inf
        else:
            left[np.abs(at - s) <= duration / 4] = -np.inf
            left[k] = -np.inf
    return sorted(out)


def sliding_pearson(x: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Pearson r of t with each full window of x; NaN for a window without spread, zeros for such a template."""
    m = len(t)
    if m == 0 or m > len(x):
        return np.array([])
    if t.std() <= EPS:
        return np.zeros(len(x) - m + 1)
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    s = w.std(axis=1)
    return np.where(s > 1e-12, (w - w.mean(axis=1, keepdims=True)) @ ((t - t.mean()) / t.std()) / (m * np.where(s > 1e-12, s, 1)), np.nan)


# ---- time warping -----------------------------------------------------------------------------------------------


def spline(xk: np.ndarray, yk: np.ndarray) -> np.ndarray:
    """Second derivatives at the knots of the cubic spline whose third derivative does not jump at the second and the last
    but one knot (a parabola through three, a line through two)."""
    n = len(xk)
    if n < 3:
        return np.zeros(n)
    h = np.diff(xk)
    slope = np.diff(yk) / h
    r = 6 * np.diff(slope)
    if n == 3:
        return np.full(3, 2 * (slope[1] - slope[0]) / (h[0] + h[1]))
    lower, diag, upper = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    # the end values follow from their neighbours and leave the system
    p, q = h[0] / h[1], h[-1] / h[-2]
    diag[0] += h[0] * (1 + p)
    upper[0] -= h[0] * p
    diag[-1] += h[-1] * (1 + q)
    lower[-1] -= h[-1] * q
    lo, di, up, rhs = lower.tolist(), diag.tolist(), upper.tolist(), r.tolist()
    for k in range(1, n - 2):
        w = lo[k] / di[k - 1]
        di[k] -= w * up[k - 1]
        rhs[k] -= w * rhs[k - 1]
    m = [0.0] * (n - 2)
    m[-1] = rhs[-1] / di[-1]
    for k in range(n - 4, -1, -1):
        m[k] = (rhs[k] - up[k] * m[k + 1]) / di[k]
    return np.array([m[0] * (1 + p) - m[1] * p, *m, m[-1] * (1 + q) - m[-2] * q])


def spline_at(xk: np.ndarray, yk: np.ndarray, m: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The spline's values at x (beyond its ends the outer pieces go on)."""
    if len(xk) < 2:
        return np.full(len(x), yk[0] if len(yk) else np.nan)
    k = np.clip(np.searchsorted(xk, x) - 1, 0, len(xk) - 2)
    d = xk[k + 1] - xk[k]
    u, v = xk[k + 1] - x, x - xk[k]
    return (m[k] * u**3 + m[k + 1] * v**3) / (6 * d) + (yk[k] / d - m[k] * d / 6) * u + (yk[k + 1] / d - m[k + 1] * d / 6) * v


def cubic(xk: np.ndarray, yk: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cubic spline through (xk, yk) at x."""
    return spline_at(xk, yk, spline(xk, yk), x)


def minimize(f: Callable, x0: np.ndarray, steps: int = 200, tol: float = 1e-6) -> np.ndarray:
    """BFGS with numeric gradients and backtracking."""
    x, n = np.asarray(x0, float).copy(), len(x0)
    h = np.eye(n)

    def grad(p):
        g = np.zeros(n)
        for i in range(n):
            d = np.zeros(n)
            d[i] = 1e-6
            g[i] = (f(p + d) - f(p - d)) / 2e-6
        return g

    g, fx = grad(x), f(x)
    for _ in range(steps):
        if np.max(np.abs(g)) < tol:
            break
        p = -h @ g
        if p @ g >= 0:
            h, p = np.eye(n), -g
        t = 1.0
        while t > 1e-10 and f(x + t * p) > fx + 1e-4 * t * (g @ p):
            t /= 2
        s = t * p
        new = grad(x + s)
        y = new - g
        if y @ s > 1e-12:
            rho = 1 / (y @ s)
            i = np.eye(n)
            h = (i - rho * np.outer(s, y)) @ h @ (i - rho * np.outer(y, s)) + rho * np.outer(s, s)
        x, g = x + s, new
        if abs(fx - f(x)) < 1e-12:
            break
        fx = f(x)
    return x


def warp_knots(n: int, rate: float, interval: float = 0.1) -> np.ndarray:
    """Times of the delays of a warp (0 at the signal's left edge): every interval, centred on the signal, one beyond each end."""
    m = int(n / rate // interval) + 2
    return n / rate / 2 + interval * (np.arange(m) - (m - 1) / 2)


class Reader:
    """A signal read between its samples by a cubic; outside its first and last sample it gives outside."""

    def __init__(self, x: np.ndarray, rate: float, outside: float = 0.0):
        self.t, self.x, self.outside = (np.arange(len(x)) + 0.5) / rate, np.asarray(x, float), outside
        self.m = spline(self.t, self.x)

    def __call__(self, at: np.ndarray) -> np.ndarray:
        y = spline_at(self.t, self.x, self.m, at)
        return np.where((at >= self.t[0]) & (at <= self.t[-1]), y, self.outside)


def warp(x: np.ndarray, rate: float, times: np.ndarray, delays: np.ndarray) -> np.ndarray:
    """x read at t + delay(t), the delays a cubic through the knots; NaN outside the signal."""
    t = (np.arange(len(x)) + 0.5) / rate
    return Reader(x, rate, np.nan)(t + cubic(times, delays, t)) if len(x) else np.asarray(x, float)


def parse_delays(text: str) -> np.ndarray:
    """Delays written as '[0.1 0.2]', or times and delays as '[[0 0.1] [0.01 0.02]]' (two rows)."""
    rows = [[float(v) for v in part.replace(",", " ").split()] for part in text.replace("[", " ").split("]") if part.strip(" ,\n")]
    if len(rows) not in (1, 2) or len({len(r) for r in rows}) != 1:
        raise ValueError(f"no delays: {text!r}")
    return np.array(rows[0] if len(rows) == 1 else rows)


def delays_at(delays, knots: np.ndarray) -> np.ndarray:
    """Delays at the knots from a list, an array of one or two rows (times, delays), their text, or a function of time."""
    if isinstance(delays, str):
        delays = parse_delays(delays)
    if callable(delays):
        return np.asarray(delays(knots), float)
    d = np.asarray(delays, float)
    if d.ndim == 2:
        inner = np.clip(knots, d[0, 0], d[0, -1])
        return cubic(d[0], d[1], inner)
    if d.ndim != 1 or len(d) != len(knots):
        raise ValueError(f"{len(knots)} delays are needed")
    return d


def smooth_time_warp(x: np.ndarray, to: np.ndarray, rate: float, interval: float = 0.1, dmax: float = 0.05, dstep: float = 0.01, delays=None, steps: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Knots, delays and final correlation of the smooth warp that makes x most like to.

    Cost: minus the mean product of the standardised signals, plus the mean fourth power of the delays over dmax, plus the
    squared distances of inner delays from their neighbours' mean over dstep, by the number of knots. The search begins at
    delays, else at the one lag at which x without its ends correlates best.
    """
    n = min(len(x), len(to))
    if n == 0:
        return np.array([]), np.array([]), float("nan")
    x, to = np.asarray(x[:n], float), np.asarray(to[:n], float)
    z = lambda v: (v - v.mean()) / v.std() if v.std() > 0 else v * 0
    knots, goal, read = warp_knots(n, rate, interval), z(to), Reader(z(x), rate)
    m, t = len(knots), (np.arange(n) + 0.5) / rate
    if delays is not None:
        d0 = delays_at(delays, knots)
    else:
        cut = int(dmax * rate)
        if n <= 2 * cut:
            raise ValueError("the signal must be longer than twice dmax")
        part = z(x)[cut : n - cut]
        scores = []
        for k in range(2 * cut + 1):
            w = goal[k : k + len(part)]
            scores.append(np.mean((w - w.mean()) * (part - part.mean())) / (w.std() * part.std()) if w.std() > 0 and part.std() > 0 else -np.inf)
        d0 = np.full(m, (cut - int(np.argmax(scores))) / rate)

    def cost(d):
        s = read(t + cubic(knots, d, t))
        bend = d[1:-1] - (d[:-2] + d[2:]) / 2
        return -float(s @ goal) / n + float(np.sum(d**4)) / (m * dmax**4) + float(bend @ bend) / (m * dstep**2)

    d = minimize(cost, d0, steps)
    y = warp(x, rate, knots, d)
    ok = ~np.isnan(y)
    r = float(np.mean(z(y[ok]) * z(to[ok]))) if ok.any() else float("nan")
    return knots, d, r


# ---- lagged non-negative factorisation --------------------------------------------------------------------------


def roll0(a: np.ndarray, shift: int) -> np.ndarray:
    """Columns shifted, zeros coming in."""
    out = np.zeros_like(a)
    if shift == 0:
        out[...] = a
    elif 0 < shift < a.shape[-1]:
        out[..., shift:] = a[..., :-shift]
    elif -a.shape[-1] < shift < 0:
        out[..., :shift] = a[..., -shift:]
    return out


def lag_rows(m: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """m[..., row, t - lag[..., row]] with zeros from outside: rows of m moved by their lags."""
    t = np.arange(m.shape[-1]) - lag[..., None]
    inside = (t >= 0) & (t < m.shape[-1])
    return np.where(inside, np.take_along_axis(np.broadcast_to(m, t.shape), np.where(inside, t, 0), -1), 0.0)


def nmf_lag(
    y: np.ndarray, j: int | None = None, a: np.ndarray | None = None, x: np.ndarray | None = None, lag: np.ndarray | None = None, lags: int | tuple[int, int] = 0,
    fit_a: bool | None = None, fit_x: bool | None = None, fit_lag: bool | None = None, a_range: tuple[float | None, float | None] = (None, None), x_range: tuple[float | None, float | None] = (None, None),
    alpha_a: float = 0.0, alpha_x: float = 0.0, alpha_lag: float = 0.0, steps: int = 1000, tol: float = 1e-3, seed: int = 0,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Y[i, t] ~ sum_j A[i, j] X[j, t - L[i, j]]: A, X, L, the model and half its squared error.

    Multiplicative updates (image space reconstruction), each factor kept between 0.7071 and 1.4142; alpha_a and alpha_x
    make A and X sparse, alpha_lag makes neighbouring columns of L alike. A lag moves by one, within lags (a bound or a
    range), where first differences of the X at the beginning say that the cost falls. What is given is not fitted unless
    its fit_ flag says so; what is not is drawn by seed (lags: 0). a_range and x_range: entries below the first become 0
    in the end, none exceeds the second. It ends when the error is below tol or changes by less than that share. NaN
    counts as 0, what is not positive as epsilon.
    """
    y = np.nan_to_num(np.asarray(y, float))
    y = np.where(y <= 0, EPS, y)
    i_n, t_n = y.shape
    rng = np.random.default_rng(seed)
    j = j if x is None else len(x)
    if j is None:
        raise ValueError("the rank or X")
    fit_a, fit_x, fit_lag = (given is None if flag is None else flag for given, flag in ((a, fit_a), (x, fit_x), (lag, fit_lag)))
    a = rng.random((i_n, j)) if a is None else np.nan_to_num(np.asarray(a, float))
    x = rng.random((j, t_n)) if x is None else np.nan_to_num(np.asarray(x, float))
    lag = np.zeros((i_n, j), int) if lag is None else np.asarray(lag, int).copy()
    if a.shape != (i_n, j) or x.shape != (j, t_n) or lag.shape != (i_n, j):
        raise ValueError("the shapes of Y, A, X and L do not agree")
    a, x = np.where(a <= 0, EPS, a), np.where(x <= 0, EPS, x)
    low, high = (-abs(lags), abs(lags)) if isinstance(lags, int) else lags
    factor = (0.7071, 1.4142)  # fixed values: bounds of one update
    later, sooner = roll0(x, 1) - x, roll0(x, -1) - x
    weight = np.sum(later**2, axis=1)
    bend = 2 * np.eye(j) - np.eye(j, k=1) - np.eye(j, k=-1)
    bend[0, 0] = bend[-1, -1] = 1
    ends = np.ones(j)
    ends[[0, -1]] = 0.5
    d, last = np.inf, np.inf
    model = y
    for _ in range(steps):
        moved = lag_rows(x[None], lag)
        model = np.einsum("ij,ijt->it", a, moved)
        d = 0.5 * float(np.sum((y - model) ** 2))
        rest = y - model
        if fit_a:
            up, down = np.einsum("it,ijt->ij", y, moved), np.einsum("it,ijt->ij", model, moved)
            a = np.clip(a * np.clip(up / (down + alpha_a + EPS), *factor), 0, a_range[1])
        if fit_x:
            back = lambda m: np.einsum("ij,ijt->jt", a, lag_rows(np.broadcast_to(m[:, None, :], (i_n, j, t_n)), -lag))  # noqa: E731, B023
            x = np.clip(x * np.clip(back(y) / (back(model) + alpha_x + EPS), *factor), 0, x_range[1])
        if fit_lag:
            change = lambda step: -a * np.einsum("it,ijt->ij", rest, lag_rows(step[None], lag)) + 0.5 * a * a * weight  # noqa: E731, B023
            grow, shrink = change(later) + alpha_lag * (ends + lag @ bend), change(sooner) + alpha_lag * (ends - lag @ bend)
            lag = np.clip(lag + np.sign(np.minimum(shrink, 0) - np.minimum(grow, 0)).astype(int), low, high)
        if d < tol or np.isfinite(last) and last > 0 and abs(d / last - 1) < tol:
            break
        last = d
    if a_range[0] is not None and fit_a:
        a = np.where(a < a_range[0], 0, a)
    if x_range[0] is not None and fit_x:
        x = np.where(x < x_range[0], 0, x)
    return a, x, lag, model, d


# ---- song synthesis ---------------------------------------------------------------------------------------------

# Constants of the published model. Time scale and pressure of the labia; speed of sound as the tube's
# length is given; circuit of the upper tract: capacitance, inductances of beak and glottis, resistances of beak and cavity.
LABIA = {"alpha": -0.15, "gamma": 24000.0}
SOUND_SPEED = 35000.0
TRACT = {"ch": 0.8e-8 / 360, "lb": 1e4, "lg": 82.0, "rb": 0.5e7, "rh": 6e5}
SILENT_BETA, SILENT_BELOW = 0.15, 10.0


def rk4(deriv: Callable, state: np.ndarray, dt: float, *args) -> np.ndarray:
    """One step of the classical Runge-Kutta method for d state / dt = deriv(state, *args)."""
    k1 = deriv(state, *args)
    k2 = deriv(state + dt / 2 * k1, *args)
    k3 = deriv(state + dt / 2 * k2, *args)
    k4 = deriv(state + dt * k3, *args)
    return state + dt / 6 * (k1 + 2 * (k2 + k3) + k4)


def beta_of(fund: np.ndarray, lookup: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Tension that gives each frequency, from a table of frequencies and betas; 0.15 (silence) below 10 Hz."""
    freq, beta = (np.asarray(v, float) for v in lookup)
    order = np.argsort(freq)
    return np.where(fund < SILENT_BELOW, SILENT_BETA, np.interp(fund, freq[order], beta[order]))


def _labia(x: np.ndarray, v: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Acceleration of the labia: normal form of a Takens-Bogdanov bifurcation."""
    g = LABIA["gamma"]
    return g * g * (LABIA["alpha"] + beta * x + x * x - x**3) - g * x * v * (1 + x)


def finch(
    env: np.ndarray, beta: np.ndarray, rate: float, detune: np.ndarray | None = None, filtered: bool = True, noise_amplitude: float = 0.05, noise_beta: float = 0.002,
    seeds: list[int] | None = None, steps: int = 20, reflect: float = 0.1, length: float = 4.0, **tract: float,
) -> dict[str, np.ndarray]:
    """Songs of several birds at once: arrays (songs, samples) in and out; rows shorter than others end in zeros.

    A labial source, or two with detune (the second's beta is beta * detune), drives a tube that reflects at its end and
    a resonant cavity (circuit equations, see TRACT), all integrated in steps of a sample's part. env is scaled to a 99th
    percentile of 10. Noise: uniform on the amplitude, normal on beta, drawn by seeds. Result: syn (greatest magnitude
    1), labium_0 and labium_1. filtered False leaves tube and cavity out.
    """
    env, beta = np.atleast_2d(np.asarray(env, float)), np.atleast_2d(np.asarray(beta, float))
    g, n = beta.shape
    q = [np.ones_like(beta)] + ([np.atleast_2d(np.asarray(detune, float))] if detune is not None else [])
    top = np.percentile(np.abs(env), 99, axis=1, keepdims=True) if n else np.zeros((g, 1))
    amp = np.divide(env * 10, top, out=np.zeros_like(env), where=top > 0)
    rngs = [np.random.default_rng(s) for s in (seeds or range(g))]
    c = TRACT | tract
    ns, dt = len(q), 1.0 / (rate * steps)
    lag = max(1, int(length * rate * steps / SOUND_SPEED)) if filtered else 0
    first = (lag + 1) // steps if filtered else 0
    lg, lb, rb, rh, ch = c["lg"], c["lb"], c["rb"], c["rh"], c["ch"]

    def deriv(s, b, push, dpush):
        out = np.empty_like(s)
        for k in range(ns):
            out[2 * k] = s[2 * k + 1]
            out[2 * k + 1] = _labia(s[2 * k], s[2 * k + 1], b[k])
        if filtered:
            i1, i2, i3 = s[2 * ns :]
            out[2 * ns] = i2
            out[2 * ns + 1] = (dpush - i1 / ch + i3 / ch) / lg - rh * (1 / lb + 1 / lg) * i2 + rh * (push - rb * i3) / (lg * lb)
            out[2 * ns + 2] = (push - lg * i2 - rb * i3) / lb
        return out

    s = np.zeros((2 * ns + (3 if filtered else 0), g))
    syn, labium = np.zeros((g, n)), np.zeros((ns, g, n))
    source, wave = np.zeros((lag + 1, g)), np.zeros((lag + 1, g))  # the last moments of the tube, by step modulo lag + 1
    push = dpush = np.zeros(g)
    for i in range(first, n):
        shake = np.array([r.uniform(-1, 1, steps) for r in rngs]) * noise_amplitude
        wobble = [np.array([r.standard_normal(steps) for r in rngs]) * noise_beta for _ in range(ns)]
        speed = sum(s[2 * k + 1] for k in range(ns))
        syn[:, i] = rb * s[-1] if filtered else (amp[:, i] + shake[:, 0]) * speed
        labium[:, :, i] = s[0 : 2 * ns : 2]
        for k in range(steps):
            if filtered:
                at, behind = (i * steps + k) % (lag + 1), (i * steps + k - lag) % (lag + 1)
                arriving, before = wave[behind].copy(), wave[(at - 1) % (lag + 1)]
                leaving = source[behind].copy()
                source[at] = 0.5 * (amp[:, i] + shake[:, k]) * sum(s[2 * m + 1] for m in range(ns)) - reflect * arriving
                push, dpush = (1 - reflect) * leaving, (1 - reflect) * (leaving - before) / dt
                wave[at] = leaving
            s = rk4(deriv, s, dt, [beta[:, i] * q[m][:, i] + wobble[m][:, k] for m in range(ns)], push, dpush)
    size = np.nanmax(np.abs(syn), axis=1, initial=0.0)[:, None] if n else np.zeros((g, 1))
    syn = np.divide(syn, size, out=syn.copy(), where=size > 0)
    return {"syn": syn} | {f"labium_{k}": labium[k] for k in range(ns)}


def tract_magnitude(freq: np.ndarray, reflect: float = 0.1, length: float = 4.0, **tract: float) -> np.ndarray:
    """Steady-state gain of the upper tract: the reflecting tube times the cavity's circuit (see TRACT)."""
    c, w = TRACT | tract, 2 * np.pi * np.asarray(freq, float)
    turn = np.exp(1j * w * length / SOUND_SPEED)
    tube = (1 - reflect) * turn / (turn**2 + reflect)
    inner = c["ch"] * c["lg"] * w**2 * (1j * c["rb"] - c["lb"] * w) / (c["ch"] * c["rh"] * w - 1j)
    return np.abs(tube / (c["rb"] + 1j * w * (c["lb"] + c["lg"]) + inner))


def fir_from_magnitude(freq: np.ndarray, gain: np.ndarray, rate: float, taps: int = 101) -> np.ndarray:
    """Linear-phase taps (odd number, Hamming window) of a magnitude given at frequencies from 0 to rate / 2."""
    n = 1 + (1 << max(taps - 1, 1).bit_length())
    g = np.interp(np.linspace(0, rate / 2, n), freq, gain) * np.exp(-1j * np.pi * (taps - 1) / 2 * np.linspace(0, 1, n))
    return np.fft.irfft(g)[:taps] * np.hamming(taps)
