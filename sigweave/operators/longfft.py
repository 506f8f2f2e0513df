"""Analytic signals of any length: near and far samples apart.

A signal of n samples is convolved with the discrete Hilbert kernel of that n, around its ends as a transform of the whole
does. The signal is cut into B equal boxes (see boxes). What a box and its two neighbours give to the box's samples is a
short convolution with the kernel. What all other boxes give is smooth there, so each box is summed up by NODES Chebyshev
sums of its even and of its odd samples (the kernel hangs on the parity of the lag), boxes meet boxes at NODES points in
one convolution over boxes, and the result is a polynomial in each box: exact to about 1e-15 of the signal. Samples go
through one shuffle, in blocks of boxes with a halo; the sums of all boxes, a bounded number, meet in one task a signal.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shipped

#: Chebyshev points of a box; boxes that meet in them are a box apart, so the error is about 5.8 ** -NODES.
NODES = 20
#: Samples of a box at least, boxes of a signal at most, and boxes of a block (a task's array) at least.
BOX, BOXES, TOGETHER = 1 << 12, 1 << 15, 32
#: Numbers that a task gathers before it hands them on.
FLUSH = 1 << 18


def boxes(n: int) -> int:
    """B: sample t is in box t * B // n."""
    return max(8, min(BOXES, 1 << max(n // BOX, 1).bit_length() - 1))


def start(n: int, b):
    """First sample of box b; boxes below 0 and from B on are those of the signal repeated."""
    return -(-b * n // boxes(n))


def kernel(n: int, d: np.ndarray) -> np.ndarray:
    """Imaginary kernel at signed lags d, |d| <= n / 2: its circular convolution of length n gives the analytic signal."""
    u = np.pi * d / (2 * n)
    with np.errstate(divide="ignore", invalid="ignore"):
        odd, even = (2 / np.tan(2 * u), 0.0) if n % 2 == 0 else (1 / np.tan(u), -np.tan(u))
    return np.where(d % 2 == 1, odd, even) / n


@lru_cache(4)
def blocks_of(n: int, before: int, after: int) -> dict[str, np.ndarray]:
    """Of each block: own samples s0 <= t < s1; first and last box that they and their halo lie in; samples that it reads."""
    b = boxes(n)
    together = min(TOGETHER, b // 4)
    while together < b and together * n < max(before, after) * b:
        together *= 2
    k = np.arange(b // together)
    s0, s1 = start(n, k * together), start(n, (k + 1) * together)
    lo, hi = np.maximum(s0 - before, 0), np.minimum(s1 + after, n)
    low, high = lo * b // n, (hi - 1) * b // n
    return {"s0": s0, "s1": s1, "lo": lo, "hi": hi, "low": low, "high": high, "e0": start(n, low - 1), "e1": start(n, high + 2)}


@lru_cache(1)
def _points() -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev points and the matrix (points, degrees) between values there and coefficients."""
    x = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
    t = np.cos(np.arange(NODES)[None, :] * np.arccos(x)[:, None])
    return x, t * np.where(np.arange(NODES) == 0, 1, 2) / NODES


def _polynomials(n: int, t: np.ndarray, box: np.ndarray):
    """Chebyshev polynomials by degree at samples t of their boxes."""
    x = 2 * ((t * boxes(n) - box * n) / n) - 1
    last, now = x, np.ones(len(x))  # T-1 is T1
    for _ in range(NODES):
        yield now
        last, now = now, 2 * x * now - last


def sums(n: int, first: int, x: np.ndarray) -> tuple[int, np.ndarray]:
    """First box and the sums (box, parity, degree) of samples x from position first on."""
    t = np.arange(first, first + len(x))
    box = t * boxes(n) // n
    low = int(box[0])
    out = np.zeros((int(box[-1]) - low + 1, 2, NODES))
    for odd in range(2):
        own = slice((first + odd) % 2, None, 2)
        b, v = box[own], x[own]
        if len(b):
            at = np.flatnonzero(np.diff(b, prepend=-1))
            for k, p in enumerate(_polynomials(n, t[own], b)):
                out[b[at] - low, odd, k] = np.add.reduceat(v * p, at)
    return low, out


def far(n: int, c: np.ndarray) -> np.ndarray:
    """Coefficients (box, parity, degree) of what the boxes that are no neighbours give, of the sums of all boxes."""
    b = boxes(n)
    if not np.isfinite(c).all():  # as in one transform
        return np.full(c.shape, np.nan)
    x, matrix = _points()
    m = np.fft.rfft(c @ matrix.T, 2 * b, axis=0).transpose(1, 2, 0).copy()
    lag = np.arange(2 * b)
    lag[b:] -= 2 * b
    there = (np.abs(lag) > 1) & (np.abs(lag) < b - 1)
    out = np.zeros((2, NODES, b + 1), complex)
    k, same = np.zeros(2 * b), np.zeros(2 * b)
    for i in range(NODES):
        for j in range(NODES):
            u = np.pi * (lag[there] + (x[i] - x[j]) / 2) / (2 * b)
            if n % 2 == 0:
                k[there] = 2 / np.tan(2 * u)
            else:
                tangent = np.tan(u)
                k[there], same[there] = 1 / tangent, -tangent
                out[:, i] += np.fft.rfft(same) * m[:, j]
            out[:, i] += np.fft.rfft(k) * m[::-1, j]
    return np.fft.irfft(out, 2 * b, axis=2)[:, :, :b].transpose(2, 0, 1) @ matrix / n


@lru_cache(4)
def _near(n: int) -> tuple[int, int, np.ndarray]:
    """Width that holds any box, length of its transforms, and the kernel's transform."""
    width = -(-n // boxes(n)) + 1
    length = min(s << k for s in (1, 3, 5, 9, 15) for k in range(3, 40) if s << k >= 4 * width)
    d = np.arange(1 - 2 * width, 2 * width)
    g = kernel(n, d)
    g[2 * width - 1] = 0
    return width, length, np.fft.rfft(g, length)


def magnitudes(n: int, low: int, high: int, x: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """Magnitudes of the samples of boxes low to high, x those of boxes low - 1 to high + 1."""
    at = start(n, np.arange(low - 1, high + 3))
    width, length, g = _near(n)
    rows = np.zeros((high - low + 1, length))
    for r in range(len(rows)):
        a, c = at[r] - at[r + 1] + width, at[r + 3] - at[r + 1] + width
        rows[r, a:c] = x[at[r] - at[0] : at[r + 3] - at[0]]
    rows = np.fft.irfft(np.fft.rfft(rows, axis=1) * g, length, axis=1)
    y = np.concatenate([rows[r, 3 * width - 1 : 3 * width - 1 + at[r + 2] - at[r + 1]] for r in range(len(rows))])
    t = np.arange(at[1], at[-2])
    box = t * boxes(n) // n
    for odd in range(2):
        own = slice(int(t[0] + odd) % 2, None, 2)
        b = box[own] - low
        for k, p in enumerate(_polynomials(n, t[own], box[own])):
            y[own] += coefficients[:, odd, k][b] * p
    return np.where(np.isnan(y), np.nan, np.hypot(x[at[1] - at[0] : at[-2] - at[0]], y))


def _arrays(rb: pa.RecordBatch, at: int):
    """Samples of each row of a batch, in its list column at; NULL as NaN."""
    lists = rb.column(at)
    values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    for r in range(rb.num_rows):
        yield r, np.array(values[offsets[r] : offsets[r + 1]], float)


def magnitude(parts: DataFrame, keys: Sequence[str], then: Callable[[np.ndarray], np.ndarray] | None = None, before: int = 0, after: int = 0) -> DataFrame:
    """(keys, first, samples): magnitude of the analytic signal of array parts (keys, first, samples, n), n the length of
    each signal, a box each at least.

    Positions must be complete. NULL and NaN spread over their whole signal, as in one transform. then: array to array of
    equal length, that looks at so many neighbours before and after; it is applied to the magnitudes.
    """
    types = dict(parts.dtypes)
    n_keys, kept = len(keys) + 1, [*keys, "n"]
    ddl = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n bigint, "

    def batches_of(rb, rows, names):
        """rows: (row of rb, numbers and bytes by names)."""
        take, held, size = [], [], 0
        for r, *row in rows:
            take.append(r)
            held.append(row)
            size += len(row[-1]) // 8
            if size >= FLUSH:
                yield made(rb, take, held, names)
                take, held, size = [], [], 0
        if take:
            yield made(rb, take, held, names)

    def made(rb, take, held, names):
        cols = [rb.column(k).take(pa.array(take)) for k in range(n_keys)]
        new = [pa.array(c, pa.binary() if isinstance(c[0], bytes) else pa.int64()) for c in zip(*held, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, *new], names=[*kept, *names])

    def summed(batches):
        for rb in batches:
            n, first = rb.column(n_keys - 1).to_pylist(), rb.column(n_keys).to_pylist()
            rows = ((r, first[r], low, c.tobytes()) for r, x in _arrays(rb, n_keys + 1) if len(x) for low, c in [sums(n[r], first[r], x)])
            yield from batches_of(rb, rows, ["first", "box", "c"])

    def cut(batches):
        def rows(rb, n, first):
            for r, x in _arrays(rb, n_keys + 1):
                b = blocks_of(n[r], before, after)
                for f in (first[r] - n[r], first[r], first[r] + n[r]):  # the signal, and its ends once more around it
                    for k in range(np.searchsorted(b["e1"], f, "right"), np.searchsorted(b["e0"], f + len(x), "left")):
                        lo, hi = max(f, int(b["e0"][k])), min(f + len(x), int(b["e1"][k]))
                        yield r, int(k), lo, x[lo - f : hi - f].tobytes()

        for rb in batches:
            yield from batches_of(rb, rows(rb, rb.column(n_keys - 1).to_pylist(), rb.column(n_keys).to_pylist()), ["block", "at", "x"])

    def met(key, t):
        n = key[-1].as_py()
        c = np.zeros((boxes(n), 2, NODES))
        for _, low, raw in sorted(zip(*(t.column(k).to_pylist() for k in ("first", "box", "c")), strict=True)):
            own = np.frombuffer(raw).reshape(-1, 2, NODES)
            c[low : low + len(own)] += own
        c, b = far(n, c), blocks_of(n, before, after)
        rows = [c[low : high + 1].tobytes() for low, high in zip(b["low"], b["high"], strict=True)]
        return pa.table([*(pa.array([k.as_py()] * len(rows), k.type) for k in key), pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.binary())], names=[*kept, "block", "c"])

    def put(key, t):
        n, k = key[-2].as_py(), key[-1].as_py()
        lo, hi, low, high, e0, e1, s0, s1 = (int(blocks_of(n, before, after)[c][k]) for c in ("lo", "hi", "low", "high", "e0", "e1", "s0", "s1"))
        x, c = np.zeros(e1 - e0), None
        for at, raw, far_raw in zip(*(t.column(c).to_pylist() for c in ("at", "x", "c")), strict=True):
            if raw is None:
                c = np.frombuffer(far_raw).reshape(-1, 2, NODES)
            else:
                x[at - e0 : at - e0 + len(raw) // 8] = np.frombuffer(raw)
        first = int(start(n, low))
        y = magnitudes(n, low, high, x, c)[lo - first : hi - first]
        y = np.asarray(then(y) if then else y, float)[s0 - lo : s1 - lo]
        samples = pa.ListArray.from_arrays(pa.array([0, len(y)], pa.int32()), pa.array(y))
        return pa.table([*(pa.array([k.as_py()], k.type) for k in key[: n_keys - 1]), pa.array([s0], pa.int64()), samples], names=[*keys, "first", "samples"])

    p = shipped(parts.select(*keys, "n", "first", "samples"))
    c = p.mapInArrow(summed, ddl + "first bigint, box bigint, c binary").groupBy(*kept).applyInArrow(met, ddl + "block bigint, c binary")
    x = p.mapInArrow(cut, ddl + "block bigint, at bigint, x binary").withColumn("c", F.lit(None).cast("binary"))
    both = x.unionByName(c.select(*kept, "block", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("binary").alias("x"), "c"))
    return both.groupBy(*kept, "block").applyInArrow(put, ddl.replace("n bigint, ", "") + "first bigint, samples array<double>")
