"""Pitch points of songs: silence between syllables, and the regular series of the fundamental frequency."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import kernels as K
from .signals import create_grid


def silence_fill(points: DataFrame, keys: Sequence[str], floor: float = 0.0, step: float = 0.005, syllable: str = "syl") -> DataFrame:
    """points and, between consecutive syllables, points of frequency floor every step seconds strictly inside the gap.

    points: keys, syllable, time, freq. Syllables follow each other by their first time. A window runs over the syllables
    of a key (their bounds only), not over the points.
    """
    s = points.groupBy(*keys, syllable).agg(F.min("time").alias("_a"), F.max("time").alias("_b"))
    w = W.partitionBy(*keys).orderBy("_a", syllable)
    gaps = s.withColumn("_from", F.lag("_b").over(w)).where(F.col("_from").isNotNull() & (F.col("_a") - F.col("_from") > 2 * step))
    n = F.ceil((F.col("_a") - F.col("_from")) / step - 1e-9).cast("int") - 1
    fill = gaps.withColumn("_k", F.explode(F.sequence(F.lit(1), n))).select(*keys, F.lit("").alias(syllable), (F.col("_from") + F.col("_k") * step).alias("time"), F.lit(float(floor)).alias("freq"))
    return points.select(*keys, F.col(syllable).cast("string").alias(syllable), "time", F.col("freq").cast("double").alias("freq")).unionByName(fill)


def fundamental(points: DataFrame, keys: Sequence[str], rate: float) -> DataFrame:
    """freq / harmonic interpolated to a regular series from the first to the last point: keys, i, v."""
    f = points.select(*keys, "time", F.try_divide(F.col("freq"), F.coalesce(F.col("harmonic"), F.lit(1))).alias("v"))
    return create_grid(f.select(*keys, F.col("time").alias("t"), "v"), keys, rate)


def tract_gain(freq: Column, reflect: float = 0.1, length: float = 4.0, **tract: float) -> Column:
    """Steady-state gain of the upper tract at a frequency: kernels.tract_magnitude without Python, in real numbers."""
    c, w = K.TRACT | tract, 2 * F.pi() * freq
    tube = (1 - reflect) / F.sqrt(1 + 2 * reflect * F.cos(2 * w * length / K.SOUND_SPEED) + reflect * reflect)
    k = c["ch"] * c["lg"] * w * w / (F.pow(c["ch"] * c["rh"] * w, F.lit(2.0)) + 1)
    real = c["rb"] - k * (c["rb"] + c["lb"] * c["ch"] * c["rh"] * w * w)
    imaginary = w * (c["lb"] + c["lg"]) + k * w * (c["rb"] * c["ch"] * c["rh"] - c["lb"])
    return tube / F.sqrt(real * real + imaginary * imaginary)


def tract_taps(rate: float, taps: int = 1001, reflect: float = 0.1, length: float = 4.0, **tract: float) -> list[float]:
    """Taps of the filter with that gain, for transforms.lfilter: given at as many frequencies as it has taps."""
    import numpy as np

    f = np.linspace(0, rate / 2, taps)
    return K.fir_from_magnitude(f, K.tract_magnitude(f, reflect, length, **tract), rate, taps).tolist()
