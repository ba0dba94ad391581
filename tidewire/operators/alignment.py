"""Alignment of multichannel waveforms to their peak at a fraction of a sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parabola(x: list[Column], y: list[Column]) -> tuple[Column, Column, Column]:
    """Coefficients a, b, c of the parabola through three points; null where two x are equal."""
    x0, x1, x2 = x
    d = F.nullif((x0 - x1) * (x0 - x2) * (x1 - x2), F.lit(0.0))
    a = (x2 * (y[1] - y[0]) + x1 * (y[0] - y[2]) + x0 * (y[2] - y[1])) / d
    b = (x2 * x2 * (y[0] - y[1]) + x1 * x1 * (y[2] - y[0]) + x0 * x0 * (y[1] - y[2])) / d
    c = (x1 * x2 * (x1 - x2) * y[0] + x2 * x0 * (x2 - x0) * y[1] + x0 * x1 * (x0 - x1) * y[2]) / d
    return a, b, c


def vertex(a: Column, b: Column) -> Column:
    """Place of a parabola's peak; null for a straight line."""
    return -b / F.nullif(2 * a, F.lit(0.0))


def peak_vertex(place: Column, before: Column, at: Column, after: Column) -> Column:
    """Place of the peak of the parabola through three neighbouring samples."""
    return place - 0.5 * (after - before) / F.nullif(after - 2 * at + before, F.lit(0.0))


def spline_coefficients(y: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients of the columns of ``y`` with mirrored ends: two recursive passes (Unser and others, 1993)."""
    y = np.asarray(y, float)
    n = len(y)
    if n == 1:
        return y.copy()
    z = np.sqrt(3.0) - 2
    forward = np.empty_like(y)
    k = np.arange(2 * n - 2)
    mirrored = np.concatenate([y, y[-2:0:-1]])
    forward[0] = (mirrored * (z**k)[:, None]).sum(0) / (1 - z ** (2 * n - 2))
    for i in range(1, n):
        forward[i] = y[i] + z * forward[i - 1]
    c = np.empty_like(y)
    c[-1] = z / (z * z - 1) * (forward[-1] + z * forward[-2])
    for i in range(n - 2, -1, -1):
        c[i] = z * (c[i + 1] - forward[i])
    return 6 * c


def spline_values(c: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of the spline at ``x``; places beyond the ends are mirrored."""
    n, first = len(c), np.floor(x).astype(int)
    out = np.zeros((len(x), c.shape[1]))
    for k in range(-1, 3):
        at, d = first + k, np.abs(x - (first + k))
        w = np.where(d < 1, 2 / 3 - d**2 + d**3 / 2, np.where(d < 2, (2 - d) ** 3 / 6, 0.0))
        m = np.abs(at) % max(2 * n - 2, 1)
        out += w[:, None] * c[np.where(m < n, m, 2 * n - 2 - m)]
    return out


def resample(waveform: np.ndarray, peak: float, before: int, after: int, kind: str = "cubic") -> np.ndarray:
    """``before + after`` samples (float32) of each channel, ``before`` of them before ``peak``. Linear resampling raises beyond the ends."""
    x = peak + np.arange(-before, after)
    if kind == "cubic":
        return spline_values(spline_coefficients(waveform), x).astype(np.float32)
    if kind == "linear":
        if len(x) and (x.min() < 0 or x.max() > len(waveform) - 1):
            raise ValueError("linear resampling can't go beyond the waveform")
        return np.stack([np.interp(x, np.arange(len(waveform)), w) for w in waveform.T], 1).astype(np.float32)
    raise ValueError("kind is linear or cubic")


def align(waveform: np.ndarray, place: int | None = None, channel: int | None = None, before: int | None = None, after: int | None = None, pad: bool = False, kind: str = "cubic", polarity: str = "pos") -> np.ndarray:
    """Align one waveform (samples, channels) to the peak of its highest channel, or to a given place on a given channel.

    The peak of the parabola through the place and its neighbours moves every channel alike. At an edge, or on a flat
    top, the whole sample stays. ``polarity`` neg seeks the lowest value.
    """
    w = np.asarray(waveform, float)
    up = w if polarity == "pos" else -w
    if place is None:
        channel = int(np.argmax(up.max(0)))
        place = int(np.argmax(up[:, channel]))
    elif channel is None:
        raise ValueError("a given place needs a channel")
    before = place if before is None else before
    after = len(w) - before if after is None else after
    peak = float(place)
    if 0 < place < len(w) - 1:
        l, m, r = w[place - 1 : place + 2, channel]
        if l - 2 * m + r:
            peak = place - 0.5 * (r - l) / (l - 2 * m + r)
    return resample(np.vstack([w[:1], w, w[-1:]]), peak + 1, before, after, kind) if pad else resample(w, peak, before, after, kind)


def align_waveforms(df: DataFrame, waveform: str = "waveform", out: str = "aligned", channels: int | None = None, **options) -> DataFrame:
    """Rows with ``out`` (array<array<float>>, samples by channels); options of ``align``.

    ``waveform`` is array<array>, or a flat array with ``channels`` values a sample. Null waveforms give null.
    """

    @F.pandas_udf("array<array<float>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([None if w is None else align(np.stack(w) if channels is None else np.asarray(w, float).reshape(-1, channels), **options).tolist() for w in s])

    return df.withColumn(out, run(waveform))


def resample_linear(waveform: Column, peak: Column, before: int, after: int) -> Column:
    """Linear resampling of one channel (array) as a column expression; null beyond the ends."""

    def at(k: Column) -> Column:
        x = peak + k
        i = F.floor(x).cast("int")
        a, b = F.get(waveform, i), F.get(waveform, i + 1)
        return F.when(x == i, a).otherwise(a + (b - a) * (x - i))

    return F.transform(F.sequence(F.lit(-before), F.lit(after - 1)), at)
