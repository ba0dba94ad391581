"""Decimation of samples within their segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .filtering import band_filter
from .ordered import with_latest, with_neighbour


def factor(fs_in: float | None = None, fs_out: float | None = None, q: int | None = None) -> int:
    """The whole factor of a decimation given by (fs_in, q), (fs_in, fs_out) or q alone."""
    if q is None:
        if fs_in is None or fs_out is None:
            raise ValueError("give q, or both sampling rates")
        ratio = fs_in / fs_out
        if ratio < 1 or abs(ratio - round(ratio)) > 1e-9:
            raise ValueError("the sampling rates have no whole ratio")
        return round(ratio)
    if fs_out is not None:
        raise ValueError("q and fs_out can't both be given")
    if q < 1 or int(q) != q:
        raise ValueError("q is a whole number from 1 on")
    return int(q)


def _placed(samples: DataFrame, ts: str, keys: list[str], width: int | None) -> DataFrame:
    near = with_neighbour(with_neighbour(samples, {"__before": ts}, [ts], keys, width), {"__after": ts}, [ts], keys, width, back=False)
    near = near.withColumn("__first", F.col("__before").isNull() | (F.col(ts) - F.col("__before") >= 2))
    near = near.withColumn("__last", F.col("__after").isNull() | (F.col("__after") - F.col(ts) >= 2))
    return with_latest(near, "__from", F.when(F.col("__first"), F.col(ts)), [ts], keys, width)


_MADE = ("__before", "__after", "__first", "__last", "__from")


def every_nth(samples: DataFrame, q: int = 10, ts: str = "ts", keys: list[str] | None = None, width: int | None = None, ends: bool = True) -> DataFrame:
    """Every ``q``-th sample of each segment, counted from its start, and with ``ends`` its first and last ones."""
    rows = _placed(samples, ts, keys or [], width)
    keep = F.pmod(F.col(ts) - F.col("__from"), F.lit(q)) == 0
    return rows.where(keep | F.col("__first") | F.col("__last") if ends else keep).drop(*_MADE)


def decimate(samples: DataFrame, fs_in: float | None = None, fs_out: float | None = None, q: int | None = None, prefilter: bool | Callable[[DataFrame], DataFrame] = True, ts: str = "ts", value: str = "value", keys: list[str] | None = None, width: int | None = None, **options) -> DataFrame:
    """Low-pass the samples below the new rate's half, then keep every ``q``-th one of each segment.

    ``prefilter`` may be false, or a function of the samples. Without ``fs_in`` the rate is taken as 1.
    """
    n = factor(fs_in, fs_out, q)
    if callable(prefilter):
        samples = prefilter(samples)
    elif prefilter and n > 1:
        fs = fs_in or 1.0
        samples = band_filter(samples, fs=fs, fh=0.5 * fs / n / 1.4, ts=ts, value=value, keys=keys, width=width, **({"as_int16": False, "short": "pass"} | options))
    return every_nth(samples, n, ts, keys, width, ends=False)
