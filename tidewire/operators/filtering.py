"""Zero-phase filtering of channels within their segments, by chunks with overlaps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.design import Preset, butter_band, design, edges, response, settle_length
from ..functions.zero_phase import pad_length, zero_phase
from .interpolate import to_int16
from .ordered import with_latest, with_neighbour

_OUT = "__filtered"


def filter_segments(samples: DataFrame, sos: np.ndarray, ts: str = "ts", value: str = "value", keys: list[str] | None = None, epochs: DataFrame | None = None, buffer_len: int = 1 << 22, overlap_len: int | None = None, width: int | None = None, short: str = "raise", as_int16: bool = True) -> DataFrame:
    """(keys, ts, value) filtered forward and back within each contiguous segment, or within caller's ``epochs`` (keys, start_ts, stop_ts).

    A segment is cut into chunks of ``buffer_len`` samples; each is filtered with ``overlap_len`` more to both sides,
    within the segment, and only its own samples are kept. The default overlap is what the filter's slowest pole needs
    to decay to 1e-6. Stretches no longer than the padding raise ValueError, or pass unfiltered with ``short='pass'``.
    Samples outside ``epochs`` are 0.
    """
    keys = keys or []
    overlap = settle_length(sos) if overlap_len is None else overlap_len
    plain = samples.select(*keys, ts, F.col(value).cast("double").alias(value))
    if epochs is None:
        near = with_neighbour(plain, {"__before": ts}, [ts], keys, width)
        begins = F.when(F.col("__before").isNull() | (F.col(ts) - F.col("__before") >= 2), F.col(ts))
        placed, outside = with_latest(near, "__from", begins, [ts], keys, width).drop("__before"), None
    else:
        from .segments import in_segment

        placed = in_segment(plain, epochs.select(*keys, "start_ts", "stop_ts"), ts, keys).withColumnRenamed("start_ts", "__from").drop("stop_ts")
        outside = plain.join(placed.select(*keys, ts), [*keys, ts], "left_anti").select(*keys, ts, F.lit(0.0).alias(_OUT))
    at = F.col(ts) - F.col("__from")
    chunks = F.sequence(F.greatest(F.floor((at - overlap) / buffer_len), F.lit(0)), F.floor((at + overlap) / buffer_len))
    spread = placed.withColumn("__own", F.floor(at / buffer_len)).withColumn("__chunk", F.explode(chunks))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*keys, ts)) + f", `{_OUT}` double"

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(ts)
        own = table.column("__own").to_numpy() == table.column("__chunk")[0].as_py()
        if not own.any():  # a chunk past the segment's end, met by overlaps only
            return table.slice(0, 0).select([*keys, ts]).append_column(_OUT, pa.array([], pa.float64()))
        x = table.column(value).to_numpy()
        if short == "pass" and len(x) <= pad_length(sos):
            y = x
        else:
            y = zero_phase(sos, x)
        return table.select([*keys, ts]).append_column(_OUT, pa.array(y)).filter(pa.array(own))

    done = spread.groupBy(*keys, "__from", "__chunk").applyInArrow(run, schema)
    if outside is not None:
        done = done.unionByName(outside)
    return done.select(*keys, ts, (to_int16(F.col(_OUT)) if as_int16 else F.col(_OUT)).alias(value))


def band_filter(samples: DataFrame, fs: float = 30000.0, fl: float | None = None, fh: float | None = None, gpass: float = 0.1, gstop: float = 30.0, kind: str = "cheby2", max_len: int | None = None, idx: str | None = None, **options) -> DataFrame:
    """Design a low-, high- or band-pass filter and apply it; ``max_len`` keeps the first samples by ``idx`` only. Options of ``filter_segments``."""
    sos = design(*edges(fs, fl, fh), gpass, gstop, kind)
    if max_len is not None and max_len >= 0:
        samples = samples.where(F.col(idx or options.get("ts", "ts")) < max_len)
    return filter_segments(samples, sos, **options)


def preset_filter(samples: DataFrame, preset: Preset, **options) -> DataFrame:
    """``band_filter`` with the settings of a preset."""
    settings = {"buffer_len": preset.buffer_len, "overlap_len": preset.overlap_len} | options
    return band_filter(samples, preset.fs, preset.fl, preset.fh, preset.gpass, preset.gstop, **settings)


def butterworth(samples: DataFrame, low: float = 300.0, high: float = 6000.0, rate: float = 30000.0, **options) -> DataFrame:
    """Three-pole Butterworth band-pass, forward and back."""
    return filter_segments(samples, butter_band(low, high, rate), **({"as_int16": False} | options))


def frequency_response(spark, sos: np.ndarray, fs: float = 30000.0, points: int = 512) -> DataFrame:
    """(frequency, magnitude_db) at even steps below half the sampling rate."""
    s = [F.lit(float(x)) for x in np.asarray(sos).ravel()]
    w = F.col("k") * (np.pi / points)
    db = F.lit(0.0)
    for i in range(0, len(s), 6):
        for b, sign in ((s[i : i + 3], 10.0), (s[i + 3 : i + 6], -10.0)):
            re = b[0] + b[1] * F.cos(w) + b[2] * F.cos(2 * w)
            im = b[1] * F.sin(w) + b[2] * F.sin(2 * w)
            db = db + sign * F.log10(F.greatest(re * re + im * im, F.lit(1e-300)))
    return spark.range(points).withColumnRenamed("id", "k").select((F.col("k") * (fs / 2 / points)).alias("frequency"), db.alias("magnitude_db"))


def response_db(sos: np.ndarray, frequencies: np.ndarray, fs: float) -> np.ndarray:
    return 20 * np.log10(np.maximum(np.abs(response(sos, 2 * np.pi * np.asarray(frequencies) / fs)), 1e-15))
