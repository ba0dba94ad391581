"""Spike detection: robust threshold, crossings, refractory censoring, waveform extraction, tetrodes, common reference."""

from __future__ import annotations

from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .medians import exact_median
from .ordered import width_for, with_neighbour

# Channels of each tetrode of the 16-channel probe.
TETRODES = {1: [16, 18, 17, 20], 2: [19, 22, 21, 24], 3: [23, 26, 25, 28], 4: [27, 30, 29, 32]}


class ProcessingError(Exception):
    """A processing step could not be carried out."""


def threshold(samples: DataFrame, value: str = "value", keys: list[str] | None = None, multiplier: float = 4, approx: bool = False) -> DataFrame:
    """(keys, threshold): multiplier * median(|value| / 0.6745), exact or from a mergeable sketch; no task holds a channel's values."""
    x = F.abs(F.col(value)) / 0.6745
    if approx:
        mid = samples.groupBy(*(keys or [])).agg(F.percentile_approx(x, 0.5, 10000).alias("__mid"))
    else:
        mid = exact_median(samples.select(*(keys or []), x.alias("__x")), "__x", keys, "__mid")
    return mid.select(*(keys or []), (F.lit(multiplier) * F.col("__mid")).alias("threshold"))


def crossings(samples: DataFrame, thr: Column, polarity: str = "pos", idx: str = "idx", value: str = "value", keys: list[str] | None = None, width: int | None = None, adjacent: bool = True) -> DataFrame:
    """Rows of samples that lie beyond the threshold together with the next sample; ``thr`` is positive.

    ``adjacent`` asks that the next sample's index follows at once, so nothing crosses a gap.
    """
    if polarity not in ("pos", "neg", "both"):
        raise ValueError("polarity is pos, neg or both")
    near = with_neighbour(samples.withColumn("__thr", thr), {"__v": value, "__i": idx}, [idx], keys, width, back=False)
    v, nxt, t = F.col(value), F.col("__v"), F.col("__thr")
    above, below = (v > t) & (nxt > t), (v < -t) & (nxt < -t)
    beyond = {"pos": above, "neg": below, "both": above | below}[polarity]
    close = (F.col("__i") == F.col(idx) + 1) if adjacent else F.lit(True)
    return near.where(beyond & close).drop("__v", "__i", "__thr")


def _last_kept(t: np.ndarray, width) -> list[int]:
    """For each event of sorted ones, the last event kept if it is kept."""
    after = np.searchsorted(t, t + width, "right").tolist()
    out = list(range(len(t)))
    for i in range(len(t) - 1, -1, -1):
        if after[i] < len(t):
            out[i] = out[after[i]]
    return out


def censor(events: DataFrame, t: str = "idx", width: int = 30, keys: list[str] | None = None, span: int | None = None) -> DataFrame:
    """(keys, t) kept by a refractory period: the first, then each later than ``width`` after the last kept one.

    The order is cut into buckets of ``span`` units, by default of about ordered.ROWS events. Which event a bucket keeps
    first depends on the last kept one before it, and lies within ``width`` of its first event: a bucket tells, for each
    of these, the last event it would then keep. A walk over these tables, a row a bucket, gives every bucket the event
    before it, and buckets are then censored side by side, in time linear in their events. No events give none.
    """
    by = keys or ["__all"]
    plain = events.select(*(keys or []), t).where(F.col(t).isNotNull()).distinct()
    plain = plain if keys else plain.withColumn("__all", F.lit(0))
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    span = width_for(plain, t, span, keys or [])
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in by)
    kind = to_arrow_type(plain.schema[t].dataType)

    def times(table: pa.Table) -> np.ndarray:
        return np.sort(table.column(t).to_numpy())

    def told(table: pa.Table) -> pa.Table:
        x = times(table)
        k = int(np.searchsorted(x, x[0] + width, "right")) + 1
        last = x[_last_kept(x, width)[:k]]
        one = table.slice(0, 1).select([*by, "__b"])
        return one.append_column("__from", pa.array([x[:k]], pa.list_(kind))).append_column("__to", pa.array([last], pa.list_(kind)))

    def walked(table: pa.Table) -> pa.Table:
        table = table.sort_by("__b")
        last, before = None, []
        for first, to in zip(table.column("__from").to_pylist(), table.column("__to").to_pylist(), strict=True):
            before.append(last)
            i = 0 if last is None else bisect_right(first, last + width)
            last = to[i] if i < len(to) else last
        return table.select([*by, "__b"]).append_column("__before", pa.array(before, kind))

    def kept(table: pa.Table) -> pa.Table:
        x, last = times(table), table.column("__before")[0].as_py()
        after = np.searchsorted(x, x + width, "right").tolist()
        i, found = 0 if last is None else int(np.searchsorted(x, last + width, "right")), []
        while i < len(x):
            found.append(i)
            i = after[i]
        return table.slice(0, len(found)).select(by).append_column(t, pa.array(x[found], kind))

    if span is None:
        cut = plain.withColumn("__before", F.lit(None).cast(kinds[t]))
        out = cut.groupBy(*by).applyInArrow(kept, f"{fields}, `{t}` {kinds[t]}")
    else:
        cut = plain.withColumn("__b", F.floor(F.col(t) / max(span, width + 1)).cast("long"))
        tables = cut.groupBy(*by, "__b").applyInArrow(told, f"{fields}, __b long, __from array<{kinds[t]}>, __to array<{kinds[t]}>")
        walk = tables.groupBy(*by).applyInArrow(walked, f"{fields}, __b long, __before {kinds[t]}")
        out = cut.join(walk, [*by, "__b"]).groupBy(*by, "__b").applyInArrow(kept, f"{fields}, `{t}` {kinds[t]}")
    return out.select(*(keys or []), t)


def _near(samples: DataFrame, peaks: DataFrame, at: str, low: Column, high: Column, idx: str, value: str, keys: list[str], bucket: int) -> DataFrame:
    """Samples within [low, high) of each peak: the peak goes to the one or two buckets it meets, so the join is by equality."""
    wanted = peaks.withColumn("__lo", low).withColumn("__hi", high)
    wanted = wanted.withColumn("__b", F.explode(F.sequence(F.floor(F.col("__lo") / bucket), F.floor((F.col("__hi") - 1) / bucket))))
    placed = samples.select(*keys, F.col(idx).alias("__i"), F.col(value).alias("__v"), F.floor(F.col(idx) / bucket).alias("__b"))
    return placed.join(wanted, [*keys, "__b"]).where((F.col("__i") >= F.col("__lo")) & (F.col("__i") < F.col("__hi")))


def extract(samples: DataFrame, peaks: DataFrame, patch_size: int = 30, offset: int = 0, polarity: str = "neg", idx: str = "idx", value: str = "value", peak: str = "peak", keys: list[str] | None = None, bucket: int = 4096) -> DataFrame:
    """(keys, peak, peak_idx, waveform): a patch of ``patch_size`` samples round the extreme near each peak.

    The extreme (minimum for ``neg``, maximum for ``pos``, the first of equals) is sought in half a patch to each side,
    from index 0 on; the patch is centred on it plus ``offset``. Samples missing at its end are zeros, and an odd
    size has one zero at the end.
    """
    keys = keys or []
    half = patch_size // 2
    want = peaks.select(*keys, F.col(peak).cast("long").alias(peak)).distinct()
    around = _near(samples, want, peak, F.greatest(F.col(peak) - half, F.lit(0).cast("long")), F.col(peak) + half, idx, value, keys, max(bucket, patch_size))
    order = F.struct(F.col("__v") if polarity == "neg" else -F.col("__v"), F.col("__i"))
    centres = around.groupBy(*keys, peak).agg(F.min_by("__i", order).cast("long").alias("peak_idx"))
    centre = F.col("peak_idx") + offset
    patches = _near(samples, centres, "peak_idx", F.greatest(centre - half, F.lit(0).cast("long")), centre + half, idx, value, keys, max(bucket, patch_size))
    rows = patches.groupBy(*keys, peak, "peak_idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__v"))), lambda x: x["__v"].cast("double")).alias("waveform"))
    padded = F.concat("waveform", F.array_repeat(F.lit(0.0), F.greatest(F.lit(patch_size) - F.size("waveform"), F.lit(0))))
    return rows.select(*keys, peak, "peak_idx", padded.alias("waveform"))


def detect_spikes(samples: DataFrame, multiplier: float = 4, patch_size: int = 30, offset: int = 0, idx: str = "idx", value: str = "value", keys: list[str] | None = None, width: int | None = None, polarity: str = "neg") -> DataFrame:
    """(keys, times, spikes): threshold, crossings, censoring over 30 samples, and patches. The thresholds, a row a channel, are broadcast."""
    keys = keys or []
    thr = threshold(samples, value, keys, multiplier)
    with_thr = samples.join(F.broadcast(thr), keys) if keys else samples.crossJoin(F.broadcast(thr))
    events = censor(crossings(with_thr, F.col("threshold"), polarity, idx, value, keys, width), idx, 30, keys, width)
    found = extract(samples, events.withColumnRenamed(idx, "peak"), patch_size, offset, polarity, idx, value, "peak", keys)
    return found.select(*keys, F.col("peak_idx").cast("double").alias("times"), F.col("waveform").alias("spikes"))


def tetrode_channels(lookup: DataFrame, tetrode: str) -> DataFrame:
    """Rows with the array of their tetrode's ``channels``; an unknown tetrode raises an error when its row is read."""
    table = F.create_map(*[x for t, c in TETRODES.items() for x in (F.lit(t), F.array(*map(F.lit, c)))])
    found = F.try_element_at(table, F.col(tetrode).cast("int"))
    return lookup.withColumn("channels", F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("no tetrode "), F.col(tetrode).cast("string")))))


def form_tetrode(samples: DataFrame, times: DataFrame, channels: list, patch_size: int = 30, offset: int = 0, rate: float = 30000.0, limit: float = 300.0, channel: str = "channel", idx: str = "idx", value: str = "value", time: str = "time", keys: list[str] | None = None) -> DataFrame:
    """(keys, times, spikes): each shared time's patches of all channels, one after another, in seconds.

    Spikes with any sample outside (-limit, limit) go, and those without samples on every channel.
    """
    keys = keys or []
    want = times.select(*keys, F.col(time).alias("peak")).distinct().withColumn(channel, F.explode(F.array(*map(F.lit, channels))))
    patches = extract(samples.where(F.col(channel).isin(channels)), want, patch_size, offset, "neg", idx, value, "peak", [*keys, channel])
    place = F.array_position(F.array(*map(F.lit, channels)), F.col(channel))
    rows = patches.groupBy(*keys, "peak").agg(F.sort_array(F.collect_list(F.struct(place.alias("p"), "waveform"))).alias("w")).where(F.size("w") == len(channels))
    rows = rows.withColumn("spikes", F.flatten(F.transform("w", lambda x: x["waveform"])))
    return rows.where(F.forall("spikes", lambda v: (v < limit) & (v > -limit))).select(*keys, (F.col("peak") / rate).alias("times"), "spikes")


def common_reference(samples: DataFrame, value: str = "value", by: list[str] | None = None) -> DataFrame:
    """Samples with ``reference``, the mean of all channels at the same ``by``, and ``rereferenced``, the value without it."""
    w = Window.partitionBy(*(by or ["idx"]))
    return samples.withColumn("reference", F.avg(value).over(w)).withColumn("rereferenced", F.col(value) - F.col("reference"))


def map_groups(df: DataFrame, keys: list[str], func, schema: str) -> DataFrame:
    """``func`` over the pandas frame of each group, in parallel; order it by a column of its own."""
    return df.groupBy(*keys).applyInPandas(func, schema)


def scale_raw(samples: DataFrame, raw: str = "raw", per_bit: float = 4096.0 / 2**15) -> DataFrame:
    """Samples with ``value``: raw counts in microvolts."""
    return samples.withColumn("value", F.col(raw) * per_bit)
