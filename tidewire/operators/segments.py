"""Contiguous segments of timestamps, and what follows from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .medians import exact_median
from .ordered import with_index, with_neighbour


def _by(keys: list[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def segments(df: DataFrame, ts: str, step: float | None = 1, keys: list[str] | None = None, width: int | None = None, order: list[str] | None = None, strict: bool = False) -> DataFrame:
    """(keys, start_ts, stop_ts, start_idx, stop_idx): half-open segments of timestamps and of their sorted positions.

    A segment ends where the next timestamp is at least 2 * ``step`` later; with ``strict`` wherever it isn't exactly
    1 later, so duplicates end one too and ``step`` moves the stop alone. ``step=None`` takes the exact median step of
    each key. Only the rows at which segments begin are ordered globally.
    """
    keys = keys or []
    order = order or [ts]
    numbered = with_index(df.where(F.col(ts).isNotNull()), "__idx", order, keys, width)
    near = with_neighbour(numbered, {"__before": ts}, order, keys, width)
    if step is None:
        steps = exact_median(near.select(*keys, (F.col(ts) - F.col("__before")).alias("__d")), "__d", keys, "__step")
        near = near.join(F.broadcast(steps), keys) if keys else near.crossJoin(F.broadcast(steps))  # one row a key
    else:
        near = near.withColumn("__step", F.lit(step))
    diff = F.col(ts) - F.col("__before")
    begins = F.col("__before").isNull() | ((diff != 1) if strict else (diff >= 2 * F.col("__step")))
    ends = near.groupBy(*keys).agg(F.max(ts).alias("__last"), (F.max("__idx") + 1).alias("__count"))
    starts = near.where(begins).select(*keys, F.col(ts).alias("start_ts"), "__before", "__step", F.col("__idx").alias("start_idx"))
    w = _by(keys).orderBy("start_idx")
    starts = starts.withColumn("__stop", F.lead("__before").over(w)).withColumn("stop_idx", F.lead("start_idx").over(w))
    starts = starts.join(F.broadcast(ends), keys, "left") if keys else starts.crossJoin(F.broadcast(ends))
    kind = df.schema[ts].dataType
    stop = (F.coalesce("__stop", "__last") + F.col("__step")).cast(kind) if step is None or float(step).is_integer() else F.coalesce("__stop", "__last") + F.col("__step")
    return starts.select(*keys, "start_ts", stop.alias("stop_ts"), "start_idx", F.coalesce("stop_idx", "__count").alias("stop_idx"))


def inclusive_indices(found: DataFrame) -> DataFrame:
    """Segments with the index of their last row in place of the one after it."""
    return found.withColumn("stop_idx", F.col("stop_idx") - 1)


def gap_lengths(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, start_ts, gap): samples missing between each segment and the next, from ``segments``."""
    w = _by(keys or []).orderBy("start_idx")
    return found.withColumn("gap", F.lead("start_ts").over(w) - F.col("stop_ts")).where("gap is not null").select(*(keys or []), "start_ts", "gap")


def index_epochs(found: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, start_ts, start, stop): index ranges that segments of ``stop_ts - start_ts`` samples take one after another."""
    w = _by(keys or []).orderBy("start_ts").rowsBetween(Window.unboundedPreceding, 0)
    length = F.col("stop_ts") - F.col("start_ts")
    return found.withColumn("stop", F.sum(length).over(w)).select(*(keys or []), "start_ts", (F.col("stop") - length).alias("start"), "stop")


def in_segment(samples: DataFrame, found: DataFrame, ts: str, keys: list[str] | None = None, bucket: int = 65536) -> DataFrame:
    """Samples joined with the segment (``start_ts``, ``stop_ts``) that holds them: a range join by equal buckets."""
    keys = keys or []
    spread = found.withColumn("__b", F.explode(F.sequence(F.floor(F.col("start_ts") / bucket), F.floor((F.col("stop_ts") - 1) / bucket))))
    placed = samples.withColumn("__b", F.floor(F.col(ts) / bucket))
    return placed.join(spread, [*keys, "__b"]).where((F.col(ts) >= F.col("start_ts")) & (F.col(ts) < F.col("stop_ts"))).drop("__b")
