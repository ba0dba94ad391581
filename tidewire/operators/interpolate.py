"""Linear filling of short gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_neighbour


def to_int16(value: Column) -> Column:
    """Truncate toward zero and saturate to 16 bits."""
    return F.greatest(F.least(value, F.lit(32767.0)), F.lit(-32768.0)).cast("long").cast("short")


def fill_gaps(samples: DataFrame, ts: str = "ts", value: str = "value", max_gap_size: int = 0, keys: list[str] | None = None, width: int | None = None, as_int16: bool = True) -> DataFrame:
    """(keys, ts, value): the samples and, in gaps of at most ``max_gap_size`` missing ones, linearly interpolated ones.

    Larger gaps stay. Values are truncated to 16 bits unless ``as_int16`` is false. Timestamps are distinct by key.
    """
    keys = keys or []
    plain = samples.select(*keys, ts, value)
    number = (lambda c: to_int16(c.cast("double"))) if as_int16 else (lambda c: c.cast("double"))
    if max_gap_size < 1:
        return plain.withColumn(value, number(F.col(value)))
    near = with_neighbour(plain, {"__t": ts, "__v": value}, [ts], keys, width, back=False)
    t0, v0, t1, v1 = F.col(ts), F.col(value), F.col("__t"), F.col("__v")
    missing = t1 - t0 - 1
    # Each row makes itself and the missing ones after it: no union, one pass.
    to = F.when(missing.between(1, max_gap_size), t1 - 1).otherwise(t0)
    rows = near.select(*keys, t0.alias("__t0"), v0.alias("__v0"), "__t", "__v", F.explode(F.sequence(t0, to)).alias(ts))
    t = F.col(ts)
    line = F.col("__v0") + (F.col("__v") - F.col("__v0")).cast("double") * (t - F.col("__t0")) / (F.col("__t") - F.col("__t0"))
    return rows.select(*keys, ts, number(F.when(t == F.col("__t0"), F.col("__v0")).otherwise(line)).alias(value))
