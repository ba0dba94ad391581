"""Neighbours, running values and row numbers along an ordered column.

A window over one whole channel, or over data without a channel, puts it all in one task. With ``width`` these
operators cut the order into buckets of that many units: windows run inside a bucket, and what a bucket needs from those
before it comes from a table of one row a bucket. Without ``width`` a pass over the ordering column chooses one, of
about ROWS rows a bucket; only tables of no more rows than that, and orders that aren't numbers, are plain windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

_B = "__bucket"
#: Rows of a bucket, about, where no width is given.
ROWS = 1 << 20


def width_for(df: DataFrame, order: str, width: int | None, keys: list[str]) -> int | None:
    """The width given, or one that puts about ROWS rows into each bucket of each key if they lie evenly; None for a plain window."""
    if width is not None or df.isStreaming or not isinstance(df.schema[order].dataType, NumericType):
        return width
    low, high, n = df.agg(F.min(order), F.max(order), F.count("*")).first()
    if n <= ROWS or low is None or low == high:
        return None
    each = n / max(1, df.select(*keys).distinct().count()) if keys else n
    return max(1, math.ceil((high - low) * ROWS / max(each, ROWS)))



def _window(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _bucketed(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(order) / width))


def _borders(df: DataFrame, keys: list[str], value: Column, width: int, back: bool) -> DataFrame:
    """(keys, bucket, __border): ``value`` summed up by bucket, moved on to the next bucket that has rows."""
    w = _window(keys).orderBy(F.col(_B) if back else F.col(_B).desc())
    return df.groupBy(*keys, _B).agg(value.alias("__v")).withColumn("__border", F.lag("__v").over(w)).drop("__v")


def with_neighbour(df: DataFrame, made: dict[str, str], order: list[str], keys: list[str] | None = None, width: int | None = None, back: bool = True) -> DataFrame:
    """Add columns that hold another column's value in the row before (``back``) or after; null at the ends.

    ``order`` is the ordering columns; the first is numeric. Ties follow the further ones.
    """
    keys = keys or []
    step = F.lag if back else F.lead
    width = width_for(df, order[0], width, keys)
    if width is None:
        w = _window(keys).orderBy(*order)
        return df.select("*", *(step(c).over(w).alias(name) for name, c in made.items()))
    df = _bucketed(df, order[0], width)
    inner = Window.partitionBy(*keys, _B).orderBy(*order)
    pick = F.max_by if back else F.min_by
    borders = _borders(df, keys, pick(F.struct(*(F.col(c).alias(n) for n, c in made.items())), F.struct(*order)), width, back)
    row = df.select("*", step(F.struct(*(F.col(c).alias(n) for n, c in made.items()))).over(inner).alias("__near"))
    out = row.join(borders, [*keys, _B], "left").withColumn("__near", F.coalesce("__near", "__border"))
    return out.select(*[c for c in df.columns if c != _B], *(F.col(f"__near.{n}").alias(n) for n in made))


def with_latest(df: DataFrame, name: str, value: Column, order: list[str], keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Add the last non-null ``value`` up to and including each row."""
    keys = keys or []
    df = df.withColumn("__value", value)
    width = width_for(df, order[0], width, keys)
    if width is None:
        w = _window(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(name, F.last("__value", ignorenulls=True).over(w)).drop("__value")
    df = _bucketed(df, order[0], width)
    inner = Window.partitionBy(*keys, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = df.where("__value is not null").groupBy(*keys, _B).agg(F.max_by("__value", F.struct(*order)).alias("__v"))
    every = df.select(*keys, _B).distinct().join(last, [*keys, _B], "left")
    before = _window(keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    borders = every.withColumn("__border", F.last("__v", ignorenulls=True).over(before)).drop("__v")
    out = df.withColumn("__in", F.last("__value", ignorenulls=True).over(inner)).join(borders, [*keys, _B], "left")
    return out.withColumn(name, F.coalesce("__in", "__border")).drop(_B, "__in", "__border", "__value")


def with_index(df: DataFrame, name: str, order: list[str], keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """Add the 0-based number of each row along the order (long)."""
    keys = keys or []
    width = width_for(df, order[0], width, keys)
    if width is None:
        return df.withColumn(name, (F.row_number().over(_window(keys).orderBy(*order)) - 1).cast("long"))
    df = _bucketed(df, order[0], width)
    before = _window(keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*keys, _B).agg(F.count("*").alias("__n")).withColumn("__from", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inner = Window.partitionBy(*keys, _B).orderBy(*order)
    out = df.withColumn("__i", F.row_number().over(inner)).join(counts, [*keys, _B])
    return out.withColumn(name, (F.col("__from") + F.col("__i") - 1).cast("long")).drop(_B, "__i", "__from")
