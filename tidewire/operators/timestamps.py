"""Checks and cleaning of sample timestamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import with_index, with_neighbour


def is_sorted(df: DataFrame, value: str, order: list[str], keys: list[str] | None = None, width: int | None = None, accept: Column | None = None) -> DataFrame:
    """(keys, is_sorted): no value is below the one before it. ``accept`` may judge pairs (``previous``, value) otherwise. Empty data is sorted."""
    pairs = with_neighbour(df, {"previous": value}, order, keys, width)
    ok = (F.col(value) >= F.col("previous")) if accept is None else accept
    return pairs.groupBy(*(keys or [])).agg(F.coalesce(F.bool_and(ok | F.col("previous").isNull()), F.lit(True)).alias("is_sorted"))


def pairwise(df: DataFrame, value: str, order: list[str], keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """(keys, a, b): every two adjacent values in order."""
    following = with_neighbour(df, {"b": value, "__has": order[0]}, order, keys, width, back=False)
    return following.where("__has is not null").select(*(keys or []), F.col(value).alias("a"), "b")


def argsort(df: DataFrame, value: str, idx: str, keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """(keys, rank, idx): the stable order that sorts ``value``."""
    return with_index(df, "rank", [value, idx], keys, width).select(*(keys or []), "rank", idx)


def has_duplicates(df: DataFrame, ts: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, has_duplicates): any timestamp occurs twice. Counts by timestamp are summed before they meet."""
    per = df.groupBy(*(keys or []), ts).agg(F.count("*").alias("n"))
    return per.groupBy(*(keys or [])).agg(F.coalesce(F.max("n") > 1, F.lit(False)).alias("has_duplicates"))


def duplicate_indices(df: DataFrame, ts: str, order: list[str], keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """(keys, dup_index): sorted positions of the second and further occurrences of a timestamp."""
    numbered = with_index(df, "dup_index", order, keys, width)
    near = with_neighbour(numbered, {"previous": ts}, order, keys, width)
    return near.where(F.col(ts) - F.col("previous") < 1).select(*(keys or []), "dup_index")


def distinct_differences(df: DataFrame, ts: str, order: list[str], keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """(keys, diff): the inventory of steps between neighbours."""
    near = with_neighbour(df, {"previous": ts}, order, keys, width).where("previous is not null")
    return near.select(*(keys or []), (F.col(ts) - F.col("previous")).alias("diff")).distinct()


def integral(value: Column) -> Column:
    """True if a value of any type can be read as an integral number."""
    number = value.try_cast("double")
    return F.coalesce((number == F.floor(number)) & (F.abs(number) < float("inf")), F.lit(False))


def all_integral(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, all_integral) of all rows; empty data is integral."""
    return df.groupBy(*(keys or [])).agg(F.coalesce(F.bool_and(integral(F.col(value))), F.lit(True)).alias("all_integral"))


def sanitise(df: DataFrame, ts: str, packet: str, keys: list[str] | None = None) -> DataFrame:
    """The first row by ``packet`` of each timestamp, all columns kept; rows with a null timestamp go.

    One aggregation by (keys, ts) with map-side combining picks the survivor, so no window sorts the channel.
    """
    keys = keys or []
    rest = [c for c in df.columns if c not in (*keys, ts)]
    first = df.where(F.col(ts).isNotNull()).groupBy(*keys, ts).agg(F.min_by(F.struct(*rest), packet).alias("__row"))
    return first.select(*[F.col(c) if c in (*keys, ts) else F.col(f"__row.{c}").alias(c) for c in df.columns])


def check(df: DataFrame, ts: str, order: list[str], keys: list[str] | None = None, width: int | None = None) -> DataFrame:
    """(keys, is_sorted, n_duplicates, n_not_integral, ok) of timestamps in the order of their rows."""
    near = with_neighbour(df, {"previous": ts}, order, keys, width)
    step = F.col(ts) - F.col("previous")
    out = near.groupBy(*(keys or [])).agg(
        F.coalesce(F.bool_and(F.coalesce(step >= 0, F.lit(True))), F.lit(True)).alias("is_sorted"),
        F.count(F.when(step == 0, 1)).alias("n_duplicates"),
        F.count(F.when(~integral(F.col(ts)), 1)).alias("n_not_integral"),
    )
    return out.withColumn("ok", F.col("is_sorted") & (F.col("n_duplicates") == 0) & (F.col("n_not_integral") == 0))
