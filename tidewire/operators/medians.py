"""Exact medians of any number of values, by counts in narrowing ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distinct values of a range that one task may order.
MOST_VALUES = 1 << 20
#: Cells that a range is cut into.
CELLS = 1 << 12
ROUNDS = 8


def exact_median(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "median", most: int = MOST_VALUES) -> DataFrame:
    """(keys, median) of a numeric column as double: the middle value of each key, or the mean of the two middle ones; keys are few.

    Nulls and NaN are left out; keys without values have no row, and without keys an empty table gives a null. A first
    pass counts and bounds the values of each key. Where a range may hold too many distinct values to order, it is cut
    into cells, these are counted, and the range shrinks to the cells that hold the middle ones: sums by cell, whatever
    the number of rows.
    """
    keys = keys or []
    plain = df.select(*keys, F.col(value).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    plain = plain if keys else plain.withColumn("__all", F.lit(0))
    by = keys or ["__all"]
    ranges = plain.groupBy(*by).agg(F.count("*").alias("__n"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")).withColumn("__below", F.lit(0).cast("long"))
    first, second = F.floor((F.col("__n") - 1) / 2), F.floor(F.col("__n") / 2)  # places of the middle values, from 0 on
    spark = df.sparkSession
    for _ in range(ROUNDS):
        # One row a key: collected, so that every pass reads the values once.
        rows = ranges.collect()
        ranges = spark.createDataFrame(rows, ranges.schema)
        inside = plain.join(F.broadcast(ranges), by).where("__x >= __lo and __x <= __hi")
        if not rows or max(r["__n"] for r in rows) <= most:
            break
        # A cell holds [edge, next edge) by one monotonous function of the value, so cells are counted and cut alike.
        cell = F.least(F.floor((F.col("__x") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * CELLS), F.lit(CELLS - 1))
        celled = inside.withColumn("__cell", F.when(F.col("__hi") > F.col("__lo"), cell).otherwise(F.lit(0)).cast("long"))
        cells = celled.groupBy(*by, "__cell", "__n", "__below").agg(F.count("*").alias("__c"), F.min("__x").alias("__a"), F.max("__x").alias("__b"))
        before = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("__from", F.col("__below") + F.coalesce(F.sum("__c").over(before), F.lit(0)))
        held = cells.where((F.col("__from") <= second) & (F.col("__from") + F.col("__c") > first))
        new = held.groupBy(*by, "__n").agg(F.min("__a").alias("__lo"), F.max("__b").alias("__hi"), F.min("__from").alias("__below")).select(*by, "__n", "__lo", "__hi", "__below").collect()
        same = {tuple(r[k] for k in by): (r["__lo"], r["__hi"]) for r in rows} == {tuple(r[k] for k in by): (r["__lo"], r["__hi"]) for r in new}
        ranges = spark.createDataFrame(new, ranges.schema)
        inside = plain.join(F.broadcast(ranges), by).where("__x >= __lo and __x <= __hi")
        if same or inside.groupBy(*by).agg(F.count("*").alias("c")).where(F.col("c") > most).limit(1).count() == 0:
            break
    counts = inside.groupBy(*by, "__n", "__below", "__x").agg(F.count("*").alias("__c"))
    before = Window.partitionBy(*by).orderBy("__x").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__from", F.col("__below") + F.coalesce(F.sum("__c").over(before), F.lit(0)))
    holds = lambda at: (F.col("__from") <= at) & (F.col("__from") + F.col("__c") > at)
    out = counts.groupBy(*by).agg(((F.max(F.when(holds(first), F.col("__x"))) + F.max(F.when(holds(second), F.col("__x")))) / 2).alias(name))
    return out if keys else out.agg(F.max(name).alias(name))
