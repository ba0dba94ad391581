"""The catalogue of a session's files: (file_id, path, start_ts, stop_ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formatting import pretty_duration


def build(packets: DataFrame, file: str, ts: str) -> DataFrame:
    """First and last timestamp of each file: one aggregation with map-side combining."""
    return packets.groupBy(F.col(file).alias("file_id")).agg(F.min(ts).alias("start_ts"), F.max(ts).alias("stop_ts"))


def add_files(catalogue: DataFrame, more: DataFrame) -> DataFrame:
    """Both catalogues' files; files named twice stay twice. Files that stop before they start raise an error when read."""
    ok = F.assert_true(F.col("start_ts") <= F.col("stop_ts"), F.lit("a file stops before it starts"))
    return catalogue.unionByName(more).where(ok.isNull())


def in_order(catalogue: DataFrame) -> DataFrame:
    """Files sorted by start, with their number ``position``."""
    w = Window.partitionBy(F.lit(0)).orderBy("start_ts", "file_id")  # a row for each file
    return catalogue.withColumn("position", (F.row_number().over(w) - 1).cast("long")).orderBy("position")


def bounds(catalogue: DataFrame, fs: float = 30000.0) -> DataFrame:
    """Bounds of each file in samples and seconds."""
    return catalogue.select("file_id", "start_ts", "stop_ts", (F.col("start_ts") / fs).alias("start_s"), (F.col("stop_ts") / fs).alias("stop_s"))


def extents(catalogue: DataFrame, fs: float = 30000.0) -> DataFrame:
    """One row: the first start, the stop of the file that starts last, both in seconds too; infinite for no files."""
    inf = float("inf")
    return catalogue.agg(F.min("start_ts").cast("double").alias("a"), F.max_by("stop_ts", F.struct("start_ts", "file_id")).cast("double").alias("b")).select(
        F.coalesce("a", F.lit(inf)).alias("start"), F.coalesce("b", F.lit(-inf)).alias("stop"),
        F.coalesce(F.col("a") / fs, F.lit(inf)).alias("start_time"), F.coalesce(F.col("b") / fs, F.lit(-inf)).alias("stop_time"),
    )


def durations(catalogue: DataFrame, fs: float = 30000.0) -> DataFrame:
    """(file_id, duration) in seconds."""
    return catalogue.select("file_id", ((F.col("stop_ts") - F.col("start_ts")) / fs).alias("duration"))


def summary(catalogue: DataFrame, fs: float = 30000.0) -> DataFrame:
    """One row: number of files, emptiness, durations with and without gaps between files, sum of these gaps, and a text."""
    w = Window.partitionBy(F.lit(0)).orderBy("start_ts", "file_id")
    gaps = catalogue.withColumn("gap", F.lead("start_ts").over(w) - F.col("stop_ts"))
    one = gaps.agg(
        F.count("*").alias("n_files"), F.coalesce(F.sum(F.col("stop_ts") - F.col("start_ts")) / fs, F.lit(0.0)).alias("duration_wo_gaps"),
        F.coalesce(F.sum("gap") / fs, F.lit(0.0)).alias("inter_gap"), F.min("start_ts").alias("a"), F.max_by("stop_ts", F.struct("start_ts", "file_id")).alias("b"),
    )
    out = one.withColumn("is_empty", F.col("n_files") == 0).withColumn("duration_w_gaps", F.coalesce((F.col("b") - F.col("a")) / fs, F.lit(0.0)))
    text = F.concat(F.lit("<file map: "), F.col("n_files").cast("string"), F.lit(" files> "), pretty_duration(F.col("duration_wo_gaps")))
    return out.select("n_files", "is_empty", "duration_w_gaps", "duration_wo_gaps", "inter_gap", F.when(F.col("is_empty"), F.lit("<empty file map>")).otherwise(text).alias("repr"))


def request(samples: DataFrame, start: float, stop: float, ts: str = "ts", fs: float | None = None) -> DataFrame:
    """Samples between two sample numbers, both included (or seconds, with ``fs``); the filter reaches the scan.

    Raises ValueError if the range isn't within the data's bounds, which are read off the files' statistics.
    """
    if start > stop:
        raise ValueError("start lies after stop")
    lo, hi = (start * fs, stop * fs) if fs else (start, stop)
    low, high = samples.agg(F.min(ts), F.max(ts)).first()
    if low is None or lo < low or hi > high:
        raise ValueError(f"{lo} to {hi} isn't within the data's bounds {low} to {high}")
    return samples.where(F.col(ts).between(lo, hi))
