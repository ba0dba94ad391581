"""From packets of all channels to channels of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .interpolate import fill_gaps
from .timestamps import check, sanitise


def pick_channels(data: Column, order: list[int]) -> Column:
    """The values of an array at the given places, in that order."""
    return F.transform(F.array(*map(F.lit, order)), lambda i: F.get(data, i))


def stitch(packets: DataFrame, catalogue: DataFrame, file: str = "file_id") -> DataFrame:
    """Packets with their file's ``start_ts``: (start_ts, packet_no) orders them over all files. The catalogue has a row a file."""
    return packets.join(catalogue.select(F.col("file_id").alias(file), "start_ts"), file)


def to_long(packets: DataFrame, data: str = "data", channels: list[int] | None = None, keep: list[str] | None = None) -> DataFrame:
    """(keep, channel, value): a row for each packet and wanted channel."""
    keep = keep or [c for c in packets.columns if c != data]
    if channels is None:
        return packets.select(*keep, F.posexplode(data).alias("channel", "value"))
    pairs = F.array(*(F.struct(F.lit(c).alias("channel"), F.get(F.col(data), F.lit(c)).alias("value")) for c in channels))
    return packets.select(*keep, F.inline(pairs))


def extract_channels(packets: DataFrame, ts: str = "ts", packet: str = "packet_no", data: str = "data", channels: list[int] | None = None, max_gap_size: int = 0, width: int | None = 1 << 20) -> DataFrame:
    """(channel, ts, value): duplicates dropped, short gaps filled, wanted channels only, before any of it is spread out.

    Packets are deduplicated by timestamp once for all channels; only wanted channels are exploded and filled.
    """
    once = sanitise(packets.select(ts, packet, data), ts, packet)
    long = to_long(once, data, channels, [ts])
    return fill_gaps(long, ts, "value", max_gap_size, ["channel"], width)


def write_channels(samples: DataFrame, path: str, validate: bool = True, ts: str = "ts") -> None:
    """Write samples as Parquet by channel, sorted by timestamp; then read them again and check the timestamps."""
    samples.repartition("channel", F.floor(F.col(ts) / (1 << 22))).sortWithinPartitions("channel", ts).write.partitionBy("channel").parquet(path)
    if validate:
        back = samples.sparkSession.read.parquet(path)
        bad = check(back, ts, [ts], ["channel"]).where("not ok").limit(1).collect()
        if bad:
            raise ValueError(f"timestamps of channel {bad[0]['channel']} aren't sorted, distinct and integral")


def channel_file_name(channel: Column, channels: int, prefix: str = "") -> Column:
    """Name of a channel's raw file: the number padded to the width of the number of channels."""
    return F.concat(F.lit(f"{prefix}ch."), F.lpad(channel.cast("string"), len(str(channels)), "0"), F.lit(".raw"))
