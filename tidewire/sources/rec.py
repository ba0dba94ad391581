"""Packet recordings as a data source: ``spark.read.format("tidewire_rec").load(path)``.

A file is an XML workspace that ends in a line ``</Configuration>``, then packets of one size: a header, a 32-bit
timestamp, and a 16-bit sample of every hardware channel, all little-endian.
"""

from __future__ import annotations

import glob
import os
import xml.etree.ElementTree as ET
from abc import ABC, abstractmethod
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "file_id int, path string, packet_no long, ts long, data array<short>"
# Fixed values of the format.
END, MAX_LINES, CARD = b"</Configuration>\n", 1000, 32


class PacketFormat(ABC):
    """A recording format: where a file's packets lie, and how a range of them is decoded."""

    @abstractmethod
    def layout(self, path: str) -> Layout: ...

    @abstractmethod
    def decode(self, path: str, layout: Layout, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        """Timestamps (n) and samples (n, channels in logical order) of ``count`` packets from ``first`` on."""

    def bounds(self, path: str) -> tuple[int, int] | None:
        """First and last timestamp by reading two packets; None without packets."""
        at = self.layout(path)
        if not at.packets:
            return None
        return int(self.decode(path, at, 0, 1)[0][0]), int(self.decode(path, at, at.packets - 1, 1)[0][0])


@dataclass(frozen=True)
class Layout:
    start: int
    header: int
    channels: int
    order: tuple[int, ...]
    packets: int
    ts_bytes: int = 4
    sample_bytes: int = 2

    @property
    def dtype(self) -> np.dtype:
        return np.dtype([("header", "u1", (self.header,)), ("ts", f"<u{self.ts_bytes}"), ("data", f"<i{self.sample_bytes}", (self.channels,))])


class RecFormat(PacketFormat):
    """Sizes in bytes of a packet's start, timestamp and samples, and the number of hardware channels (0: as the workspace says)."""

    def __init__(self, start_byte_size: int = 1, timestamp_size: int = 4, n_channels: int = 0, bytes_per_neural_channel: int = 2):
        if timestamp_size not in (2, 4, 8) or bytes_per_neural_channel not in (1, 2):
            raise ValueError("timestamps have 2, 4 or 8 bytes and samples 1 or 2")
        self.start_byte_size, self.timestamp_size, self.n_channels, self.bytes_per_neural_channel = start_byte_size, timestamp_size, n_channels, bytes_per_neural_channel

    @staticmethod
    def of(options: dict) -> RecFormat:
        named = ("start_byte_size", "timestamp_size", "n_channels", "bytes_per_neural_channel")
        return RecFormat(**{k: int(options[k]) for k in named if k in options})

    def layout(self, path: str) -> Layout:
        text = b""
        with open(path, "rb") as f:
            for _ in range(MAX_LINES):
                line = f.readline()
                text += line
                if line == END or not line:
                    break
        if not text.endswith(END):
            raise ValueError(f"{path}: no line ends the configuration")
        root = ET.fromstring(text)
        hardware = root.find("HardwareConfiguration")
        if hardware is None:
            raise ValueError(f"{path}: no HardwareConfiguration")
        channels = self.n_channels or int(hardware.attrib["numChannels"])
        if channels % CARD:
            raise ValueError(f"{path}: {channels} channels aren't a multiple of {CARD}")
        if not channels:
            raise ValueError(f"{path}: no channels")
        header = self.start_byte_size + sum(int(x.attrib.get("numBytes", 0)) for x in hardware)
        cards = channels // CARD
        wires = [int(x.attrib["hwChan"]) for x in root.iter("SpikeChannel")]
        order = tuple(w % CARD * cards + w // CARD for w in wires)
        at = Layout(len(text), header, channels, order, 0, self.timestamp_size, self.bytes_per_neural_channel)
        return replace(at, packets=(os.path.getsize(path) - len(text)) // at.dtype.itemsize)  # a cut-off last packet doesn't count

    def decode(self, path: str, layout: Layout, first: int, count: int) -> tuple[np.ndarray, np.ndarray]:
        rows = np.fromfile(path, layout.dtype, count, offset=layout.start + first * layout.dtype.itemsize)
        return rows["ts"].astype(np.int64), rows["data"][:, list(layout.order)].astype(np.int16)


@dataclass
class PacketRange(InputPartition):
    file_id: int
    path: str
    layout: Layout
    first: int
    count: int


def files_of(path: str) -> list[str]:
    """Files of a comma-separated list of paths, patterns and folders, sorted within each."""
    out: list[str] = []
    for part in path.split(","):
        part = part.strip().removeprefix("file://")
        out += sorted(glob.glob(os.path.join(part, "*.rec"))) if os.path.isdir(part) else sorted(glob.glob(part)) or [part]
    return out


class RecReader(DataSourceReader):
    """Ranges of packets of each file are partitions. Packets outside the timestamp bounds are left out where they are read: as timestamps may wrap or lie out of order, no range is judged by its ends."""

    def __init__(self, options: dict, form: PacketFormat | None = None):
        self.form = form or RecFormat.of(options)
        self.files = files_of(options["path"])
        self.per = int(options.get("packets_per_partition", 1 << 18))
        self.block = int(options.get("block_size", 8192))
        wanted = options.get("channels")
        self.channels = [int(x) for x in wanted.split(",")] if wanted else None
        self.low, self.high = -(1 << 63), (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("ts",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo):
                    self.low = max(self.low, f.value)
                if isinstance(f, LessThanOrEqual | LessThan | EqualTo):
                    self.high = min(self.high, f.value)
            yield f  # Spark filters the rows again

    def partitions(self) -> list[PacketRange]:
        out = []
        for i, path in enumerate(self.files):
            at = self.form.layout(path)
            for first in range(0, at.packets, self.per):
                out.append(PacketRange(i, path, at, first, min(self.per, at.packets - first)))
        return out or [PacketRange(-1, "", Layout(0, 0, 0, (), 0), 0, 0)]

    def read(self, partition: PacketRange) -> Iterator[pa.RecordBatch]:
        for first in range(partition.first, partition.first + partition.count, self.block):
            n = min(self.block, partition.first + partition.count - first)
            ts, data = self.form.decode(partition.path, partition.layout, first, n)
            number = np.arange(first, first + n)
            inside = (ts >= self.low) & (ts <= self.high)
            if not inside.all():
                ts, data, number, n = ts[inside], data[inside], number[inside], int(inside.sum())
            if not n:
                continue
            if self.channels is not None:
                data = data[:, self.channels]
            flat = pa.array(np.ascontiguousarray(data).ravel(), pa.int16())
            ends = pa.array(np.arange(n + 1, dtype=np.int32) * data.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, partition.file_id, np.int32)), pa.array([partition.path] * n), pa.array(number), pa.array(ts), pa.ListArray.from_arrays(ends, flat)],
                schema=pa.schema([("file_id", pa.int32()), ("path", pa.string()), ("packet_no", pa.int64()), ("ts", pa.int64()), ("data", pa.list_(pa.int16()))]),
            )


class RecSource(DataSource):
    """Options: ``path``, ``channels`` (e.g. ``9,3,0``: these logical channels in this order), ``packets_per_partition``, ``block_size``, and those of RecFormat."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_rec"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RecReader:
        return RecReader(self.options)

    def streamReader(self, schema):
        from ..streaming.recordings import RecStream

        return RecStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources of this package known to the session, with filters pushed down to them."""
    from .raw import RawSource

    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecSource)
    spark.dataSource.register(RawSource)


def read_rec(spark: SparkSession, path: str, **options) -> DataFrame:
    """Packets of one or several files; (file start, packet_no) is their order over files."""
    register(spark)
    return spark.read.format("tidewire_rec").options(**{k: str(v) for k, v in options.items()}).load(path)


def catalogue_of(spark: SparkSession, path: str, form: PacketFormat | None = None) -> DataFrame:
    """(file_id, path, start_ts, stop_ts) by reading each file's first and last packet only; files without packets are left out."""
    form = form or RecFormat()
    rows = [(i, p, *b) for i, p in enumerate(files_of(path)) if (b := form.bounds(p))]
    return spark.createDataFrame(rows, "file_id int, path string, start_ts long, stop_ts long")
