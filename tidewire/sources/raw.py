"""Raw channel files: 16-bit samples without a header, beside a file of 32-bit timestamps; read and written."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "idx long, ts long, value short"


@dataclass
class ElementRange(InputPartition):
    first: int
    count: int


class RawReader(DataSourceReader):
    """Ranges of elements; both files are read at the same places. Without timestamps ``ts`` is the index."""

    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.times = options.get("timestamps")
        self.dtype = np.dtype(options.get("dtype", "<i2"))
        self.ts_dtype = np.dtype(options.get("timestamps_dtype", "<u4"))
        self.per = int(options.get("elements_per_partition", 1 << 24))
        self.block = int(options.get("block_size", 1 << 16))

    def partitions(self) -> list[ElementRange]:
        n = os.path.getsize(self.path) // self.dtype.itemsize
        if self.times:
            n = min(n, os.path.getsize(self.times) // self.ts_dtype.itemsize)
        return [ElementRange(i, min(self.per, n - i)) for i in range(0, n, self.per)] or [ElementRange(0, 0)]

    def read(self, partition: ElementRange) -> Iterator[pa.RecordBatch]:
        for first in range(partition.first, partition.first + partition.count, self.block):
            n = min(self.block, partition.first + partition.count - first)
            value = np.fromfile(self.path, self.dtype, n, offset=first * self.dtype.itemsize)
            idx = np.arange(first, first + n)
            ts = np.fromfile(self.times, self.ts_dtype, n, offset=first * self.ts_dtype.itemsize).astype(np.int64) if self.times else idx
            yield pa.RecordBatch.from_arrays([pa.array(idx), pa.array(ts), pa.array(value.astype(np.int16))], ["idx", "ts", "value"])


@dataclass
class Part:
    """A file with the samples of one channel from one task, and one with their timestamps."""

    channel: int
    first: int
    last: int
    count: int
    base: str


@dataclass
class Wrote(WriterCommitMessage):
    parts: list[Part]


class RawWriter(DataSourceArrowWriter):
    """Rows (channel, ts, value), by channel and sorted, become ``<prefix>ch.<nn>.raw``; the least channel's timestamps ``<prefix>timestamps.raw``.

    Tasks write parts of their own to the shared folder. The commit checks that each channel's timestamps strictly grow
    over all parts, and only then are these laid out, in the order of their first timestamps: by the commit itself or,
    with the option ``manifest``, by tasks that ``write_raw`` starts from the list of parts that is left there.
    """

    def __init__(self, options: dict):
        self.folder, self.prefix = options["path"].removeprefix("file://"), options.get("prefix", "")
        self.width, self.manifest = len(str(options.get("channels", "0"))), options.get("manifest")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Wrote:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        parts: dict[int, Part] = {}
        who = TaskContext.get().taskAttemptId()
        for batch in iterator:
            channel, ts, value = (batch.column(c).to_numpy() for c in ("channel", "ts", "value"))
            edge = np.flatnonzero(np.diff(channel, prepend=channel[0] - 1, append=channel[-1] + 1)) if len(channel) else []
            for a, b in zip(edge[:-1], edge[1:], strict=True):
                c = int(channel[a])
                part = parts.setdefault(c, Part(c, int(ts[a]), int(ts[a]) - 1, 0, os.path.join(self.folder, f".{c}-{who}-{uuid.uuid4().hex}")))
                if (np.diff(ts[a:b], prepend=part.last) <= 0).any():
                    _remove(parts.values())
                    raise ValueError(f"channel {c}: timestamps don't strictly grow")
                part.last, part.count = int(ts[b - 1]), part.count + int(b - a)
                for end, x, kind in ((".value", value, "<i2"), (".time", ts, "<u4")):
                    with open(part.base + end, "ab") as f:
                        f.write(x[a:b].astype(kind).tobytes())
        return Wrote(list(parts.values()))

    def commit(self, messages: list[Wrote | None]) -> None:
        parts = sorted((p for m in messages if m for p in m.parts), key=lambda p: (p.channel, p.first))
        for x, y in zip(parts, parts[1:], strict=False):
            if x.channel == y.channel and y.first <= x.last:
                _remove(parts)
                raise ValueError(f"channel {x.channel}: timestamps don't strictly grow")
        plan = laid_out(parts, self.folder, self.prefix, self.width)
        if self.manifest:
            with open(self.manifest, "w") as f:
                json.dump([[vars(p) for p in parts], plan], f)
            return
        for move in plan:
            copy_part(*move)
        finish(plan, parts)

    def abort(self, messages: list[Wrote | None]) -> None:
        _remove(p for m in messages if m for p in m.parts)


def _remove(parts) -> None:
    for path in (p.base + end for p in parts for end in (".value", ".time")):
        if os.path.exists(path):
            os.remove(path)


def laid_out(parts: list[Part], folder: str, prefix: str, width: int) -> list[tuple[str, str, int]]:
    """(part's file, final file, byte offset) of sorted parts."""
    plan, at = [], {}
    for p in parts:
        name = os.path.join(folder, f"{prefix}ch.{str(p.channel).zfill(width)}.raw")
        plan.append((p.base + ".value", name, 2 * at.get(p.channel, 0)))
        if p.channel == parts[0].channel:
            plan.append((p.base + ".time", os.path.join(folder, f"{prefix}timestamps.raw"), 4 * at.get(p.channel, 0)))
        at[p.channel] = at.get(p.channel, 0) + p.count
    return plan


def copy_part(source: str, name: str, offset: int) -> None:
    """Copy a part to its place; again after a lost task, it writes the same bytes."""
    fd = os.open(name + ".new", os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        with open(source, "rb") as f:
            while block := f.read(1 << 20):
                os.pwrite(fd, block, offset)
                offset += len(block)
    finally:
        os.close(fd)


def finish(plan: list[tuple[str, str, int]], parts: list[Part]) -> None:
    """Give complete files their names."""
    for name in {name for _, name, _ in plan}:
        os.replace(name + ".new", name)
    _remove(parts)


class RawSource(DataSource):
    """Options to read: ``path``, ``timestamps``, ``dtype``, ``timestamps_dtype``; to write: ``path`` (a folder), ``prefix``, ``channels`` (their number)."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_raw"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RawReader:
        return RawReader(self.options)

    def writer(self, schema, overwrite: bool) -> RawWriter:
        return RawWriter(self.options)


def read_raw(spark: SparkSession, path: str, timestamps: str | None = None, **options) -> DataFrame:
    from .rec import register

    register(spark)
    options = {k: str(v) for k, v in options.items()} | ({"timestamps": timestamps} if timestamps else {})
    return spark.read.format("tidewire_raw").options(**options).load(path)


def write_raw(samples: DataFrame, folder: str, channels: int, prefix: str = "", partitions: int | None = None) -> None:
    """Write (channel, ts, value) as raw files in a folder that all machines share; timestamps that don't strictly grow in a channel are an error, and no file then appears."""
    from .rec import register

    register(samples.sparkSession)
    n = partitions or int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = samples.select(F.col("channel").cast("int"), F.col("ts").cast("long"), F.col("value").cast("short"))
    dealt = rows.repartitionByRange(n, "channel", "ts").sortWithinPartitions("channel", "ts")
    manifest = os.path.join(folder.removeprefix("file://"), f".parts-{uuid.uuid4().hex}.json")
    dealt.write.format("tidewire_raw").mode("append").options(prefix=prefix, channels=str(channels), manifest=manifest).save(folder)
    with open(manifest) as f:
        parts, plan = json.load(f)
    os.remove(manifest)

    def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for move in zip(*(batch.column(c).to_pylist() for c in ("source", "name", "offset")), strict=True):
                copy_part(*move)
            yield batch.select(["offset"])

    if plan:
        moves = samples.sparkSession.createDataFrame([tuple(m) for m in plan], "source string, name string, offset long")  # one row a part
        moves.repartition(min(len(plan), n)).mapInArrow(copied, "offset long").write.format("noop").mode("overwrite").save()
    finish(plan, [Part(**p) for p in parts])


def write_spikes(spikes: DataFrame, path: str) -> None:
    spikes.write.parquet(path)


def read_spikes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_spike_matrix(spark: SparkSession, path: str, ncols: int = 120) -> DataFrame:
    """(spikes, times) of a file of 64-bit floats: rows of ``ncols`` samples and a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                m = np.frombuffer(content.as_buffer(), "<f8")
                m = m[: len(m) // (ncols + 1) * (ncols + 1)].reshape(-1, ncols + 1)
                yield pa.RecordBatch.from_arrays([pa.array(list(m[:, :-1]), pa.list_(pa.float64())), pa.array(m[:, -1].copy())], ["spikes", "times"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "spikes array<double>, times double")
