"""Recordings that grow, as streams, and operators that carry state from block to block."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSourceStreamReader
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.rec import PacketRange, RecReader, files_of


class RecStream(DataSourceStreamReader):
    """Packets appended to recordings; an offset is the number of packets of each file, and ranges of them are partitions.

    ``packets_per_trigger`` bounds a micro-batch of each file. After a restart Spark doesn't tell the reader where the
    stream stands before it asks for the latest offset, so the first batch then takes all packets that are there: none is
    delivered twice or lost, and ranges keep its tasks small.
    """

    def __init__(self, options: dict):
        self.reader, self.path = RecReader(options), options["path"]
        self.most = int(options.get("packets_per_trigger", 1 << 20))
        #: Packets of each file up to which batches were planned; None until Spark has told where the stream stands.
        self.at: dict | None = None

    def initialOffset(self) -> dict:
        self.at = {p: 0 for p in files_of(self.path)}
        return dict(self.at)

    def latestOffset(self) -> dict:
        """At most ``packets_per_trigger`` more packets of each file than those planned."""
        there = {p: self.reader.form.layout(p).packets for p in files_of(self.path)}
        if self.at is None:
            return there
        self.at = self.at | {p: max(self.at.get(p, 0), min(n, self.at.get(p, 0) + self.most)) for p, n in there.items()}
        return dict(self.at)

    def _stands(self, offset: dict) -> None:
        at = self.at or {}
        self.at = at | {p: max(at.get(p, 0), n) for p, n in offset.items()}

    def partitions(self, start: dict, end: dict) -> list[PacketRange]:
        self._stands(end)
        out = []
        for i, p in enumerate(files_of(self.path)):
            a, b = start.get(p, 0), end.get(p, 0)
            if b > a:
                layout = self.reader.form.layout(p)
                out += [PacketRange(i, p, layout, k, min(self.reader.per, b - k)) for k in range(a, b, self.reader.per)]
        return out

    def read(self, partition: PacketRange) -> Iterator[pa.RecordBatch]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        self._stands(end)


def censor_stream(events: DataFrame, t: str = "idx", channel: str = "channel", width: int = 30) -> DataFrame:
    """(channel, t) kept by a refractory period over a stream; the last kept event of each channel is its state.

    Within a micro-batch events are taken in order; later batches must not hold earlier events.
    """
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        kept = []
        for x in sorted(x for f in frames for x in f[t].tolist()):
            if last is None or x > last + width:
                kept.append(x)
                last = x
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({channel: [key[0]] * len(kept), t: kept})

    schema = f"`{channel}` {kinds[channel]}, `{t}` {kinds[t]}"
    return events.select(channel, t).groupBy(channel).applyInPandasWithState(run, schema, f"last {kinds[t]}", "append", GroupStateTimeout.NoTimeout)


def fill_stream(samples: DataFrame, max_gap_size: int, ts: str = "ts", value: str = "value", channel: str = "channel") -> DataFrame:
    """(channel, ts, value) with short gaps filled linearly over a stream; the last sample of each channel is its state.

    Samples come in order from batch to batch; repeated timestamps count once, the first.
    """
    kinds = {f.name: f.dataType.simpleString() for f in samples.schema.fields}

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t0, v0 = state.get if state.exists else (None, None)
        out = []
        for t, v in sorted((r for f in frames for r in zip(f[ts].tolist(), f[value].tolist(), strict=True)), key=lambda r: r[0]):
            if t0 is not None:
                if t <= t0:
                    continue
                if t - t0 - 1 <= max_gap_size:
                    out += [(x, int(v0 + (v - v0) * (x - t0) / (t - t0))) for x in range(t0 + 1, t)]
            out.append((t, v))
            t0, v0 = t, v
        if t0 is not None:
            state.update((t0, v0))
        yield pd.DataFrame({channel: [key[0]] * len(out), ts: [r[0] for r in out], value: [r[1] for r in out]})

    schema = f"`{channel}` {kinds[channel]}, `{ts}` {kinds[ts]}, `{value}` {kinds[value]}"
    state = f"t {kinds[ts]}, v {kinds[value]}"
    return samples.select(channel, ts, value).groupBy(channel).applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout)
