"""Vertical fragments: keys of many rows, cut by the order of their hashes into fragments that are looked at one by one.

Rows of (fragment, payload) carry many keys each: a payload is 64-bit owners, the number of each owner's keys, and the
keys' low 48 bits. The high bits of a key choose its fragment, so all holders of a key meet in one fragment.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release

#: Keys of one fragment that a task is to hold, about; the number of fragments follows the number of keys.
KEYS_PER_FRAGMENT = 2_000_000
#: Partitions that fragments are dealt to at most; a task takes its fragments one after the other.
MOST_PARTITIONS = 1 << 14
#: Keys that a task gathers before it sends them on.
KEYS_PER_PAYLOAD = 1_500_000
#: Owner of keys that several rows of one payload share: it stands for all of them.
SHARED = -(1 << 63)
SCHEMA = "fragment int, payload binary"


def n_fragments(keys: int, least: int) -> int:
    """A power of two, at least about ``least``."""
    n = 16
    while n < least or n * KEYS_PER_FRAGMENT < keys:
        n *= 2
    return n


def pack(owners: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> bytes:
    low = (keys & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]
    return struct.pack("<II", len(owners), len(keys)) + owners.astype(np.int64).tobytes() + counts.astype(np.uint32).tobytes() + low.tobytes()


def unpack(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Owner and low 48 bits of each key."""
    n, k = struct.unpack_from("<II", payload)
    owners = np.frombuffer(payload, np.int64, n, 8)
    counts = np.frombuffer(payload, np.uint32, n, 8 + 8 * n)
    keys = np.zeros((k, 8), np.uint8)
    keys[:, :6] = np.frombuffer(payload, np.uint8, 6 * k, 8 + 12 * n).reshape(k, 6)
    return np.repeat(owners, counts), keys.view(np.uint64).ravel()


def split(owners: np.ndarray, keys: np.ndarray, bits: int) -> Iterator[tuple[int, bytes]]:
    """Payloads of (owner, key) entries by fragment; entries of an owner need not be together."""
    if not len(keys):
        return
    fragment = (keys >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(owners)
    order = order[np.argsort(fragment[order].astype(np.uint16) if bits <= 16 else fragment[order], kind="stable")]
    owners, keys, fragment = owners[order], keys[order], fragment[order]
    edges = np.flatnonzero(np.diff(fragment, prepend=-1, append=1 << 40))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own, first = np.unique(owners[a:b], return_index=True)
        yield int(fragment[a]), pack(own, np.diff(np.append(first, b - a)), keys[a:b])


def pack_counts(owners: np.ndarray, counts: np.ndarray) -> bytes:
    """A payload of sums that fragments pass on as they are."""
    return struct.pack("<II", 0xFFFFFFFF, len(owners)) + owners.astype(np.int64).tobytes() + counts.astype(np.int64).tobytes()


def _counts_of(payload: bytes) -> tuple[np.ndarray, np.ndarray] | None:
    kind, k = struct.unpack_from("<II", payload)
    return (np.frombuffer(payload, np.int64, k, 8), np.frombuffer(payload, np.int64, k, 8 + 8 * k)) if kind == 0xFFFFFFFF else None


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal sorted keys."""
    start = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return start, np.diff(np.append(start, len(keys)))


def _distinct(owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries sorted by key and owner, once each."""
    order = np.argsort(keys)
    owners, keys = owners[order], keys[order]
    again = np.flatnonzero(keys[1:] == keys[:-1])
    if len(again):  # only keys that come again need their owners in order
        at = np.unique(np.concatenate([again, again + 1]))
        owners[at] = owners[at][np.lexsort((owners[at], keys[at]))]
    once = np.append(True, (owners[1:] != owners[:-1]) | (keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    return owners[once], keys[once]


def _settle(owners: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each key that several owners of a gathering hold, one entry of SHARED goes on; those owners count it here."""
    owners, keys = _distinct(owners, keys)
    start, length = runs(keys)
    several = np.repeat(length > 1, length)
    known = owners[several]
    owners = owners.copy()
    owners[start[length > 1]] = SHARED
    several[start[length > 1]] = False
    return owners[~several], keys[~several], known


def send(rows: Iterator[tuple[np.ndarray, np.ndarray]], bits: int) -> Iterator[pa.RecordBatch]:
    """Gather entries (owners, keys) into payloads; an entry that comes again in a gathering counts once."""

    def flush() -> pa.RecordBatch:
        own, key, known = _settle(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        out = list(split(own, key, bits))
        if len(known):
            who, n = np.unique(known, return_counts=True)
            out.append((int(who[0]) & ((1 << bits) - 1), pack_counts(who, n)))
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["fragment", "payload"])

    held, size = [], 0
    for owners, keys in rows:
        held.append((owners, keys))
        size += len(keys)
        if size >= KEYS_PER_PAYLOAD:
            yield flush()
            held, size = [], 0
    if size:
        yield flush()


def by_fragment(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The payloads of one fragment after the other."""
    now, held = None, []
    for batch in batches:
        for f, payload in zip(batch.column("fragment").to_pylist(), batch.column("payload"), strict=True):
            if f != now and held:
                yield held
                held = []
            now = f
            held.append(payload.as_py())
    if held:
        yield held


def shared_counts(sent: DataFrame, fragments: int) -> DataFrame:
    """(owner, n): how many keys of each owner another owner holds too, counted by fragment and summed.

    Partial counts travel as payloads too, dealt by the owner's low bits; there are no more of them than keys.
    """

    def shared_out(who: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        share = who & (fragments - 1)
        order = np.argsort(share, kind="stable")
        who, n, share = who[order], n[order], share[order]
        start, length = runs(share)
        return pa.RecordBatch.from_arrays([pa.array(share[start], pa.int32()), pa.array([pack_counts(who[a : a + k], n[a : a + k]) for a, k in zip(start, length, strict=True)], pa.binary())], ["fragment", "payload"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> Iterator[pa.RecordBatch]:
            if held:
                own, key = _distinct(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                held.clear()
                length = runs(key)[1]
                own = own[np.repeat(length > 1, length)]
                yield shared_out(*np.unique(own[own != SHARED], return_counts=True))

        for batch in batches:
            for f, payload in zip(batch.column("fragment").to_pylist(), batch.column("payload"), strict=True):
                if f != now:
                    yield from done()
                    now = f
                raw = payload.as_py()
                if (x := _counts_of(raw)) is not None:
                    yield shared_out(*x)
                else:
                    held.append(unpack(raw))
        yield from done()
        release()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_fragment(batches):
            parts = [_counts_of(x) for x in held]
            who, at = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x[1] for x in parts]), len(who)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(who, pa.int64()), pa.array(n, pa.int64())], ["owner", "n"])
        release()

    return dealt(dealt(sent, fragments).mapInArrow(count, SCHEMA), fragments).mapInArrow(add_up, "owner long, n long")


def partitions(fragments: int) -> int:
    return min(fragments, MOST_PARTITIONS)


def dealt(sent: DataFrame, fragments: int) -> DataFrame:
    """Payloads by partitions, and by fragment within them."""
    return sent.repartitionById(partitions(fragments), (F.col("fragment") % partitions(fragments)).cast("int")).sortWithinPartitions("fragment")


#: Kinds of entries that meet: anchors of different rows, equal paragraphs, different paragraphs in one band.
HIT, UNIT, BAND = 0, 1, 2
#: Entries that are known to meet before they reach their fragment.
DONE = 4
#: Of a HIT: the row and place. Of a UNIT: also its hash (a) and number of words (b). Of a BAND: also its key (a).
MET = "kind int, key long, id long, place int, a long, b int"
_NAMES = ["kind", "key", "id", "place", "a", "b"]
#: Entries that a task gathers before it sends them on.
ENTRIES_PER_PAYLOAD = 1_000_000
_FLAG = np.uint32(1 << 31)
_48 = np.uint64((1 << 48) - 1)


def _six(x: np.ndarray) -> bytes:
    return x.astype(np.uint64).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(raw: bytes, n: int, at: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8, 6 * n, at).reshape(n, 6)
    return out.view(np.uint64).ravel()


@dataclass
class Entries:
    """Entries of rows: keys and ids of rows; row, place, 48-bit hash and 48 bits more of each entry, and whether it stands for entries known to meet.

    The 48 bits more are the low 16 bits of the hash over 32 bits of words for a UNIT, and 48 bits of the paragraph's hash for a BAND.
    """

    kind: int
    keys: np.ndarray
    ids: np.ndarray
    row: np.ndarray
    place: np.ndarray
    hash: np.ndarray
    more: np.ndarray
    flag: np.ndarray

    @staticmethod
    def of(kind: int, keys: np.ndarray, ids: np.ndarray, row: np.ndarray, place: np.ndarray, hashes: np.ndarray, more: np.ndarray | None = None) -> Entries:
        """From 64-bit hashes. more: words of a UNIT, hash of the paragraph of a BAND."""
        more = np.zeros(len(row), np.uint64) if more is None else more.astype(np.uint64)
        if kind == UNIT:
            more = (hashes & np.uint64(0xFFFF)) << np.uint64(32) | more
        return Entries(kind, keys, ids, row, place.astype(np.uint32), hashes >> np.uint64(16), more & _48, np.zeros(len(row), bool))

    def take(self, at: np.ndarray, flag: np.ndarray | None = None) -> Entries:
        return Entries(self.kind, self.keys, self.ids, self.row[at], self.place[at], self.hash[at], self.more[at], self.flag[at] if flag is None else flag)

    @staticmethod
    def joined(parts: list[Entries]) -> Entries:
        base = np.cumsum([0] + [len(x.keys) for x in parts])
        cols = [np.concatenate([getattr(x, c) for x in parts]) for c in ("keys", "ids", "place", "hash", "more", "flag")]
        row = np.concatenate([x.row + b for x, b in zip(parts, base, strict=False)])
        # Rows of one key are one.
        keys, first, same = np.unique(cols[0], return_index=True, return_inverse=True)
        return Entries(parts[0].kind, keys, cols[1][first], same[row], *cols[2:])

    def meet(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Order by hash, starts and lengths of runs of equal hashes, and whether different ones meet in a run, here or before."""
        who = self.row.astype(np.int64) if self.kind == HIT else self.more.astype(np.int64) if self.kind == BAND else self.row.astype(np.int64) << 32 | self.place.astype(np.int64)
        full = self.whole() if self.kind == UNIT else self.hash
        order = np.argsort(full)
        start, length = runs(full[order])
        if not len(start):
            return order, start, length, np.empty(0, bool)
        who = who[order]
        return order, start, length, (np.minimum.reduceat(who, start) != np.maximum.reduceat(who, start)) | np.maximum.reduceat(self.flag[order], start)

    def whole(self) -> np.ndarray:
        return self.hash << np.uint64(16) | self.more >> np.uint64(32)

    def settled(self) -> tuple[Entries, Entries]:
        """Entries that go on, one for each run (flagged where different ones meet), and those known to meet."""
        order, start, length, several = self.meet()
        return self.take(order[start], several), self.take(order[np.repeat(several, length)])

    def packed(self, fragment: np.ndarray, kind: int) -> Iterator[tuple[int, bytes]]:
        order = np.lexsort((self.row, fragment))
        e, fragment = self.take(order), fragment[order]
        first, length = runs(fragment)
        for a, k in zip(first, length, strict=True):
            b = a + k
            r, n = runs(e.row[a:b])
            own = e.row[a:b][r]
            ids = self.ids[own].tobytes() if self.kind == UNIT else b""
            more = _six(e.more[a:b]) if self.kind != HIT else b""
            place = e.place[a:b] | np.where(e.flag[a:b], _FLAG, np.uint32(0))
            yield int(fragment[a]), struct.pack("<III", kind, len(own), k) + self.keys[own].tobytes() + ids + n.astype(np.uint32).tobytes() + place.tobytes() + _six(e.hash[a:b]) + more

    @staticmethod
    def unpacked(raw: bytes) -> tuple[Entries, bool]:
        """Entries of a payload, and whether they are known to meet."""
        kind, rows, n = struct.unpack_from("<III", raw)
        done, kind, at = bool(kind & DONE), kind & 3, 12
        keys = np.frombuffer(raw, np.int64, rows, at)
        at += 8 * rows
        ids = np.frombuffer(raw, np.int64, rows, at) if kind == UNIT else np.zeros(rows, np.int64)
        at += 8 * rows * (kind == UNIT)
        row = np.repeat(np.arange(rows), np.frombuffer(raw, np.uint32, rows, at))
        at += 4 * rows
        place = np.frombuffer(raw, np.uint32, n, at)
        at += 4 * n
        more = _from_six(raw, n, at + 6 * n) if kind != HIT else np.zeros(n, np.uint64)
        return Entries(kind, keys, ids, row, place & ~_FLAG, _from_six(raw, n, at), more, place >= _FLAG), done

    def batch(self) -> pa.RecordBatch:
        n = len(self.row)
        a = self.whole() if self.kind == UNIT else self.hash
        words = (self.more & np.uint64(0xFFFFFFFF)).astype(np.int32) if self.kind == UNIT else np.zeros(n, np.int32)
        ids = self.ids[self.row]
        cols = [pa.array(np.full(n, self.kind, np.int32)), pa.array(self.keys[self.row]), pa.array(ids, mask=ids == NO_ID), pa.array(self.place.astype(np.int32)), pa.array(a.view(np.int64)), pa.array(words)]
        return pa.RecordBatch.from_arrays(cols, _NAMES)


#: Stands for a null id, which comes first in order.
NO_ID = -(1 << 63)


class Gatherer:
    """Gathers entries of one kind, and sends them to the fragments of their hashes."""

    def __init__(self, kind: int, bits: int):
        self.kind, self.bits, self.held, self.size = kind, bits, [], 0

    def add(self, *entries) -> Iterator[tuple[int, bytes]]:
        e = Entries.of(self.kind, *entries)
        if len(e.row):
            self.held.append(e)
            self.size += len(e.row)
        if self.size >= ENTRIES_PER_PAYLOAD:
            yield from self.flush()

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if self.held:
            on, done = Entries.joined(self.held).settled()
            self.held, self.size = [], 0
            yield from on.packed((on.hash >> np.uint64(48 - self.bits)).astype(np.int64), self.kind)
            yield from done.packed(done.keys[done.row] & ((1 << self.bits) - 1), self.kind | DONE)


def payloads(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], ["fragment", "payload"])


def met(sent: DataFrame, fragments: int) -> DataFrame:
    """MET rows of all entries that meet different ones, in their task or in their fragment; an entry may come more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}

        def done() -> Iterator[pa.RecordBatch]:
            for parts in held.values():
                e = Entries.joined(parts)
                order, _, length, several = e.meet()
                at = order[np.repeat(several, length)]
                if len(at := at[~e.flag[at]]):
                    yield e.take(at).batch()
            held.clear()

        for batch in batches:
            for f, payload in zip(batch.column("fragment").to_pylist(), batch.column("payload"), strict=True):
                if f != now:
                    yield from done()
                    now = f
                e, known = Entries.unpacked(payload.as_py())
                if known:
                    yield e.batch()
                else:
                    held.setdefault(e.kind, []).append(e)
        yield from done()
        release()

    return dealt(sent, fragments).mapInArrow(run, MET)
