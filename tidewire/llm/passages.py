"""Exact passages of WINDOW words and more that several rows hold, found by anchors and verified window by window.

Of every REACH neighbouring runs of GRAM words a text chooses the one of the least hash as an anchor (winnowing), so a
passage of WINDOW words has an anchor in common wherever it stands. Around anchors that several rows hold, all windows
of WINDOW words are compared by their hashes; those that several rows hold cover the passage from its first to its last word.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import fragments as fr
from .common import Words, grams, mix, release

#: Passages of over 50 words count; REACH is a power of two.
WINDOW, GRAM = 51, 20
REACH = WINDOW - GRAM + 1
NO_ID = fr.NO_ID
#: Kinds of pieces: covered by repeated windows, by such that are not the first of their text, and the row of a first one.
COVERED, REMOVED, KEEPER = 2, 3, 4
SPANS = "key long, start long, stop long, kind int, keeper long"


def _sliding(x: np.ndarray, f: np.ufunc) -> np.ndarray:
    k = 1
    while k < REACH:
        x = f(x[:-k], x[k:])
        k *= 2
    return x


def anchors(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in ``w``, texts and hashes of the runs of GRAM words that are the least of any REACH neighbours in their text."""
    h = w.hashes
    if len(h) < WINDOW:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    g, owner = grams(h, GRAM), w.text_of()
    least = _sliding(g, np.minimum)
    least[owner[: len(least)] != owner[WINDOW - 1 :]] = 0  # windows over the end of a text choose nothing
    at = np.flatnonzero(g == _sliding(np.pad(least, REACH - 1), np.maximum))
    at = at[g[at] > 0]
    return at, owner[at], g[at]


def _by_text(text: np.ndarray, g: np.ndarray) -> np.ndarray:
    return mix(g + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def once(text: np.ndarray, g: np.ndarray) -> np.ndarray:
    """The first of equal hashes of a text."""
    return np.sort(np.unique(_by_text(text, g), return_index=True)[1])


def windows(w: Words, text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts, first words and hashes of the windows that hold an anchor equal to one of those at these places of their texts."""
    at, own, g = anchors(w)
    tags = _by_text(own, g)
    chosen = np.isin(tags, tags[np.searchsorted(at, w.before[text] + place)])
    at, own = at[chosen], own[chosen]
    low, high = np.maximum(at - REACH + 1, w.before[own]), np.minimum(at, w.before[own + 1] - WINDOW)
    ok = low <= high
    size = len(w.hashes) + 1
    start = np.flatnonzero(np.cumsum(np.bincount(low[ok], minlength=size) - np.bincount(high[ok] + 1, minlength=size)) > 0)
    own = np.searchsorted(w.before, start, "right") - 1
    return own, start - w.before[own], grams(w.hashes, WINDOW)[start]


class Sender:
    """Gathers (key, id, places, hashes) of rows into payloads by fragment of the hashes."""

    def __init__(self, bits: int):
        self.bits, self.held, self.size = bits, [], 0

    def add(self, keys: np.ndarray, ids: np.ndarray, row: np.ndarray, place: np.ndarray, hashes: np.ndarray) -> bool:
        """Whether it is time to send."""
        if len(place):
            self.held.append((keys, ids, row, place, hashes))
            self.size += len(place)
        return self.size >= fr.ENTRIES_PER_PAYLOAD

    def payloads(self) -> Iterator[tuple[int, bytes]]:
        if not self.held:
            return
        base = np.cumsum([0] + [len(x[0]) for x in self.held])
        keys, ids, place, hashes = (np.concatenate([x[j] for x in self.held]) for j in (0, 1, 3, 4))
        row = np.concatenate([x[2] + b for x, b in zip(self.held, base, strict=False)])
        self.held, self.size = [], 0
        place = place.astype(np.uint32)
        fragment = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(fragment.astype(np.uint16) if self.bits <= 16 else fragment, kind="stable")
        fragment, row, place, hashes = fragment[order], row[order], place[order], hashes[order]
        low = (hashes & np.uint64((1 << 48) - 1)).view(np.uint8).reshape(-1, 8)[:, :6]
        first, length = fr.runs(fragment)
        for a, k in zip(first, length, strict=True):
            r, n = fr.runs(row[a : a + k])
            own = row[a : a + k][r]
            yield int(fragment[a]), struct.pack("<II", len(own), k) + keys[own].tobytes() + ids[own].tobytes() + n.astype(np.uint32).tobytes() + place[a : a + k].tobytes() + low[a : a + k].tobytes()


def _read(payload: bytes) -> tuple[np.ndarray, ...]:
    n, k = struct.unpack_from("<II", payload)
    keys, ids, counts = np.frombuffer(payload, np.int64, n, 8), np.frombuffer(payload, np.int64, n, 8 + 8 * n), np.frombuffer(payload, np.uint32, n, 8 + 16 * n)
    hashes = np.zeros((k, 8), np.uint8)
    hashes[:, :6] = np.frombuffer(payload, np.uint8, 6 * k, 8 + 20 * n + 4 * k).reshape(k, 6)
    return keys, ids, counts, np.frombuffer(payload, np.uint32, k, 8 + 20 * n), hashes.view(np.uint64).ravel()


def _met(payloads: list[bytes], shares: int) -> Iterator[tuple[int, bytes]]:
    """Of one fragment's entries those whose hash several rows hold, dealt by the row's key: places, whether each is the first of all, and the first ones' ids."""
    parts = [_read(x) for x in payloads]
    keys, ids, counts, place, hashes = (np.concatenate([x[j] for x in parts]) for j in range(5))
    order = np.lexsort((keys, ids))
    new = np.append(True, (keys[order][1:] != keys[order][:-1]) | (ids[order][1:] != ids[order][:-1]))
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new) - 1
    keys, ids = keys[order][new], ids[order][new]
    entry = np.repeat(rank, counts) << 32 | place.astype(np.int64)
    order = np.argsort(hashes)
    entry = entry[order]
    start, length = fr.runs(hashes[order])
    low, high = np.minimum.reduceat(entry, start), np.maximum.reduceat(entry, start)
    several = np.repeat(low >> 32 != high >> 32, length)
    if not several.any():
        return
    entry, low = entry[several], np.repeat(low, length)[several]
    dealt = np.empty(len(keys), np.int64)
    dealt[np.argsort(keys & (shares - 1), kind="stable")] = np.arange(len(keys))
    order = np.argsort(dealt[entry >> 32] << 32 | (entry & 0xFFFFFFFF))
    entry, low = entry[order], low[order]
    row, keeper = entry >> 32, low >> 32
    first, length = fr.runs(keys[row] & (shares - 1))
    for a, k in zip(first, length, strict=True):
        r, n = fr.runs(row[a : a + k])
        own = keys[row[a : a + k][r]]
        pairs = row[a : a + k] << 32 | keeper[a : a + k]
        pairs = np.unique(pairs[fr.runs(pairs)[0]])
        marked = (entry[a : a + k] & 0xFFFFFFFF) << 1 | (entry[a : a + k] == low[a : a + k])
        yield int(own[0] & (shares - 1)), struct.pack("<III", len(own), k, len(pairs)) + own.tobytes() + keys[pairs >> 32].tobytes() + ids[pairs & 0xFFFFFFFF].tobytes() + n.astype(np.uint32).tobytes() + marked.astype(np.uint32).tobytes()


def _gathered(payloads: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(key, places, whether each is first, ids of first ones) of every row, places in order."""
    keys, counts, marked, who, keepers = [], [], [], [], []
    for x in payloads:
        n, k, p = struct.unpack_from("<III", x)
        at = 12 + 8 * n + 16 * p
        keys.append(np.frombuffer(x, np.int64, n, 12))
        counts.append(np.frombuffer(x, np.uint32, n, at))
        marked.append(np.frombuffer(x, np.uint32, k, at + 4 * n))
        who.append(np.frombuffer(x, np.int64, p, 12 + 8 * n))
        keepers.append(np.frombuffer(x, np.int64, p, 12 + 8 * n + 8 * p))
    keys, counts, marked, who, keepers = (np.concatenate(x) for x in (keys, counts, marked, who, keepers))
    keys, at = np.unique(keys, return_inverse=True)
    entry = np.unique(np.repeat(at.astype(np.int64), counts) << 32 | marked)
    order = np.argsort(who, kind="stable")
    who, keepers = who[order], keepers[order]
    edges = np.searchsorted(entry >> 32, np.arange(len(keys) + 1))
    for key, a, b, c, d in zip(keys.tolist(), edges[:-1], edges[1:], np.searchsorted(who, keys), np.searchsorted(who, keys, "right"), strict=True):
        m = entry[a:b] & 0xFFFFFFFF
        yield key, m >> 1, (m & 1).astype(bool), np.unique(keepers[c:d])


def spans(place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the stretches that windows at these ordered places cover."""
    new = np.flatnonzero(np.diff(place) > WINDOW)
    return place[np.append(0, new + 1)], place[np.append(new, len(place) - 1)] + WINDOW


def _covered(place: np.ndarray, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    edge[place] += 1
    edge[place + WINDOW] -= 1
    return np.cumsum(edge)[:-1] > 0


def span_rows(payloads: list[bytes]) -> pa.RecordBatch:
    """SPANS: every window's first occurrence stays whole, so words that one covers are not removed."""
    out: list[tuple] = []
    for key, place, first, keepers in _gathered(payloads):
        a, b = spans(place)
        out += [(key, int(x), int(y), COVERED, None) for x, y in zip(a, b, strict=True)]
        out += [(key, 0, 0, KEEPER, int(x)) for x in keepers if x != NO_ID]
        if not first.any():
            out += [(key, int(x), int(y), REMOVED, None) for x, y in zip(a, b, strict=True)]
        elif not first.all():
            size = int(place[-1]) + WINDOW
            edge = np.diff((_covered(place[~first], size) & ~_covered(place[first], size)).astype(np.int8), prepend=0, append=0)
            out += [(key, int(x), int(y), REMOVED, None) for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    cols = list(zip(*out, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if i == 3 else pa.int64()) for i, c in enumerate(cols)], ["key", "start", "stop", "kind", "keeper"])


def repeated(sent: DataFrame, fragments: int) -> DataFrame:
    """SPANS of each row whose windows another row holds too."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in fr.by_fragment(batches):
            if out := list(_met(held, fragments)):
                yield fr.payloads(out)
        release()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in fr.by_fragment(batches):
            yield span_rows(held)
        release()

    return fr.dealt(fr.dealt(sent, fragments).mapInArrow(meet, fr.SCHEMA), fragments).mapInArrow(gather, SPANS)
