"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows, as counted, up to which a side counts as small enough to broadcast.
BROADCAST_BYTES = 16 << 20

#: Bytes of an Arrow batch of texts.
ARROW_BYTES = 8 << 20

SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_python(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches held to ARROW_BYTES: texts are long, and JVM and worker each hold a batch."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) > ARROW_BYTES:
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    return df


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that the session names in spark.checkpoint.dir; all executors must share it.

    Without one, a session of a single process (``local[...]``, as in tests) gets a folder of its own, removed at its end;
    on a cluster that is an error, as a folder of one machine would be lost with it.
    """
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="checkpoints")
            atexit.register(shutil.rmtree, named, True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``checkpoint_dir``."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def row_bytes(df: DataFrame) -> Column:
    """About the bytes that a row takes in a broadcast hash relation: 8 for each number and 32 for the row, arrays, strings and binaries by their length."""
    total = F.lit(32)
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        c = F.col(f"`{f.name}`")
        if kind == "array":
            total = total + 16 + F.coalesce(F.size(c), F.lit(0)) * (64 if f.dataType.elementType.typeName() in ("string", "struct", "array") else 8)
        elif kind in ("string", "binary"):
            total = total + 16 + F.coalesce(F.octet_length(c), F.lit(0))
        else:
            total = total + 8 * (len(f.dataType.fields) if kind == "struct" else 1)
    return total


def is_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    return df.agg(F.coalesce(F.sum(row_bytes(df).cast("long")), F.lit(0))).first()[0] <= limit


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Mark ``df`` for a broadcast join if its counted bytes are within ``limit``; beyond it the join shuffles. Only for cheap, checkpointed or written sides."""
    return F.broadcast(df) if is_small(df, limit) else df.hint("merge")


#: Bits of a bitmap for each hash, and longs that it has at most (16 MB); beyond them it drops less, and never what it should not.
BITS_PER_HASH, MOST_LONGS = 64, 1 << 21


def bitmap_of(hashes: DataFrame) -> tuple[DataFrame, int]:
    """One checkpointed row ``bitmap``, an array of longs in which a bit of each hash ``h`` is set, and the number of longs (a power of two)."""
    longs = min(MOST_LONGS, 1 << max(6, (hashes.count() * BITS_PER_HASH // 64).bit_length()))
    at = F.col("h").bitwiseAND(F.lit(longs * 64 - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    filled = hashes.groupBy(F.shiftright(at, 6).alias("id")).agg(F.bit_or(one).alias("bits"))
    dense = hashes.sparkSession.range(longs).join(filled, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return checkpointed(dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bitmap"))), longs


def holds(bitmap: Column, h: Column, longs: int) -> Column:
    """Whether the bit of ``h`` is set: true for every hash of the bitmap, and for few others."""
    at = h.bitwiseAND(F.lit(longs * 64 - 1))
    return F.getbit(F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1


def joined_few(rows: DataFrame, few: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Rows of long texts joined with the rows of ``few`` by hashes ``key``: a bitmap drops most texts without one before the others are shuffled, alike at every size."""
    bitmap, longs = bitmap_of(few.select(F.col(key).alias("h")))
    thin = rows.crossJoin(F.broadcast(bitmap)).where(holds(F.col("bitmap"), F.col(key), longs)).drop("bitmap")
    return thin.join(few.hint("merge"), key, how)


def words(text: Column) -> Column:
    """Whitespace words of a text as an array (null and blank texts: empty array)."""
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) > 0, F.split(trimmed, SPACES)).otherwise(F.array().cast("array<string>"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; other letters stay as they are."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def row_key(id_col: str, text_col: str) -> Column:
    """A 64-bit key of (id, text): rows that repeat both share it, and so share their results."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def private(columns: list[str], prefix: str = "__tw") -> str:
    """A prefix that none of the columns has."""
    while any(c.lower().startswith(prefix) for c in columns):
        prefix += "_"
    return prefix


def text_batches(batches: Iterator[pa.RecordBatch], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold about ``limit`` bytes each, and one row at least, so that memory doesn't follow the number of long texts in a batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = max(1, int(batch.num_rows * limit / max(batch.nbytes, 1)))
        if rows >= batch.num_rows:
            yield batch
            continue
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop
    release()


def release() -> None:
    """Give memory that a worker no longer uses back: it stays alive between tasks, beside others of its executor."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC, "malloc_trim"):
        _LIBC.malloc_trim(0)


_LIBC = ctypes.CDLL(None)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Bytes of a text up to which powers are held in tables (two of 8 bytes a place).
_TABLE = 1 << 21
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of an odd base modulo 2 ** 64, kept and doubled as longer texts come."""
    got = _POWERS.get(base)
    if got is None or len(got) < n:
        out = np.full(1 << max(12, (n - 1).bit_length()), base, np.uint64)
        out[0] = 1
        got = _POWERS[base] = np.multiply.accumulate(out)
    return got


def word_hashes(text: bytes | np.ndarray, borders: np.ndarray | None = None, lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes, first bytes and ends of the whitespace words of UTF-8 bytes; words end at ``borders`` too. ``lower``: A-Z count as a-z.

    A word's bytes, turned to random numbers, are the digits of a number in an odd base modulo 2 ** 64: a difference of
    running sums over the text, moved back to the first place by the base's inverse power.
    """
    raw = np.frombuffer(text, np.uint8) if isinstance(text, bytes) else text
    digit = _LOWER if lower else _BYTE
    inside = ~_SPACE[raw]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    if borders is not None and len(raw):
        at = borders[(borders > 0) & (borders < len(raw))]
        begins[at] = inside[at]
        ends[at - 1] = inside[at - 1]
    start, stop = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    if not len(start):
        return np.empty(0, np.uint64), start, stop
    if len(raw) <= _TABLE:
        sums = np.cumsum(digit[raw] * _powers(_BASE, len(raw))[: len(raw)])
        total = (sums[stop - 1] - np.where(start > 0, sums[start - 1], np.uint64(0))) * _powers(_UNBASE, len(raw))[start]
    else:  # by parts of whole words, and words by themselves if they are longer than that
        total, at = np.empty(len(start), np.uint64), 0
        while at < len(start):
            to = max(at + 1, int(np.searchsorted(stop, start[at] + _TABLE, "right")))
            part = digit[raw[start[at] : stop[to - 1]]]
            part[~inside[start[at] : stop[to - 1]]] = 0
            if to > at + 1 or len(part) <= _TABLE:
                sums = np.append(np.uint64(0), np.cumsum(part * _powers(_BASE, len(part))[: len(part)]))
                total[at:to] = (sums[stop[at:to] - start[at]] - sums[start[at:to] - start[at]]) * _powers(_UNBASE, len(part))[start[at:to] - start[at]]
            else:
                total[at] = _long_word(part)
            at = to
    return mix(total + (stop - start).astype(np.uint64)), start, stop


def _long_word(digits: np.ndarray) -> np.uint64:
    total, scale = np.uint64(0), 1
    for i in range(0, len(digits), _TABLE):
        part = digits[i : i + _TABLE]
        with np.errstate(over="ignore"):
            total = total + (part * _powers(_BASE, len(part))[: len(part)]).sum(dtype=np.uint64) * np.uint64(scale)
        scale = scale * pow(_BASE, len(part), 1 << 64) % (1 << 64)
    return total


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]


@dataclass
class Words:
    """Words of many texts: hashes of the A-Z-lower-cased words, first bytes and ends in ``raw``, and the number of words before each text."""

    raw: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    before: np.ndarray

    @staticmethod
    def of(texts: pa.Array) -> Words:
        """Words of an Arrow array of texts, read from its buffers in one go; null texts have none."""
        texts = texts.cast(pa.string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.empty(0, np.uint8)
        offsets -= offsets[0]
        h, start, stop = word_hashes(raw, offsets, True)
        return Words(raw, h, start, stop, np.searchsorted(start, offsets))

    def text_of(self) -> np.ndarray:
        """The number of each word's text."""
        return np.repeat(np.arange(len(self.before) - 1), np.diff(self.before))


#: Words of which running sums are made at once.
_PART = 1 << 20


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n word hashes by running sums; none if there are fewer."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    out = np.empty(len(h) - n + 1, np.uint64)
    for a in range(0, len(out), _PART):
        part = h[a : a + _PART + n - 1]
        sums = np.append(np.uint64(0), np.cumsum(part * _powers(_BASE, len(part))[: len(part)]))
        out[a : a + _PART] = mix((sums[n:] - sums[:-n]) * _powers(_UNBASE, len(part))[: len(part) - n + 1])
    return out


@dataclass
class Sets:
    """Distinct shingles of many texts: hashes, in order within each text, the number before each text, and each one's text."""

    hashes: np.ndarray
    before: np.ndarray
    owner: np.ndarray

    @staticmethod
    def of(w: Words, n: int) -> Sets:
        """The n-word shingles of each text; a text of fewer words, but not none, has its whole sequence as one."""
        texts, size = len(w.before) - 1, np.diff(w.before)
        runs, owner = grams(w.hashes, n), w.text_of()
        inside = owner[: len(runs)] == owner[n - 1 : n - 1 + len(runs)]
        found, whose = [runs[inside]], [owner[: len(runs)][inside]]
        for k in range(1, n):
            short = np.flatnonzero(size == k)
            total = np.zeros(len(short), np.uint64)
            for i in range(k):
                total = mix(total + w.hashes[w.before[short] + i] + np.uint64(k))
            found.append(total)
            whose.append(short)
        return distinct_sets(np.concatenate(found), np.concatenate(whose), texts)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sums of the values of each text's shingles, modulo 2 ** 64."""
        out = np.zeros(len(self.before) - 1, values.dtype)
        full = np.flatnonzero(np.diff(self.before))
        if len(full):
            out[full] = np.add.reduceat(values, self.before[full])
        return out


def distinct_sets(hashes: np.ndarray, owner: np.ndarray, texts: int) -> Sets:
    """Each owner's hashes once, in order."""
    order = np.argsort(owner.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(20)) if texts < 1 << 20 else np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    if ((o[1:] == o[:-1]) & (h[1:] < h[:-1])).any():  # hashes that only differ in their low bits
        order = np.lexsort((hashes, owner))
        h, o = hashes[order], owner[order]
    once = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])) if len(h) else np.empty(0, bool)
    h, o = h[once], o[once]
    return Sets(h, np.searchsorted(o, np.arange(texts + 1)), o)


def list_array(values: np.ndarray, before: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(values))


def combine(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every run of n word hashes (of the whole sequence if it is shorter)."""
    return grams(h, min(n, len(h))) if len(h) else h


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table as Parquet into the checkpoint folder and read it back: a cut of the lineage of which later readers take the columns they need."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
