"""Substring deduplication by paragraph MinHash banding.

A text's paragraphs are its stretches between line ends and sentence ends, very long ones cut further. Distinct paragraphs are banded by MinHash
over 5-word shingles; those that collide are verified by exact Jaccard similarity and clustered by components. Clusters
that occur in several documents make runs of repeated text; all occurrences but a cluster's first are removed. Passages
of over 50 words that several documents hold word by word count wherever they begin and however their lines are cut.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fragments as fr
from . import passages
from .common import Words, checkpointed, distinct_sets, grams, joined_few, mix, release, row_key, small_or_shuffled, text_batches, to_python, written
from .links import FACTS, PARITIES, linked_components, parities, parts

SHINGLE = 5
#: Bands of two MinHashes each: at a similarity of 0.8 two paragraphs collide in one of 6 with probability 0.998.
BANDS, ROWS = 6, 2
#: Paragraphs of fewer shingles than this can't be 80 % similar to others without being equal, so they are not banded.
LEAST_SHINGLES = 4
#: Paragraphs of more words than LONG are cut behind one word in CUT.
LONG, CUT = 64, 16
#: Bytes of texts whose words are hashed together.
TOGETHER = 1 << 20
_ENDS = np.isin(np.arange(256), list(b".!?"))
#: One hash function for each MinHash: a random number is added to a shingle bit by bit, and an odd one multiplied.
_SALTS, _FACTORS = mix(np.arange(1, 1 + BANDS * ROWS, dtype=np.uint64)), mix(np.arange(101, 101 + BANDS * ROWS, dtype=np.uint64)) | np.uint64(1)


@dataclass
class Units:
    """Paragraphs of many texts: first word in ``words``, number of words, text, 64-bit hash, and whether each is compared."""

    words: Words
    first: np.ndarray
    n: np.ndarray
    text: np.ndarray
    u: np.ndarray
    ok: np.ndarray

    @staticmethod
    def of(w: Words, least: int) -> Units:
        h, size = w.hashes, np.diff(w.before)
        new = np.zeros(len(h), bool)
        if len(h):
            new[1:] = _ENDS[w.raw[w.stop[:-1] - 1]] | (np.diff(np.searchsorted(np.flatnonzero(w.raw == 10), w.start)) > 0)
            new[w.before[:-1][size > 0]] = True
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(h)))
        if (n > LONG).any():
            # Text without line or sentence ends is cut behind words that their hashes choose, alike wherever it stands.
            new[1:] |= (h[:-1] % np.uint64(CUT) == 0) & np.repeat(n > LONG, n)[:-1]
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(h)))
        text = np.searchsorted(w.before, first, "right") - 1
        place = (np.arange(len(h)) - np.repeat(first, n)).astype(np.uint64)
        u = mix(np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), first) + n.astype(np.uint64)) if len(first) else np.empty(0, np.uint64)
        return Units(w, first, n, text, u, n >= least)

    def shingles(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the wanted paragraphs that have LEAST_SHINGLES at least; their shingles with the place of each's paragraph among those, in order."""
        wide = wanted & (self.n >= SHINGLE - 1 + LEAST_SHINGLES)
        unit = np.repeat(np.arange(len(self.n)), self.n)
        inside = wide[unit]
        last = unit[SHINGLE - 1 :]
        inside = inside[: len(last)] & (unit[: len(last)] == last)
        return np.flatnonzero(wide), grams(self.words.hashes, SHINGLE)[inside], (np.cumsum(wide) - 1)[unit[: len(last)][inside]]


def bands(five: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) keys of ROWS MinHashes each; every paragraph has a shingle."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))[: len(owner)]
    least = [np.minimum.reduceat((five ^ salt) * factor, first) for salt, factor in zip(_SALTS, _FACTORS, strict=True)]
    return np.stack([mix(mix(least[2 * b]) + np.uint64(3) * least[2 * b + 1] + np.uint64(b)) for b in range(BANDS)], 1)


#: Kinds of pieces, beside those of passages: a paragraph that is its cluster's first, and another.
FIRST, LATER = 0, 1
_RESULT = "key long, n_repeated long, n_removed long, repeated_words long, removed_words long, component_ids array<long>, removed_spans array<struct<start:long,stop:long>>"
_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])


def _of_lists(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each value's list, and the values; null lists have none."""
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _merged(start: np.ndarray, stop: np.ndarray, kind: np.ndarray, keeper: np.ndarray, min_words: int, min_run: int) -> tuple | None:
    """A row's results: paragraphs, and the stretches of exact passages beside them, are its pieces; of a cluster's first paragraph, words of earlier passages go."""
    unit = np.flatnonzero(kind <= LATER)
    size = int(stop.max())
    label = np.full(size, -1)
    exact, gone = np.zeros(size, bool), np.zeros(size, bool)
    for i in np.flatnonzero(kind == passages.COVERED):
        exact[start[i] : stop[i]] = True
    for i in np.flatnonzero(kind == passages.REMOVED):
        gone[start[i] : stop[i]] = True
    label[exact] = -2
    label[gone] = -3
    for i in unit:
        inside = label[start[i] : stop[i]]
        inside[...] = i if kind[i] == LATER else np.where(inside == -3, -3, i)
    edge = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    end = np.append(edge[1:], size)
    piece = label[edge] != -1
    edge, end, what = edge[piece], end[piece], label[edge[piece]]
    run = np.cumsum(np.append(True, edge[1:] - end[:-1] >= min_words)) - 1
    ok = np.bincount(run, end - edge)[run] >= min_run
    if not ok.any():
        return None
    edge, end, what = edge[ok], end[ok], what[ok]
    removed = (what == -3) | (what >= 0) & (kind[what] == LATER)
    ids = set(keeper[what[what >= 0]].tolist())
    if exact[edge].any() or (what < 0).any():
        ids |= set(keeper[kind == passages.KEEPER].tolist())
    words = end - edge
    taken = [{"start": int(a), "stop": int(b)} for a, b in zip(edge[removed], end[removed], strict=True)]
    return len(edge), int(removed.sum()), int(words.sum()), int(words[removed].sum()), sorted(ids - {passages.NO_ID}), taken


def _by_row(min_words: int, min_run: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come in order of their rows' keys; the last key of a batch waits for the next one."""
        rest: list[np.ndarray] | None = None

        def results(cols: list[np.ndarray]) -> pa.RecordBatch:
            first, length = fr.runs(cols[0])
            out = [(int(cols[0][a]), *x) for a, k in zip(first, length, strict=True) if (x := _merged(*(c[a : a + k] for c in cols[1:]), min_words, min_run)) is not None]
            types = [pa.int64()] * 5 + [pa.list_(pa.int64()), pa.list_(_SPAN)]
            names = ["key", "n_repeated", "n_removed", "repeated_words", "removed_words", "component_ids", "removed_spans"]
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(types)], names)

        for batch in batches:
            cols = [batch.column(c).fill_null(passages.NO_ID).to_numpy(zero_copy_only=False) if c == "keeper" else batch.column(c).to_numpy() for c in ("key", "start", "stop", "kind", "keeper")]
            if rest is not None:
                cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
            if not len(cols[0]):
                continue
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            rest = [c[last:].copy() for c in cols]
            if last:
                yield results([c[:last] for c in cols])
        if rest is not None:
            yield results(rest)
        release()

    return run


def repeated_paragraphs(docs: DataFrame, percent: int = 80, min_words: int = 6, min_run: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_repeated, n_removed, repeated_words, removed_words, component_ids, removed_spans) of every row.

    Paragraphs of at least ``min_words`` words (5 at least) are compared: equal ones, and those whose 5-word shingle
    sets have a Jaccard similarity of ``percent`` % or more, cluster. A cluster counts if it occurs in several rows.
    Every passage of passages.WINDOW words that several rows hold word by word counts too, from its first to its last
    word; pieces are repeated paragraphs, and the stretches of such passages beside them. Pieces that follow each
    other with less than ``min_words`` words between are a run; runs of fewer than ``min_run`` words (licence lines,
    set phrases) are left alone. ``n_repeated``: pieces in runs; ``n_removed``: those that are not their cluster's or
    passage's first occurrence by (id, row, place); ``component_ids``: ids of
    the first occurrences' rows, sorted; ``removed_spans``: (start, stop) in words. Null, empty and unrepeated texts
    have zeros and empty arrays. Rows that repeat id and text are one occurrence and share a result. Ids are integers.
    """
    least = max(min_words, SHINGLE)
    source = to_python(docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")))
    # One entry for about 16 bytes: an anchor in 16 words, a paragraph and its bands in 8 words or more.
    size = source.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    count = fr.n_fragments(size // 8, 16)
    bits = int(math.log2(count))

    def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return batch.column("key").to_numpy(), batch.column("id").fill_null(fr.NO_ID).to_numpy(zero_copy_only=False)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Anchors, paragraphs and bands of all texts."""
        hit, unit, band = (fr.Gatherer(kind, bits) for kind in (fr.HIT, fr.UNIT, fr.BAND))
        for batch in text_batches(batches, TOGETHER):
            keys, ids = rows_of(batch)
            w = Words.of(batch.column("text"))
            x = Units.of(w, least)
            at, text, g = passages.anchors(w)
            one = passages.once(text, g)
            wide, five, owner = x.shingles(x.ok)
            start = x.first - w.before[x.text]
            found = list(hit.add(keys, ids, text[one], (at - w.before[text])[one], g[one]))
            found += unit.add(keys, ids, x.text[x.ok], start[x.ok], x.u[x.ok], x.n[x.ok])
            if len(wide):
                again = np.repeat(wide, BANDS)
                found += band.add(keys, ids, x.text[again], start[again], bands(five, owner).ravel(), x.u[again])
            if found:
                yield fr.payloads(found)
        if found := [x for g in (hit, unit, band) for x in g.flush()]:
            yield fr.payloads(found)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of texts that are read again: the sets of paragraphs that met others, and the windows around anchors that met."""
        sender = passages.Sender(bits)

        def sent(found: list[tuple[int, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(pa.nulls(len(found), f.type) for f in near), pa.array([x[0] for x in found], pa.int32()), pa.array([x[1] for x in found], pa.binary())], [f.name for f in near] + ["fragment", "payload"])

        for batch in text_batches(batches, TOGETHER):
            keys, ids = rows_of(batch)
            w = Words.of(batch.column("text"))
            text, place = _of_lists(batch.column("hits"))
            if sender.add(keys, ids, *passages.windows(w, text, place)):
                yield sent(list(sender.payloads()))
            x = Units.of(w, least)
            text, place = _of_lists(batch.column("near"))
            wanted = np.zeros(len(x.first), bool)
            wanted[np.searchsorted(x.first, w.before[text] + place)] = True
            wide, five, owner = x.shingles(wanted)
            sets = distinct_sets(five, owner, len(wide))
            own = x.text[wide]
            cols = [pa.array(keys[own]), pa.array(ids[own], mask=ids[own] == fr.NO_ID), pa.array((x.first[wide] - w.before[own]).astype(np.int32)), pa.array(x.n[wide].astype(np.int32)), pa.array(x.u[wide].view(np.int64)), pa.array(np.diff(sets.before)), *parities(sets), parts(sets, 1)]
            if len(wide):
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(len(wide), pa.int32()), pa.nulls(len(wide), pa.binary())], [f.name for f in near] + ["fragment", "payload"])
        if found := list(sender.payloads()):
            yield sent(found)

    long = pa.int64()
    near = [pa.field(c, t) for c, t in (("key", long), ("id", long), ("start", pa.int32()), ("words", pa.int32()), ("u", long), ("n", long), *((c, long) for c in PARITIES), ("parts", pa.list_(pa.list_(long))))]
    read = "key long, id long, start int, words int, u long, n long, b0 long, b1 long, b2 long, b3 long, parts array<array<long>>, fragment int, payload binary"

    met = written(fr.met(source.mapInArrow(entries, fr.SCHEMA), count), "met")
    places = lambda kind: F.collect_set(F.when(F.col("kind") == kind, F.col("place")))
    wanted = checkpointed(met.where(F.col("kind") != fr.UNIT).groupBy("key").agg(places(fr.HIT).alias("hits"), places(fr.BAND).alias("near")))
    # Texts that share an anchor or a band with another row are read again.
    twice = written(joined_few(source, wanted, "key").select("key", "id", "text", "hits", "near").mapInArrow(again, read), "twice")
    exact = passages.repeated(twice.where("payload is not null").select("fragment", "payload"), count)

    copies = twice.where("payload is null")
    names = copies.select("key", "start", F.col("u").alias("sig"), "n", F.col("n").alias("rest"), *PARITIES).dropDuplicates(["key", "start"])
    banded = met.where(F.col("kind") == fr.BAND).select(F.col("a").alias("t"), "key", F.col("place").alias("start")).distinct()
    banded = checkpointed(banded.join(names, ["key", "start"]).select("t", *FACTS).dropDuplicates(["t", "sig"]))
    linked = linked_components(banded, copies.select(F.col("u").alias("sig"), "parts").dropDuplicates(["sig"]), percent)
    linked = checkpointed(linked.select(F.col("node").alias("u"), F.col("component").alias("root")))

    # A paragraph that only one text holds counts if it is linked; of the others all occurrences have met.
    units = met.where(F.col("kind") == fr.UNIT).select("key", "id", F.col("place").alias("start"), F.col("b").alias("n"), F.col("a").alias("u"))
    single = copies.select("key", "id", "start", F.col("words").alias("n"), "u").join(linked.select("u"), "u", "left_semi")
    units = units.unionByName(single).dropDuplicates(["key", "start"])
    first = F.min(F.struct("id", "key", "start"))
    texts = units.groupBy("u").agg(first.alias("first"), F.min("key").alias("low"), F.max("key").alias("high"))
    named = texts.join(linked, "u", "left").withColumn("root", F.coalesce("root", "u"))
    clusters = named.where("low <> high").select("u", "root", "first", "low", "high").unionByName(named.where("low = high").join(linked.select("root").distinct(), "root", "left_semi").select("u", "root", "first", "low", "high"))
    clusters = checkpointed(clusters)
    whole = clusters.groupBy("root").agg(F.min("first").alias("first"), F.min("low").alias("low"), F.max("high").alias("high")).where("low <> high")
    told = checkpointed(clusters.select("u", "root").join(whole.select("root", "first"), "root").select("u", F.col("first.id").alias("keeper"), F.col("first.key").alias("keeper_key"), F.col("first.start").alias("keeper_start")))

    placed = units.join(small_or_shuffled(told), "u").select("key", "start", (F.col("start") + F.col("n")).alias("stop"), "n", "keeper", ((F.col("key") == F.col("keeper_key")) & (F.col("start") == F.col("keeper_start"))).alias("first")).distinct()
    pieces = placed.select("key", "start", "stop", F.when(F.col("first"), FIRST).otherwise(LATER).alias("kind"), "keeper").unionByName(exact)
    by_row = checkpointed(pieces.repartition("key").sortWithinPartitions("key").mapInArrow(_by_row(min_words, min_run), _RESULT))
    joined = source.select("id", "key").join(by_row, "key", "left")
    zero = F.lit(0).cast("long")
    return joined.select(
        F.col("id").alias(id_col), *(F.coalesce(c, zero).alias(c) for c in ("n_repeated", "n_removed", "repeated_words", "removed_words")),
        F.coalesce("component_ids", F.array().cast("array<bigint>")).alias("component_ids"),
        F.coalesce("removed_spans", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias("removed_spans"),
    )
