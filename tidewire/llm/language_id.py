"""Language identification by language-bitmask n-gram filters.

The filters of all languages are one bit-sliced Bloom filter: a slot holds one bit for each language, and the AND of an
n-gram's slots is the mask of all languages whose filters hold it. A text's hits per language are the popcounts of its
masks by bit, corrected for each filter's rate of false positives; the largest corrected share decides. Where no filter
holds any n-gram of a text, its single letters decide in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix, text_batches, to_python

#: An n-gram belongs to a language if it makes up this share of the language's n-grams at least: at most 1 / MIN_SHARE
#: n-grams of each language reach the driver.
MIN_SHARE = 2e-5
#: ... and this share of what it makes up in the language that holds most of it (passages in another language).
MIN_OF_BEST = 0.3
SLOTS_PER_GRAM, HASHES = 10, 3
UNKNOWN = "und"

#: Marks codes of single letters, which are in the filters too.
SINGLE = np.uint64(1 << 63)

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters with both neighbours (others than letters count as one mark) and the number in each text."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("\n".join(["", *lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[~letters()[points]] = 0
    at = np.flatnonzero(points)
    codes = points[at - 1] << np.uint64(42) | points[at] << np.uint64(21) | points[at + 1]
    ends = np.cumsum([len(t) + 1 for t in lower]) + 1
    return codes, np.diff(np.searchsorted(at, np.concatenate(([0], ends - 1))))


def singles(codes: np.ndarray) -> np.ndarray:
    """Codes of the letters in the middle of n-grams."""
    return codes >> np.uint64(21) & np.uint64((1 << 21) - 1) | SINGLE


@dataclass
class Filters:
    langs: list[str]
    slots: np.ndarray  # (slots, words of 64 languages)
    false_rate: np.ndarray

    def masks(self, codes: np.ndarray) -> np.ndarray:
        h, size = mix(codes), np.uint64(len(self.slots) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        out = self.slots[h & size]
        for k in range(1, HASHES):
            out = out & self.slots[(h + np.uint64(k) * step) & size]
        return out

    def shares(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """(texts, languages): corrected share of each text's codes that the language's filter holds."""
        masks, ends = self.masks(codes), np.concatenate(([0], np.cumsum(counts)))
        share = np.zeros((len(counts), len(self.langs)))
        for j in range(len(self.langs)):
            hit = np.concatenate(([0], np.cumsum(masks[:, j // 64] >> np.uint64(j % 64) & np.uint64(1))))
            share[:, j] = (hit[ends[1:]] - hit[ends[:-1]]) / np.maximum(counts, 1)
        return np.clip((share - self.false_rate) / (1 - self.false_rate), 0, 1)

    def decide(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        codes, counts = trigrams(texts)
        share = self.shares(codes, counts)
        missed = (counts > 0) & (share.max(1, initial=0) == 0)
        if missed.any():
            share[missed] = self.shares(singles(codes[np.repeat(missed, counts)]), counts[missed])
        best = share.argmax(1) if self.langs else np.zeros(len(texts), int)
        known = (counts > 0) & bool(self.langs)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, share.max(1, initial=0), 0.0)


def build(grams: dict[str, np.ndarray]) -> Filters:
    """Filters of (language, codes); languages come in the order that decides ties."""
    langs, most = list(grams), max([len(x) for x in grams.values()], default=1)
    slots = np.zeros((1 << int(np.ceil(np.log2(max(most, 1) * SLOTS_PER_GRAM))), (len(langs) + 63) // 64 or 1), np.uint64)
    for j, codes in enumerate(grams.values()):
        h, size = mix(codes.astype(np.uint64)), np.uint64(len(slots) - 1)
        step = (h >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            slots[(h + np.uint64(k) * step) & size, j // 64] |= np.uint64(1) << np.uint64(j % 64)
    filled = np.array([(slots[:, j // 64] >> np.uint64(j % 64) & np.uint64(1)).mean() for j in range(len(langs))])
    return Filters(langs, slots, filled**HASHES)


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Filters:
    """Count the n-grams of all rows by language and build the filters; rows with a null text or language teach nothing.

    Languages with more n-grams come first, equal ones by name; that order decides ties.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches):
            codes, counts = trigrams(batch.column("text").to_pylist())
            by_text = np.array(batch.column("lang").to_pylist(), object)
            owner = np.repeat(by_text, counts)
            for lang in sorted(set(by_text)):
                code, n = np.unique(codes[owner == lang], return_counts=True)
                letter, at = np.unique(singles(code), return_inverse=True)
                code, n = np.append(code, letter), np.append(n, np.bincount(at, n, len(letter)).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.view(np.int64)), pa.array(n, pa.int64())], ["lang", "code", "n"])

    source = to_python(docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null"))
    # Counts are kept by language in rows of few columns; shares of a language and of an n-gram's best language choose.
    counts = source.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = {r["lang"]: r["n"] for r in counts.where("code >= 0").groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    order = sorted(totals, key=lambda x: (-totals[x], x))
    if not order:
        return build({})
    share = F.col("n") / F.element_at(F.create_map(*[F.lit(y) for x in order for y in (x, float(totals[x]))]), F.col("lang"))
    shared = counts.withColumn("share", share).where(F.col("share") >= MIN_SHARE * MIN_OF_BEST)
    best = shared.groupBy("code").agg(F.max("share").alias("best"))
    kept = shared.join(best, "code").where((F.col("share") >= MIN_SHARE) & (F.col("share") >= MIN_OF_BEST * F.col("best"))).select("lang", "code").toPandas()
    counts.unpersist()
    return build({x: np.sort(kept["code"][kept["lang"] == x].to_numpy(np.int64)) for x in order})


def language_id(docs: DataFrame, learned: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang_pred, score) of every row, after learning from the rows for which ``learned`` is true.

    ``score`` is the corrected share of the text's n-grams, or else letters, that the language's filter holds. A null text, one without
    a letter, and any text if nothing could be learned are ``und`` with score 0. Whole texts are read; repeated rows
    get equal results.
    """
    filters = docs.sparkSession.sparkContext.broadcast(learn(docs.where(learned), text_col, lang_col))  # at most MIN_SHARE's bound a language
    source = to_python(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, 2 << 20):
            langs, score = filters.value.decide(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(langs, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    return source.mapInArrow(run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)
