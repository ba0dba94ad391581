"""Token counts by an exact histogram of encoded lengths.

Documents are aggregated by their number of tokens; sums over the longer ones answer, for every context limit at once,
how many documents and tokens there are, how many stay after truncation, and at which length any quantile lies.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_batches, to_python

#: Fixed value: the pattern that cuts texts before the merges of byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths are summed within blocks of this many first, then over blocks.
BLOCK = 1024

_ENCODING: dict[int, object] = {}


def encoding(ranks: bytes, pattern: str = PATTERN):
    """The encoding of a rank file's content, one for a worker."""
    import tiktoken

    key = zlib.crc32(ranks + pattern.encode())
    if key not in _ENCODING:
        _ENCODING.clear()
        table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
        _ENCODING[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODING[key]


def token_lengths(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens) of every row; null texts have 0 tokens; strings of special tokens in a text are ordinary text."""
    shared = _ranks(docs, ranks_path)
    source = to_python(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    kind = source.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(shared.value)
        for batch in text_batches(batches):
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_lengths(e, batch), pa.int64())], ["id", "n_tokens"])

    return source.mapInArrow(run, f"id {kind}, n_tokens long").withColumnRenamed("id", id_col)


def _ranks(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file: its size doesn't depend on the data


def _lengths(e, batch: pa.RecordBatch) -> list[int]:
    return [len(e.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]


def length_histogram(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) of all rows; tasks send one row for each length and stretch of texts."""
    shared = _ranks(docs, ranks_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(shared.value)
        for batch in text_batches(batches):
            length, n = np.unique(np.array(_lengths(e, batch), np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(n, pa.int64())], ["n_tokens", "n_docs"])

    parts = to_python(docs.select(F.col(text_col).alias("text"))).mapInArrow(run, "n_tokens long, n_docs long")
    return parts.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for each length L: ``docs_longer`` (more than L), ``tokens_longer`` (their tokens), ``tokens_total``
    (of texts up to L), ``tokens_kept`` (of all texts, cut at L tokens) and ``share`` (of texts up to L). An empty histogram stays empty.
    """
    # Both its own rows and the sums of its blocks are read.
    blocked = checkpointed(histogram).withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("n_docs"))
    sums = blocked.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    # One row for each 1024 lengths: few, whatever the number of texts.
    after = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    zero = F.lit(0).cast("long")
    sums = sums.select("block", F.coalesce(F.sum("d").over(after), zero).alias("d"), F.coalesce(F.sum("t").over(after), zero).alias("t"), F.sum("d").over(every).alias("all_d"), F.sum("t").over(every).alias("all_t"))
    inside = Window.partitionBy("block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(inside), zero)
    more = F.coalesce(F.sum("tokens").over(inside), zero)
    return (
        blocked.select("block", "n_tokens", "n_docs", longer.alias("l"), more.alias("m"))
        .join(sums, "block")
        .select("n_tokens", "n_docs", (F.col("l") + F.col("d")).alias("docs_longer"), (F.col("m") + F.col("t")).alias("tokens_longer"), "all_d", "all_t")
        .select(
            "n_tokens", "n_docs", "docs_longer", "tokens_longer", (F.col("all_t") - F.col("tokens_longer")).alias("tokens_total"),
            (F.col("all_t") - F.col("tokens_longer") + F.col("n_tokens") * F.col("docs_longer")).alias("tokens_kept"),
            ((F.col("all_d") - F.col("docs_longer")) / F.col("all_d")).alias("share"),
        )
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, docs_longer, tokens_kept) for any context limits, from ``with_suffix_sums``."""
    spark = sums.sparkSession
    asked = spark.createDataFrame([(x,) for x in limits], "limit long")
    # The longest length up to the limit knows all that is longer; without one, every text is cut.
    below = asked.join(sums, F.col("n_tokens") <= F.col("limit")).groupBy("limit").agg(F.max_by(F.struct("docs_longer", "tokens_total"), "n_tokens").alias("x"))
    everything = sums.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n"))
    return asked.join(below, "limit", "left").join(F.broadcast(everything)).select(
        "limit", F.coalesce("x.docs_longer", "n").alias("docs_longer"),
        (F.coalesce("x.tokens_total", F.lit(0)) + F.col("limit") * F.coalesce("x.docs_longer", "n")).alias("tokens_kept"),
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(share, n_tokens): the least length that this share of the texts doesn't exceed."""
    asked = sums.sparkSession.createDataFrame([(x,) for x in shares], "q double")
    return asked.join(sums, F.col("share") >= F.col("q")).groupBy("q").agg(F.min("n_tokens").alias("n_tokens")).withColumnRenamed("q", "share")
