"""N-gram Jaccard join of whole documents by vertical partitioning.

The global order of shingle hashes is cut into fragments. A first pass counts, fragment by fragment, how many of a
document's shingles any other text holds, and sums the counts: texts with too few shared shingles can have no partner.
The others are ordered from rare to common shingles; texts that meet in a shingle of their prefixes are pairs to be
verified: partial overlaps are counted by pair and fragment of the shingle order, and summed per pair. No pair is left
out: the prefix, length, position, parity and shared-count filters only drop pairs that cannot reach the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import fragments as fr
from .common import Sets, Words, checkpointed, mix, private, row_key, small_or_shuffled, text_batches, to_python, written
from .links import FACTS, PARITIES, linked_components, parities, parts

#: Vertical fragments in which a pair's partial overlaps are counted.
FRAGMENTS = 4
#: Bytes of texts whose words are hashed together.
TOGETHER = 1 << 20


def signatures(sets: Sets) -> np.ndarray:
    """64-bit hashes of the sets, not SHARED."""
    total = sets.sums(mix(sets.hashes ^ np.uint64(0x5851F42D4C957F2D)))
    s = mix(total + np.diff(sets.before).astype(np.uint64)).view(np.int64)
    return np.where(s == fr.SHARED, 0, s)


def shingle_sets(docs: DataFrame, n: int, with_parts: bool) -> DataFrame:
    """(id, key, n, sig[, parities, parts]) of rows (id, key, text); sig is null for the empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_batches(batches, TOGETHER):
            sets = Sets.of(Words.of(batch.column("text")), n)
            size = np.diff(sets.before)
            cols = [batch.column("id"), batch.column("key"), pa.array(size), pa.array(signatures(sets), mask=size == 0)]
            if with_parts:
                cols += [*parities(sets), parts(sets, FRAGMENTS)]
            yield pa.RecordBatch.from_arrays(cols, ["id", "key", "n", "sig"] + [*PARITIES, "parts"] * with_parts)

    more = ", b0 long, b1 long, b2 long, b3 long, parts array<array<long>>" * with_parts
    return docs.mapInArrow(run, f"id long, key long, n long, sig long{more}")


def _send_all(docs: DataFrame, n: int, bits: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for batch in text_batches(batches, TOGETHER):
                sets = Sets.of(Words.of(batch.column("text")), n)
                yield signatures(sets)[sets.owner], sets.hashes

        yield from fr.send(rows(), bits)

    return docs.mapInArrow(run, fr.SCHEMA)


def _groups(docs: DataFrame, percent: int, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (id, key, n, sig), and (sig, root) of the sets that link with others."""
    source = to_python(docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")))
    meta = checkpointed(shingle_sets(source, shingle, False))
    total = meta.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    count = fr.n_fragments(total, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shared = fr.shared_counts(_send_all(source.select("text"), shingle, int(math.log2(count))), count)

    classes = meta.where("sig is not null").groupBy("sig").agg(F.min("key").alias("key"), F.first("n").alias("n"))
    able = checkpointed(classes.join(shared.select(F.col("owner").alias("sig"), F.col("n").alias("m")), "sig").where(f"100 * m >= {percent} * n").select("key", "sig"))
    few = source.join(small_or_shuffled(able.select("key")), "key", "left_semi")
    sets = written(shingle_sets(few, shingle, True).drop("id", "key").dropDuplicates(["sig"]), "sets")

    # Prefix in the order of document frequency: with ceil(p n) common shingles needed, one of the first n - ceil(p n) + 1 is common.
    tokens = sets.select("sig", "n", F.explode(F.flatten("parts")).alias("t"))
    known = tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    by_text = Window.partitionBy("sig")
    ranked = tokens.join(known, "t").select(
        "sig", "n", "t", F.row_number().over(by_text.orderBy("df", "t")).alias("rank"), F.count("*").over(by_text).alias("m")
    )
    # ``rest``: shingles from this place of the order on.
    prefix = ranked.where(f"rank + n - m <= n - cast(ceil({percent} * n / 100) as long) + 1").select("sig", "t", (F.col("m") - F.col("rank") + 1).alias("rest"))
    entries = checkpointed(prefix.join(sets.select("sig", "n", *PARITIES), "sig").select("t", *FACTS))
    joined = linked_components(entries, sets.select("sig", "parts"), percent)
    return meta, joined.select(F.col("node").alias("sig"), F.col("component").alias("root"))


def jaccard_join(docs: DataFrame, percent: int = 90, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row: texts link when their shingle sets' Jaccard similarity is at least ``percent`` %.

    Words are runs of characters other than space and \\t-\\r, A-Z lower-cased; a set holds the distinct runs of
    ``shingle`` words, or the whole sequence of a shorter text. Null and wordless texts have an empty set, link with
    nothing and are their own component. ``component_id`` is the least id that links reach. Ids are integers; rows
    that repeat an id are texts of their own that share the id; rows with a null id get the least non-null id they
    reach, else null. Equal sets are one node, so copies are never paired. Sets are compared by 64-bit hashes.
    """
    meta, linked = _groups(docs, percent, shingle, id_col, text_col)
    copies = meta.where("sig is not null").groupBy("sig").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("id").alias("ids"), F.count("*").alias("rows"))
    least = copies.join(linked, "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    roots = least.groupBy("root").agg(F.min("a").alias("component_id"))
    # Only texts whose component has another name than their own id need telling.
    told = checkpointed(least.join(roots, "root").where("a < b or ids < rows or not a <=> component_id").select("sig", "component_id"))
    return meta.join(small_or_shuffled(told), "sig", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_of_each(docs: DataFrame, percent: int = 90, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` but for copies: of each component of ``jaccard_join`` the row of the least id stays, of equal ids that of the least hash.

    Rows are told apart by id and text, so an id that repeats with another text is a row of its own; of rows that
    repeat both one stays. Rows without an id come after others. Rows without words link with nothing, and all stay.
    """
    meta, linked = _groups(docs, percent, shingle, id_col, text_col)
    rows = meta.where("sig is not null").groupBy("sig", "key").agg(F.min("id").alias("id"), F.count("*").alias("c"))
    rows = rows.join(linked, "sig", "left").select("key", "id", "c", F.coalesce("root", "sig").alias("root"))
    keepers = rows.groupBy("root").agg(F.min(F.struct(F.isnull("id"), "id", "key")).alias("kept"), F.count("*").alias("keys"), F.max("c").alias("most")).where("keys > 1 or most > 1")
    q, names = private(docs.columns), docs.columns
    told = rows.join(keepers.select("root", "kept"), "root").select(F.col("key").alias(q), (F.col("key") == F.col("kept.key")).alias(f"{q}_kept"), "c")
    told = checkpointed(told.where(~F.col(f"{q}_kept") | (F.col("c") > 1)).drop("c"))
    judged = docs.withColumn(q, row_key(id_col, text_col)).join(small_or_shuffled(told), q, "left")
    once = judged.where(F.col(f"{q}_kept")).dropDuplicates([q])
    return judged.where(F.isnull(f"{q}_kept")).unionByName(once).select(*names)
