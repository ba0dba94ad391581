"""Links of sets that meet in buckets, verified pair by pair, and the components that they make.

Every pair of sets of a bucket is decided, but only pairs that may link are compared: their sizes, what is left of them
behind the shingle in which they meet, and the Hamming distance of 256-bit parities of their sets bound what they can
share. Sets are first compared with one set of each bucket; sets that this links are one component and need no further
comparison with each other, so a group of copies costs about one comparison for each copy and bucket. What has another
component than its bucket's hub is then compared with all sets of the bucket, in blocks where a bucket is large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Sets, checkpointed, small_or_shuffled
from .components import components

#: Sets of a bucket that one block holds.
BLOCK = 1024
#: Orders by which buckets choose their hubs.
ORDERS = 3
PARITIES = ("b0", "b1", "b2", "b3")
#: Columns of a set that ``may_link`` reads; ``rest`` bounds what it can share with a set that it first meets in this entry.
FACTS = ("sig", "n", "rest", *PARITIES)


def parities(sets: Sets) -> list[pa.Array]:
    """256 bits of each set as four longs: whether an odd number of its hashes has this bit's number as low byte."""
    texts = len(sets.before) - 1
    odd = np.bincount(sets.owner * 256 + (sets.hashes & np.uint64(255)).astype(np.int64), minlength=texts * 256) & 1
    bits = np.packbits(odd.astype(bool).reshape(-1, 256), axis=1, bitorder="little").view(np.int64) if texts else np.empty((0, 4), np.int64)
    return [pa.array(bits[:, k].copy()) for k in range(4)]


def parts(sets: Sets, fragments: int) -> pa.ListArray:
    """Each set cut by the order of hashes into vertical fragments (a power of two)."""
    texts, bits = len(sets.before) - 1, int(fragments).bit_length() - 1
    at = sets.owner * fragments + ((sets.hashes >> np.uint64(64 - bits)).astype(np.int64) if bits else 0)
    inner = pa.ListArray.from_arrays(pa.array(np.searchsorted(at, np.arange(texts * fragments + 1)).astype(np.int32)), pa.array(sets.hashes.view(np.int64)))
    return pa.ListArray.from_arrays(pa.array((np.arange(texts + 1) * fragments).astype(np.int32)), inner)


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether two sets can have a Jaccard similarity of ``percent`` %, by bounds that never exclude a pair that has it."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    both = x("n") + y("n")
    apart = sum((F.bit_count(x(c).bitwiseXOR(y(c))) for c in PARITIES[1:]), F.bit_count(x("b0").bitwiseXOR(y("b0"))))
    return (
        (100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n")))
        & (F.least(x("rest"), y("rest")) * (100 + percent) >= percent * both)
        & (apart * (100 + percent) <= both * (100 - percent))
    )


def _pairs(joined: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, both) of rows (x, y) that may link."""
    x, y = F.col("x.sig"), F.col("y.sig")
    return joined.where((x != y) & may_link("x", "y", percent)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), (F.col("x.n") + F.col("y.n")).alias("both")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link: partial overlaps are counted by pair and vertical fragment, and summed by pair."""
    cut = sets.select("sig", F.posexplode("parts").alias("f", "part")).where(F.size("part") > 0)
    first = pairs.join(cut.select(F.col("sig").alias("a"), "f", F.col("part").alias("p")), "a")
    both = first.join(cut.select(F.col("sig").alias("b"), "f", F.col("part").alias("q")), ["b", "f"])
    counted = both.select("a", "b", "both", F.size(F.array_intersect("p", "q")).cast("long").alias("k")).groupBy("a", "b", "both").agg(F.sum("k").alias("k"))
    return counted.where(100 * F.col("k") >= percent * (F.col("both") - F.col("k"))).select("a", "b")


def linked_components(entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets (sig, parts) that link, of those that meet in a bucket ``t`` of ``entries`` (t, FACTS).

    ``entries`` and ``sets`` are checkpointed or written; a set has one entry for each of its buckets.
    """
    facts = F.struct(*FACTS)
    hubs = entries.groupBy("t").agg(F.min_by(facts, F.xxhash64("sig", F.pmod("t", F.lit(ORDERS)))).alias("y"), F.count("*").alias("c")).where("c > 1")
    # Of its own, so that a shuffled join with it can split the entries of a hot bucket.
    met = checkpointed(entries.join(small_or_shuffled(checkpointed(hubs)), "t").select("t", "c", "y", facts.alias("x")))
    links = checkpointed(verified(_pairs(met, percent), sets, percent))

    known = checkpointed(components(links))
    named = lambda side: known.select(F.col("node").alias(f"{side}_node"), F.col("component").alias(f"{side}_label"))
    labelled = (
        met.join(named("x"), F.col("x.sig") == F.col("x_node"), "left").join(named("y"), F.col("y.sig") == F.col("y_node"), "left")
        .select("t", "c", "x", "y", F.coalesce("x_label", "x.sig").alias("label"), F.coalesce("y_label", "y.sig").alias("hub_label"))
    )
    # Only hubs differ in their component from sets that were compared with them; all else of a bucket is still to be compared with those.
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    apart = labelled.where((F.col("label") != F.col("hub_label")) & (F.col("c") > 2)).select("t", "label", "x", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"))
    others = labelled.where("x.sig <> y.sig and c > 2").select("t", F.col("label").alias("other"), F.col("x").alias("y"), F.pmod(F.xxhash64("x.sig", F.lit(3)), blocks).cast("int").alias("block"))
    rest = checkpointed(verified(_pairs(apart.join(others, ["t", "block"]).where("label <> other"), percent), sets, percent))
    return components(links.unionByName(rest)) if rest.take(1) else known
