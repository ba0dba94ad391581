"""Benchmark decontamination by winnowing, with DataFrame functions only.

Of every 9 neighbouring 5-word grams of a text the one with the least hash is kept. Two texts that share 13 words keep
a common gram there, so a join of kept grams meets every shared span of that length; each hit is then extended word by
word to both sides, and stands if at least 13 words agree. Shorter items are looked up as whole grams of their length.

Texts are cut into chunks that overlap by a window less one word, so memory doesn't follow a text's length. A one-row
bitmap of the items' grams drops, inside each chunk, the grams that no item keeps; only the others are joined, with the
words around them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bitmap_of, checkpointed, holds, row_key, small_or_shuffled, written

WINDOW, GRAM = 13, 5
#: Grams that a winnowing window spans: GRAM + SPAN - 1 == WINDOW.
SPAN = WINDOW - GRAM + 1
#: Words that a chunk adds to those of the chunks before it.
CHUNK = 4096
#: A kept gram is one long: 51 bits of hash over 13 bits of its place in the chunk.
PLACE_BITS = 13
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def item_words(text: Column) -> Column:
    """Words of letters, digits and non-ASCII characters of the A-Z-lower-cased text; null: empty."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(_WORD), F.lit(0)), F.array().cast("array<string>"))


def gram_hash(w: Column, i: Column, n: int) -> Column:
    return F.xxhash64(*(F.get(w, i + k) for k in range(n)))


def gram_keys(w: Column, n: int = GRAM) -> Column:
    """Hash and place of every n-word gram of ``w``, as longs; pass a real column."""
    mask = (1 << PLACE_BITS) - 1
    keys = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: gram_hash(w, i, n).bitwiseAND(F.lit(~mask)).bitwiseOR(i.cast("long")))
    return F.when(F.size(w) >= n, keys)


def winnowed(keys: Column) -> Column:
    """The least key of each window of SPAN neighbouring ones, once each; null if there is no full window."""
    least = F.transform(F.sequence(F.lit(1), F.size(keys) - SPAN + 1), lambda i: F.array_min(F.slice(keys, i, SPAN)))
    return F.when(F.size(keys) >= SPAN, F.array_distinct(least))


def _place(key: Column) -> Column:
    return key.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")


def _hash(key: Column) -> Column:
    return F.shiftright(key, PLACE_BITS)


def _chunks(rows: DataFrame, *carry: str) -> DataFrame:
    """``carry`` with the chunks ``w`` of each row's words and their numbers; a row without words has one empty chunk."""
    w = F.col("w")
    last = F.greatest(F.ceil((F.size(w) - (WINDOW - 1)) / CHUNK).cast("int") - 1, F.lit(0))
    # outer: for others the optimiser would first compute the size of the array, and with it the words, once more
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(w, i * CHUNK + 1, CHUNK + WINDOW - 1))
    return rows.select(*carry, F.posexplode_outer(cut).alias("chunk", "w"))


def _around(w: Column, p: Column) -> list[Column]:
    """Words before a place, the nearest first, and from it on: as many as a window that holds a gram there can have."""
    left = F.least(p, F.lit(SPAN - 1))
    return [F.reverse(F.slice(w, p - left + 1, left)).alias("l"), F.slice(w, p + 1, WINDOW).alias("r")]


def _item_grams(items: DataFrame) -> DataFrame:
    """(n, h, ik, item, il, ir, need): kept grams of items and whole shorter items, with the words around; places with the same words around count once."""
    w = F.col("w")
    cut = _chunks(items.where(F.size("w") >= WINDOW), "ik", "item").withColumn("g", gram_keys(w)).select("ik", "item", "w", F.explode_outer(winnowed(F.col("g"))).alias("x"))
    kept = cut.select(F.lit(GRAM).alias("n"), _hash(F.col("x")).alias("h"), "ik", "item", *_around(w, _place(F.col("x"))), F.lit(WINDOW).alias("need"))
    short = items.where(F.size("w") < WINDOW)
    whole = F.coalesce(*(F.when(F.size(w) == n, gram_hash(w, F.lit(0), n)) for n in range(1, WINDOW)))
    short = short.select(F.size(w).alias("n"), F.shiftright(whole, PLACE_BITS).alias("h"), "ik", "item", F.slice(w, 1, 0).alias("l"), w.alias("r"), F.size(w).alias("need"))
    # A whole short item of GRAM words is no kept gram: its length is told apart by a negative sign.
    return kept.unionByName(short.withColumn("n", -F.col("n"))).withColumnsRenamed({"l": "il", "r": "ir"}).dropDuplicates(["n", "h", "ik", "il", "ir"])


def _agree(a: Column, b: Column, most: int) -> Column:
    """Words at the head of two arrays that agree, up to ``most``."""
    out = F.lit(most)
    for k in reversed(range(most)):
        out = F.when((F.get(a, F.lit(k)) == F.get(b, F.lit(k))).eqNullSafe(F.lit(True)), out).otherwise(F.lit(k))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", min_share: float = 0.05, key_col: str | None = None) -> DataFrame:
    """Contamination of each row: (id, n_words, n_hit, n_items, items, contaminated).

    A window is 13 consecutive words of an item, or the whole item if it is shorter; a word of the text inside any
    occurrence of a window is hit. ``items``: ids, as sorted strings, of items with an occurring window. A text is
    contaminated if at least ``min_share`` of its words, and one at least, are hit. Null and wordless texts have no
    words and are clean; wordless items have no window. Repeated rows get a result each; of repeated item ids each
    text counts, the id once. Texts and items may be of any length and number: they are read in chunks, kept grams are
    joined, and a side is broadcast only if its counted bytes are few. ``key_col``: a column for each row's key of id and
    text, as ``row_key`` has it.
    """
    source = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    items = checkpointed(
        benchmark.select(F.col(item_col).cast("string").alias("item"), item_words(F.col("text")).alias("w")).where(F.size("w") > 0)
        .withColumn("ik", F.xxhash64("item", "w")).dropDuplicates(["ik"])
    )
    lengths = sorted(r[0] for r in items.where(F.size("w") < WINDOW).select(F.size("w")).distinct().collect())  # 12 values at most
    item_grams = checkpointed(_item_grams(items))
    # The bitmap holds kept grams, whole short items, and, to look these up, their first words.
    first = items.where(F.size("w") < WINDOW).select(F.shiftright(gram_hash(F.col("w"), F.lit(0), 1), PLACE_BITS).alias("h"))
    hashes = item_grams.select("h").unionByName(first).distinct()
    bitmap, longs = bitmap_of(hashes)

    w, bits = F.col("w"), F.col("bitmap")
    worded = source.select("id", "key", item_words(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    chunks = _chunks(worded, "id", "key", "n_words").crossJoin(F.broadcast(bitmap)).withColumn("g", gram_keys(w)).withColumn("k", winnowed(F.col("g")))
    entry = lambda n, h, p: F.struct(F.lit(n).alias("n"), h.alias("h"), p.alias("p"), *_around(w, p))
    found = F.transform(F.filter("k", lambda x: holds(bits, _hash(x), longs)), lambda x: entry(GRAM, _hash(x), _place(x)))
    found = F.coalesce(found, F.slice(F.array(entry(GRAM, F.lit(0).cast("long"), F.lit(0))), 1, 0))
    if lengths:
        short = lambda i, n: F.shiftright(gram_hash(w, i, n), PLACE_BITS)
        begins = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0))), lambda i: (i < F.size(w)) & holds(bits, short(i, 1), longs))
        chunks = chunks.withColumn("begins", begins)

        def whole(n: int) -> Column:
            return F.transform(F.filter("begins", lambda i: (i + n <= F.size(w)) & holds(bits, short(i, n), longs)), lambda i: entry(-n, short(i, n), i))

        found = F.concat(found, *map(whole, lengths))
    marks = written(chunks.select("id", "key", "n_words", "chunk", found.alias("found")), "marks")
    grams = marks.select("key", "chunk", F.explode_outer("found").alias("x")).where("x is not null").select("key", (F.col("x.p") + F.col("chunk").cast("long") * CHUNK).alias("p"), "x.n", "x.h", "x.l", "x.r")
    spans = (
        grams.join(small_or_shuffled(item_grams), ["n", "h"])
        .withColumn("left", F.when(F.col("n") > 0, _agree(F.col("l"), F.col("il"), SPAN - 1)).otherwise(F.lit(0)))
        .withColumn("right", _agree(F.col("r"), F.col("ir"), WINDOW))
        .where(F.col("left") + F.col("right") >= F.col("need"))
        .select("key", "item", (F.col("p") - F.col("left")).alias("a"), (F.col("p") + F.col("right")).alias("b"))
    )
    merged = spans.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("spans"), F.sort_array(F.collect_set("item")).alias("items"))
    total = F.aggregate(
        F.col("spans"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], s["end"]))).cast("long").alias("n"), F.greatest(s["end"], x["b"]).alias("end")),
    )
    hits = checkpointed(merged.select("key", total["n"].alias("n_hit"), "items"))
    counted = marks.where("chunk = 0").select("id", "key", "n_words")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return counted.join(small_or_shuffled(hits), "key", "left").select(
        F.col("id").alias(id_col), *([F.col("key").alias(key_col)] if key_col else []), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        ((n_hit > 0) & (n_hit * (1 / min_share) >= F.col("n_words"))).alias("contaminated"),
    )
