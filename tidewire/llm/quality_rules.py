"""Line-first document cleaning with DataFrame functions only.

Every line is judged by punctuation, navigation and boilerplate rules; failing lines go, and a document that loses too
much of its text is rejected. Four repetition and symbol statistics of the whole text come with it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import private, words

SYMBOLS = r"[#*$%&|<>]"

# Phrases of legal and navigation boilerplate in four languages, matched case-insensitively in lines of few words.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "terms of use", "terms of service", "privacy policy",
    "cookie policy", "use of cookies", "enable javascript", "subscribe to our", "sign up for", "click here", "read more",
    "copyright ©", "powered by",
    "todos los derechos reservados", "política de privacidad", "política de cookies", "términos de uso", "aviso legal", "haga clic aquí", "leer más", "suscríbete a",
    "tous droits réservés", "politique de confidentialité", "politique de cookies", "conditions d'utilisation", "mentions légales", "cliquez ici", "lire la suite", "abonnez-vous",
    "alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "cookie-richtlinie", "impressum", "hier klicken", "weiterlesen", "newsletter abonnieren",
)


@dataclass(frozen=True)
class LineRules:
    """Limits of the line rules and of the share of text that a document may lose."""

    max_symbols_per_word: float = 0.5
    max_shouts_per_word: float = 0.5
    max_bars_per_word: float = 0.25
    boilerplate_words: int = 15
    max_lost_share: float = 0.5
    min_words: int = 50
    max_repeat_share: float = 0.5


def _count(text: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))


def line_fails(line: Column, rules: LineRules = LineRules()) -> Column:
    """True for a line that the punctuation, navigation or boilerplate rule removes; blank lines never fail."""
    n = F.greatest(_count(line, "[^\\x20\\x09-\\x0D]+"), F.lit(1))
    bars = _count(line, r"[|»›•]")
    odd = _count(line, r"[#*$%&<>{}\\^~=_]")
    shouts = _count(line, r"[!?]{2,}")
    return (
        ((odd > 2) & (odd > n * rules.max_symbols_per_word))
        | ((shouts > 2) & (shouts > n * rules.max_shouts_per_word))
        | ((bars > 1) & (bars > n * rules.max_bars_per_word))
        | ((n <= rules.boilerplate_words) & line.rlike("(?iu)" + "|".join(BOILERPLATE)))
    )


def windows_sorted(w: Column) -> Column:
    """Hashes of the 3-word windows of ``w`` with their places, sorted; pass a real column, as it is read for every window."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    # The partition's number, always at least 0, keeps the optimiser from moving filters on results below this column:
    # it would write its whole expression into the functions that read it for every window.
    return F.when((F.size(w) > 3) & (F.spark_partition_id() >= 0), F.sort_array(hashed))


def repeated_words(s: Column) -> Column:
    """Words that lie in a window found at least twice, its first place included, from ``windows_sorted`` as a real column.

    Equal neighbours mark both places; marked places in order cover min(3, distance to the one before) words each.
    """
    marked = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"])))
    places = F.sort_array(F.transform(marked, lambda x: x["i"]))
    summed = F.aggregate(
        places, F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p + 3 - a["end"])).cast("long").alias("n"), (p + 3).alias("end")),
    )
    return F.when(s.isNull(), F.lit(0).cast("long")).otherwise(summed["n"])


def quality_rules(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` plus the statistics, ``base_failed``, ``lost_share``, ``clean_text`` and ``kept``.

    Statistics (long): ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``. ``base_failed``:
    fewer than ``min_words`` words, or more than ``max_repeat_share`` of them in repeated windows. ``lost_share``: the
    share of word characters in failing lines. ``kept``: not base_failed and no more lost than ``max_lost_share``.
    A null text has no words, so it fails; its ``clean_text`` is null. Repeated rows are judged each; columns of
    ``docs`` with the names of results are replaced.
    """
    q = private(docs.columns)
    text, t = F.col(text_col), F.col(f"{q}_t")
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "lost_share", "clean_text", "kept"]
    kept_cols = [F.col(c) for c in docs.columns if c.lower() not in made or c == text_col]
    spaces = "[\\x20\\x09-\\x0D]+"
    chars = lambda x: F.length(F.regexp_replace(x, spaces, ""))
    staged = (
        docs.select(*kept_cols, F.coalesce(text, F.lit("")).alias(f"{q}_t"))
        .withColumn(f"{q}_w", words(t))
        .withColumn(f"{q}_lines", F.split(t, "\n"))
        .withColumn(f"{q}_full", F.filter(f"{q}_lines", lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
        .withColumn(f"{q}_good", F.filter(f"{q}_lines", lambda x: ~line_fails(x, rules)))
        .withColumn(f"{q}_s", windows_sorted(F.col(f"{q}_w")))
        .withColumn("n_words", F.size(f"{q}_w").cast("long"))
        .withColumn("word_chars", chars(t).cast("long"))
        .withColumn("n_symbols", _count(t, SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size(f"{q}_full") - F.size(F.array_distinct(f"{q}_full"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col(f"{q}_s")))
        .withColumn("base_failed", (F.col("n_words") < rules.min_words) | (F.col("n_repeat_words") > rules.max_repeat_share * F.col("n_words")))
        .withColumn(f"{q}_clean", F.array_join(f"{q}_good", "\n"))
        .withColumn("lost_share", F.when(F.col("word_chars") > 0, 1 - chars(F.col(f"{q}_clean")) / F.col("word_chars")).otherwise(F.lit(0.0)))
        .withColumn("clean_text", F.when(text.isNotNull(), F.col(f"{q}_clean")))
        .withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= rules.max_lost_share))
    )
    return staged.drop(f"{q}_t", f"{q}_w", f"{q}_lines", f"{q}_full", f"{q}_good", f"{q}_clean", f"{q}_s")
