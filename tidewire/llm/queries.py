"""The registered queries ``opN_<name>`` and their SQL twins."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .decontaminate import contamination
from .jaccard_join import jaccard_join
from .language_id import language_id
from .paragraph_dedup import repeated_paragraphs
from .pieces import PieceModel, round_trip
from .pii import pseudonymise
from .quality_classifier import quality_scores
from .quality_rules import BOILERPLATE, quality_rules
from .token_counts import length_histogram, with_suffix_sums
from .url_filter import url_filter

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Vocabulary files; set TIDEWIRE_TOKENIZERS to their folder where it is another.
TOKENIZERS = os.environ.get("TIDEWIRE_TOKENIZERS", "/opt/tokenizers")
PIECES, RANKS = f"{TOKENIZERS}/piece_bpe_32k.model", f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
#: The secret of the pseudonyms; set TIDEWIRE_PII_KEY wherever they leave the house. The default is open to all and for tests and benchmarks only.
PII_KEY = os.environ.get("TIDEWIRE_PII_KEY", "open key of tests and benchmarks")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text with pseudonyms, and the number of values replaced."""
    masked = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return masked.select("doc_id", "text", F.size("pii_found").cast("long").alias("n_pii"), F.array_join(F.array_sort(F.array_distinct("pii_found")), ",").alias("kinds"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), percent=90, shingle=3)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_suffix_sums(length_histogram(table(spark, sf_dir, "documents"), RANKS))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), PieceModel.load(PIECES))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(table(spark, sf_dir, "documents")).drop("removed_spans")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), folds=5, fold=0, threshold=0.3)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return language_id(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_pii": op2_pii,
    "op3_quality_rules": op3_quality_rules,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_token_counts": op5_token_counts,
    "op6_decontaminate": op6_decontaminate,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {
    "op1_url_filter": r"""
        WITH u AS (
          SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), hp AS (
          SELECT page_id,
                 translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
        ), r(rh, rp, rv) AS (
          VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                 ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), m AS (
          SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
          FROM hp JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY ALL
        )
        SELECT hp.page_id, hp.host, hp.path, m.rule, coalesce(m.rv, 'allow') AS verdict
        FROM hp LEFT JOIN m ON hp.page_id = m.page_id AND hp.host = m.host AND hp.path = m.path
    """,
    "op3_quality_rules": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
        pos AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) > 2),
        tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM pos),
        rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE c > 1) GROUP BY doc_id),
        ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
        dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        lm AS (
          SELECT doc_id, l, greatest(len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')), 1) AS n,
                 length(regexp_replace(l, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
                 len(regexp_extract_all(l, '[|»›•]')) AS bars,
                 len(regexp_extract_all(l, '[#*$%&<>{}\\^~=_]')) AS odd,
                 len(regexp_extract_all(l, '[!?]{2,}')) AS shouts FROM ln
        ), good AS (
          SELECT doc_id, sum(CASE WHEN (odd > 2 AND odd > n * 0.5) OR (shouts > 2 AND shouts > n * 0.5) OR (bars > 1 AND bars > n * 0.25)
              OR (n <= 15 AND regexp_matches(l, '(?i)@BOILERPLATE@'))
              THEN 0 ELSE chars END) AS chars FROM lm GROUP BY doc_id
        ), s AS (
          SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words,
                 CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
                 CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
                 CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, good.chars AS good_chars
          FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN rep ON rep.doc_id = w.doc_id LEFT JOIN good ON good.doc_id = w.doc_id
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
               NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
                 AND (word_chars = 0 OR 1 - CAST(good_chars AS DOUBLE) / word_chars <= 0.5) AS kept
        FROM s
    """,
    "op4_ngram_jaccard": r"""
        WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        g AS (SELECT doc_id, w, least(len(w), 3) AS n FROM dw WHERE len(w) > 0),
        s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + n - 1], ' ')) AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM g)),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * k >= 90 * (cx.n + cy.n - k)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
        SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id
        FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) m ON m.x = d.doc_id
    """,
    "op6_decontaminate": r"""
        WITH dw AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        bw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bn AS (SELECT item_id, w, least(len(w), 13) AS n FROM bw WHERE len(w) > 0),
        bg AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
        lens AS (SELECT DISTINCT n FROM bn),
        dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n),
        hit AS (SELECT doc_id, item_id, i, dp.n FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM dp) dp JOIN bg ON bg.n = dp.n AND bg.g = dp.g),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
        it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items FROM hit GROUP BY doc_id)
        SELECT dw.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
        FROM dw LEFT JOIN h ON h.doc_id = dw.doc_id LEFT JOIN it ON it.doc_id = dw.doc_id
    """,
}

ORACLE_SQL["op3_quality_rules"] = ORACLE_SQL["op3_quality_rules"].replace("@BOILERPLATE@", "|".join(BOILERPLATE).replace("'", "''"))
