"""Cleaning of a training corpus, from ``documents`` to token ids, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of ``documents``.
Rows are told apart by id and text: rows that repeat an id with other texts, or have none, stay or go by themselves.
Null and empty texts have no words and are rejected by the quality rules; a later stage given them keeps them as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.common import checkpointed, row_key, small_or_shuffled, table, written
from tidewire.llm.decontaminate import contamination
from tidewire.llm.jaccard_join import one_of_each
from tidewire.llm.pieces import PieceModel, encode
from tidewire.llm.pii import pseudonymise
from tidewire.llm.quality_rules import quality_rules
from tidewire.llm.queries import PIECES, PII_KEY

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL can't express the keyed permutations and the merges of the last two stages.
ORACLE_SQL = None


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """The columns of documents with another text and its length."""
    return docs.withColumn("text", F.col(text)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that fail them; null and empty texts are not kept."""
    return _with_text(quality_rules(docs).where("kept"), "clean_text")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (Jaccard similarity of 3-word shingles at least 0.9), that of the least id; null and wordless texts all stay."""
    return one_of_each(docs, percent=90, shingle=3).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies in passages of ``benchmark``; null and wordless texts stay."""
    found = contamination(docs, table(spark, sf_dir, "benchmark"), key_col="key").where("contaminated").select(F.col("key").alias("__key")).distinct()
    return docs.withColumn("__key", row_key("doc_id", "text")).join(small_or_shuffled(checkpointed(found)), "__key", "left_anti").select(*COLUMNS)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and secrets replaced; null texts stay null and empty ones empty."""
    return _with_text(pseudonymise(docs, PII_KEY), "text")


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids; null texts have null ids and 0 tokens, empty ones none."""
    encoded = encode(docs.select("doc_id", "lang", "source", "text"), PieceModel.load(PIECES))
    return encoded.select("doc_id", "lang", "source", "text", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", clean_lines),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", decontaminate),
    ("PII", pseudonyms),
    ("SentencePiece encoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written to the checkpoint folder and read back."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
