"""From raw documents to packed training sequences, in five stages.

Each stage takes all that its predecessor kept and is written as Parquet before
the next one reads it. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import session
from spanloom.llm import lines, mixing, packing, quality, setsketch, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the word counts or the tokeniser's bands reject go."""
    return quality.judge(docs).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document left without a word goes too."""
    found = lines.dedup_lines(docs)
    text = F.col("kept_text")
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return found.filter((F.col("n_dropped") == 0) | text.rlike("[^\\x20\\x09-\\x0D]")).withColumn("text", text).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints connect, the one with the smallest doc_id stays.

    Shingles and distance are those of the registered query of this operator.
    """
    return simhash.drop_near_duplicates(docs, width=3, max_distance=3)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``near_dedup``, and of what it keeps no two texts that share 80 % of their five-word shingles."""
    return setsketch.drop_near_duplicates(session.stage(near_dedup(spark, docs, sf_dir), "fingerprint-dedup"), width=5, least=0.8)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as much of them, as the mix takes."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their place in sequences."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_copies),
    ("mixing sources", mixing_sources),
    ("packing", pack_sequences),
]

# Fingerprints, token counts and packing are not for SQL; the tests
# compare the stages with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = session.stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
