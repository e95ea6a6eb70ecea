"""The corpus pipeline: quality, near duplicates, decontamination, secrets, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, jaccard, quality, secrets
from tessera.llm.common import setting, stored, table
from tessera.llm.queries import PIECES

#: Texts that a Python worker gets at once; the session's default of 10,000 can be far too many long ones.
TEXTS = "500"
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def _bounded(spark: SparkSession) -> None:
    """Stages are written by their caller, after they return, so the limit stays in the session; :func:`run` puts back
    what it was."""
    spark.conf.set(BATCH, TEXTS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go. A null, empty or blank text has too few words and goes; very long texts are measured whole;
    repeated rows are judged alike; an empty table stays empty; extra columns stay."""
    _bounded(spark)
    return quality.kept(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest id, of equal ids that of the smaller hash of
    id and text, of equal rows one. Documents without words (null, empty, blank) all stay; texts are compared whole; an empty
    table stays empty; extra columns stay, whatever their names."""
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold ten words of a benchmark item in a row, or all words of a shorter one. Null and empty texts have
    no words and stay; equal rows share a fate; rows of one id are judged by their own texts; an empty table stays empty."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are masked and n_chars follows; spans that overlap are one. Every row stays, null texts stay null with
    a null n_chars; texts are scanned whole; an empty table stays empty."""
    _bounded(spark)
    masked = secrets.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token ids of every row; null texts have null ids and a null n_tokens, empty ones none. Rows of one
    id and text get the same ids; an empty table stays empty."""
    _bounded(spark)
    coded = bpe.encode(docs, PIECES, seed=42, dropout=0.1)
    return coded.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids").cast("long")).alias("n_tokens"), "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding", sentencepiece),
]

#: SQL expresses neither the secret scan's spans nor the merge agenda.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next; the session's settings stay as they were."""
    docs = table(spark, sf_dir, "documents")
    with setting(spark, BATCH, TEXTS):
        for k, (_, stage) in enumerate(STAGES):
            docs = stored(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
