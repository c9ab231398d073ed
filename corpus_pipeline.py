"""Corpus cleaning in five stages: language ID, line dedup, near-duplicate join, secret redaction, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; all but the last
return the columns of documents. A missing text stays missing where a stage keeps the row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrelq.llm import langid, linededup, ngramjoin, packing, secrets, wordpieces
from kestrelq.llm.common import id_bucket, ready, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language; the model is learned from the labelled ones that aren't held out."""
    ready(spark)
    docs = docs.select(*COLUMNS)
    return langid.identified(docs, langid.train(docs.where(id_bucket(F.col("doc_id"), 5) != 0)))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes boilerplate lines; a document that held nothing else goes, since the first one keeps them."""
    ready(spark)
    cleaned = linededup.deduplicated(docs.select(*COLUMNS))
    kept = cleaned.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_lines")))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of similar ones."""
    ready(spark)
    return ngramjoin.one_of_each(docs.select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text; documents stay."""
    ready(spark)
    text = secrets.redacted(docs.select(*COLUMNS))
    return text.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of 4096 tokens."""
    ready(spark)
    return packing.pack_documents(docs, wordpieces.default_vocabulary())


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("best-fit packing", best_fit_packing),
]

#: Prefix trees of byte contexts and merge tables have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "_"))
    return docs
