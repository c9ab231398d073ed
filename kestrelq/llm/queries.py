"""The queries of this subpackage, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import annsearch, bitpack, bpe, langid, linededup, lm, media, ngramjoin, packing, secrets, wordpieces
from .common import documents, id_bucket, ready


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir, "doc_id", "text")))


def op2_projected_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    return annsearch.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def op3_token_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitpack.pack_and_read(documents(spark, sf_dir, "doc_id", "text"), wordpieces.default_vocabulary(), end_id=2)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    held_out = id_bucket(F.col("doc_id"), 5) == 0
    found = langid.predict(docs, langid.train(docs.where(~held_out)))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similarity_classes(documents(spark, sf_dir, "doc_id", "text"))


def op6_avi_mjpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(documents(spark, sf_dir, "doc_id", "text"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir, "doc_id", "text"), wordpieces.default_vocabulary())


def op8_log_bilinear_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir, "doc_id", "text"))


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir, "doc_id", "text"), bpe.default_vocabulary())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.deduplicated(documents(spark, sf_dir, "doc_id", "text", "source")).select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan,
        op2_projected_kdtree,
        op3_token_bitpack,
        op4_language_id,
        op5_ngram_jaccard_join,
        op6_avi_mjpeg,
        op7_best_fit_packing,
        op8_log_bilinear_lm,
        op9_bpe_round_trip,
        op10_line_dedup,
    )
}
ORACLES = {"op10_line_dedup": linededup.ORACLE}
