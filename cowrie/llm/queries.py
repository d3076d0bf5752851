"""Queries of the operators: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cowrie.llm import embeddings, html, language, lm, mixing, periodic, pieces, repeats, simhash, toxicity, turns, warc, winnow
from cowrie.llm.common import crc_bucket


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    mixed = mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of near-duplicate vectors."""
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log-probability under the model of the other folds."""
    return lm.score_held_out(_table(spark, sf_dir, "documents"))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html.main_texts(_table(spark, sf_dir, "pages"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as read back from its archive through the capture index."""
    return warc.archive_and_read(_table(spark, sf_dir, "pages")).drop("url")


def op6_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the sampled segmentations of every document, decoded again."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs, digest=True).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "samples")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return winnow.fingerprint_documents(_table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from two folds of three."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs.where(crc_bucket("doc_id", 3) != 1), labels.where(crc_bucket("doc_id", 3) != 1))
    held_out = (crc_bucket("doc_id", 3) == 1).alias("held_out")
    return toxicity.score(docs.select("doc_id", "text"), model).select("doc_id", held_out, "score", "predicted")


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four folds of five."""
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(crc_bucket("doc_id", 5) != 0))
    held_out = (crc_bucket("doc_id", 5) == 0).alias("held_out")
    return language.identify(docs.select("doc_id", "text"), model, spans=False).select("doc_id", held_out, "lang_pred", "score")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every document, with periods planted by its key."""
    return periodic.report(_table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and the cheapest repair of every damaged conversation."""
    return turns.repair_damaged(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without byte strings that an earlier place holds."""
    return repeats.report(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_mixing, op2_embedding_dedup, op3_lm_scoring, op4_html_extraction, op5_warc, op6_piece_sampling, op7_fingerprints, op8_toxicity, op9_simhash_dedup, op10_language_id, op11_periodic_runs, op12_conversation_repair, op13_suffix_dedup)
}

ORACLE_SQL: dict[str, str] = {"op1_mixing": mixing.SQL, "op5_warc": warc.SQL, "op12_conversation_repair": turns.SQL}
