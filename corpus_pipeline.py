"""The corpus pipeline: language ID, toxicity, near-duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns
the columns of ``documents``; the last returns packed pieces. ``run`` writes every stage to the
shared folder and reads it again, so a lost executor costs no more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayline.llm import langid, packing, secrets_scan, simhash, toxicity
from assayline.llm.common import id_remainder, materialise, table
from assayline.llm.queries import tokenizer_path


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts in a language that was learned; null texts and texts without a letter go."""
    model = langid.train(docs.where(id_remainder(F.col("doc_id"), 3) != 1).select("doc_id", "text", "lang"))
    return docs.where(langid.predictor(docs, model)(F.col("text"))["lang_pred"] != langid.UNDETERMINED)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that are not predicted to be toxic."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), lambda i: id_remainder(i, 5) != 0)
    return docs.where(toxicity.scorer(docs, model)(F.col("text")) < 0.5)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of texts that share 0.8 of their five-word shingles."""
    return simhash.deduplicate(docs, width=5, least=0.8)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret found, in any layer, and count the characters anew."""
    clean = docs.withColumn("text", secrets_scan.redact(F.col("text")))
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the tokens of what is left into windows."""
    pieces = packing.pack(docs, tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language_id", language_id), ("toxicity", toxicity_filter), ("near_duplicates", near_duplicates), ("secret_scan", secret_redaction), ("packing", pack_windows)]

#: Trained models, fingerprints and tokenizers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
