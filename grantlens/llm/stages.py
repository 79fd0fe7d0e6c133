"""Stages of the corpus pipeline. Each takes (spark, docs, sf_dir); all but the last return the columns of docs.

docs needs doc_id, text and lang; it may have more columns, of any name. Rows without doc_id take part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, langid, packing, secrets, simhash
from .common import shipped, stage, table

def least_score(languages: int) -> float:
    """A fifteenth of the way from a guess among so many languages to certainty: 0.3 among four."""
    guess = 1 / languages
    return guess + (1 - guess) / 15


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a determined language go: no letter, or no language beyond a guess among those learned."""
    training = langid.Training()
    model = langid.train(langid.sample(docs, training, "doc_id", "text", "lang"), training)
    found = langid.predict(docs, model, "doc_id", "text", carry=True)
    bound = least_score(len(model.languages)) - 1e-9 if model else 0.0
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= bound)).select("row.*")


def one_per_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays.

    If several rows of a group have that doc_id, one of them stays. Groups that share their smallest
    doc_id keep a row each. Rows without doc_id all stay.
    """
    found = simhash.near_duplicates(docs, with_hash=True).where(F.col("doc_id") == F.col("component_id"))
    rows = found.groupBy("root", F.col("doc_id").alias("_llm_id"), F.col("h").alias("_llm_h")).agg(F.count("*").alias("_llm_n"))
    kept = stage(rows.groupBy("root").agg(F.min_by(F.struct("_llm_id", "_llm_h", "_llm_n"), "_llm_h").alias("x")).select("x.*"), "kept")
    hashed = docs.withColumn("_llm_text_h", F.xxhash64(F.coalesce("text", F.lit("")).cast("binary")))
    same = (F.col("doc_id") == F.col("_llm_id")) & (F.col("_llm_text_h") == F.col("_llm_h"))
    once = hashed.join(kept.where("_llm_n = 1"), same, "left_semi")
    again = hashed.join(kept.where("_llm_n > 1"), same, "left_semi").dropDuplicates(["doc_id", "_llm_text_h"])
    return once.unionByName(again).drop("_llm_text_h").unionByName(docs.where(F.col("doc_id").isNull()))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contract's rule calls contaminated with benchmark items go."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"), with_hash=True)
    bad = found.where(decontam.contaminated()).select(F.col("doc_id").alias("_llm_id"), F.col("h").alias("_llm_h")).distinct()
    hashed = docs.withColumn("_llm_text_h", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_llm_id")) & (F.col("_llm_text_h") == F.col("_llm_h"))
    return hashed.join(bad, same, "left_anti").drop("_llm_text_h")


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of secrets become a mark; n_chars, where there is one, follows the text."""
    made = secrets.redact(docs)
    return made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else made


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", shipped(languages)),
    ("simhash_near_dedup", shipped(one_per_group)),
    ("benchmark_decontamination", shipped(uncontaminated)),
    ("secret_scans", shipped(redacted)),
    ("best_fit_packing", shipped(packed)),
]
