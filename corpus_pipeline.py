"""From raw documents to packed sequences: quality rules, near-dedup, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and reads it back as the next stage's ``docs``.  All stages but the last return the
columns of ``documents``; further columns pass through all of these, whatever their names.

Edge cases: null and empty texts have too few words for the quality rules and go; rows with a null doc_id are
judged like the others, after those with one; rows that repeat a doc_id are judged by their own texts; rows that repeat
doc_id and text count once; of equal or near texts the smallest doc_id stays, whatever its order in the table; very long texts are
judged and cut whole; without usable labels the base rules alone decide; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import decontamination, packing, pii, quality_rules, simhash
from tracewell.plans.staging import stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor the learned decision list reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rules = quality_rules.learned_list(docs, labels)
    return quality_rules.judged(docs, rules).where("kept").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies; those without a doc_id come last."""
    return simhash.deduplicated(docs, judge_null_ids=True)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by the name of its kind, and their new lengths."""
    return pii.redacted(docs).withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), "n_chars")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("pii", redact),
    ("best-fit packing", pack),
]

#: The stages hold learned rules, fingerprints and tokens, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
