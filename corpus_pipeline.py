"""From raw documents to packed sequences, stage by stage; each stage's result is a written table.

quality rules -> quality classifier -> near-dedup -> substring dedup -> best-fit packing.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept, and returns the
columns of ``documents`` (the last one: the pieces and their places). Null texts are empty ones, null ids are kept,
repeated rows are copies of each other (one stays), an empty table stays empty, and extra columns go through
to the last stage. Substring dedup replaces ``text`` and, where it is a column, ``n_chars``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import classifier, near, packing, rules, substring
from quire.llm.queries import BYTE_BPE, PACK_END, tokenizer_file
from quire.llm.shared import drop_table, read_table, write_table


#: bytes in one Arrow batch: whole texts and sets of shingles can be large, and executors hold several batches at once. Results don't depend on it
BATCH_BYTES = "8m"


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return rules.keep_good(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled documents of the whole collection, judges those that are left."""
    _small_batches(spark)
    model = classifier.fit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return classifier.keep_good(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Verified five-word similarity of 0.8 or more of texts that SimHash fingerprints or, beyond their radius, MinHash values bring together."""
    _small_batches(spark)
    return near.drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    columns = docs.columns
    made = substring.drop_repeats(docs.withColumnsRenamed({c: f"__own_{c}" for c in ("n_words", "n_removed") if c in columns}))
    if "n_chars" in columns:
        made = made.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return made.drop("n_words", "n_removed").withColumnsRenamed({f"__own_{c}": c for c in ("n_words", "n_removed")}).select(*columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return packing.pack_documents(docs, tokenizer_file(BYTE_BPE), PACK_END)


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Compression, fingerprints and token ids have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read_table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            drop_table(before)  # the next stage is whole
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
