"""The corpus pipeline: documents through five text operators, each on all that the one before it kept.

Stages take and give the columns of `documents`; the last gives segmentations.
Rows are kept or dropped by their texts, whatever their other columns hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm import decontaminate, pieces, quality, secrets, simhash
from lamina.llm.common import free_name, quoted, shared_folder, table, written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least a half; the classifier learns from the documents themselves."""
    whole = docs.select(F.struct("*").alias("row"), "text")
    return quality.scored(whole, quality.fit(docs)).where("kept").select("row.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8) the document of the smallest id."""
    return simhash.keep_one(docs)


def off_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage is found; a text decides for the rows that hold it, not for its id."""
    name = free_name(docs, "own")
    named = docs.withColumn(name, F.xxhash64("text"))
    found = decontaminate.overlaps(named, table(spark, sf_dir, "benchmark"), doc_key=name)
    leaked = written(found.select(F.col("doc").alias(name)).distinct(), "leaked")
    return named.join(leaked, name, "left_anti").select(*map(quoted, docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts replaced and `n_chars` counted anew where there were any."""
    ledger = secrets.update(docs, shared_folder(spark, "ledger"), first=True)
    spans = free_name(docs, "found")
    found = secrets.findings(docs, ledger, into=spans)
    found = found.withColumn("text", secrets.redacted(F.col("text"), F.col(spans)))
    if "n_chars" in docs.columns:
        length = F.when(F.size(spans) > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        found = found.withColumn("n_chars", length)
    return found.select(*map(quoted, docs.columns))


def segmented(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document's text, as ids."""
    import public_tokenizers

    rows = pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return rows.withColumnRenamed("key", "doc_id")


STAGES = [
    ("quality classifier", good_quality),
    ("simhash near-dedup", one_of_each_group),
    ("benchmark decontamination", off_benchmark),
    ("secret scans", without_secrets),
    ("sentencepiece", segmented),
]

# A fitted classifier, sampled segmentations and 256-bit fingerprints are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages in turn; each reads what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
