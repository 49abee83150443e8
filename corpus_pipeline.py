"""A training-text pipeline over ``documents``: each stage reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.  Each
stage takes an empty table, null and repeated ids, null texts and other columns of any name as its operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from snapgrain.llm.exact_dedup import deduplicate
from snapgrain.llm.jaccard_join import one_of_each
from snapgrain.llm.packing import byte_bpe, pack_documents
from snapgrain.llm.quality import select_good
from snapgrain.llm.shared import new_path, remove_path, scratch
from snapgrain.llm.substring_dedup import remove_repeats


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose tail probability of the best grade is too low go."""
    return select_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest doc_id stays."""
    return deduplicate(docs, keep="min")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents the one with the smallest doc_id stays."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a window of 13 words that an earlier document starts too go; n_chars follows the text."""
    from pyspark.sql import functions as F

    shorter = remove_repeats(docs)
    if "n_chars" not in shorter.columns:
        return shorter
    return shorter.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers as tokenizers

    return pack_documents(docs, byte_bpe(tokenizers.path("byte_bpe_50k.json"), tokenizers.path("byte_bpe_50k.tiktoken"), tokenizers.PATTERN))


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("near duplicates", near_duplicates),
    ("substring dedup", substring_dedup),
    ("best-fit packing", best_fit_packing),
]

#: The classifier and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of sf_dir, each written as Parquet and read again; a stage's input and what it stored meanwhile are deleted once it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = new_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            out = stage(spark, docs, sf_dir)
            out.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {}
