"""documents to training text in five stages, each written as Parquet and read again for the next.

Every stage takes a table with doc_id, text and source at least, and returns its columns (the last one its own). Other
columns, whatever their names, go through unchanged, but for n_chars, which follows the text where there is one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import bpe_codec, line_dedup, mixing, near_dedup, quality
from wordloom.llm.common import cut


def _apart(docs: DataFrame) -> DataFrame:
    """docs with names that no operator's results have."""
    return docs.select(*[F.col(f"`{c}`").alias(f"__in_{c}") for c in docs.columns])


def _back(docs: DataFrame) -> DataFrame:
    """docs of _apart with its own names again, and without others."""
    return docs.select(*[F.col(f"`{c}`").alias(c.removeprefix("__in_")) for c in docs.columns if c.startswith("__in_")])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the compression classifier doesn't reject; it learns from the labels of those it gets.

    A null or empty text has the score of no evidence, and stays if that reaches the threshold. Repeated rows stay or go
    together. Without labels all stay. An empty table gives none."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _back(quality.score(_apart(docs), model, "__in_doc_id", "__in_text").filter("predicted = 1"))


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their boilerplate lines; n_chars, if there, follows the text where lines went.

    A null text stays null, an empty one empty; a null source is a site of its own. Repeated rows lose the same lines.
    An empty table gives none."""
    out = line_dedup.remove_boilerplate(_apart(docs), "__in_doc_id", "__in_text", "__in_source")
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("__in_n_chars", F.when(F.col("n_removed") > 0, F.length("__in_text").cast(kind)).otherwise(F.col("__in_n_chars")))
    return _back(out)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each group of near-duplicates.

    Documents without words, with null text or without doc_id stay, as they are linked with nothing; rows that share a
    doc_id stay or go together. An empty table gives none."""
    gone = near_dedup.near_groups(docs).filter("NOT kept").select(F.col("doc_id").alias("__wl_gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__wl_gone"), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, each as many times as it takes it, in order of finish time.

    Documents without words, or with null text, are taken once; a null source is a source like others. Repeated rows
    are taken each. An empty table gives none."""
    return mixing.mixed_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of what they decode to, for each document taken, repeated ones
    too. A null text counts as empty. An empty table gives none."""
    return bpe_codec.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_classifier", good_quality),
    ("line_dedup", without_boilerplate),
    ("near_dedup", one_of_each_group),
    ("mixing", mixed),
    ("bpe_codec", encoded),
]

#: Compression sizes and BPE can't be expressed in SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
    return docs
