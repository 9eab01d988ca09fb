"""A corpus pipeline of four stages, each of which applies one operator of editloom.llm to what the one before kept.

In every stage a null or empty text is a text without words: the first keeps it, the second keeps one of all these, the
third takes none of it. Very long texts are read whole. Ties and repeated rows: the second keeps one of them, the least
doc_id (null behind all others). Empty tables give empty results, and further columns pass through all stages but the
last, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from editloom.llm import bpe, copies, mixing, quality
from editloom.llm.common import cut


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards labelled clean text keeps; those it rejects go.

    Repeated doc_ids share their noise but are weighed by their own texts; null doc_ids are weighed like any other.
    """
    return quality.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (SimHash of five-word shingles, similarity 0.8) the document with the least doc_id."""
    return copies.near_dedup(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and as far, as the mix takes them; a null source is a source of its own."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and lang of every row, its token ids, their number, and the digests of ids and decoded text."""
    encoded = bpe.bpe_encode(docs, bpe.default_tokenizer(), keep=["doc_id", "source", "lang"])
    return bpe.digests(encoded, keep_ids=True)


STAGES = [
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mix),
    ("BPE encoding and decoding", tokens),
]
#: The first stage is a trained model over hashed n-grams, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage makes is written to the shared checkpoint folder, and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
