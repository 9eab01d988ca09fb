"""Reads as they arrive: files of a folder as a stream, size selection and running pattern counts.

Everything per read is stateless, so it streams as it is; only the counts keep state, one row per pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from editloom.sources.reads import size_selected


def fasta_stream(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """(id, seq) of the FASTA files that come into a folder."""
    rows = spark.readStream.option("lineSep", "\n>").option("maxFilesPerTrigger", files_per_trigger).text(folder)
    parts = rows.select(F.split(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>|\n+$", ""), "\n", 2).alias("p")).where("trim(p[0]) <> ''")
    return parts.select(F.regexp_extract(F.col("p")[0], r"^\s*(\S*)", 1).alias("id"), F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s", "").alias("seq"))


def store_reads(reads: DataFrame, path: str, checkpoint: str, low: float = 0, high: float = float("inf")) -> StreamingQuery:
    """Size-selected reads, appended to Parquet exactly once."""
    return size_selected(reads, low, high).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def running_counts(aligned: DataFrame) -> DataFrame:
    """Reads per sample, gene and pattern so far; for output mode complete or update."""
    known = aligned.where("index_pair_id is not null and target_gene is not null and read_seq is not null")
    return known.groupBy("index_pair_id", "target_gene", "read_seq").agg(F.count("*").alias("count"))
