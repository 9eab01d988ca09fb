"""Tables: configuration without header, stage outputs with one, hits of a search tool. Schemas are always explicit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PRIMERS = "primer_id string, seq string"
INDEX_LIST = "pair_id string, f_id string, f_seq string, r_id string, r_seq string"
SITES = "gene string, chrom int, pos int"
HITS_SHORT = "qseqid string, sseqid string, qstart int, qend int, sstart int, send int, length int, pident double"
HITS_LONG = "qseqid string, sseqid string, qstart int, qend int, qlen int, sstart int, send int, slen int, mismatch int, gapopen int, sseq string, qseq string"


def _headless(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, schema=schema, header=False, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    return _headless(spark, path, PRIMERS).where("primer_id is not null and seq is not null")


def read_index_list(spark: SparkSession, path: str) -> DataFrame:
    """The list with ``ordinal``, the order of its lines: the file is small and read in one piece."""
    return _headless(spark, path, INDEX_LIST).where("pair_id is not null").withColumn("ordinal", F.monotonically_increasing_id())


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    return _headless(spark, path, SITES).where("gene is not null")


def read_hits(spark: SparkSession, path: str, layout: str = "long") -> DataFrame:
    """Tab-separated hits; ids may hold quotes and number signs. An empty file gives no rows."""
    schema = {"long": HITS_LONG, "short": HITS_SHORT}[layout]
    rows = spark.read.csv(path, schema=schema, sep="\t", quote="", comment="", header=False)
    return rows.dropna(subset=["qseqid", "sseqid"])


def read_stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's CSV with a header, as ``write_csv`` leaves it."""
    return spark.read.csv(path, schema=schema, header=True)


def read_lines(spark: SparkSession, path: str, with_header: bool = False) -> DataFrame:
    """The records of a tab-separated summary, all columns as text; ``with_header`` its header is one of them."""
    return spark.read.csv(path, sep="\t", quote="", header=not with_header).dropna(how="all")
