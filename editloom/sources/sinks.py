"""Writers: FASTA, CSV with a header, TSV without one, and chunks of reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reads in a chunk.
CHUNK = 10_000


def write_fasta(rows: DataFrame, path: str, per_file: int = 0, name: str = "id", seq: str = "seq") -> None:
    """One record per row; with ``per_file`` at most so many in a file."""
    lines = rows.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))
    lines.write.mode("overwrite").option("maxRecordsPerFile", per_file).text(path)


def write_csv(rows: DataFrame, path: str, one_file: bool = False, rename: dict[str, str] | None = None) -> None:
    """With a header. ``one_file`` is for summaries; ``rename`` gives columns the names that they have in files."""
    out = rows.withColumnsRenamed(rename or {})
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def write_tsv(rows: DataFrame, path: str) -> None:
    """A summary without header, every value quoted."""
    rows.coalesce(1).write.mode("overwrite").option("sep", "\t").option("quoteAll", True).option("emptyValue", "").csv(path)


def side_names(columns: list[str]) -> dict[str, str]:
    """Names of paired columns in files: a dot before the side, where the library has an underscore."""
    return {c: f"{c[:-2]}.{c[-1]}" for c in columns if c.endswith(("_f", "_r"))}


def chunk_names(rows: DataFrame, order: str, total: int, size: int = CHUNK) -> DataFrame:
    """``rows`` with ``chunk``: the number of its chunk of ``size`` rows in the given order, padded to equal width.

    Ranks are global, yet no task sees all rows: rows are sorted into ranges, ranges counted, and ranks added up.
    """
    width = len(str(max(1, -(-total // size))))
    ranged = rows.withColumn("_range", F.floor(F.col(order) / size))
    counts = ranged.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(order)) - 1 + F.col("_before")
    number = (F.floor(at / size) + 1).cast("string")
    return ranged.join(before, "_range").select(*rows.columns, F.lpad(number, width, "0").alias("chunk"))
