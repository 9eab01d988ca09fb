"""The window around each expected edit, on the amplicon and on the reads aligned to it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions.sequences import gap_window, slice_of

#: Bases on either side of the expected site.
CHECK_WINDOW = 10


def target_windows(sites: DataFrame, amplicons: DataFrame, genome: DataFrame, half: int = CHECK_WINDOW) -> DataFrame:
    """gene, seq, start and end of the window on its amplicon, from the sites (gene, chrom number, pos).

    Positions follow from coordinates: where the window lies on the chromosome, less where the amplicon begins.
    """
    name = F.concat(F.lit("chr"), F.when(F.col("chrom") < 10, F.concat(F.lit("0"), F.col("chrom").cast("string"))).otherwise(F.col("chrom").cast("string")))
    placed = sites.select("gene", name.alias("_name"), (F.col("pos") - half).alias("_first"), (F.col("pos") + half).alias("_last"))
    cut = placed.join(genome.select(F.col("id").alias("_name"), F.col("seq").alias("_chrom")), "_name").select("gene", "_name", "_first", "_last", slice_of(F.col("_chrom"), F.col("_first"), F.col("_last")).alias("seq"))
    on = amplicons.select("gene", F.col("chrom").alias("_name"), F.col("start").alias("_at"))
    return cut.join(on, ["gene", "_name"]).select("gene", "seq", (F.col("_first") - F.col("_at") + 1).alias("start"), (F.col("_last") - F.col("_at") + 1).alias("end"))


def located(windows: DataFrame, amplicons: DataFrame) -> DataFrame:
    """gene, seq, start and end of windows that are only known by sequence: their first place on the amplicon."""
    on = amplicons.select("gene", F.col("seq").alias("_amplicon"))
    return windows.join(on, "gene").withColumn("start", F.expr("locate(seq, _amplicon)")).where("start > 0").select("gene", "seq", "start", (F.col("start") + F.length("seq") - 1).alias("end"))


def one_amplicon_per_read(hits: DataFrame, order: str = "ordinal", best: bool = False) -> DataFrame:
    """The first hit of each read in the amplicons' order; with ``best`` the longest with fewest differences."""
    by = [(F.col("qend") - F.col("qstart")).desc(), F.col("mismatch") + F.col("gapopen"), F.col(order)] if best else [F.col(order)]
    first = F.row_number().over(Window.partitionBy("sseqid").orderBy(*by, "qseqid"))
    return hits.withColumn("_n", first).where("_n = 1").drop("_n")


def covering(hits: DataFrame, windows: DataFrame, to_end: bool = False) -> DataFrame:
    """Hits (qseqid is a gene) that reach over their gene's window start; with ``to_end`` over all of the window."""
    w = windows.select(F.col("gene").alias("_gene"), F.col("start").alias("w_start"), F.col("end").alias("w_end"))
    reach = F.col("w_end") if to_end else F.col("w_start")
    return hits.join(w, (F.col("qseqid") == F.col("_gene")) & (F.col("qstart") <= F.col("w_start")) & (F.col("qend") >= reach)).drop("_gene")


def window_patterns(hits: DataFrame, windows: DataFrame, from_hit_start: bool = True, to_end: bool = False) -> DataFrame:
    """target_gene, read_name, read_seq, ref_seq, full_read_seq, aln_start, aln_end of every covering hit.

    The alignment begins at base ``qstart`` of the amplicon; with ``from_hit_start`` the window is counted from there.
    full_read_seq is the aligned read with its gaps, aln_start and aln_end are where the hit lies on the read.
    """
    over = covering(hits, windows, to_end)
    spans = [r[0] for r in windows.select(F.col("end") - F.col("start")).distinct().limit(2).collect()]
    if len(spans) > 1:
        raise ValueError("all windows must have the same length")
    start = F.col("w_start") - F.col("qstart") + 1 if from_hit_start else F.col("w_start")
    cut = over.withColumn("_w", gap_window(F.col("qseq"), F.col("sseq"), start, spans[0] if spans else 2 * CHECK_WINDOW))
    return cut.select(
        F.col("qseqid").alias("target_gene"), F.col("sseqid").alias("read_name"), F.col("_w.read_seq").alias("read_seq"), F.col("_w.ref_seq").alias("ref_seq"),
        F.col("sseq").alias("full_read_seq"), F.col("sstart").alias("aln_start"), F.col("send").alias("aln_end"),
    )


def with_samples(aligned: DataFrame, demultiplexed: DataFrame) -> DataFrame:
    """Aligned reads with the indexes and the sample of each pair that they belong to; null for reads without one."""
    samples = demultiplexed.select(F.col("sseqid").alias("_read"), F.col("qseqid_f").alias("i7_index"), F.col("qseqid_r").alias("i5_index"), "index_pair_id").distinct()
    return aligned.join(samples, F.col("read_name") == F.col("_read"), "left").drop("_read")
