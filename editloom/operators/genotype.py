"""Edit calls: sequence patterns per sample and gene, their filters, genotype strings and the wide summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions.sequences import allele_class, allele_label, class_rank

#: A pattern with fewer reads is noise; one that does not exceed this share of the most frequent pattern goes, too.
MIN_COUNT, ALLELE_FRACTION = 5, 0.5
GROUP = ("index_pair_id", "target_gene")


def is_intact(aligned: DataFrame, windows: DataFrame, any_gene: bool = False) -> DataFrame:
    """``aligned`` with ``intact``: whether the pattern is the window of its own gene, or of any gene.

    Windows are configured and few; most reads have one of a few patterns, so they are not shuffled by pattern.
    """
    known = windows.select(F.col("seq").alias("_seq"), *([] if any_gene else [F.col("gene").alias("_gene")])).distinct().withColumn("_hit", F.lit(True))
    same = aligned.read_seq == F.col("_seq")
    if not any_gene:
        same &= aligned.target_gene == F.col("_gene")
    return aligned.join(F.broadcast(known), same, "left").select(*aligned.columns, F.coalesce("_hit", F.lit(False)).alias("intact"))


def pattern_counts(aligned: DataFrame, windows: DataFrame) -> DataFrame:
    """Reads per sample, gene and pattern, with whether the pattern is its gene's window.

    Rows without sample or pattern are not counted. Counting comes before the join, which then sees one row a pattern.
    """
    counts = aligned.where("index_pair_id is not null and target_gene is not null and read_seq is not null")
    counts = counts.groupBy(*GROUP, "read_seq").agg(F.count("*").alias("count"))
    return is_intact(counts, windows).select(*GROUP, "read_seq", "count", "intact")


def frequent(counts: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    return counts.where(F.col("count") >= min_count)


def top_alleles(counts: DataFrame, fraction: float = ALLELE_FRACTION) -> DataFrame:
    """Patterns with more than ``fraction`` of the reads of their group's most frequent pattern."""
    most = F.max("count").over(Window.partitionBy(*GROUP))
    return counts.withColumn("_most", most).where(F.col("count") > F.col("_most") * fraction).drop("_most")


def against_intact(counts: DataFrame) -> DataFrame:
    """intact_count of the group (0 if there is none), and each other pattern's share of its own and the intact reads."""
    reads = F.coalesce(F.max(F.when(F.col("intact"), F.col("count"))).over(Window.partitionBy(*GROUP)), F.lit(0))
    out = counts.withColumn("intact_count", reads.cast("long"))
    ratio = F.when(~F.col("intact"), F.col("count") / (F.col("count") + F.col("intact_count")))
    return out.select(*counts.columns, ratio.alias("vs_intact_ratio"), "intact_count")


def labelled(counts: DataFrame, windows: DataFrame, true_indels: bool = False) -> DataFrame:
    """``counts`` with the class of each pattern, its rank and its label."""
    own = windows.select(F.col("gene").alias("_gene"), F.col("seq").alias("window"))
    joined = counts.join(own, counts.target_gene == F.col("_gene"))
    kind = allele_class(F.col("read_seq"), F.col("window"), F.col("intact"))
    typed = joined.withColumn("kind", kind)
    return typed.select(*counts.columns, "kind", class_rank(F.col("kind")).alias("kind_rank"), allele_label(F.col("kind"), F.col("read_seq"), F.col("window"), true_indels).alias("label"))


def _joined(alleles: Column, field: str, sep: str) -> Column:
    return F.array_join(F.transform(alleles, lambda x: x[field]), sep)


def genotype_calls(labels: DataFrame) -> DataFrame:
    """One row per sample and gene: genotype, the other patterns than the intact one, and ``total(count,count,...)``.

    Alleles stand in the order of their classes, then by falling count, then by pattern. The lists are short: each
    member has more than a fixed share of the group's most frequent pattern.
    """
    key = F.struct("kind_rank", (-F.col("count")).alias("order"), "read_seq", "label", F.col("count").cast("string").alias("reads"))
    grouped = labels.groupBy(*GROUP).agg(F.array_sort(F.collect_list(key)).alias("alleles"), F.sum("count").cast("string").alias("total"))
    alleles = F.col("alleles")
    others = F.filter(alleles, lambda x: x["kind_rank"] > 1)
    counts = F.concat(F.col("total"), F.lit("("), _joined(alleles, "reads", ","), F.lit(")"))
    return grouped.select(*GROUP, _joined(alleles, "label", "/").alias("genotype"), _joined(others, "read_seq", "/").alias("seq"), counts.alias("count"))


def genotype_matrix(calls: DataFrame, genes: list[str]) -> DataFrame:
    """Three rows a sample (genotype, seq, count), one column a gene in the order given; null where nothing was called."""
    long = calls.unpivot(list(GROUP), ["genotype", "seq", "count"], "data_type", "value")
    return long.groupBy("index_pair_id", "data_type").pivot("target_gene", genes).agg(F.first("value"))


def edit_calls(aligned: DataFrame, windows: DataFrame, min_count: int = MIN_COUNT, fraction: float = ALLELE_FRACTION, true_indels: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All patterns, those that are called, and the calls."""
    every = pattern_counts(aligned, windows)
    called = against_intact(top_alleles(frequent(every, min_count), fraction))
    return every, called, genotype_calls(labelled(called, windows, true_indels))
