"""Reads to samples: hits of index sequences near the two ends of a read, paired and classified."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Bytes of a table of hits, by the planner's estimate, that one task takes.
TASK_BYTES = 2 << 20


def best_hits(hits: DataFrame) -> DataFrame:
    """One hit per (query, read): the longest, then with fewest mismatches and gaps, then the first; in the reads' order, as joins by read need it."""
    order = Window.partitionBy("sseqid", "qseqid").orderBy((F.col("qend") - F.col("qstart")).desc(), "mismatch", "gapopen", "qstart", "sstart")
    return hits.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _tasks(*tables: DataFrame) -> int:
    """How many tasks share the rows of tables: in proportion to the largest, so what one holds does not grow with it."""
    spark = tables[0].sparkSession
    size = max(int(x._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) for x in tables)
    if size >> 50:  # not known
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(20_000, max(2 * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES)))


def best_by_read(*hits: DataFrame) -> list[DataFrame]:
    """``best_hits`` of each table, dealt out by read: pairs, classes and distinct rows of a read then need no other shuffle."""
    n = _tasks(*hits)
    return [best_hits(x.repartition(n, "sseqid")) for x in hits]


def with_position(hits: DataFrame) -> DataFrame:
    """posdiff, the distance of a hit from the end of its read, and barpos, the half that it begins in: front or rear."""
    return hits.withColumn("posdiff", F.col("slen") - F.col("sstart")).withColumn("barpos", F.when(F.col("sstart") <= F.col("slen") / 2, "front").otherwise("rear"))


def opposite_pairs(forward: DataFrame, reverse: DataFrame) -> DataFrame:
    """Pairs of a forward and a reverse hit at opposite ends of the same read; all columns of both, with _f and _r."""
    side = lambda hits, s: (F.col(c).alias(f"{c}_{s}") for c in hits.columns if c != "sseqid")
    f, r = with_position(forward), with_position(reverse)
    f, r = f.select("sseqid", *side(f, "f")), r.select(F.col("sseqid").alias("_read"), *side(r, "r"))
    return f.join(r, (F.col("sseqid") == F.col("_read")) & (F.col("barpos_f") != F.col("barpos_r"))).drop("_read")


def complete_match():
    """Both index sequences in full length, without mismatch or gap."""
    side = [(F.col(f"mismatch_{s}") + F.col(f"gapopen_{s}") == 0) & (F.col(f"qend_{s}") - F.col(f"qstart_{s}") + 1 == F.col(f"qlen_{s}")) for s in "fr"]
    return side[0] & side[1]


def partial_cost():
    """What a pair lacks to a complete one, plus 2."""
    side = [F.col(f"qlen_{s}") - F.col(f"qend_{s}") + F.col(f"qstart_{s}") + F.col(f"mismatch_{s}") + F.col(f"gapopen_{s}") for s in "fr"]
    return side[0] + side[1]


def classify(pairs: DataFrame) -> DataFrame:
    """``pairs`` with class: complete_match, single_match, partial_match, rest or excluded; all windows share one shuffle.

    All complete pairs of a read count; a read without one is settled by its only pair, else by the one pair of least
    cost. Reads where several pairs share the least cost are the rest. Other pairs of settled reads are excluded.
    """
    read = Window.partitionBy("sseqid")
    scored = pairs.withColumn("_complete", complete_match()).withColumn("_cost", partial_cost())
    seen = scored.withColumn("_any", F.max(F.col("_complete").cast("int")).over(read)).withColumn("_n", F.count("*").over(read)).withColumn("_least", F.min("_cost").over(read))
    ties = seen.withColumn("_ties", F.sum((F.col("_cost") == F.col("_least")).cast("int")).over(read))
    kind = (
        F.when(F.col("_complete"), "complete_match")
        .when(F.col("_any") == 1, "excluded")
        .when(F.col("_n") == 1, "single_match")
        .when(F.col("_ties") > 1, "rest")
        .when(F.col("_cost") == F.col("_least"), "partial_match")
        .otherwise("excluded")
    )
    return ties.select(*pairs.columns, kind.alias("class"))


def without_complete(pairs: DataFrame) -> DataFrame:
    """Pairs of the reads that have no complete pair, as an anti-join."""
    return pairs.join(pairs.where(complete_match()).select("sseqid").distinct(), "sseqid", "left_anti")


def demultiplexed(classified: DataFrame) -> DataFrame:
    return classified.where(F.col("class").isin("complete_match", "single_match", "partial_match"))


def undemultiplexed(classified: DataFrame) -> DataFrame:
    """One row per unsettled read: its first pair (by index ids) with both starts least; null hits if there is none."""
    read = Window.partitionBy("sseqid")
    rest = classified.where("class = 'rest'").drop("class")
    both = (F.col("qstart_f") == F.min("qstart_f").over(read)) & (F.col("qstart_r") == F.min("qstart_r").over(read))
    first = F.row_number().over(read.orderBy(F.col("_both").desc(), "qseqid_f", "qseqid_r", "sstart_f", "sstart_r"))
    kept = rest.withColumn("_both", both).withColumn("_first", first).where("_first = 1")
    return kept.select(*(F.col(c) if c == "sseqid" else F.when(F.col("_both"), F.col(c)).alias(c) for c in rest.columns))


def first_indexes(index_list: DataFrame, side: str) -> DataFrame:
    """The distinct index ids of one side (f or r), each with its first sequence in the list's order."""
    return index_list.groupBy(F.col(f"{side}_id").alias("id")).agg(F.min_by(f"{side}_seq", "ordinal").alias("seq"), F.min("ordinal").alias("ordinal"))


def with_samples(pairs: DataFrame, index_list: DataFrame) -> DataFrame:
    """index_pair and index_pair_id, the sample: the first entry of the list with both ids; null if none has."""
    name = lambda f, r: F.regexp_replace(F.concat_ws("_", f, r), r"\s", "_")
    listed = index_list.groupBy(name(F.col("f_id"), F.col("r_id")).alias("index_pair")).agg(F.min_by("pair_id", "ordinal").alias("index_pair_id"))
    return pairs.withColumn("index_pair", name(F.col("qseqid_f"), F.col("qseqid_r"))).join(listed, "index_pair", "left").select(*pairs.columns, "index_pair", "index_pair_id")


def demultiplex(forward: DataFrame, reverse: DataFrame, index_list: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reads with their samples, and one row for every read that stays without.

    Hits are dealt out by read first: the best hits, their pairs and the classification then need no other shuffle.
    """
    classified = classify(opposite_pairs(*best_by_read(forward, reverse)))
    return with_samples(demultiplexed(classified), index_list), undemultiplexed(classified)
