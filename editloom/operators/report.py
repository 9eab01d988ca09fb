"""Quality-control tables: how many reads each stage kept, per index and per gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from editloom.functions.sequences import percent

#: An index hit counts as found if it begins by this base of the index sequence.
QSTART_MAX = 15


def counts_by(rows: DataFrame, key: str) -> DataFrame:
    """key, n and the proportion of the total, for each value; rows without one don't count."""
    counted = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counted.withColumn("proportion", F.col("n") / F.sum("n").over(Window.partitionBy()))


def distinct_and_repeated(rows: DataFrame, key: str) -> DataFrame:
    """n_distinct and n_repeated of a column, exactly."""
    return rows.agg(F.countDistinct(key).alias("n_distinct"), (F.count(key) - F.countDistinct(key)).alias("n_repeated"))


def unassigned_breakdown(unassigned: DataFrame, most: int = QSTART_MAX) -> DataFrame:
    """n, and of these: indexed on both sides, on one side at least, on none."""
    f, r = F.col("qstart_f") <= most, F.col("qstart_r") <= most
    return unassigned.agg(F.count("*").alias("n"), F.count_if(f & r).alias("both_sides"), F.count_if(f | r).alias("one_side"), F.count_if(~f & ~r).alias("no_index"))


def non_indexed(aligned: DataFrame, unassigned: DataFrame, most: int = QSTART_MAX) -> DataFrame:
    """Aligned rows of reads whose index hits both begin late."""
    late = unassigned.where((F.col("qstart_f") > most) & (F.col("qstart_r") > most)).select(F.col("sseqid").alias("read_name"))
    return aligned.join(late, "read_name", "left_semi").select(*aligned.columns)


#: The rows of the read statistics, in order.
READ_STATS = (
    ("raw", "Raw reads: "), ("filtered", "Reads after filtering: "), ("demultiplexed", "Demultiplexed reads: "), ("aligned", "Aligned reads: "),
    ("editcalled", "Editcalled reads: "), ("n", "Undemultiplexed reads: "), ("both_sides", "Undemultiplexed reads (umbiguously indexed): "),
    ("one_side", "Undemultiplexed reads (single index): "), ("no_index", "Undemultiplexed reads (no index): "),
)


def assigned(demultiplexed: DataFrame, unassigned: DataFrame, most: int = QSTART_MAX) -> DataFrame:
    """One row: the number of demultiplexed reads, which are distinct ones, and the breakdown of the others."""
    return demultiplexed.agg(F.countDistinct("sseqid").alias("demultiplexed")).crossJoin(unassigned_breakdown(unassigned, most))  # one row each


def assigned_of(classified: DataFrame, most: int = QSTART_MAX) -> DataFrame:
    """The same from the classified pairs of all reads, in one pass: a read that is not settled has both its starts if one
    of its pairs has the least of either, which is so if the least sum of both is the sum of the least.
    """
    rest = lambda x: F.min(F.when(F.col("class") == "rest", x))
    f, r = F.col("qstart_f"), F.col("qstart_r")
    reads = classified.groupBy("sseqid").agg(F.max(F.col("class").isin("complete_match", "single_match", "partial_match")).alias("done"), rest(f).alias("f"), rest(r).alias("r"), rest(f + r).alias("both"))
    known = F.col("both") == F.col("f") + F.col("r")
    starts = reads.select("done", F.col("f").isNotNull().alias("rest"), F.when(known, F.col("f")).alias("qstart_f"), F.when(known, F.col("r")).alias("qstart_r"))
    f, r = F.col("qstart_f") <= most, F.col("qstart_r") <= most
    return starts.agg(F.count_if("done").alias("demultiplexed"), F.count_if("rest").alias("n"), F.count_if(f & r).alias("both_sides"), F.count_if(f | r).alias("one_side"), F.count_if(~f & ~r).alias("no_index"))


def read_stats(raw: DataFrame, filtered: DataFrame, assigned: DataFrame, aligned: DataFrame, called: DataFrame) -> DataFrame:
    """ordinal, label, n and pct (of raw reads, to three significant digits; null for these themselves).

    ``assigned`` is the row of that function. Aligned reads are distinct ones; edit-called reads are the sum of the called
    patterns' counts.
    """
    parts = [
        raw.agg(F.count("*").alias("raw")), filtered.agg(F.count("*").alias("filtered")), assigned,
        aligned.agg(F.countDistinct("read_name").alias("aligned")), called.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("editcalled")),
    ]
    row = parts[0]
    for part in parts[1:]:
        row = row.crossJoin(part)  # one row each
    each = F.array(*(F.struct(F.lit(k).alias("ordinal"), F.lit(label).alias("label"), F.col(c).cast("long").alias("n")) for k, (c, label) in enumerate(READ_STATS)))
    pct = F.when((F.col("x.ordinal") > 0) & (F.col("raw") > 0), percent(F.col("x.n"), F.col("raw")))
    return row.select("raw", F.explode(each).alias("x")).select("x.ordinal", "x.label", "x.n", pct.alias("pct"))


def reads_per_index(demultiplexed: DataFrame) -> DataFrame:
    """side, key, n and pct of the demultiplexed rows for each forward and each reverse index."""
    sides = [counts_by(demultiplexed, f"qseqid_{s}").withColumn("side", F.lit(s)) for s in "fr"]
    return sides[0].unionByName(sides[1]).select("side", "key", "n", percent(F.col("proportion"), F.lit(1.0)).alias("pct"))


def reads_per_gene(aligned: DataFrame, called: DataFrame, non_indexed_rows: DataFrame) -> DataFrame:
    """For each gene: aligned rows and their share, edit-called reads and non-indexed rows as shares of the aligned.

    Tables are joined by gene; what a gene has none of counts 0.
    """
    a = counts_by(aligned, "target_gene").select(F.col("key").alias("gene"), F.col("n").alias("aligned"), percent(F.col("proportion"), F.lit(1.0)).alias("aligned_pct"))
    c = called.groupBy(F.col("target_gene").alias("gene")).agg(F.sum("count").cast("long").alias("editcalled"))
    n = non_indexed_rows.groupBy(F.col("target_gene").alias("gene")).agg(F.count("*").alias("non_indexed"))
    joined = a.join(c, "gene", "full").join(n, "gene", "full").fillna(0, ["aligned", "aligned_pct", "editcalled", "non_indexed"])
    share = lambda x: F.when(F.col("aligned") > 0, percent(F.col(x), F.col("aligned")))
    return joined.select("gene", "aligned", "aligned_pct", "editcalled", share("editcalled").alias("editcalled_pct"), "non_indexed", share("non_indexed").alias("non_indexed_pct"))


#: The rows of the reports per index and per gene, with the columns that they show.
INDEX_ROWS = {
    "f": (("Indexed reads per forward index", "n"), ("Proportion of indexed reads per forward index", "pct")),
    "r": (("Indexed reads per reverse index", "n"), ("Proportion of indexed reads per reverse index", "pct")),
}
GENE_ROWS = (
    ("Aligned reads per gene", "aligned"), ("Proportion of aligned reads per gene", "aligned_pct"), ("Editcalled reads per gene", "editcalled"),
    ("Proportion of editcalled reads per gene", "editcalled_pct"), ("Non-indexed reads per gene", "non_indexed"), ("Proportion of non-indexed reads per gene", "non_indexed_pct"),
)


def _plain(column: str, kind: str) -> Column:
    """A value as text; whole numbers without a point."""
    if kind in ("double", "float"):
        return F.regexp_replace(F.round(column, 10).cast("string"), r"\.0$", "")
    return F.col(column).cast("string")


def labelled_rows(blocks: list[tuple[DataFrame, str, tuple[tuple[str, str], ...]]]) -> DataFrame:
    """ordinal, label, c1, c2, ...: a report as it is printed. Each block (table, key, (label, column), ...) gives a row
    of its keys in order, without a label, and a row for every column. Keys are configured ones, so few.
    """
    out, at, most = None, 0, 0
    for table, key, rows in blocks:
        kinds = dict(table.dtypes)
        cells = [F.struct(F.lit(at).alias("ordinal"), F.lit("").alias("label"), F.col(key).cast("string").alias("value"))]
        cells += [F.struct(F.lit(at + k).alias("ordinal"), F.lit(label).alias("label"), _plain(c, kinds[c]).alias("value")) for k, (label, c) in enumerate(rows, 1)]
        placed = table.withColumn("_p", F.row_number().over(Window.orderBy(key)))
        long = placed.select("_p", F.explode(F.array(*cells)).alias("x")).select("_p", "x.*")
        out, at, most = long if out is None else out.unionByName(long), at + len(cells), max(most, table.count())
    wide = out.groupBy("ordinal", "label").pivot("_p", list(range(1, most + 1))).agg(F.first("value"))
    return wide.select("ordinal", "label", *(F.col(str(k)).alias(f"c{k}") for k in range(1, most + 1)))


def index_report(per_index: DataFrame) -> DataFrame:
    return labelled_rows([(per_index.where(F.col("side") == side), "key", rows) for side, rows in INDEX_ROWS.items()])


def gene_report(per_gene: DataFrame) -> DataFrame:
    return labelled_rows([(per_gene, "gene", GENE_ROWS)])
