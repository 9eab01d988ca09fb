"""Amplicons from primer pairs: exact primer sites in a genome, paired by gene and chromosome, cut out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from editloom.functions.sequences import reverse_complement, slice_of

SIDES = ("F", "R")


def split_primers(primers: DataFrame) -> DataFrame:
    """gene, side and seq of primers whose ids end in _F or _R."""
    side = F.regexp_extract("primer_id", "_([FR])$", 1)
    return primers.where(F.col("primer_id").rlike("_[FR]$")).select("primer_id", F.regexp_replace("primer_id", "_[FR]$", "").alias("gene"), side.alias("side"), "seq")


#: So many primers at most are known to every task; more are joined.
CARRIED = 20_000
_SITES = "gene string, side string, chrom string, start int, end int, strand string"


def exact_sites(primers: DataFrame, genome: DataFrame, most: int | None = None) -> DataFrame:
    """gene, side, chrom, start, end, strand: where a primer matches in full on either strand.

    One site per primer and chromosome, the lowest. Few primers travel with the function as one automaton, so a
    chromosome is scanned once for all of them; more than ``CARRIED`` are joined with the places of the genome. With
    ``most``, more primers than that are an error.
    """
    want = primers.select("gene", "side", F.upper("seq").alias("plus"), reverse_complement(F.upper("seq")).alias("minus")).where("plus <> ''")
    few = want.limit((CARRIED if most is None else most) + 1).collect()
    if most is not None and len(few) > most:
        raise ValueError(f"more than {most} primers")
    return _joined(want, genome) if len(few) > CARRIED else _scanned(few, genome)


def _joined(want: DataFrame, genome: DataFrame) -> DataFrame:
    """Sites of any number of primers: places of the genome meet primers that begin with the same letters, as many as the shortest has.

    Each place brings as many letters as the longest primer has, so the rest is compared where they meet.
    """
    sizes = want.agg(F.min(F.length("plus")), F.max(F.length("plus"))).first()
    if sizes[0] is None:
        return _scanned([], genome)
    least, longest = sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.string())
        for x in batches:
            out: list[tuple] = []
            for name, row, seq in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), x.column(2), strict=True):
                s = (seq.as_py() or "").upper()
                for k in range(len(s) - least + 1):
                    out.append((name, row, k + 1, s[k : k + longest]))
                    if len(out) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["chrom", "_row", "start", "_at"])
                        out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["chrom", "_row", "start", "_at"])

    head = lambda c: F.substring(c, 1, least)
    rows = genome.select(F.col("id").cast("string").alias("id"), F.monotonically_increasing_id().alias("row"), F.col("seq").cast("string").alias("seq"))
    spark = genome.sparkSession
    places = rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "row").mapInArrow(run, "chrom string, _row long, start int, _at string").withColumn("_head", head("_at"))
    # equal rows of one primer give as many sites
    once = want.groupBy("gene", "side", "plus", "minus").agg(F.count("*").alias("_n"))
    strands = F.explode(F.array(F.struct(F.col("plus").alias("_word"), F.lit("+").alias("strand")), F.struct(F.col("minus").alias("_word"), F.lit("-").alias("strand"))))
    asked = once.select("gene", "side", "plus", "_n", strands.alias("x")).select("gene", "side", "plus", "_n", "x.*").withColumn("_head", head("_word"))
    met = places.join(asked.hint("merge"), "_head").where(F.startswith("_at", "_word"))
    first = met.groupBy("gene", "side", "plus", "_row", "chrom").agg(F.min(F.struct("start", "strand")).alias("x"), F.first("_n").alias("_n"))
    out = first.select("gene", "side", "chrom", "x.start", (F.col("x.start") + F.length("plus") - 1).alias("end"), "x.strand", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k"))
    return out.drop("_k")


def _scanned(want: list[Row], genome: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        words: dict[str, list[tuple[int, str]]] = {}
        for k, x in enumerate(want):
            words.setdefault(x.plus, []).append((k, "+"))
            words.setdefault(x.minus, []).append((k, "-"))
        machine = ahocorasick.Automaton()
        for w, of in words.items():
            machine.add_word(w, (len(w), of))
        machine.make_automaton()
        for x in batches:
            out = []
            for name, seq in zip(x.column(0).to_pylist(), x.column(1), strict=True):
                first: dict[int, tuple[int, str]] = {}
                for end, (size, of) in machine.iter((seq.as_py() or "").upper()) if words else ():
                    for k, strand in of:
                        first[k] = min(first.get(k, (end - size + 2, strand)), (end - size + 2, strand))
                out += [(want[k].gene, want[k].side, name, at, at + len(want[k].plus) - 1, strand) for k, (at, strand) in first.items()]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["gene", "side", "chrom", "start", "end", "strand"])

    rows = genome.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("string").alias("seq"))
    return rows.mapInArrow(run, _SITES)


def perfect_hits(hits: DataFrame, primers: DataFrame) -> DataFrame:
    """Hits of a search tool that have a primer's whole length without a mismatch."""
    lengths = primers.select(F.col("primer_id").alias("qseqid"), F.length("seq").alias("_width"))
    return hits.join(lengths, "qseqid").where("length = _width and pident >= 100").select(*hits.columns)


def sites_of_hits(hits: DataFrame, primers: DataFrame) -> DataFrame:
    """gene, side, chrom, start, end, strand from the hits of a search tool that are perfect; the lowest one a chromosome.

    A hit on the reverse strand has its start behind its end.
    """
    sided = perfect_hits(hits, primers).join(split_primers(primers).select(F.col("primer_id").alias("qseqid"), "gene", "side"), "qseqid")
    at = F.struct(F.least("sstart", "send").alias("start"), F.greatest("sstart", "send").alias("end"), F.when(F.col("sstart") <= F.col("send"), "+").otherwise("-").alias("strand"))
    return sided.groupBy("gene", "side", F.col("sseqid").alias("chrom")).agg(F.min(at).alias("at")).select("gene", "side", "chrom", "at.*")


def pair_sites(forward: DataFrame, reverse: DataFrame, how: str = "inner") -> DataFrame:
    """(gene, chrom, start, end) spanned by both sites. ``how="full"`` keeps unpaired sites, with null bounds."""
    f = forward.select("gene", "chrom", F.col("start").alias("start_f"), F.col("end").alias("end_f"))
    r = reverse.select("gene", "chrom", F.col("start").alias("start_r"), F.col("end").alias("end_r"))
    known = F.col("start_f").isNotNull() & F.col("start_r").isNotNull()
    every = [F.col(c) for c in ("start_f", "end_f", "start_r", "end_r")]
    return f.join(r, ["gene", "chrom"], how).select("gene", "chrom", F.when(known, F.least(*every)).alias("start"), F.when(known, F.greatest(*every)).alias("end"))


def cut_out(intervals: DataFrame, genome: DataFrame) -> DataFrame:
    """The sequence of each interval (chrom, start, end; from 1, both ends included) on the plus strand."""
    source = genome.select(F.col("id").alias("chrom"), F.col("seq").alias("_chrom"))
    return intervals.join(source, "chrom").select(*intervals.columns, slice_of(F.col("_chrom"), F.col("start"), F.col("end")).alias("seq"))


def amplicons(primers: DataFrame, genome: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """gene, chrom, start, end, seq of every amplicon; one per gene and chromosome. Sites come from ``hits`` if given."""
    sites = exact_sites(split_primers(primers), genome) if hits is None else sites_of_hits(hits, primers)
    return cut_out(pair_sites(sites.where("side = 'F'"), sites.where("side = 'R'")), genome)


def unpaired(primers: DataFrame, genome: DataFrame) -> DataFrame:
    """Genes with a site of one primer only on some chromosome."""
    sites = exact_sites(split_primers(primers), genome)
    return pair_sites(sites.where("side = 'F'"), sites.where("side = 'R'"), "full").where("start is null").select("gene", "chrom")


def checked(found: DataFrame) -> DataFrame:
    """``found``, unless a gene has several amplicons."""
    double = [r.gene for r in found.groupBy("gene").count().where("count > 1").select("gene").limit(20).collect()]
    if double:
        raise ValueError(f"more than one amplicon for {', '.join(sorted(double))}")
    return found
