"""The whole run, from reads to genotypes and reports, with stages that are kept and taken up again.

A stage's output lies under a fingerprint of its options, its inputs' paths and the stages before it, so a run with other
options never reads what was made under the old ones.
"""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editloom.operators import align, amplicons, demux, genotype, report, windows
from editloom.sources import reads as sources
from editloom.sources import sinks, tables

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Options:
    """Every constant of the run; the defaults are the usual ones, and switches say where results may differ."""

    size_low: float = 0
    size_high: float = float("inf")
    check_window: int = windows.CHECK_WINDOW
    min_count: int = genotype.MIN_COUNT
    allele_fraction: float = genotype.ALLELE_FRACTION
    qstart_max: int = report.QSTART_MAX
    drop_parents: bool = True
    min_qscore: float = 10
    best_amplicon: bool = False
    window_from_hit_start: bool = True
    window_to_end: bool = False
    true_indel_labels: bool = False
    index_min_score: int = 24
    amplicon_min_score: int = 40
    amplicon_seed: int = 11
    summary_header_counts: bool = False


@dataclass(frozen=True)
class Inputs:
    """Paths. Hits of a search tool take the place of the built-in search where they are given: of primers in the short
    layout, of indexes and amplicons in the long one. With ``summary``, raw reads are counted by its lines.
    """

    reads: str
    primers: str
    sites: str
    index_list: str
    genome: str
    reads_format: str = "fasta"
    summary: str = ""
    primer_hits: str = ""
    index_hits_f: str = ""
    index_hits_r: str = ""
    amplicon_hits: str = ""


class Stages:
    """Stage outputs as Parquet under ``folder``; present ones are reused if ``resume`` is set."""

    def __init__(self, spark: SparkSession, folder: str, resume: bool):
        self.spark, self.folder, self.resume = spark, folder.rstrip("/"), resume
        self.key = ""

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def run(self, name: str, options: dict, make: Callable[[], dict[str, DataFrame]], outputs: tuple[str, ...]) -> dict[str, DataFrame]:
        self.key = hashlib.sha256(json.dumps([self.key, name, options], sort_keys=True, default=str).encode()).hexdigest()[:16]
        paths = {o: f"{self.folder}/{name}/{self.key}/{o}" for o in outputs}
        if self.resume and all(map(self._exists, paths.values())):
            log.info("stage %s is taken from %s", name, self.folder)
        else:
            made = make()
            for o, path in paths.items():
                made[o].write.mode("overwrite").parquet(path)
        return {o: self.spark.read.parquet(path) for o, path in paths.items()}


def _few(df: DataFrame, what: str, most: int = 10_000) -> list[tuple[str, str]]:
    """Configured sequences, which travel with a function: an error if there are too many."""
    rows = df.select("id", "seq").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} {what}")
    return [(r.id, r.seq) for r in rows]


def load_reads(spark: SparkSession, inputs: Inputs, options: Options) -> tuple[DataFrame, DataFrame]:
    """Raw reads, and those that are large and small enough."""
    reader = {"fasta": sources.read_fasta, "fastq": sources.read_fastq, "bam": sources.read_bam}[inputs.reads_format]
    raw = reader(spark, inputs.reads)
    kept = sources.without_parents(raw) if options.drop_parents and "dx" in raw.columns else raw
    if "mean_q" in raw.columns:
        kept = sources.good_quality(kept, options.min_qscore)
    return raw, sources.size_selected(kept, options.size_low, options.size_high).select("id", "seq")


def call_edits(spark: SparkSession, inputs: Inputs, folder: str, options: Options | None = None, resume: bool = False) -> dict[str, DataFrame]:
    """All stages; the result has the tables of every stage by name. Files for reading lie under ``folder``/out."""
    o = options or Options()
    stages = Stages(spark, folder, resume)
    genome = sources.read_fasta(spark, inputs.genome)
    primers, sites, index_list = tables.read_primers(spark, inputs.primers), tables.read_sites(spark, inputs.sites), tables.read_index_list(spark, inputs.index_list)
    raw, kept = load_reads(spark, inputs, o)
    all_options = asdict(o) | asdict(inputs)
    pick = lambda *names: {n: all_options[n] for n in names}

    def targets() -> dict[str, DataFrame]:
        given = tables.read_hits(spark, inputs.primer_hits, "short") if inputs.primer_hits else None
        found = amplicons.checked(amplicons.amplicons(primers, genome, given))
        return {"amplicons": found, "windows": windows.target_windows(sites, found, genome, o.check_window)}

    known = stages.run("targets", pick("primers", "genome", "sites", "check_window", "primer_hits"), targets, ("amplicons", "windows"))
    base = stages.run("reads", pick("reads", "reads_format", "size_low", "size_high", "drop_parents", "min_qscore"), lambda: {"reads": kept}, ("reads",))["reads"]

    def demultiplexing() -> dict[str, DataFrame]:
        def side(s: str, given: str) -> DataFrame:
            if given:
                return tables.read_hits(spark, given)
            return align.align_reads(base, _few(demux.first_indexes(index_list, s), "indexes"), 4, o.index_min_score).drop("score")

        done, rest = demux.demultiplex(side("f", inputs.index_hits_f), side("r", inputs.index_hits_r), index_list)
        return {"demultiplexed": done, "undemultiplexed": rest}

    split = stages.run("demultiplex", pick("index_list", "index_min_score", "index_hits_f", "index_hits_r"), demultiplexing, ("demultiplexed", "undemultiplexed"))

    def alignment() -> dict[str, DataFrame]:
        references = known["amplicons"].select(F.col("gene").alias("id"), "seq")
        if inputs.amplicon_hits:
            hits = tables.read_hits(spark, inputs.amplicon_hits)
        else:
            hits = align.align_reads(base, _few(references, "amplicons"), o.amplicon_seed, o.amplicon_min_score)
        first = windows.one_amplicon_per_read(hits, "qseqid", o.best_amplicon)
        patterns = windows.window_patterns(first, known["windows"], o.window_from_hit_start, o.window_to_end)
        return {"aligned": genotype.is_intact(patterns, known["windows"], any_gene=True)}

    aligned = stages.run("align", pick("best_amplicon", "window_from_hit_start", "window_to_end", "amplicon_min_score", "amplicon_seed", "amplicon_hits"), alignment, ("aligned",))["aligned"]

    def calling() -> dict[str, DataFrame]:
        sampled = windows.with_samples(aligned.drop("intact"), split["demultiplexed"])
        every, called, calls = genotype.edit_calls(sampled, known["windows"], o.min_count, o.allele_fraction, o.true_indel_labels)
        return {"patterns": every, "called": called, "calls": calls}

    made = stages.run("editcall", pick("min_count", "allele_fraction", "true_indel_labels"), calling, ("patterns", "called", "calls"))
    late = report.non_indexed(aligned, split["undemultiplexed"], o.qstart_max)
    counted = tables.read_lines(spark, inputs.summary, o.summary_header_counts) if inputs.summary else raw
    per_index, per_gene = report.reads_per_index(split["demultiplexed"]), report.reads_per_gene(aligned, made["called"], late)
    return known | {"raw": raw, "reads": base, "aligned": aligned} | split | made | {
        "summary": genotype.genotype_matrix(made["calls"], [g for g, _ in _few(known["windows"].select(F.col("gene").alias("id"), "seq").orderBy("id"), "genes")]),
        "read_stats": report.read_stats(counted, base, report.assigned(split["demultiplexed"], split["undemultiplexed"], o.qstart_max), aligned, made["called"]),
        "reads_per_index": per_index,
        "reads_per_gene": per_gene,
        "index_report": report.index_report(per_index),
        "gene_report": report.gene_report(per_gene),
        "non_indexed": late,
    }


def write_outputs(results: dict[str, DataFrame], folder: str, output_reads: bool = False) -> None:
    """The tables as files: lists with headers, in the order of their keys; intact windows as FASTA; reports as they are
    printed, as quoted tables.
    """
    order = {
        "demultiplexed": ("class", "sseqid", "qseqid_f", "qseqid_r"), "undemultiplexed": ("sseqid",), "aligned": ("target_gene", "read_name"),
        "patterns": ("index_pair_id", "target_gene", F.desc("count"), "read_seq"), "called": ("index_pair_id", "target_gene", F.desc("count"), "read_seq"), "summary": ("index_pair_id", "data_type"),
    }
    results = results | {name: results[name].orderBy(*by) for name, by in order.items()}
    for name, place in (("demultiplexed", "demultiplex/demultiplex_list.csv"), ("undemultiplexed", "demultiplex/undemultiplex_list.csv")):
        sinks.write_csv(results[name], f"{folder}/{place}", rename=sinks.side_names(results[name].columns))
    sinks.write_csv(results["aligned"], f"{folder}/align/alignment_list.csv")
    sinks.write_fasta(results["windows"], f"{folder}/align/intact_seq.fa", name="gene")
    for name, file in (("patterns", "editcall_all"), ("called", "editcall_filtered"), ("summary", "editcall_summary")):
        sinks.write_csv(results[name], f"{folder}/editcall/{file}.csv", one_file=name == "summary")
    sinks.write_fasta(results["reads"], f"{folder}/basecall/reads", per_file=sinks.CHUNK)
    for name, file in (("read_stats", "read_stats"), ("index_report", "indexed_reads_per_gene"), ("gene_report", "aligned_reads_per_gene")):
        sinks.write_tsv(results[name].orderBy("ordinal").drop("ordinal"), f"{folder}/summary/{file}.tsv")
    if output_reads:
        names = results["non_indexed"].select(F.col("read_name").alias("id")).distinct()
        sinks.write_fasta(results["reads"].join(names, "id", "left_semi"), f"{folder}/non_indexed_aligned_read_seq.fa")
