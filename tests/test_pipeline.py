"""A planted experiment from reads to genotypes, on both strands; stages that are taken up again; a stream of files."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from editloom.operators import align, amplicons, demux
from editloom.sources import reads as sources
from editloom.sources import tables
from editloom.plans.pipeline import Inputs, Options, call_edits, write_outputs
from editloom.streaming import ingest

TURN = str.maketrans("ACGT", "TGCA")


def dna(r, n):
    return "".join(r.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def planted(tmp_path_factory):
    r, at = random.Random(11), tmp_path_factory.mktemp("planted")
    chrom = {f"chr{c:02d}": dna(r, 1500) for c in (1, 2)}
    genes = {"GA": ("chr01", 300), "GB": ("chr02", 700)}
    amplicon = {g: chrom[c][p : p + 300] for g, (c, p) in genes.items()}
    (at / "genome.fa").write_text("".join(f">{n} test\n{s[:700]}\n{s[700:]}\n" for n, s in chrom.items()))
    (at / "primers.csv").write_text("".join(f"{g}_F,{a[:20]}\r\n{g}_R,{a[-20:][::-1].translate(TURN)}\r\n" for g, a in amplicon.items()))
    (at / "sites.csv").write_text("".join(f"{g},{int(c[3:])},{p + 150}\n" for g, (c, p) in genes.items()))
    index = {n: dna(r, 24) for n in ("F1", "F2", "R1", "R2")}
    (at / "index.csv").write_text("".join(f"S{k},{f},{index[f]},{q},{index[q]}\n" for k, (f, q) in enumerate([("F1", "R1"), ("F2", "R2")])))
    edits = {("S0", "GA"): ["ref"] * 8 + ["del3"] * 7, ("S0", "GB"): ["ins2"] * 12, ("S1", "GA"): ["sub"] * 9 + ["ref"] * 2, ("S1", "GB"): ["ref"] * 10}
    reads = []
    for (sample, gene), kinds in edits.items():
        f, q = ("F1", "R1") if sample == "S0" else ("F2", "R2")
        for kind in kinds:
            a = amplicon[gene]
            swap = {"A": "C", "C": "G", "G": "T", "T": "A"}[a[149]]
            a = {"ref": a, "del3": a[:148] + a[151:], "ins2": a[:150] + ("AC" if a[149] != "C" and a[150] != "A" else "GT") + a[150:], "sub": a[:149] + swap + a[150:]}[kind]
            s = dna(r, 5) + index[f] + a + index[q][::-1].translate(TURN) + dna(r, 5)
            reads.append(s if r.random() < 0.5 else s[::-1].translate(TURN))
    reads.append(dna(r, 20))  # too short
    (at / "reads.fa").write_text("".join(f">read{k}\n{s}\n" for k, s in enumerate(reads)))
    return at, Inputs(f"{at}/reads.fa", f"{at}/primers.csv", f"{at}/sites.csv", f"{at}/index.csv", f"{at}/genome.fa")


def test_planted_edits_are_called(spark, planted, caplog):
    at, inputs = planted
    options = Options(size_low=100)
    out = call_edits(spark, inputs, f"{at}/work", options)
    calls = {(x.index_pair_id, x.target_gene): x.genotype for x in out["calls"].collect()}
    assert calls == {("S0", "GA"): "ref/del3", ("S0", "GB"): "ins2", ("S1", "GA"): "sub", ("S1", "GB"): "ref"}
    stats = {x.label.strip(): x.n for x in out["read_stats"].collect()}
    assert stats["Raw reads:"] == 49 and stats["Reads after filtering:"] == 48 == stats["Demultiplexed reads:"] == stats["Aligned reads:"]
    summary = {(x.index_pair_id, x.data_type): x.GA for x in out["summary"].collect()}
    assert summary["S0", "genotype"] == "ref/del3" and summary["S0", "count"] == "15(8,7)"
    write_outputs(out, f"{at}/out", output_reads=True)
    assert spark.read.csv(f"{at}/out/editcall/editcall_summary.csv", header=True).count() == 6
    listed = [(x.index_pair_id, x.target_gene, -int(x["count"])) for x in spark.read.csv(f"{at}/out/editcall/editcall_all.csv", header=True).collect()]
    assert listed == sorted(listed) and len(listed) == 6
    printed = spark.read.csv(f"{at}/out/summary/aligned_reads_per_gene.tsv", sep="\t").collect()
    assert [tuple(x) for x in printed[:2]] == [(None, "GA", "GB"), ("Aligned reads per gene", "26", "22")]
    assert spark.read.text(f"{at}/out/non_indexed_aligned_read_seq.fa").count() == 0  # every read has its indexes
    caplog.set_level("INFO")
    call_edits(spark, inputs, f"{at}/work", options, resume=True)
    assert sum("is taken from" in m for m in caplog.messages) == 5
    caplog.clear()
    again = call_edits(spark, inputs, f"{at}/work", Options(size_low=100, min_count=8), resume=True)
    assert sum("is taken from" in m for m in caplog.messages) == 4
    assert {(x.index_pair_id, x.target_gene): x.genotype for x in again["calls"].collect()}["S0", "GA"] == "ref"


def test_hits_and_summary_as_inputs(spark, planted):
    """What a search tool found takes the place of the built-in search; the result is the same."""
    at, inputs = planted
    base = sources.read_fasta(spark, inputs.reads)
    index = tables.read_index_list(spark, inputs.index_list)
    long = [f.split()[0] for f in tables.HITS_LONG.split(", ")]
    given = {}
    for side in "fr":
        found = align.align_reads(base, [(x.id, x.seq) for x in demux.first_indexes(index, side).collect()], 4, 24)
        found.select(*long).coalesce(1).write.csv(f"{at}/hits_{side}", sep="\t", mode="overwrite")
        given[f"index_hits_{side}"] = f"{at}/hits_{side}"
    genome = sources.read_fasta(spark, inputs.genome)
    known = amplicons.amplicons(tables.read_primers(spark, inputs.primers), genome)
    align.align_reads(base.where("length(seq) >= 100"), [(x.gene, x.seq) for x in known.collect()], 11, 40).select(*long).write.csv(f"{at}/hits_a", sep="\t", mode="overwrite")
    sites = amplicons.exact_sites(amplicons.split_primers(tables.read_primers(spark, inputs.primers)), genome)
    forth = F.col("strand") == "+"
    short = sites.select(F.concat_ws("_", "gene", "side").alias("q"), "chrom", F.lit(1).alias("a"), F.lit(20).alias("b"), F.when(forth, F.col("start")).otherwise(F.col("end")), F.when(forth, F.col("end")).otherwise(F.col("start")).alias("z"), F.lit(20).alias("n"), F.lit(100.0).alias("p"))
    short.write.csv(f"{at}/hits_p", sep="\t", mode="overwrite")
    (at / "summary.tsv").write_text("read_id\tlength\n" + "".join(f"read{k}\t5\n" for k in range(60)))
    other = replace(inputs, amplicon_hits=f"{at}/hits_a", primer_hits=f"{at}/hits_p", summary=f"{at}/summary.tsv", **given)
    out = call_edits(spark, other, f"{at}/hits", Options(size_low=100))
    plain = call_edits(spark, inputs, f"{at}/work", Options(size_low=100), resume=True)
    assert sorted(map(tuple, out["calls"].collect())) == sorted(map(tuple, plain["calls"].collect()))
    assert sorted(map(tuple, out["amplicons"].collect())) == sorted(map(tuple, plain["amplicons"].collect()))
    raw = lambda o: o["read_stats"].where("ordinal = 0").first().n
    assert raw(out) == 60
    assert raw(call_edits(spark, other, f"{at}/hits", Options(size_low=100, summary_header_counts=True), resume=True)) == 61


def test_no_reads_give_empty_tables(spark, planted):
    at, inputs = planted
    out = call_edits(spark, inputs, f"{at}/none", Options(size_low=10_000))
    assert out["calls"].count() == 0 == out["demultiplexed"].count()


def test_stream(spark, planted, tmp_path):
    at, _ = planted
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.fa").write_text((at / "reads.fa").read_text())
    ingest.store_reads(ingest.fasta_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/cp", 100).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 48
    rows = spark.createDataFrame([("S", "G", "A"), ("S", "G", "A"), (None, "G", "A")], "index_pair_id string, target_gene string, read_seq string")
    rows.write.parquet(f"{tmp_path}/aligned")
    stream = ingest.running_counts(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/aligned"))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [x["count"] for x in spark.table("counted").collect()] == [2]
