"""Edit calls, windows and reports against values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from editloom.operators import amplicons, demux, genotype, report, windows


def test_share_of_own_and_intact_reads(spark):
    rows = [("S", "A", "x", 30, True), ("S", "A", "y", 20, False), ("S", "B", "z", 8, False), ("T", "A", "x", 9, True)]
    counts = spark.createDataFrame(rows, "index_pair_id string, target_gene string, read_seq string, count long, intact boolean")
    got = {(x.index_pair_id, x.target_gene, x.read_seq): (x.vs_intact_ratio, x.intact_count) for x in genotype.against_intact(counts).collect()}
    assert got == {("S", "A", "x"): (None, 30), ("S", "A", "y"): (0.4, 30), ("S", "B", "z"): (1.0, 0), ("T", "A", "x"): (None, 9)}


HITS = "qseqid string, sseqid string, qstart int, qend int, sstart int, send int, qseq string, sseq string, mismatch int, gapopen int"


@pytest.fixture
def hits(spark):
    ref = "".join("ACGT"[k % 4] for k in range(40))
    read = ref[:14] + "-" + ref[15:]
    rows = [("A", "r1", 1, 40, 7, 46, ref, read, 0, 1), ("B", "r1", 3, 42, 5, 44, ref, ref, 0, 0), ("A", "r2", 5, 30, 90, 65, ref[:26], ref[:26], 0, 0), ("A", "r3", 21, 40, 1, 20, ref[:20], ref[:20], 0, 0)]
    return spark.createDataFrame(rows, HITS)


def test_alignment_list(spark, hits):
    known = spark.createDataFrame([("A", "x", 12, 22), ("B", "y", 12, 22)], "gene string, seq string, start int, end int")
    ref = "".join("ACGT"[k % 4] for k in range(40))
    one = windows.one_amplicon_per_read(hits, "qseqid")
    rows = {x.read_name: x for x in windows.window_patterns(one, known).collect()}
    assert set(rows) == {"r1", "r2"}  # r3 begins behind the window's start
    x = rows["r1"]
    assert (x.target_gene, x.read_seq, x.ref_seq) == ("A", (ref[:14] + "-" + ref[15:])[11:22], ref[11:22])
    assert (x.full_read_seq, x.aln_start, x.aln_end) == (ref[:14] + "-" + ref[15:], 7, 46)  # the aligned read with gaps; where it lies on the read
    assert (rows["r2"].read_seq, rows["r2"].aln_start, rows["r2"].aln_end) == (ref[7:18], 90, 65)
    by_amplicon = {x.read_name: x.read_seq for x in windows.window_patterns(one, known, from_hit_start=False).collect()}
    assert by_amplicon == {"r1": (ref[:14] + "-" + ref[15:])[11:22], "r2": ref[11:22]}
    narrow = hits.where("sseqid = 'r2'").withColumn("qend", F.lit(15))
    assert windows.window_patterns(narrow, known).count() == 1 and windows.window_patterns(narrow, known, to_end=True).count() == 0


def test_which_amplicon_a_read_keeps(hits):
    first = {x.sseqid: x.qseqid for x in windows.one_amplicon_per_read(hits, "qseqid").collect()}
    best = {x.sseqid: x.qseqid for x in windows.one_amplicon_per_read(hits, "qseqid", best=True).collect()}
    assert first["r1"] == "A" and best["r1"] == "B"  # of equal length, that with fewer differences


def test_columns_of_both_sides(spark):
    row = ("F1", "r", 1, 24, 24, 5, 28, 420, 0, 0, "AC", "AG")
    long = "qseqid string, sseqid string, qstart int, qend int, qlen int, sstart int, send int, slen int, mismatch int, gapopen int, sseq string, qseq string"
    pairs = demux.opposite_pairs(spark.createDataFrame([row], long), spark.createDataFrame([("R1", "r", 1, 24, 24, 400, 377, 420, 0, 0, "GG", "GT")], long))
    assert {f"{c}_{s}" for c in ("qseqid", "qstart", "qend", "qlen", "sstart", "send", "slen", "mismatch", "gapopen", "sseq", "qseq", "posdiff", "barpos") for s in "fr"} | {"sseqid"} == set(pairs.columns)
    x = pairs.first()
    assert (x.send_f, x.sseq_f, x.qseq_r, x.posdiff_r) == (28, "AC", "GT", 20)


def test_sites_on_both_strands(spark):
    primers = spark.createDataFrame([("G_F", "ACCGT"), ("G_R", "GGTTA"), ("X_F", "TTTTTTT"), ("odd", "ACCGT")], "primer_id string, seq string")
    genome = spark.createDataFrame([("c1", "ggACCGTccTAACCggACCGT"), ("c2", "ACGGT" + "C" + "TAACC"), ("c3", None)], "id string, seq string")
    got = {(x.gene, x.side, x.chrom): (x.start, x.end, x.strand) for x in amplicons.exact_sites(amplicons.split_primers(primers), genome).collect()}
    assert got == {("G", "F", "c1"): (3, 7, "+"), ("G", "R", "c1"): (10, 14, "-"), ("G", "F", "c2"): (1, 5, "-"), ("G", "R", "c2"): (7, 11, "-")}
    assert [tuple(x) for x in amplicons.amplicons(primers, genome.where("id = 'c1'")).collect()] == [("G", "c1", 3, 14, "ACCGTccTAACC")]
    assert [tuple(x) for x in amplicons.unpaired(primers, genome.withColumn("seq", F.regexp_replace("seq", "TAACC", ""))).collect()] == [("G", "c1"), ("G", "c2")]
    with pytest.raises(ValueError, match="more than 2"):
        amplicons.exact_sites(amplicons.split_primers(primers), genome, most=2)


def test_sites_of_any_number_of_primers(spark, monkeypatch):
    r = random.Random(8)
    some = lambda n: "".join(r.choice("ACGTac") for _ in range(n))
    chromosomes = [(f"c{k}", some(r.randint(0, 90))) for k in range(40)] + [("c1", some(60)), ("c7", None), (None, some(50)), ("short", "AC")]
    cut = lambda s: s[(k := r.randint(0, len(s) - 4)) : k + r.randint(3, 9)]
    words = [cut(s) for _, s in chromosomes * 3 if s and len(s) > 9]
    primers = [(f"G{k % 50}_{'FR'[k % 3 % 2]}", w if k % 4 else w.upper()[::-1].translate(str.maketrans("ACGT", "TGCA"))) for k, w in enumerate(words)]
    primers += [("P_F", "ACGT"), ("P_F", "ACGT"), ("N_R", None), ("E_R", ""), ("H_F", "acgtacgtacgtacgtacgt")]
    primers, genome = amplicons.split_primers(spark.createDataFrame(primers, "primer_id string, seq string")), spark.createDataFrame(chromosomes, "id string, seq string")
    want = sorted(map(str, amplicons.exact_sites(primers, genome).collect()))
    monkeypatch.setattr(amplicons, "CARRIED", 3)
    got = amplicons.exact_sites(primers, genome)
    assert sorted(map(str, got.collect())) == want and len(want) > 200
    assert amplicons.exact_sites(primers, genome.limit(0)).count() == 0 == amplicons.exact_sites(primers.limit(0), genome).count()
    monkeypatch.undo()
    many = spark.range(200_001).select(F.lit("G").alias("gene"), F.lit("F").alias("side"), F.lpad(F.translate(F.conv("id", 10, 4), "0123", "ACGT"), 12, "A").alias("seq"))
    last = many.orderBy(F.desc("seq")).first().seq
    assert [x.start for x in amplicons.exact_sites(many, spark.createDataFrame([("c", "GG" + last)], "id string, seq string")).collect() if x.strand == "+" and x.end == 14] == [3]


def test_printed_reports(spark):
    done = spark.createDataFrame([("F1", "R1"), ("F1", "R2"), ("F2", "R1"), ("F1", "R3")], "qseqid_f string, qseqid_r string")
    rows = [tuple(x)[1:] for x in report.index_report(report.reads_per_index(done)).orderBy("ordinal").collect()]
    assert rows == [
        ("", "F1", "F2", None), ("Indexed reads per forward index", "3", "1", None), ("Proportion of indexed reads per forward index", "75", "25", None),
        ("", "R1", "R2", "R3"), ("Indexed reads per reverse index", "2", "1", "1"), ("Proportion of indexed reads per reverse index", "50", "25", "25"),
    ]
    genes = spark.createDataFrame([("B", 3, 37.5, 2, 66.7, 0, 0.0), ("A", 5, 62.5, 0, 0.0, 1, 20.0)], "gene string, aligned long, aligned_pct double, editcalled long, editcalled_pct double, non_indexed long, non_indexed_pct double")
    rows = [tuple(x)[1:] for x in report.gene_report(genes).orderBy("ordinal").collect()]
    assert rows[:3] == [("", "A", "B"), ("Aligned reads per gene", "5", "3"), ("Proportion of aligned reads per gene", "62.5", "37.5")] and rows[6][2] == "0"
