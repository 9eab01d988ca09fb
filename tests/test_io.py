"""Files: round trips, line ends, compression, empty files, BAM."""

import gzip
import struct
import time
import zlib

from editloom.sources import reads, sinks, tables


def test_fasta_round_trip(spark, tmp_path):
    rows = [(f"r{k}", "ACGT" * k) for k in range(25)]
    sinks.write_fasta(spark.createDataFrame(rows, "id string, seq string"), f"{tmp_path}/fa", per_file=10)
    assert sorted((x.id, x.seq) for x in reads.read_fasta(spark, f"{tmp_path}/fa").collect()) == sorted(rows)


def test_fasta_shapes(spark, tmp_path):
    (tmp_path / "a.fa").write_bytes(b">one two > three\r\nACG\r\nTTA\r\n>b\r\n\r\n>c\nAC\n")
    got = [(x.id, x.seq) for x in reads.read_fasta(spark, f"{tmp_path}/a.fa").orderBy("ordinal").collect()]
    assert got == [("one", "ACGTTA"), ("b", ""), ("c", "AC")]
    (tmp_path / "b.fa.gz").write_bytes(gzip.compress(b">z\nGG\nCC\n"))
    assert [(x.id, x.seq) for x in reads.read_fasta(spark, f"{tmp_path}/b.fa.gz").collect()] == [("z", "GGCC")]
    (tmp_path / "c.fa").write_bytes(b"")
    assert reads.read_fasta(spark, f"{tmp_path}/c.fa").count() == 0


def test_fastq_with_at_signs_in_qualities(spark, tmp_path):
    (tmp_path / "a.fq").write_bytes(b"@r1 x\nACGT\n+\n@@@@\n@r2\nGGTT\n+r2\nIIII\n@r3\r\nTT\r\n+\r\n@I\r\n")
    got = sorted((x.id, x.seq) for x in reads.read_fastq(spark, f"{tmp_path}/a.fq").collect())
    assert got == [("r1", "ACGT"), ("r2", "GGTT"), ("r3", "TT")]


def block(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, seq, tags=b""):
    codes = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
    body = struct.pack("<iiBBHHHiiii", -1, -1, len(name) + 1, 0, 0, 0, 4, len(seq), -1, -1, 0) + name.encode() + b"\0" + packed + b"\x1e" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


def test_bam(spark, tmp_path):
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", 0)
    dx = lambda n: b"XZZhi\0" + b"XBBi" + struct.pack("<i", 1) + struct.pack("<i", 7) + b"dxi" + struct.pack("<i", n)
    data = head + record("a", "ACGTN") + record("b", "GG", dx(-1)) + record("c", "TTTT", dx(1))
    (tmp_path / "a.bam").write_bytes(block(data[:30]) + block(data[30:]) + block(b""))
    got = reads.read_bam(spark, f"{tmp_path}/a.bam")
    assert sorted((x.id, x.seq, x.dx) for x in got.collect()) == [("a", "ACGTN", None), ("b", "GG", -1), ("c", "TTTT", 1)]
    assert sorted(x.id for x in reads.without_parents(got).collect()) == ["a", "c"]
    assert {round(x.mean_q, 6) for x in got.collect()} == {30.0}
    assert reads.good_quality(got, 31).count() == 0 and reads.good_quality(got, 30 - 1e-9).count() == 3
    assert abs(reads.mean_quality(bytes([10, 20])) - 12.596373) < 1e-6 and reads.mean_quality(b"\xff") is None


def test_tables(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes(b"g1_F,ACGT\r\ng1_R,TTTT\r\n")
    assert [tuple(x) for x in tables.read_primers(spark, f"{tmp_path}/p.csv").collect()] == [("g1_F", "ACGT"), ("g1_R", "TTTT")]
    (tmp_path / "i.csv").write_bytes(b"P1,F1,AC,R1,GT\nP2,F2,AA,R1,GT\n")
    assert [(x.pair_id, x.ordinal) for x in tables.read_index_list(spark, f"{tmp_path}/i.csv").collect()] == [("P1", 0), ("P2", 1)]
    (tmp_path / "h.tsv").write_bytes(b"q'1\ts#1\t1\t4\t9\t12\t4\t100.0\n\ts\t1\t4\t9\t12\t4\t100.0\n")
    assert [(x.qseqid, x.sseqid, x.pident) for x in tables.read_hits(spark, f"{tmp_path}/h.tsv", "short").collect()] == [("q'1", "s#1", 100.0)]
    (tmp_path / "e.tsv").write_bytes(b"")
    assert tables.read_hits(spark, f"{tmp_path}/e.tsv").count() == 0
    (tmp_path / "s.tsv").write_bytes(b"read_id\tlen\na\t5\nb\t6\n\n")
    assert tables.read_lines(spark, f"{tmp_path}/s.tsv").count() == 2
    assert tables.read_lines(spark, f"{tmp_path}/s.tsv", with_header=True).count() == 3


def test_a_list_is_read_as_it_was_written(spark, tmp_path):
    rows = [("g1", "r1", "AC-T", True, None), ("g2", None, None, False, 5)]
    df = spark.createDataFrame(rows, "target_gene string, read_name string, read_seq string, intact boolean, n int")
    sinks.write_csv(df, f"{tmp_path}/l.csv")
    assert sorted(map(tuple, tables.read_stage(spark, f"{tmp_path}/l.csv", "target_gene string, read_name string, read_seq string, intact boolean, n int").collect())) == [("g1", "r1", "AC-T", True, None), ("g2", None, None, False, 5)]


def test_several_files_by_a_pattern(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part_{k}.fa").write_text(f">r{k}\nACGT\n")
    (tmp_path / "other.txt").write_text(">x\nAA\n")
    assert sorted(x.id for x in reads.read_fasta(spark, f"{tmp_path}/part_*.fa").collect()) == ["r0", "r1", "r2"]


def test_bam_of_many_blocks_in_linear_time():
    head = b"BAM\1" + struct.pack("<ii", 0, 0)
    one = b"".join(record(f"read{k}", "ACGT" * 50) for k in range(60))
    data = block(head) + block(one) * 4000 + block(b"")  # tens of thousands of records in 4,000 blocks
    began = time.process_time()
    assert sum(map(len, reads.unblocked(data))) == len(head) + 4000 * len(one)
    took = time.process_time() - began
    began = time.process_time()
    sum(map(len, reads.unblocked(data + data[len(block(head)) :])))
    assert time.process_time() - began < 4 * took + 0.5
    small = block(head) + block(one[:1000]) + block(one[1000:])
    assert [x[0] for x in reads.bam_records(memoryview(small))] == [f"read{k}" for k in range(60)]
    plain = gzip.compress(head + one[:5000]) + gzip.compress(one[5000:])  # members without their size
    assert [x[1] for x in reads.bam_records(plain)] == ["ACGT" * 50] * 60


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "x_f string, n int")
    sinks.write_csv(df, f"{tmp_path}/c", one_file=True, rename=sinks.side_names(df.columns))
    assert spark.read.csv(f"{tmp_path}/c", header=True).columns == ["x.f", "n"]
    sinks.write_tsv(df, f"{tmp_path}/t")
    assert sorted(x.value for x in spark.read.text(f"{tmp_path}/t").collect()) == ['"a"\t"1"', '"b"\t"2"']
    got = sinks.chunk_names(spark.range(25), "id", 25, 10).groupBy("chunk").count().orderBy("chunk").collect()
    assert [tuple(x) for x in got] == [("1", 10), ("2", 10), ("3", 5)]
