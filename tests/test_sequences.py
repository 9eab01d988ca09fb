"""Column functions against the stated rules, step by step."""

import random

from pyspark.sql import functions as F

from editloom.functions import sequences as fn


def window_by_steps(q, s, start, span):
    """Move past the gaps before the window, then widen until enough reference bases are in."""
    at = start + q[: max(start - 1, 0)].count("-")
    rest = q[at - 1 :]
    width = span
    while True:
        wider = min(len(rest), span + rest[:width].count("-"))
        if wider == width or wider >= len(rest):
            width = wider
            break
        width = wider
    return s[at - 1 : at + width], q[at - 1 : at + width]


def label_by_rule(pattern, window):
    if pattern == window:
        return "ref"
    gaps, gain = pattern.count("-"), len(pattern.replace("-", "")) - len(window)
    if gaps and gain > 0:
        return f"indel{gain}-{gain}"
    return f"del{gaps}" if gaps else f"ins{gain}" if gain > 0 else "sub"


def test_gap_window(spark):
    r = random.Random(3)
    rows = []
    for k in range(3000):
        n = r.randint(20, 90)
        q, s = ("".join(r.choice("ACGT" + "-" * r.choice([1, 1, 4])) for _ in range(n)) for _ in "qs")
        rows.append((k, q, s, r.randint(1, 40)))
    df = spark.createDataFrame(rows, "k int, q string, s string, st int")
    got = {x.k: (x.w.read_seq, x.w.ref_seq) for x in df.select("k", fn.gap_window(F.col("q"), F.col("s"), F.col("st"), 20).alias("w")).collect()}
    assert all(got[k] == window_by_steps(q, s, st, 20) for k, q, s, st in rows)


def test_labels(spark):
    r = random.Random(4)
    w = "ACGTACGTACGTACGTACGTA"
    pats = [w, w[:10] + "--" + w[12:], w[:10] + "TTT" + w[10:], w[:3] + "-" + w[4:9] + "AAAC" + w[9:], w[:10] + "C" + w[11:], w[:10]]
    pats += ["".join(r.choice("ACGT-") for _ in range(r.randint(10, 30))) for _ in range(200)]
    df = spark.createDataFrame([(p, w) for p in pats], "p string, w string")
    kind = fn.allele_class(F.col("p"), F.col("w"), F.col("p") == F.col("w"))
    got = df.select("p", fn.allele_label(kind, F.col("p"), F.col("w")).alias("l"), fn.class_rank(kind).alias("r")).collect()
    assert all(x.l == label_by_rule(x.p, w) for x in got)
    assert {x.l.rstrip("0123456789-"): x.r for x in got} == {"ref": 1, "sub": 2, "ins": 3, "del": 4, "indel": 5}
    true = df.where("p like '%-%AAAC%'").select(fn.allele_label(kind, F.col("p"), F.col("w"), True).alias("l")).first().l
    assert true == "indel3-1"


def test_small_functions(spark):
    row = spark.sql("select 'AACGTN' s, 'A-C--' g, 1234.5D x, 0D z").select(
        fn.reverse_complement(F.col("s")).alias("rc"), fn.gap_count(F.col("g")).alias("n"), fn.significant(F.col("x")).alias("x"), fn.significant(F.col("z")).alias("z"),
        fn.is_dna(F.col("g")).alias("dna"), fn.is_dna(F.lit("AXE")).alias("no"), fn.slice_of(F.col("s"), F.lit(3), F.lit(2)).alias("empty"),
    ).first()
    assert (row.rc, row.n, row.x, row.z, row.dna, row.no, row.empty) == ("NACGTT", 3, 1230.0, 0.0, True, False, "")
