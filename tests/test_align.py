"""The aligner against a plain dynamic programme."""

import random

import resource

from editloom.operators import align
from editloom.operators.align import SCORES, align_long, align_many, align_reads, shared_words


def best_score(q, s):
    match, miss, first, more = SCORES
    low = -(10**6)
    h = [[0] * (len(s) + 1) for _ in range(len(q) + 1)]
    d = [[low] * (len(s) + 1) for _ in range(len(q) + 1)]
    r = [[low] * (len(s) + 1) for _ in range(len(q) + 1)]
    best = 0
    for i in range(1, len(q) + 1):
        for j in range(1, len(s) + 1):
            d[i][j] = max(h[i - 1][j] + first, d[i - 1][j] + more)
            r[i][j] = max(h[i][j - 1] + first, r[i][j - 1] + more)
            h[i][j] = max(0, h[i - 1][j - 1] + (match if q[i - 1] == s[j - 1] and q[i - 1] != "N" else miss), d[i][j], r[i][j])
            best = max(best, h[i][j])
    return best


def rescored(q, s):
    match, miss, first, more = SCORES
    total, k = 0, 0
    while k < len(q):
        if q[k] == "-" or s[k] == "-":
            side = q if q[k] == "-" else s
            n = k
            while n < len(q) and side[n] == "-":
                n += 1
            total, k = total + first + (n - k - 1) * more, n
        else:
            total, k = total + (match if q[k] == s[k] and q[k] != "N" else miss), k + 1
    return total


def test_scores_and_rows():
    r = random.Random(5)
    q = "".join(r.choice("ACGT") for _ in range(30))
    reads = []
    for _ in range(60):
        s = list(q[r.randint(0, 8) : r.randint(20, 30)])
        for _ in range(r.randint(0, 5)):
            k = r.randrange(len(s))
            s[k : k + r.choice([0, 1, 2])] = r.choice(["", "A", "GT", "N"])
        reads.append("".join(r.choice("ACGT") for _ in range(r.randint(0, 12))) + "".join(s))
    for read, hit in zip(reads, align_many(q.encode(), [x.encode() for x in reads]), strict=True):
        want = best_score(q, read)
        if not want:
            assert hit is None
            continue
        score, qs, qe, ss, se, mis, gaps, top, low = hit
        assert score == want == rescored(top, low)
        assert top.replace("-", "") == q[qs - 1 : qe] and low.replace("-", "") == read[ss - 1 : se]


def test_strands_and_empty(spark):
    q = "ACGTTGCAAGGCTTAACCGT"
    back = q[::-1].translate(str.maketrans("ACGT", "TGCA"))
    reads = spark.createDataFrame([("a", "TTTT" + q + "GG"), ("b", "CC" + back + "AAAAA"), ("c", None), ("d", "")], "id string, seq string")
    got = {x.sseqid: x for x in align_reads(reads, [("q", q)], min_score=30).collect()}
    assert set(got) == {"a", "b"}
    assert (got["a"].sstart, got["a"].send, got["a"].mismatch) == (5, 24, 0)
    assert (got["b"].sstart, got["b"].send, got["b"].sseq) == (22, 3, q)
    assert align_reads(reads.limit(0), [("q", q)]).count() == 0 == align_reads(reads, []).count()


def test_long_reads_in_windows(monkeypatch):
    r = random.Random(9)
    q = "".join(r.choice("ACGT") for _ in range(25)).encode()
    reads = []
    for _ in range(40):
        parts = []
        for _ in range(6):
            s = list(q.decode())
            for _ in range(r.randint(1, 8)):
                k = r.randrange(len(s))
                s[k : k + 1] = r.choice(["", "A", "GTTTTT", "N"])
            parts.append("".join(r.choice("ACGT") for _ in range(r.randint(0, 60))) + "".join(s))
        reads.append("".join(parts).encode())
    whole = align_many(q, reads)
    monkeypatch.setattr(align, "CELLS", 1)  # windows as short as they may be
    assert [align_long(q, s) for s in reads] == whole


def test_a_read_of_a_megabase_needs_bounded_memory():
    r = random.Random(1)
    q = "".join(r.choice("ACGT") for _ in range(500)).encode()
    read = ("".join(r.choice("ACGT") for _ in range(700_000)) + q.decode() + "".join(r.choice("ACGT") for _ in range(300_000))).encode()
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    hit = align_long(q, read, least=40)
    assert hit[0] == 1000 and hit[3] == 700_001 and hit[4] == 700_500
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_common_words_in_blocks(spark, monkeypatch):
    r = random.Random(3)
    some = lambda n, letters: [(f"{'s' if k % 7 else 'twice'}{k if k % 7 else ''}", "".join(r.choice(letters) for _ in range(r.randint(0, 40)))) for k in range(n)]
    left, right = [*some(60, "ACG"), ("null", None), (None, "ACGACG"), ("low", "A" * 50)], [*some(50, "ACGN"), ("odd", "ACG\u00e9\U0001f600ACG\u00e9\U0001f600")]

    def by_rules(a, b, k):
        out = {}
        words = lambda s: {s[i : i + k] for i in range(len(s or "") - k + 1)}
        for x, s in a:
            for y, z in b:
                if n := len(words(s) & words(z)):
                    out[x, y] = out.get((x, y), 0) + n
        return out

    a, b = (spark.createDataFrame(x, "id string, seq string") for x in (left, right))
    for letters, joined in ((align.LETTERS, align.JOINED), (150, 40)):
        monkeypatch.setattr(align, "LETTERS", letters)
        monkeypatch.setattr(align, "JOINED", joined)
        for x, y, k in ((a, b, 3), (a, a, 3), (b, b, 5), (a, b, 30)):
            got = shared_words(x, y, k)
            rows = {(p.left_id, p.right_id): p.n_words for p in got.collect()}
            assert rows == by_rules(*({id(a): left, id(b): right}[id(z)] for z in (x, y)), k) and got.count() == len(rows)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert shared_words(a.limit(0), a, 3).count() == 0


def test_seeds_are_common_words():
    r = random.Random(4)
    some = lambda n, m: ["".join(r.choice("ACGTN") for _ in range(r.randint(0, m))).encode() for _ in range(n)]
    queries, reads = [*some(9, 30), b"", "\u00e9ACG".encode()], [*some(80, 40), b"ACG\xff", "TT\u00e9ACGT".encode(), b""]
    for seed in (1, 3, 4, 20, 50):
        words = [{q[k : k + seed] for k in range(len(q) - seed + 1)} for q in queries]
        assert align._seeded(queries, reads, seed) == [[k for k, s in enumerate(reads) if any(w in s for w in of)] for of in words]


def test_reads_of_one_file_are_dealt_out(spark, tmp_path):
    spark.createDataFrame([(str(k), "ACGTTGCAAGGCTTAACCGT") for k in range(400)], "id string, seq string").coalesce(1).write.parquet(f"{tmp_path}/reads")
    reads = spark.read.parquet(f"{tmp_path}/reads")
    assert reads.rdd.getNumPartitions() == 1
    parts = align_reads(reads, [("q", "ACGTTGCAAGGCTTAACCGT")], seed=8).rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()
    assert sum(parts) == 400 and max(parts) < 100
