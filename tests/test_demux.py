"""Classification of read pairs against the rules, read by read."""

import random
from collections import defaultdict

from editloom.operators import demux, report

COLUMNS = "qseqid string, sseqid long, qstart int, qend int, qlen int, sstart int, slen int, mismatch int, gapopen int"


def hits(side, seed):
    r = random.Random(seed)
    return [
        (f"{side}{q}", read, r.choice([1, 1, 1, 2, 17]), r.choice([24, 24, 22]), 24, r.choice([10, 12, 390, 210, 211]), 420, r.choice([0, 0, 1]), r.choice([0, 0, 0, 1]))
        for read in range(150) for q in r.sample(range(4), r.randint(0, 4))
    ]


def by_rules(forward, reverse):
    where = lambda h: "front" if h[5] <= h[6] / 2 else "rear"
    full = lambda h: h[7] + h[8] == 0 and h[3] - h[2] + 1 == h[4]
    cost = lambda h: h[4] - h[3] + h[2] + h[7] + h[8]
    pairs = defaultdict(list)
    for f in forward:
        for g in reverse:
            if f[1] == g[1] and where(f) != where(g):
                pairs[f[1]].append((f, g))
    out = {}
    for read, found in pairs.items():
        done = [p for p in found if full(p[0]) and full(p[1])]
        least = min(cost(f) + cost(g) for f, g in found)
        best = [p for p in found if cost(p[0]) + cost(p[1]) == least]
        for p in found:
            if done:
                kind = "complete_match" if p in done else "excluded"
            elif len(found) == 1:
                kind = "single_match"
            elif len(best) == 1:
                kind = "partial_match" if p in best else "excluded"
            else:
                kind = "rest"
            out[read, p[0][0], p[1][0]] = kind
    return out


def test_classify(spark):
    f, r = hits("F", 1), hits("R", 2)
    got = demux.classify(demux.opposite_pairs(spark.createDataFrame(f, COLUMNS), spark.createDataFrame(r, COLUMNS))).collect()
    want = by_rules(f, r)
    assert {(x.sseqid, x.qseqid_f, x.qseqid_r): x["class"] for x in got} == want
    assert set(want.values()) == {"complete_match", "single_match", "partial_match", "rest", "excluded"}


def test_unsettled_reads_keep_one_row(spark):
    f, r = hits("F", 1), hits("R", 2)
    classified = demux.classify(demux.opposite_pairs(spark.createDataFrame(f, COLUMNS), spark.createDataFrame(r, COLUMNS)))
    rest = {x.sseqid for x in classified.where("class = 'rest'").collect()}
    got = demux.undemultiplexed(classified).collect()
    assert sorted(x.sseqid for x in got) == sorted(rest)
    for x in got:
        own = [y for y in classified.where(f"sseqid = {x.sseqid}").collect()] if x.qstart_f is None else None
        assert own is None or not any(y.qstart_f == min(z.qstart_f for z in own) and y.qstart_r == min(z.qstart_r for z in own) for y in own)


def test_no_complete_pair_and_empty_input(spark):
    one = spark.createDataFrame([("F1", 1, 2, 24, 24, 10, 420, 0, 0)], COLUMNS)
    other = spark.createDataFrame([("R1", 1, 2, 24, 24, 400, 420, 0, 0)], COLUMNS)
    assert [x["class"] for x in demux.classify(demux.opposite_pairs(one, other)).collect()] == ["single_match"]
    assert demux.classify(demux.opposite_pairs(one.limit(0), other)).count() == 0


def test_samples_take_the_first_entry(spark):
    listed = spark.createDataFrame([("P2", "F1", "A", "R1", "C", 5), ("P1", "F1", "G", "R1", "T", 3), ("P3", "F 2", "G", "R1", "T", 9)], "pair_id string, f_id string, f_seq string, r_id string, r_seq string, ordinal long")
    pairs = spark.createDataFrame([("F1", "R1"), ("F9", "R1"), ("F_2", "R1")], "qseqid_f string, qseqid_r string")
    got = {x.qseqid_f: x.index_pair_id for x in demux.with_samples(pairs, listed).collect()}
    assert got == {"F1": "P1", "F9": None, "F_2": "P3"}
    assert {x.id: x.seq for x in demux.first_indexes(listed, "f").collect()} == {"F1": "G", "F 2": "G"}


def test_one_shuffle_a_side(spark):
    f, r = spark.createDataFrame(hits("F", 1), COLUMNS), spark.createDataFrame(hits("R", 2), COLUMNS)
    listed = spark.createDataFrame([("P1", "F1", "G", "R1", "T", 3)], "pair_id string, f_id string, f_seq string, r_id string, r_seq string, ordinal long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        _, rest = demux.demultiplex(f, r, listed)
        plan = rest._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning") == 2


def test_counts_in_one_pass(spark):
    f, r = hits("F", 1), hits("R", 2)
    classified = demux.classify(demux.opposite_pairs(spark.createDataFrame(f, COLUMNS), spark.createDataFrame(r, COLUMNS)))
    for most in (1, 2, 15):
        want = report.assigned(demux.demultiplexed(classified), demux.undemultiplexed(classified), most).first()
        assert report.assigned_of(classified, most).first() == want and want.n > 0


def test_tasks_grow_with_the_hits(spark, tmp_path, monkeypatch):
    f, r = hits("F", 1), hits("R", 2)
    for name, rows in (("f", f), ("r", r)):
        spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/{name}")
    forward, reverse = (spark.read.parquet(f"{tmp_path}/{x}") for x in "fr")
    listed = spark.createDataFrame([("P1", "F1", "G", "R1", "T", 3)], "pair_id string, f_id string, f_seq string, r_id string, r_seq string, ordinal long")
    want = sorted(map(str, demux.demultiplex(forward, reverse, listed)[0].collect()))
    monkeypatch.setattr(demux, "TASK_BYTES", 100)
    tasks = demux._tasks(forward, reverse)
    assert tasks > 2 * spark.sparkContext.defaultParallelism
    done = demux.demultiplex(forward, reverse, listed)[0]
    assert sorted(map(str, done.collect())) == want and want
    assert done._jdf.queryExecution().executedPlan().toString().count(f"Exchange hashpartitioning(sseqid, {tasks})") in (0, 2)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks})" in plan
