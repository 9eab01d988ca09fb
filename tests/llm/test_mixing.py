import re
from collections import defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from editloom.llm import mixing
from tests.llm.fixtures import documents, odd_rows


def targets_by_rounds(sizes, weights=(5, 2, 1), repeats=3):
    """Shares by weight; what exceeds the bound is shared again until none does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    bound = {s: Fraction(repeats * n) for s, n in sizes.items()}
    stopped = set()
    while True:
        left = sum(sizes.values()) - sum(bound[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        share = {s: left * weight[s] / Fraction(sum(weight[x] for x in free)) for s in free}
        over = {s for s in free if share[s] > bound[s]}
        if not over:
            return {s: bound[s] if s in stopped else share[s] for s in names}
        stopped |= over


def sainte_lague(claims, seats):
    got = dict.fromkeys(claims, 0)
    for _ in range(seats):
        best = max(sorted(claims), key=lambda c: Fraction(claims[c]) / (2 * got[c] + 1))
        got[best] += 1
    return got


@pytest.mark.parametrize("sizes", [{"a": 1000, "b": 10, "c": 700, None: 3}, {"a": 1, "b": 1000}, {"Z": 50, "a": 50, "é": 50, "b": 0}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x.source: x.target for x in mixing.targets(df).collect()}
    want = targets_by_rounds(sizes)
    assert got == pytest.approx({s: float(t) for s, t in want.items()})


@pytest.mark.parametrize("seats", [0, 1, 7, 100, 1001])
def test_apportionment(spark, seats):
    claims = {1: 53, 2: 24, 3: 23, 4: 1, 5: 1, 6: 1, 7: 0}
    df = spark.createDataFrame([(r, float(c)) for r, c in claims.items()], "rank long, c double")
    got = mixing.apportion(df, spark.createDataFrame([(seats,)], "seats long"), [], "c", ["rank"])
    assert {x["rank"]: x.quota for x in got.collect()} == sainte_lague(claims, seats)


def test_words_and_bounds(spark):
    rows = odd_rows() + [(200 + k, " ".join(f"w{k}x{j}" for j in range(50 + k)), "abc"[k % 3]) for k in range(90)]
    docs = documents(spark, rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    words = lambda t: len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for _, t, s in rows:
        sizes[s] += words(t)
    for x in out:
        taken[x.source] += x.taken
        target[x.source] = x.target
        assert 0 <= x.taken <= 3 * x["size"] and x.source_size == sizes[x.source]
    assert target == pytest.approx({s: float(t) for s, t in targets_by_rounds(sizes).items()})
    for s, t in target.items():
        assert abs(taken[s] - t) <= 2 * mixing.BLOCK
    key = lambda x: (str(x.doc_id), x["size"], x.taken, str(x.source))
    assert sorted(map(key, mixing.mix(docs.repartition(7)).collect())) == sorted(map(key, out))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {x.source: x.w for x in mixed.groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("w")).collect()} == {s: n for s, n in taken.items() if n}
    texts = {t for _, t, _ in rows}
    assert all(x.text in texts or x.n_chars == len(x.text) for x in mixed.collect())


def test_empty(spark):
    docs = documents(spark, odd_rows()).limit(0)
    assert mixing.mix(docs).count() == 0 == mixing.mixed_documents(docs).count()
    none = documents(spark, [(1, None, "a"), (2, "", "b")])
    assert [x.taken for x in mixing.mix(none).collect()] == [0, 0]


def test_rows_that_share_an_id_keep_plans_of_their_own(spark):
    rows = [(None, " ".join(f"n{k}y{j}" for j in range(100)), "b") for k in range(9)] + [(7, " ".join(f"t{k}y{j}" for j in range(90)), "b") for k in range(9)]
    rows += [(100 + k, " ".join(f"w{k}x{j}" for j in range(80)), "a") for k in range(12)] + [(7, rows[9][1], "b")] * 3
    docs = documents(spark, rows)
    words = lambda t: F.sum(mixing.size_of(F.col(t)))
    want = {x.source: x.w for x in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("w")).collect()}
    got = {x.source: x.w for x in mixing.mixed_documents(docs).groupBy("source").agg(words("text").alias("w")).collect()}
    assert got == {s: w for s, w in want.items() if w} and 0 < want["a"] < 12 * 80 * 3


def test_picks_are_seeded_and_exact(spark):
    df = spark.range(1000).withColumn("k", F.explode(F.array(*map(F.lit, (1, 2, 3, 7, 11, 462, 693, 1000))))).where("id < k")
    turns = [[x.o for x in df.select(mixing.order_of(F.col("id"), F.lit(t)).alias("o")).collect()] for t in (5, 6)]
    keys = [(x.id, x.k) for x in df.collect()]
    for order in turns:
        for k in (1, 2, 3, 7, 11, 462, 693, 1000):
            own = {o: j for (j, n), o in zip(keys, order, strict=True) if n == k}
            assert len(own) == k
            took = sorted(own[o] for o in sorted(own)[: -(-k // 3)])
            if k > 400:  # neither a run nor even steps
                assert 0.6 < sum(b - a > 1 for a, b in zip(took, took[1:])) / len(took) < 0.74
                assert 0.4 < sum(t < k / 2 for t in took) / len(took) < 0.6
    assert turns[0] != turns[1]


def test_sql_agrees(spark):
    import duckdb
    import pandas as pd

    rows = odd_rows() + [(200 + k, " ".join(f"w{k}x{j}" for j in range(50 + k)), "abc"[k % 3]) for k in range(90)]
    documents_ = pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents_)
    want = con.sql(mixing.op2_sql()).fetchall()
    got = mixing.mix(documents(spark, rows)).select("doc_id", "size", "source_size", "target", "taken", "source").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
