import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from editloom.llm import sharding
from tests.llm.fixtures import documents, odd_rows


def test_matrix():
    rows = [10, 0, 7, 100, 3]
    m = sharding.communication_matrix(rows, 8)
    assert m.sum(axis=1).tolist() == rows and m.sum(axis=0).tolist() == [15] * 8
    assert sharding.communication_matrix([], 8).shape == (0, 8)
    assert (m >= 0).all()


def test_chances_are_exact():
    for good, bad, n in ((3, 5, 4), (0, 7, 3), (7, 0, 3), (40, 25, 30), (1, 1, 0), (300, 500, 77)):
        low, p = sharding.hypergeometric(good, bad, n)
        want = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(max(0, n - bad), min(n, good) + 1)]
        assert low == max(0, n - bad) and np.allclose(p, want, rtol=1e-12, atol=0)


def test_draws_at_any_size():
    random = np.random.default_rng(0)
    for places, n in ((np.array([10**9, 10**9, 2 * 10**9]), 6), (np.array([3, 3, 6]), 6), (np.array([10**13, 10**13, 2 * 10**13]), 10**8)):
        m = np.array([sharding.draw(random, places, n) for _ in range(2000 if n < 10 else 200)])
        total = places.sum()
        spread = np.sqrt(n * (places / total) * (1 - places / total) * (total - n) / (total - 1))
        assert (m.sum(axis=1) == n).all() and (abs(m.mean(axis=0) - n * (places / total)) < 4 * spread / math.sqrt(len(m))).all()
        assert np.allclose(m.std(axis=0), spread, rtol=0.25)


def test_matrices_come_as_often_as_they_should():
    """Against all ways to put rows in order: the joint distribution of a whole matrix."""
    rows, shards = [2, 1, 2], 2
    of = [p for p, n in enumerate(rows) for _ in range(n)]
    sizes = [3, 2]
    want = Counter()
    for order in itertools.permutations(range(5)):
        m = np.zeros((3, shards), int)
        for place, k in enumerate(order):
            m[of[k], 0 if place < sizes[0] else 1] += 1
        want[m.tobytes()] += 1 / 120
    got = Counter(sharding.communication_matrix(rows, shards, seed).astype(int).tobytes() for seed in range(4000))
    assert set(got) == set(want)
    assert all(abs(got[m] / 4000 - p) < 4 * math.sqrt(p * (1 - p) / 4000) for m, p in want.items())


def test_law_and_digests(spark):
    rows = odd_rows()
    docs = documents(spark, rows).repartition(5)
    got = sharding.shuffle_into_shards(docs).collect()
    assert len(got) == len(rows)
    sizes = np.bincount([x.shard for x in got], minlength=8)
    assert sizes.max() - sizes.min() <= 1
    for k in range(8):
        assert sorted(x.slot for x in got if x.shard == k) == list(range(sizes[k]))
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows), key=str)
    assert sorted(((x.doc_id, x["size"], x.text_crc32) for x in got), key=str) == want
    assert sharding.shuffle_into_shards(docs.limit(0)).count() == 0


def test_shards_hold_whole_rows(spark):
    docs = documents(spark, odd_rows()).repartition(5)
    got = sharding.shuffle_into_shards(docs)
    assert got.select("row.*").schema == docs.schema
    rows = got.collect()
    assert Counter(tuple(x.row) for x in rows) == Counter(map(tuple, docs.collect()))
    assert all((x.doc_id, x["size"]) == (x.row.doc_id, len((x.row.text or "").encode()) + 1) for x in rows)


def test_texts_are_exchanged(spark, tmp_path):
    docs = documents(spark, [(k, f"text {k}", "s") for k in range(100)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plan = sharding.op8(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Exchange hashpartitioning\(shard.*\n(?:.*\n)*?.*MapInArrow.*row#", plan)


def test_reruns_agree_and_order_is_mixed(spark, monkeypatch):
    monkeypatch.setattr(sharding, "RUN_ROWS", 50)  # several runs a shard
    docs = documents(spark, [(k, "t", "s") for k in range(4000)])
    a, b = ({x.doc_id: (x.shard, x.slot) for x in sharding.shuffle_into_shards(docs).collect()} for _ in range(2))
    assert a == b and len(set(a.values())) == 4000
    assert abs(np.corrcoef(list(a), [s for _, s in a.values()])[0, 1]) < 0.06
    assert {x.doc_id: (x.shard, x.slot) for x in sharding.shuffle_into_shards(docs, seed=1).collect()} != a


def test_pairs_of_rows_meet_as_often_as_in_a_uniform_shuffle(spark):
    docs = documents(spark, [(k, "t", "s") for k in range(64)]).repartition(4).cache()
    same = []
    for seed in range(12):
        of = {x.doc_id: x.shard for x in sharding.shuffle_into_shards(docs, 8, seed).collect()}
        same += [of[k] == of[k + 1] for k in range(0, 64, 2)]
    assert abs(np.mean(same) - 7 / 63) < 0.06
