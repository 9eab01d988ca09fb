import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from editloom.llm import polytope, rabitq
from tests.llm.fixtures import vectors

BAD = [(900, None), (901, [0.0] * 24), (902, [1.0] * 23 + [None]), (903, [float("nan")] * 24), (904, [1.0, 2.0]), (None, [1.0] * 24), (905, []), (906, [float("inf")] + [1.0] * 23)]


def near(seed, groups, size, d=24, noise=0.03):
    """Groups of vectors about a centre, copies among them, and others."""
    r = np.random.default_rng(seed)
    rows = []
    for _ in range(groups):
        c = r.standard_normal(d)
        rows += [c + noise * r.standard_normal(d) * np.sqrt(d) * r.random() for _ in range(size)]
    rows += [r.standard_normal(d) for _ in range(200)]
    rows += [rows[0], rows[0], 2 * rows[5]]
    return [(k, [float(np.float32(v)) for v in x]) for k, x in enumerate(rows)]


def test_links_against_brute_force(spark):
    rows = near(1, 8, 25)
    for block in (1024, 16):  # with 16, buckets are split into pairs of blocks
        got = {x.vec_id: x for x in polytope.near_vectors(vectors(spark, rows + BAD), block=block).collect()}
        x = np.array([v for _, v in rows])
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        link = u @ u.T >= 0.95
        root = np.arange(len(rows))
        while (least := np.where(link, root[None], len(rows)).min(axis=1)).tolist() != root.tolist():
            root = least
        assert [got[k].n_links for k in range(len(rows))] == (link.sum(axis=1) - 1).tolist()
        assert [got[k].component_id for k in range(len(rows))] == root.tolist()
        assert all(got[k].kept == (root[k] == k) for k in range(len(rows)))
        assert all((got[k].n_links, got[k].component_id, got[k].kept) == (0, k, k is not None) for k, _ in BAD)


def test_many_equal_vectors_and_empty(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(500)] + [(500, [-1.0, 0.0, 0.0]), (3, [1.0, 2.0, 3.0])]
    got = polytope.near_vectors(vectors(spark, rows, "double")).collect()
    assert {(x.n_links, x.component_id) for x in got if x.vec_id != 500} == {(500, 0)} and len(got) == 502
    assert polytope.near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_hadamard_keeps_lengths_and_tables_suffice():
    x = np.random.default_rng(0).standard_normal((50, 64))
    y = polytope.hadamard(x)
    assert np.allclose((x * x).sum(axis=1), (y * y).sum(axis=1)) and np.allclose(polytope.hadamard(y), x)
    assert 1 <= polytope.tables_needed(64, 1, 0.95) < polytope.tables_needed(64, 2, 0.95) < 20


def best_by_brute_force(rows, k):
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    out = {}
    for q in ids[ids % 20 == 0]:
        score = x @ x[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
        out[int(q)] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def test_recall_and_scores(spark):
    r = np.random.default_rng(3)
    rows = [(k, [float(np.float32(v)) for v in r.standard_normal(24) * r.uniform(0.5, 2)]) for k in range(3000)]
    got = {}
    for x in rabitq.nearest_vectors(vectors(spark, rows + BAD), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    want = best_by_brute_force(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 20 * len(want)
    x = dict(rows)
    assert all(abs(s - np.dot(x[q], x[i])) < 1e-9 for q, f in got.items() for i, s in f)
    assert all(f == sorted(f, key=lambda p: (-p[1], p[0])) for f in got.values())


def test_blocks_give_the_same(spark, monkeypatch):
    rows = near(5, 4, 60)
    ask = lambda: sorted(map(tuple, rabitq.nearest_vectors(vectors(spark, rows), F.col("vec_id") % 20 == 0, 5, recall=1.0).collect()))
    whole = ask()
    monkeypatch.setattr(rabitq, "BLOCK", 40)
    monkeypatch.setattr(rabitq, "QUERIES", 3)
    split = ask()
    assert [x[:3] for x in split] == [x[:3] for x in whole]


def test_few_candidates_ties_and_empty(spark):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]
    got = rabitq.nearest_vectors(vectors(spark, rows), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [tuple(x) for x in got] == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 3, 0.0)]
    assert rabitq.nearest_vectors(vectors(spark, rows).limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert rabitq.nearest_vectors(vectors(spark, rows[:1]), F.col("vec_id") % 20 == 0).count() == 0


def test_error_bounds_hold():
    r = np.random.default_rng(7)
    x, q = r.standard_normal((2000, 64)), r.standard_normal((20, 64))
    index = rabitq.Index(rabitq.centroids_of(x, 1))
    at, bits, size, fit = index.encode(x)
    about, bound = index.estimate(q, 0, bits, size, fit)
    assert (np.abs(about - q @ x.T) <= bound).mean() > 0.995 and not at.any()


def test_copies_whose_estimate_is_rounded_down_stay():
    class Low(rabitq.Index):
        def estimate(self, *args):
            about, bound = super().estimate(*args)
            return np.nextafter(about, -np.inf), bound

    r = np.random.default_rng(7)
    c, ask = r.standard_normal(24), r.standard_normal(24)
    index = Low(c[None])
    at, bits, size, fit = index.encode(np.tile(c, (100, 1)))
    assert not size.any()
    vectors_ = pa.array([*np.tile(c, (100, 1)).tolist(), ask.tolist()], pa.list_(pa.float64()))
    columns = [[0] * 101, [0] * 101, [0] * 101, [0] * 100 + [1], list(range(101)), vectors_, [x.tobytes() for x in bits] + [None], [*size, 0.0], [*fit, 1.0], [float("-inf")] * 101]
    group = pa.table([pa.array(x) if isinstance(x, list) else x for x in columns], names=[str(k) for k in range(10)])
    names, ids, scores = rabitq._search(group, index, 20)
    assert ids.tolist() == list(range(20)) and set(names) == {100} and np.allclose(scores, c @ ask)
