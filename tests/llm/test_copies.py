import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from editloom.llm import copies
from tests.llm.fixtures import documents, odd_rows
from tests.llm.test_simhash import components


def shingles(text, width=5):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
    return {b" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def edited(r, words, n):
    out = list(words)
    for k in r.sample(range(len(words)), n):
        out[k] = f"new{r.randint(0, 10**9)}"
    return " ".join(out)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    rows, at = [], 0
    for _ in range(120):
        words = [f"w{r.randint(0, 5000)}" for _ in range(r.randint(60, 300))]
        for n in (0, 0, max(1, len(words) // 200), len(words) // 60, len(words) // 45, len(words) // 12):
            rows.append((at, edited(r, words, n), "a"))
            at += 1
    return rows


def test_pairs_of_the_similarity_are_caught(spark, corpus):
    found = copies.near_copies(documents(spark, corpus))
    kept = {x.doc_id for x in found.where("kept").collect()}
    sets = [shingles(t) for _, t, _ in corpus]
    pairs = [(a, b, jaccard(sets[a], sets[b])) for a in range(len(corpus)) for b in range(a) if a // 6 == b // 6]
    alike = components(range(len(corpus)), [(a, b) for a, b, j in pairs if j >= 0.8])
    loose = components(range(len(corpus)), [(a, b) for a, b, j in pairs if j >= 0.55])
    gone = set(range(len(corpus))) - kept
    want = {k for k, root in alike.items() if k != root}
    assert len(want) > 250 and len(want - gone) <= 0.03 * len(want)
    assert all(loose[k] != k for k in gone)  # nothing goes that is not like an earlier text


def test_components_are_those_of_the_fingerprints(spark):
    r = random.Random(6)
    base = [np.array([r.getrandbits(64) for _ in range(copies.WORDS)], np.uint64) for _ in range(30)]
    fps = [b.copy() for b in base]
    for _ in range(1500):  # a large group of near copies
        f = base[0].copy()
        for k in r.sample(range(copies.BITS), r.randint(0, 30)):
            f[k // 64] ^= np.uint64(1 << (k % 64))
        fps.append(f)
    fps = np.array(fps)
    near = (np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2) <= copies.limit_for(0.8))
    want = components(range(len(fps)), zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near, 1)))))
    df = spark.createDataFrame([(k, *map(int, f.view(np.int64))) for k, f in enumerate(fps)], "node long, " + ", ".join(f"f{w} long" for w in range(copies.WORDS)))
    for block in (1024, 50):
        edges = [(x.a, x.b) for x in copies.near_links(df, block=block).collect()]
        assert all(near[a, b] or want[a] == want[b] for a, b in edges)
        assert components(range(len(fps)), edges) == want
        assert len(edges) < 40 * len(fps)


def flipped(r, f, n):
    out = f.copy()
    for bit in r.choice(copies.BITS, n, replace=False):
        out[bit // 64] ^= np.uint64(1 << int(bit % 64))
    return out


def test_no_link_at_the_limit_is_left_out(spark, monkeypatch):
    """Pairs just at the limit, which samples of bits miss now and then, and chains of them; in several parts."""
    monkeypatch.setattr(copies, "LEAST_ROWS", 300)
    r, limit = np.random.default_rng(8), copies.limit_for(0.8)
    fps = []
    for _ in range(400):
        fps += [r.integers(0, 2**64, copies.WORDS, dtype=np.uint64)]
        fps += [flipped(r, fps[-1], limit), flipped(r, fps[-1], limit + 1)]
    for _ in range(100):
        fps.append(flipped(r, fps[-1], limit))
    near = np.bitwise_count(np.array(fps)[:, None] ^ np.array(fps)[None, :]).sum(axis=2) <= limit
    want = components(range(len(fps)), zip(*map(np.ndarray.tolist, np.nonzero(np.triu(near, 1)))))
    df = spark.createDataFrame([(k, *map(int, f.view(np.int64))) for k, f in enumerate(fps)], "node long, " + ", ".join(f"f{w} long" for w in range(copies.WORDS)))
    assert components(range(len(fps)), [(x.a, x.b) for x in copies.near_links(df).collect()]) == want


def test_links_between_groups_are_exact(monkeypatch):
    r = np.random.default_rng(9)
    base = r.integers(0, 2**64, (10, copies.WORDS), dtype=np.uint64)
    fps = np.array([flipped(r, base[k % 10], int(r.integers(10, 40))) for k in range(400)])
    for limit, many, pairs in ((47, 2048, 1 << 19), (47, 20, 100), (20, 20, 1 << 19), (60, 2048, 1 << 19)):
        monkeypatch.setattr(copies, "MANY", many)
        monkeypatch.setattr(copies, "PAIRS", pairs)
        root = r.integers(0, 12, 400) if many == 20 else np.arange(400)
        for a, b in ((slice(0, 400), slice(0, 400)), (slice(0, 150), slice(150, 400))):
            near = np.bitwise_count(fps[a][:, None] ^ fps[b][None, :]).sum(axis=2) <= limit
            want = {(x, y) for x, y in zip(root[a][np.nonzero(near)[0]].tolist(), root[b][np.nonzero(near)[1]].tolist(), strict=True) if x != y}
            assert set(map(tuple, copies._apart(fps[a], root[a], fps[b], root[b], limit).tolist())) == want


def test_spread_is_exact():
    r = np.random.default_rng(3)
    for _ in range(20):
        fps = r.integers(0, 2**63, (60, copies.WORDS), dtype=np.uint64)
        fps[20:] = fps[r.integers(0, 12, 40)]
        for k in range(20, 60):
            for bit in r.choice(copies.BITS, r.integers(10, 45), replace=False):
                fps[k, bit // 64] ^= np.uint64(1 << int(bit % 64))
        limit = 48
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]).sum(axis=2) <= limit
        assert (copies.near(fps[:, None], fps[None, :], limit) == near).all()
        want = components(range(60), zip(*map(np.ndarray.tolist, np.nonzero(near))))
        root, lead = copies._spread(fps, limit)
        assert Counter(Counter(root.tolist()).values()) == Counter(Counter(want.values()).values())
        assert near[lead].any(axis=0).all()


def test_sets_of_shingles():
    r = random.Random(7)
    texts = [" ".join(r.choice("abcdef") for _ in range(n)) for n in (0, 1, 4, 5, 6, 50)] + [None, " ".join(f"v{r.randint(0, 60)}" for _ in range(200_000)), "A b  C d\te", "a B c d e"]
    found = {}
    for rows, h in copies._sets(pa.array(texts), 5):
        for k, x in zip(rows.tolist(), h.tolist(), strict=True):
            found.setdefault(k, []).append(x)
    assert all(len(set(v)) == len(v) for v in found.values())
    assert {k: len(v) for k, v in found.items()} == {k: len(s) for k, t in enumerate(texts) if (s := shingles(t))}
    assert found[8] == found[9]


def test_rows_stay_or_go_by_their_text(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(80)) for c in "ab")
    one = documents(spark, [(3, a, "s"), (5, a, "s"), (5, b, "s"), (None, a, "s"), (None, b, "s"), (None, "alone in this", "s"), (None, "alone in this", "s")])
    got = sorted(((x.doc_id, x.text) for x in copies.near_dedup(one).collect()), key=str)
    assert got == sorted([(3, a), (5, b), (None, "alone in this")], key=str)
    two = documents(spark, [(5, a, "s"), (5, b, "s"), (7, a.upper(), "s")])
    assert sorted((x.doc_id, x.text) for x in copies.near_dedup(two).collect()) == [(5, a), (5, b)]


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    out = copies.near_dedup(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert [x.doc_id for x in rows if not (x.text or "").strip()] == [100]  # of those without words the first
    assert len({x.text for x in rows}) == len(rows)
    assert copies.near_dedup(docs.limit(0)).count() == 0
