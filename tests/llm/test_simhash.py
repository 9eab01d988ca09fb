import random
import re

import pyarrow as pa
import xxhash

from editloom.llm import graph, simhash
from tests.llm.fixtures import documents, odd_rows


def fingerprint(text):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, near):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_and_components(spark):
    rows = odd_rows()
    got = simhash.simhash_components(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = [(i, fingerprint(t)) for i, t, _ in rows]
    key = lambda p: (str(p[0]), p[1])
    assert sorted(((x.doc_id, x.fp % 2**64) for x in got), key=key) == sorted(fps, key=key)
    values = sorted({f for _, f in fps})
    of = components(values, [(a, b) for a in values for b in values if (a ^ b).bit_count() <= 3])
    least = {}
    for i, f in fps:
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    assert all(x.component_id == least.get(of[x.fp % 2**64]) for x in got)


def test_near_edges_lose_nothing(spark):
    r = random.Random(2)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base) | {r.getrandbits(64) for _ in range(300)} | {0, 2**64 - 1}
    for f in base:
        for _ in range(12):
            fps.add(f ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    want = components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 3])
    for group in (1024, 4):  # with 4, nearly all buckets get longer keys
        edges = [(x.a % 2**64, x.b % 2**64) for x in simhash.near_edges(df, 3, group).collect()]
        assert all((a ^ b).bit_count() <= 64 for a, b in edges)
        assert components(fps, edges) == want


def test_chains_hold_for_every_near_pair():
    r = random.Random(3)
    keys = simhash.ring_keys(3)
    assert len(keys) == 16 and all(m.bit_count() == 28 for _, m in keys)
    for _ in range(5000):
        apart = sum(1 << b for b in r.sample(range(64), r.randint(0, 3)))
        assert any(not apart & m and all((apart & simhash._segments(s, n)).bit_count() <= 3 * n // 8 for n in range(1, 9)) for s, m in keys)


def test_large_groups_and_dedup(spark):
    text = " ".join(f"word{k}" for k in range(200))
    rows = [(k, text, "a") for k in range(10, 600)] + [(5, "  " + text.upper() + "\n", "a"), (700, "something else entirely here", "a"), (None, text, "a"), (10, text, "a")]
    docs = documents(spark, rows)
    got = simhash.simhash_components(docs)
    assert {x.component_id for x in got.where("doc_id <> 700").collect()} == {5}


def test_empty_table(spark):
    docs = documents(spark, odd_rows()).limit(0)
    assert simhash.simhash_components(docs).count() == 0


def test_long_texts_in_pieces():
    r = random.Random(8)
    texts = [" ".join(f"W{r.randint(0, 4000)}" for _ in range(n)) for n in (90_000, 3, 2, 150_000)]
    texts += ["x" * 700_000, "a " + "y" * 600_000 + " b c " + "z" * 300_000, " " * 400_000, " ".join(["q" * 299_000] * 4), None]
    got = simhash.fingerprints_of(pa.array(texts))
    assert got.tolist() == [fingerprint(t) for t in texts]


def test_graph(spark):
    r = random.Random(4)
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, x) for x in range(1000, 1200)] + [(r.randint(2000, 2100), r.randint(2000, 2100)) for _ in range(80)] + [(3, 3)]
    got = graph.connected_components(spark.createDataFrame([*edges, (None, 4)], "a long, b long")).collect()
    want = components({x for e in edges for x in e}, edges)
    assert len(got) == len({x.node for x in got})
    assert {x.node: x.root for x in got} == {k: v for k, v in want.items() if k != v}
