import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from editloom.llm import quality
from tests.llm.fixtures import documents, odd_rows

LABELS = "doc_id long, quality int, toxic int"


def clean(k):
    return " ".join(f"the word{(k * 7 + j) % 90} of a story" for j in range(20))


def junk(k):
    return " ".join(f"buy!!! now{(k + j) % 50} $$$" for j in range(20))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, junk(k) if k % 5 == 0 else clean(k), "s") for k in range(800)]
    return documents(spark, rows), spark.createDataFrame([(k, int(k % 5 != 0), 0) for k in range(0, 800, 2)], LABELS)


def test_held_out_accuracy(corpus):
    found, model = quality.importance_resample(*corpus)
    kept = {x.doc_id: x.kept for x in found.collect()}
    assert len(kept) == 800
    right = [kept[k] == (k % 5 != 0) for k in range(1, 800, 2)]  # documents without label
    assert np.mean(right) > 0.98
    docs = quality.resampled(*corpus)
    assert {x.doc_id for x in docs.select("doc_id").collect()} == {k for k, v in kept.items() if v}
    assert docs.columns == corpus[0].columns


def plain_pieces(text):
    """Runs of letters, digits and underscores (with all bytes beyond ASCII), and runs of other characters, lower-cased."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    return re.findall(rb"[0-9a-z_\x80-\xff]+|[^0-9a-z_\x80-\xff\x20\x09-\x0d]+", (text or "").encode().translate(lower))


def plain_buckets(text):
    """The definition, number by number: a polynomial in the bytes, mixed; neighbours of a text give the pairs."""
    base, whole = 0x9E3779B97F4A7C15, 2**64

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 % whole
        h = (h ^ h >> 27) * 0x94D049BB133111EB % whole
        return h ^ h >> 31

    each = [mix((sum((c + 1) * pow(base, k, whole) for k, c in enumerate(w)) + len(w)) % whole) for w in plain_pieces(text)]
    return [h % quality.BUCKETS for h in each + [mix((a * 3 + b) % whole) for a, b in zip(each, each[1:])]]


def test_model_and_weights_equal_a_plain_one(spark, corpus):
    docs = documents(spark, [(x.doc_id, x.text, "s") for x in corpus[0].limit(40).collect()] + odd_rows()[:66])
    rows = [(x.text, k % 3 == 0) for k, x in enumerate(docs.collect())]
    flagged = spark.createDataFrame(rows, "text string, is_target boolean")
    raw, target = quality.count_models(flagged)
    want = [np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)]
    for t, good in rows:
        for b in plain_buckets(t):
            want[0][b] += 1
            want[1][b] += good
    assert (raw == want[0]).all() and (target == want[1]).all()
    ratio = quality.log_ratio(target, raw)
    sums = [target.sum() + quality.BUCKETS, raw.sum() + quality.BUCKETS]
    scores = []
    for t, _ in rows:
        logs = [math.log((want[1][b] + 1) / sums[0]) - math.log((want[0][b] + 1) / sums[1]) for b in plain_buckets(t)]
        scores.append(sum(logs) / max(1, len(logs)) * 16 * math.log(1 + len(logs)))
    assert quality.weights_of(pa.array([t for t, _ in rows]), ratio) == pytest.approx(scores)


def test_long_texts_are_read_in_pieces_without_loss():
    r = random.Random(2)
    long = " ".join(r.choice(["alpha", "be-ta!!", "Gamma", "dél."]) for _ in range(120_000))
    texts = ["one two", long, None, "", "x" * 600_000 + " end", long + " " + "y" * 400_000]
    found = {}
    for bucket, doc in quality.features(pa.array(texts)):
        for d in np.unique(doc):
            found[int(d)] = found.get(int(d), 0) + np.bincount(bucket[doc == d], minlength=quality.BUCKETS)
    assert set(found) == {0, 1, 4, 5}
    for k in (0, 1):
        assert (found[k] == np.bincount(plain_buckets(texts[k]), minlength=quality.BUCKETS)).all()
    assert found[4].sum() == 3 and found[5].sum() == found[1].sum() + 2


def test_top_k_is_exact(corpus):
    found, _ = quality.importance_resample(*corpus, k=123)
    rows = found.collect()
    cut = sorted((x.gumbel_key for x in rows), reverse=True)[122]
    assert [x.kept for x in rows] == [x.gumbel_key >= cut for x in rows] and sum(x.kept for x in rows) == 123


def test_kth_largest_with_ties(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 5, 5, 1, 2, 2, 9, -3]] + [(None,)], "v double")
    assert [quality.kth_largest(df, "v", k) for k in range(1, 9)] == [9, 5, 5, 5, 2, 2, 1, -3]
    assert quality.kth_largest(df, "v", 20) == -3
    assert quality.kth_largest(df.limit(0), "v", 1) == float("-inf")


def test_odd_rows(spark):
    docs = documents(spark, odd_rows())
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, 0), (900, 1, 1)], LABELS)
    found, _ = quality.importance_resample(docs, labels)
    rows = found.collect()
    assert len(rows) == docs.count() and all(x.kept for x in rows)  # a class is missing: nothing is rejected
    assert {x.log_weight for x in rows if x.doc_id in (100, 101, 102)} == {0.0}
    for d, n in ((docs, labels.limit(0)), (docs.limit(0), labels)):
        assert quality.importance_resample(d, n)[0].where("kept").count() == d.count()


def test_cut():
    keys, good = np.array([1.0, 2, 3, 4, 5, 6]), np.array([False, False, True, False, True, True])
    assert quality.best_cut(keys, good, clean_cost=10) == 2.5
    assert quality.best_cut(keys, good, clean_cost=0.1) == 4.5
