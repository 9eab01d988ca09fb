import hashlib
import os
import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import odd_rows
from tests.llm.test_copies import jaccard, shingles

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def held_against_plain_rules(spark, path, labels):
    """Every stage on its own input, against rules written out anew."""
    import corpus_pipeline
    from editloom.llm import bpe

    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], path).write.parquet(f"{path}-stage{k}")
        steps.append(spark.read.parquet(f"{path}-stage{k}"))
    given, kept, once, mixed, last = ([tuple(x) for x in s.select("doc_id", "text", "source").collect()] if "text" in s.columns else s.collect() for s in steps)
    assert docs.columns == steps[1].columns == steps[2].columns == steps[3].columns
    # 1: only rows of the input, none lost that is labelled clean; of junk next to none stays
    assert not Counter(kept) - Counter(given)
    ids = {i for i, _, _ in kept}
    assert {i for i, q in labels.items() if q == 1 and i in {g[0] for g in given}} <= ids
    assert len({i for i, q in labels.items() if q == 0} & ids) <= max(2, 0.1 * sum(q == 0 for q in labels.values()))
    # 2: by brute force over all pairs: of those alike one stays, and what goes is like something that came before
    sets = [shingles(t) for _, t, _ in kept]
    order = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, hashlib.md5((kept[k][1] or "").encode()).hexdigest() if kept[k][1] is not None else ""))
    root = list(range(len(kept)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    place = {k: n for n, k in enumerate(order)}
    loose = defaultdict(set)
    for x, a in enumerate(order):
        for b in order[:x]:
            if min(len(sets[a]), len(sets[b])) >= 0.5 * max(len(sets[a]), len(sets[b])) and (j := jaccard(sets[a], sets[b])) >= 0.5:
                loose[a].add(b)
                if j >= 0.85 or kept[a][1] == kept[b][1]:
                    a_, b_ = find(a), find(b)
                    root[max(a_, b_, key=place.get)] = min(a_, b_, key=place.get)
    left = Counter(once)
    assert not left - Counter(kept) and len(set(once)) == len(once)
    for k in range(len(kept)):
        if find(k) != k:
            assert kept[k] not in left or kept[k] == kept[find(k)] or loose[k] == set()
        elif not loose[k]:
            assert kept[k] in left
    # 3: no document more than three times, blocks of it in order, and sources near their shares
    texts = {(i, s): t for i, t, s in once}
    taken = defaultdict(int)
    for i, t, s in mixed:
        whole, at = words(texts[i, s]), 0
        taken[i, s] += len(words(t))
        for w in words(t):
            at = whole.index(w, at) + 1
    assert all(n <= 3 * len(words(texts[key])) for key, n in taken.items())
    # 4: as the library encodes and decodes
    library = Tokenizer.from_file(bpe.default_tokenizer())
    want = Counter()
    for i, t, _ in mixed:
        e = library.encode(t or "", add_special_tokens=False).ids
        want[i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert Counter((x.doc_id, x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in last) == want
    assert all(x.n_tokens == len(x.ids) for x in last)
    return steps


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    steps = held_against_plain_rules(spark, str(tmp_path), labels)
    import corpus_pipeline

    assert corpus_pipeline.run(spark, str(tmp_path)).count() == steps[-1].count()


def test_odd_rows(spark, tmp_path):
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in odd_rows()]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    steps = held_against_plain_rules(spark, str(tmp_path), {1: 1})
    assert steps[1].count() == len(rows)  # a class is missing
    assert steps[2].where("text is null or trim(text) = ''").count() == 1 and steps[3].where("text is null").count() == 0


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
