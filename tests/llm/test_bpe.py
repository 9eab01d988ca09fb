import hashlib
import random

import pytest

from editloom.llm import bpe
from tests.llm.fixtures import documents, odd_rows

tokenizers = pytest.importorskip("tokenizers")
PATH = bpe.default_tokenizer()


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def model():
    with open(PATH, encoding="utf-8") as f:
        return bpe.WordBpe(f.read())


def test_random_texts(library, model):
    r = random.Random(6)
    parts = ["a", "th", "the", "in", " ", "'s", "'", "İ", "Σ", "ß", "日本", "e\u0301", "\u00a0", "\x1c", "1", "²", "½", "_", "<|endoftext|>", "<|startoftext|>", "<", "🙂", "ΟΔΟΣ ", "\t", "\n", "K", "ﬁ", "!!", "%", "٣", "ǅ", "한", "\x00", "\u2028", "ſ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    texts += ["".join(r.choice("aehnt") for _ in range(r.randint(1, 60))) for _ in range(2000)] + ["a" * k for k in range(80)] + ["the" * 2000]
    ids = model.encode_all(texts)
    assert ids == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [model.decode(i) for i in ids] == [library.decode(i, skip_special_tokens=False) for i in ids]


def test_forgetting_changes_nothing(model, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    texts = ["one two three four", "five six <|endoftext|> one", "", "two seven"]
    first = model.encode_all(texts)
    assert [model.encode_all([t])[0] for t in texts] == first


def test_table(spark, library):
    rows = odd_rows()
    got = bpe.digests(bpe.bpe_encode(documents(spark, rows), PATH)).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert bpe.bpe_encode(documents(spark, rows).limit(0), PATH).count() == 0


def test_small_vocabulary_against_the_library():
    merges = [("a", "b"), ("b", "a</w>"), ("ab", "ab"), ("a", "a"), ("aa", "a</w>"), ("b", "b")]
    vocab = {t: k for k, t in enumerate(["a", "b", "a</w>", "b</w>", *(x + y for x, y in merges)])}
    trie = bpe.TrieEncoder(vocab, merges, "</w>")
    library = tokenizers.Tokenizer(tokenizers.models.BPE(vocab=vocab, merges=merges, end_of_word_suffix="</w>"))
    r = random.Random(1)
    words = {"".join(r.choice("aaabbbz") for _ in range(r.randint(1, 12))) for _ in range(1500)}  # z is unknown
    got = trie.encode(words)
    for w in words:
        assert list(got[w]) == library.encode(w, add_special_tokens=False).ids, w
