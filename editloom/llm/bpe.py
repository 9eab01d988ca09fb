"""BPE encoding by a trie of distinct words, and decoding.

Encoding rests on two facts about byte pair merges in rank order. Without its last token, the encoding of a string is
the encoding of a shorter prefix. A token may follow another exactly if the two, merged from their symbols, give
themselves again. So the last token of every prefix fixes all encodings: it is the one token that ends the prefix and
may follow the last token of what it leaves.

Distinct words form a trie; a depth-first walk carries the last tokens of the current path, so that the states of a
shared prefix are computed once. The walk visits the words in sorted order and keeps only the path, which is the trie
in depth-first order without its nodes in memory.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.llm.common import released, table

#: Characters of text whose words are encoded together; a longer text is taken alone.
RUN_CHARS = 1 << 20
#: Words whose encodings a worker remembers; beyond, it forgets them all and computes them again when they return.
REMEMBERED = 300_000
#: Pairs of tokens of which a worker remembers whether they may stand together.
PAIRS = 500_000
#: Characters that NFC leaves alone and on which both engines of regular expressions agree: ASCII without controls,
#: Latin-1 and Latin Extended-A without spaces, superscripts, fractions and the dotted capital I.
_PLAIN = re.compile("[\t-\r -~\xa1-\xac\xae-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ſ]*")


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {b: chr(b) for b in kept} | {b: chr(256 + k) for k, b in enumerate(rest)}


class TrieEncoder:
    """Encodes sets of words under one vocabulary; words are strings of the byte alphabet."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], suffix: str):
        self.ranks = {tuple(m): k for k, m in enumerate(merges)}
        self.suffix = suffix
        self.names = {i: t for t, i in vocab.items()}
        self.inner = {t: i for t, i in vocab.items() if not (suffix and t.endswith(suffix))}
        self.final = {t[: len(t) - len(suffix)]: i for t, i in vocab.items() if t.endswith(suffix)}
        self.ids = vocab
        self.sizes = {-1: 0, -2: 1} | {i: len(t) for t, i in self.inner.items()}
        self.longest = max((len(t) for t in (*self.inner, *self.final)), default=1)
        self.follows: dict[int, bool] = {}

    def symbols(self, token: str) -> list[str]:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            word = token[: -len(self.suffix)]
            return [*word[:-1], word[-1] + self.suffix]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, lowest rank and then leftmost first. For two tokens at most, so short."""
        while len(symbols) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 60), k) for k, pair in enumerate(zip(symbols, symbols[1:])))
            if rank == 1 << 60:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def may_follow(self, last: int, token: int) -> bool:
        """Whether merging leaves ``last`` and ``token`` side by side; last is -1 at the beginning of a word."""
        key = (last + 1) << 32 | token
        if (known := self.follows.get(key)) is None:
            if last == -2:
                return False
            if len(self.follows) >= PAIRS:
                self.follows.clear()
            both = ([self.names[last]] if last >= 0 else []) + [self.names[token]]
            known = self.follows[key] = self.merged([s for t in both for s in self.symbols(t)]) == both
        return known

    def _last_token(self, tokens: dict[str, int], word: str, end: int, last: list[int]) -> int:
        """The one token that ends the prefix; the last token before, longer by a symbol, is tried first."""
        follows, get = self.follows, tokens.get
        likely = end - 1 - self.sizes[last[end - 1]] if end > 1 else 0
        for begin in chain((likely,), range(end - 1, likely, -1), range(likely - 1, max(-1, end - self.longest - 1), -1)):
            token = get(word[begin:end])
            if token is not None:
                known = follows.get((last[begin] + 1) << 32 | token)
                if known or known is None and self.may_follow(last[begin], token):
                    return token
        return -2  # a symbol that is not in the vocabulary

    def encode(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The tokens of each word."""
        out: dict[str, tuple[int, ...]] = {}
        last, known, path = [-1], 0, ""
        sizes = self.sizes
        for word in sorted(set(words)):
            if not word:
                out[word] = ()
                continue
            top = min(known, len(word) - 1, len(path))
            if word[:top] != path[:top]:
                low = 0
                while top - low > 1:  # the shared prefix, by bisection
                    mid = (low + top) // 2
                    low, top = (mid, top) if word[:mid] == path[:mid] else (low, mid)
                top = low
            del last[top + 1 :]
            for end in range(top + 1, len(word)):
                last.append(self._last_token(self.inner, word, end, last))
            known, path = len(word) - 1, word
            token = self._last_token(self.final, word, len(word), last)
            if token == -2 or -2 in last:
                out[word] = self._merged_known(word)
                continue
            ids, end = [token], len(word) - (len(self.names[token]) - len(self.suffix))
            while end:
                ids.append(last[end])
                end -= sizes[last[end]]
            out[word] = tuple(reversed(ids))
        return out

    def _merged_known(self, word: str) -> tuple[int, ...]:
        """Words with symbols outside the vocabulary: those symbols are left out, as the library does without an unknown token."""
        symbols = [s for s in self.symbols(word + self.suffix) if s in self.ids]
        return tuple(self.ids[t] for t in self.merged(symbols))


class WordBpe:
    """Whole texts to token ids and back, for a tokenizer file with the parts that ``check`` names."""

    def __init__(self, source: str):
        from tokenizers import Tokenizer

        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError("a BPE without unknown token, byte fallback, whole-word lookup and decoder is expected")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.trie = TrieEncoder(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        self.library = Tokenizer.from_str(source)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = re.compile(split.replace(r"[\p{L}]", r"[^\W\d_]").replace(r"[\p{N}]", r"\d").replace(r"[^\s\p{L}\p{N}]", r"(?:[^\s\w]|_)"))
        self.names = self.trie.names | {i: t for t, i in self.special.items()}
        self.alphabet = {b: c for b, c in byte_alphabet().items() if chr(b) != c}
        #: By word; a special token stands for itself, and words that the library split begin with a null character.
        self.known: dict[str, tuple[int, ...]] = {t: (i,) for t, i in self.special.items()}

    def split(self, text: str) -> list[str]:
        """The words of a text, in the byte alphabet where they begin with a null character."""
        if _PLAIN.fullmatch(text):
            return self.words.findall(text.lower())
        normal = self.library.normalizer.normalize_str(text)
        return ["\0" + w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def mapped(self, word: str) -> str:
        if word[0] == "\0":
            return word[1:]
        return word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not yet known, all in one walk of their trie."""
        of = {w: self.mapped(w) for w in words}
        ids = self.trie.encode(of.values())
        self.known.update((w, ids[m]) for w, m in of.items())

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        flat: list[str] = []
        ends = []
        for text in texts:
            for piece in self.at_special.split(text) if self.at_special and "<" in text else (text,):
                if piece in self.special:
                    flat.append(piece)
                elif piece:
                    flat += self.split(piece)
            ends.append(len(flat))
        get = self.known.get
        ids = list(map(get, flat))
        if None in ids:
            new = {w for w, known in zip(flat, ids, strict=True) if known is None}
            if len(self.known) + len(new) > REMEMBERED:
                self.known, new = {t: (i,) for t, i in self.special.items()}, set(flat) - self.special.keys()
                get = self.known.get
            self.learn(new)
            ids = list(map(get, flat))
        each = iter(ids)
        return [list(chain.from_iterable(islice(each, b - a))) for a, b in zip([0, *ends], ends)]

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.names.__getitem__, ids))


_MODELS: dict[str, WordBpe] = {}


def _model(source: str) -> WordBpe:
    """One model a worker, kept between tasks."""
    if source not in _MODELS:
        _MODELS.clear()
        _MODELS[source] = WordBpe(source)
    return _MODELS[source]


def _runs(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """Runs of rows with about RUN_CHARS characters."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    a, n = 0, 0
    for k, size in enumerate(sizes):
        n += size
        if n >= RUN_CHARS or k == len(sizes) - 1:
            yield a, k + 1, [t or "" for t in texts.slice(a, k + 1 - a).to_pylist()]
            a, n = k + 1, 0


def bpe_encode(docs: DataFrame, tokenizer: str, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) of every row of ``docs``, its token ids and the text decoded from them.

    ``tokenizer`` is the path of a tokenizer file as the driver sees it; its content (a few MB) is sent to the workers.

    A null text counts as empty and has no ids; very long texts and words are taken whole; repeated rows and null
    doc_ids are encoded like any other; an empty table gives no rows; further columns are left out, whatever their names.
    """
    keep = keep or ["doc_id"]
    with open(tokenizer, encoding="utf-8") as f:
        source = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(source.value)
        for x in batches:
            for a, b, texts in _runs(x.column(len(keep))):
                ids = model.encode_all(texts)
                columns = [x.column(k).slice(a, b - a) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(ids, pa.list_(pa.int32())), pa.array(map(model.decode, ids), pa.string())], [*keep, "ids", "decoded"])

    rows = docs.select(*keep, F.col("text").cast("string").alias("text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(lambda x: released(run(x)), f"{fields}, ids array<int>, decoded string")


def digests(encoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in the place of decoded, and of ids unless they are to stay."""
    kept = [c for c in encoded.columns if c != "decoded" and (keep_ids or c != "ids")]
    return encoded.select(*kept, F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7(spark, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return digests(bpe_encode(table(spark, sf_dir, "documents"), tokenizer or default_tokenizer()))
