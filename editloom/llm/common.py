"""What the operators of this package share: reliable checkpoints, words of a text as bytes, blocks of a group."""

from __future__ import annotations

import ctypes
import functools
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The separators of words: space and the bytes 0x09 to 0x0D.
WORD = r"[^\x20\x09-\x0D]+"
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of text that one vectorised step takes at once; longer texts are taken in pieces of whole words.
STEP_BYTES = 1 << 18


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from it: lineage ends there and survives lost executors.

    The folder is the one that the session names in ``spark.checkpoint.dir``. Only a session in one process may do
    without one (as in tests) and gets a folder of this machine.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoint"))
    return df.checkpoint(eager=True)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; when they are through, memory that the worker's allocators hold unused goes back to the system.

    A worker waits for its next task beside tasks of the JVM that need the executor's memory.
    """
    yield from batches
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not with every C library
        pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(texts: pa.Array, overlap: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of texts of about STEP_BYTES: the rows they belong to, their UTF-8 bytes, their offsets.

    A text that is longer than that comes in several runs of its own, cut between words; of these each begins with the
    last ``overlap`` words of the one before, and has more than ``overlap`` words if the text does. A null text has no
    bytes.
    """
    if pa.types.is_large_string(texts.type) or texts.null_count:
        texts = texts.fill_null("")
    texts = pa.concat_arrays([texts]) if texts.offset else texts
    large = pa.types.is_large_string(texts.type)
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if large else np.int32, count=n + 1 + texts.offset)[texts.offset :].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + STEP_BYTES, "right")) - 1)
        if offsets[b] - offsets[a] > STEP_BYTES:
            for piece in _pieces(data[offsets[a] : offsets[b]], overlap):
                yield np.array([a]), piece, np.array([0, len(piece)])
        else:
            yield np.arange(a, b), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _pieces(data: np.ndarray, overlap: int) -> Iterator[np.ndarray]:
    """A long text in pieces of about STEP_BYTES that end with a word and begin ``overlap`` words before the last end."""
    begin, end = 0, 0
    while end < len(data):
        end = max(end, begin + STEP_BYTES)
        while True:  # to the end of a word, and on until a word is new
            rest = np.flatnonzero(_SEPARATOR[data[end : end + STEP_BYTES]])
            while not len(rest) and end < len(data):  # within a very long word
                end = min(len(data), end + STEP_BYTES)
                rest = np.flatnonzero(_SEPARATOR[data[end : end + STEP_BYTES]])
            end = min(len(data), end + int(rest[0])) if len(rest) else len(data)
            if end == len(data):
                break
            word = ~_SEPARATOR[data[begin:end]]
            starts = np.flatnonzero(word[1:] & ~word[:-1]) + 1
            starts = np.concatenate([[0], starts]) if word[0] else starts
            if len(starts) > overlap:
                break
            end += 1
        yield data[begin:end]
        if end < len(data):
            begin = begin + int(starts[-overlap]) if overlap else end


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, byte by byte."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each word of the texts that lie between ``offsets`` in ``data``."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    word = ~_SEPARATOR[data]
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    edge = offsets[:-1][offsets[:-1] < len(data)]
    opens[edge] = word[edge]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = word[last]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... n modulo 2 ** 64."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) <= n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % 2**64
    return out


_BASE = 0x9E3779B97F4A7C15


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for a step; longer ones are made where a word needs them."""
    return _powers(_BASE, STEP_BYTES), _powers(pow(_BASE, -1, 2**64), STEP_BYTES)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial in its bytes, by differences of prefix sums, then mixed."""
    n = len(data)
    up, down = _tables() if n <= STEP_BYTES else (_powers(_BASE, n), _powers(pow(_BASE, -1, 2**64), n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return mixed((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


_KIND = np.full(256, 2, dtype=np.uint8)
_KIND[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = 1
_KIND[_SEPARATOR] = 0


def piece_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each run of letters and digits, and of each run of ASCII punctuation."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kind = _KIND[data]
    opens, closes = kind > 0, kind > 0
    same = kind[1:] == kind[:-1]
    opens[1:] &= ~same
    closes[:-1] &= ~same
    edge = offsets[:-1][offsets[:-1] < len(data)]
    opens[edge] = kind[edge] > 0
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = kind[last] > 0
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
