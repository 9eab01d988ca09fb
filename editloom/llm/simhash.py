"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

The 64 bits of a fingerprint form a ring of eight segments of eight bits. If two fingerprints differ in at most three
bits, some run of consecutive segments begins such that the differences in its first l segments are at most 3 l / 8, for
every l: none in the first two, at most one in the first five, two in the first seven. The join key of a beginning is
therefore the sixteen bits of two segments, with one half of the next three segments, of which one at least is equal:
28 bits, sixteen keys a fingerprint. In a bucket, the chain of budgets is checked before the whole distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.llm.common import cut, lowered, released, steps, word_spans
from editloom.llm.graph import connected_components

BITS, SEGMENTS, WIDTH = 64, 8, 3
#: The most fingerprints that are compared with each other in one group; larger groups get longer keys.
GROUP = 1024


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _segments(start: int, count: int) -> int:
    return sum(0xFF << (8 * ((start + k) % SEGMENTS)) for k in range(count))


def _split(mask: int, parts: int) -> list[int]:
    """The bits of the mask in so many runs of nearly equal length."""
    bits = [k for k in range(BITS) if mask >> k & 1]
    return [sum(1 << k for k in run) for run in (bits[len(bits) * i // parts : len(bits) * (i + 1) // parts] for i in range(parts)) if run]


def ring_keys(limit: int = 3) -> list[tuple[int, int]]:
    """(beginning, mask of the bits that must be equal) for each key of a fingerprint."""
    budget = [limit * n // SEGMENTS for n in range(SEGMENTS + 1)]
    exact = max(n for n in range(SEGMENTS + 1) if budget[n] == 0)
    near = max(n for n in range(SEGMENTS + 1) if budget[n] <= 1)
    keys = []
    for start in range(SEGMENTS):
        fixed = _segments(start, exact)
        rest = _segments(start, near) & ~fixed
        keys += [(start, fixed | half) for half in (_split(rest, 2) if rest else [0])]
    return keys


def fingerprints_of(texts: pa.Array) -> np.ndarray:
    """The fingerprint of each text, as uint64."""
    digest = xxhash.xxh64_intdigest
    votes, shingles = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    for rows, data, offsets in steps(texts, WIDTH - 1):
        start, end, doc = word_spans(data, offsets)
        if not len(start):
            continue
        # the words of the run, each with a space behind it
        size = end - start
        at = np.cumsum(size + 1) - size - 1
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        joined[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = lowered(data)[np.arange(int(size.sum())) + np.repeat(start - (np.cumsum(size) - size), size)]
        words = np.bincount(doc, minlength=len(rows))
        first = np.cumsum(words) - words
        here = np.flatnonzero(words)
        made = np.maximum(words - (WIDTH - 1), 1)[here]
        total = int(made.sum())
        lead = np.arange(total) + np.repeat(first[here] - (np.cumsum(made) - made), made)
        tail = np.minimum(lead + WIDTH - 1, np.repeat(first[here] + words[here] - 1, made))
        raw, lo, hi = joined.tobytes(), at[lead].tolist(), (at[tail] + size[tail]).tolist()
        h = np.fromiter((digest(raw[i:j], 42) for i, j in zip(lo, hi, strict=True)), np.uint64, total)
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes[rows[here]] += np.add.reduceat(bits, np.cumsum(made) - made, axis=0, dtype=np.int32)
        shingles[rows[here]] += made
    return np.packbits(2 * votes > shingles[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of ``docs``: words in lower case (A-Z), shingles of three words, XXH64 with seed 42."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0).cast(pa.int64()), pa.array(fingerprints_of(x.column(1)).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda x: released(run(x)), "doc_id long, fp long")


def _local_roots(near: np.ndarray) -> np.ndarray:
    """The least index that each row reaches in a small boolean matrix of links."""
    n = len(near)
    root = np.arange(n)
    while True:
        least = np.where(near, root[None, :], n).min(axis=1)
        least = np.minimum(least, root)
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _group_edges(fps: np.ndarray, start: int, limit: int) -> np.ndarray:
    """Links that span the near groups among the fingerprints of one bucket, as rows (a, b)."""
    fps = np.sort(fps.view(np.uint64))
    apart = fps[:, None] ^ fps[None, :]
    ok = np.ones(apart.shape, bool)
    for n in range(1, SEGMENTS) if start >= 0 else ():
        ok &= np.bitwise_count(apart & np.uint64(_segments(start, n))) <= limit * n // SEGMENTS
    ok &= np.bitwise_count(apart) <= limit
    root = _local_roots(ok)
    here = np.flatnonzero(root != np.arange(len(fps)))
    return np.stack([fps[here], fps[root[here]]], axis=1).view(np.int64)


def _edges(groups: DataFrame, limit: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            start, lists = x.column(0).to_numpy(), x.column(1)
            values, ends = lists.flatten().to_numpy(), np.cumsum(pc.list_value_length(lists).to_numpy())
            begin = 0
            found = []
            for s, e in zip(start, ends, strict=True):
                found.append(_group_edges(values[begin:e], int(s), limit))
                begin = e
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return groups.select("start", "fps").mapInArrow(run, "a long, b long")


def near_edges(fps: DataFrame, limit: int = 3, group: int = GROUP) -> DataFrame:
    """Links (a, b) that span every group of the distinct fingerprints ``fps`` (fp) within ``limit`` bits.

    Buckets of more than ``group`` fingerprints are dealt out anew under longer keys: of the bits that their key leaves
    open, ``limit`` differences leave one of limit + 1 runs equal. Keys grow until so few bits are open that no larger
    bucket can exist, so nothing is cut off and no task holds more than ``group`` fingerprints of a bucket.
    """
    if not 0 <= limit < SEGMENTS:
        raise ValueError("limit must be from 0 to 7")
    spark = fps.sparkSession
    keys = F.array(*(F.struct(F.lit(s).alias("start"), F.lit(_signed(m)).cast("long").alias("mask")) for s, m in ring_keys(limit)))
    keyed = fps.select("fp", F.explode(keys).alias("k")).select("fp", "k.start", "k.mask", F.col("fp").bitwiseAND(F.col("k.mask")).alias("bits"))
    masks = {m for _, m in ring_keys(limit)}
    by = ["start", "mask", "bits"]
    found = None
    while True:
        sizes = keyed.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")
        last = all(2 ** (BITS - m.bit_count()) <= group for m in masks)
        small = sizes if last else sizes.where(F.col("n") <= group)
        lists = keyed.join(small.select(*by), by).groupBy(*by).agg(F.collect_list("fp").alias("fps"))
        edges = _edges(lists, limit)
        found = edges if found is None else found.unionByName(edges)
        if last:
            return found
        over = cut(keyed.join(sizes.where(F.col("n") > group).select(*by), by, "left_semi"))
        if over.isEmpty():
            return found
        finer = [(_signed(m), _signed(m | part)) for m in masks for part in _split(~m & (2**64 - 1), limit + 1)]
        masks = {m & (2**64 - 1) for _, m in finer}
        pairs = spark.createDataFrame(finer, "mask long, finer long")  # at most 16 * (limit + 1) ** 5 rows
        keyed = over.join(F.broadcast(pairs), "mask").select("fp", F.lit(-1).alias("start"), F.col("finer").alias("mask"), F.col("fp").bitwiseAND(F.col("finer")).alias("bits")).distinct()


def simhash_components(docs: DataFrame, limit: int = 3, group: int = GROUP) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text).

    Documents are linked when their fingerprints differ in at most ``limit`` bits; component_id is the least doc_id that
    a document reaches by links, its own included. Equal fingerprints are one node of the graph, so thousands of copies
    cost no pairs.

    A null or empty text has fingerprint zero and is linked like any other; very long texts are taken whole; repeated
    rows each give a row; a null doc_id gets its component, but is never its name (null if nothing else is in it); an
    empty table gives no rows; further columns of ``docs`` are ignored, whatever their names.
    """
    fps = cut(fingerprints(docs))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = connected_components(near_edges(nodes.select("fp"), limit, group))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.select("fp", "root").join(names, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", "fp", "component_id")


def op5(spark, sf_dir: str) -> DataFrame:
    found = simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
