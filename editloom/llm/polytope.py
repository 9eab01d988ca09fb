"""Near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations, with several probes per table.

A hash rotates a vector by three rounds of random signs and a Walsh-Hadamard transform, and takes the largest coordinate
with its sign. A table joins a few hashes; a vector lies in the buckets of its best few combinations. How many tables
are needed for pairs just at the threshold is measured by simulation. Vectors that share a bucket are compared in double
precision; a pair counts in its first common bucket only, so no table of pairs is ever made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.llm.common import cut, table
from editloom.llm.graph import connected_components
from editloom.llm.vectors import common_length, matrix, sorted_groups, takes_part, unit

#: Vectors that a task compares with each other at once; larger buckets are split into pairs of such blocks.
BLOCK = 1024
#: Buckets of a table that a vector is put into.
PROBES = 2
#: The share of pairs just at the threshold that may be missed.
MISS = 1e-4
SEED = 42


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, whose length is a power of two; lengths stay."""
    n, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(n, d)
        h *= 2
    return x / math.sqrt(d)


def signs(length: int, tables: int, hashes: int, seed: int = SEED) -> np.ndarray:
    """Random signs: three rounds for every hash, of the next power of two above ``length``."""
    width = max(2, 1 << (length - 1).bit_length())
    return np.random.default_rng([seed, length]).choice([-1.0, 1.0], size=(tables, hashes, 3, width))


def buckets(unit_rows: np.ndarray, flips: np.ndarray, probes: int = PROBES) -> np.ndarray:
    """(row, table, probe): the buckets of each row, best first; numbers of different tables differ."""
    n = len(unit_rows)
    tables, hashes, _, width = flips.shape
    padded = np.zeros((n, width))
    padded[:, : unit_rows.shape[1]] = unit_rows
    out = np.empty((n, tables, probes), np.int64)
    base = 2 * width
    for t in range(tables):
        codes, losses = [], []
        for k in range(hashes):
            y = padded
            for r in range(3):
                y = hadamard(y * flips[t, k, r])
            most = np.argpartition(-np.abs(y), 1, axis=1)[:, :2]
            size = np.take_along_axis(np.abs(y), most, axis=1)
            swap = size[:, 0] < size[:, 1]
            most[swap], size[swap] = most[swap][:, ::-1], size[swap][:, ::-1]
            code = 2 * most + (np.take_along_axis(y, most, axis=1) > 0)
            codes.append(code)
            losses.append(size[:, 0] - size[:, 1])
        home = np.zeros(n, np.int64)
        for code in codes:
            home = home * base + code[:, 0]
        each = [home]
        for k in range(hashes):  # the second coordinate in one hash, the first in the others
            each.append(home + (codes[k][:, 1] - codes[k][:, 0]) * base ** (hashes - 1 - k))
        loss = np.stack([np.full(n, -1.0), *losses], axis=1)
        best = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        took = np.take_along_axis(np.stack(each, axis=1), best, axis=1)
        if took.shape[1] < probes:
            took = np.pad(took, ((0, 0), (0, probes - took.shape[1])), mode="edge")
        out[:, t] = took * tables + t
    return out


def tables_needed(length: int, hashes: int, threshold: float, probes: int = PROBES, miss: float = MISS, pairs: int = 2000) -> int:
    """Tables after which a pair with a cosine just at the threshold is missed with probability ``miss``, by simulation."""
    if length < 2:
        return 1
    random = np.random.default_rng(length)
    a = unit(random.standard_normal((pairs, length)))
    b = random.standard_normal((pairs, length))
    b = unit(b - (a * b).sum(axis=1, keepdims=True) * a)
    b = threshold * a + math.sqrt(1 - threshold**2) * b
    flips = signs(length, 8, hashes, seed=1)
    x, y = buckets(a, flips, probes), buckets(b, flips, probes)
    hit = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(2, 3)).mean()
    return max(1, math.ceil(math.log(miss) / math.log(max(1 - hit, 1e-9))))


def _first_common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first common bucket of each pair of rows (pair, table, probe): of the first such table, the least."""
    none = np.iinfo(np.int64).max
    same = np.where((x[:, :, :, None] == y[:, :, None, :]).any(axis=3), x, none).min(axis=2)
    return same[np.arange(len(same)), np.argmax(same != none, axis=1)]


def _links(group: pa.Table, length: int, tables: int, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Of one bucket, or two blocks of one: the linked vectors, their links that count here, and a root of each."""
    bucket, i, j = (group.column(k)[0].as_py() for k in range(3))
    block, ids, copies = (group.column(k).to_numpy() for k in (3, 4, 5))
    if len(ids) < 2:
        return None
    codes = group.column(6).combine_chunks().flatten().to_numpy().reshape(len(ids), tables, -1)
    u = unit(matrix(group.column(7), length))
    near = np.triu(u @ u.T >= threshold, 1)
    if i != j:
        near &= block[:, None] != block[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return None
    count = np.zeros(len(ids), np.int64)
    for p in range(0, len(a), 50_000):
        x, y = a[p : p + 50_000], b[p : p + 50_000]
        here = _first_common(codes[x], codes[y]) == bucket
        np.add.at(count, x[here], copies[y[here]])
        np.add.at(count, y[here], copies[x[here]])
    root = ids.copy()
    while True:  # least identifier within reach
        least = root.copy()
        np.minimum.at(least, a, root[b])
        np.minimum.at(least, b, root[a])
        if (least == root).all():
            break
        root = least
    linked = np.union1d(a, b)
    return ids[linked], count[linked], root[linked]


def near_vectors(vectors: DataFrame, threshold: float = 0.95, probes: int = PROBES, block: int = BLOCK, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding): vec_id, n_links, component_id, kept.

    Links join vectors whose cosine, in double precision, is ``threshold`` or more; n_links counts the other vectors
    linked with this one, component_id is the least vec_id in reach and kept tells whether that is its own.

    Equal vectors are one node with a number of copies, so they cost no pairs. A vector that is null, zero, of another
    length than most or with components that are null or not finite has no links and is its own component; so is every
    row with a null vec_id (its component is null, and it is not kept). Rows that repeat a vec_id are one node of the
    graph. An empty table gives no rows; further columns are ignored.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    length = common_length(rows.where(takes_part(F.col("embedding"))), "embedding")
    part = F.col("vec_id").isNotNull() & takes_part(F.col("embedding")) & (F.size("embedding") == length)
    valid = rows.where(part)
    classes = cut(valid.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    members = cut(valid.join(classes, "embedding").select("vec_id", "node", "copies"))
    n = classes.count()
    hashes = max(1, math.ceil(math.log(max(n / 64, 1)) / math.log(2 * max(2, 1 << max(length - 1, 0).bit_length()))))
    tables = tables_needed(length, hashes, threshold, probes, miss)
    flips = signs(max(length, 1), tables, hashes, seed)

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a in range(0, x.num_rows, 2048):
                y = x.slice(a, 2048)
                codes = buckets(unit(matrix(y.column(2), length)), flips, probes).reshape(y.num_rows, -1)
                lists = pa.ListArray.from_arrays(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([y.column(0), y.column(1), lists, y.column(2)], ["node", "copies", "codes", "vector"])

    kind = rows.schema["embedding"].dataType.simpleString()
    hashed = classes.select("node", "copies", "embedding").mapInArrow(hash_all, f"node long, copies long, codes array<long>, vector {kind}")
    placed = hashed.withColumn("bucket", F.explode(F.array_distinct("codes")))
    large = hashed.select(F.explode(F.array_distinct("codes")).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = large.select("bucket", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    own = F.when(F.col("blocks") > 1, F.pmod(F.xxhash64("node"), F.col("blocks"))).otherwise(0).cast("int")
    placed = placed.join(large, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", own)
    paired = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keyed = paired.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "copies", "codes", "vector")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in sorted_groups(batches, 3):
            if (found := _links(group, length, tables, threshold)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "links", "root"])

    found = cut(keyed.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(compare, "node long, links long, root long"))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = members.join(links, "node", "left").join(roots, "node", "left")
    done = named.select("vec_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    rest = rows.where(~part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return done.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op10(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
