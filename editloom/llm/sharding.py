"""Shards by a uniform shuffle with exact sizes: a hypergeometric communication matrix and two permutations.

How many rows of each partition go to each shard is drawn first, exactly as a uniform shuffle would have it: partition by
partition from the places that are left, without replacement. Then each partition permutes its rows and deals them out by
its row of the matrix, whole rows are exchanged, and each shard permutes what it got.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from editloom.llm.common import cut, released, table

#: About so many rows of a shard, and bytes of their texts, are permuted in one task.
RUN_ROWS = 50_000
RUN_BYTES = 1 << 24
SEED = 42


def communication_matrix(rows: list[int], shards: int, seed: int = SEED) -> np.ndarray:
    """(partition, shard): how many rows go where; columns differ by one at most, the first of them are the larger."""
    total = sum(rows)
    left = np.array([total // shards + (k < total % shards) for k in range(shards)], dtype=np.int64)
    random = np.random.default_rng([seed, shards])
    out = np.zeros((len(rows), shards), np.int64)
    for p, n in enumerate(rows):
        out[p] = draw(random, left, n)
        left = left - out[p]
    return out


def hypergeometric(good: int, bad: int, n: int) -> tuple[int, np.ndarray]:
    """The least count, and the probabilities of it and the following ones, of good places among ``n`` drawn.

    Probabilities follow from each other outward from the most likely count, by ratios that doubles hold for any size;
    those beyond forty standard deviations are less than any double and left out.
    """
    total = good + bad
    mode = (n + 1) * (good + 1) // (total + 2)
    wide = 50 + int(40 * math.sqrt(n * (good / max(total, 1)) * (bad / max(total, 1)) * ((total - n) / max(total - 1, 1))))
    low, high = max(0, n - bad, mode - wide), min(n, good, mode + wide)
    k = np.arange(low, high, dtype=np.float64)
    up = (good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))  # of k + 1 to that of k
    at = mode - low
    weights = np.concatenate([np.cumprod(1 / up[:at][::-1])[::-1], [1.0], np.cumprod(up[at:])])
    return low, weights / weights.sum()


def draw(random: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """How many of ``n`` rows go to each shard, of whose places ``left`` are free: shard by shard, by inversion."""
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for k, good in enumerate(map(int, left)):
        rest -= good
        low, chances = hypergeometric(good, rest, n)
        out[k] = low + min(int(np.searchsorted(np.cumsum(chances), random.random(), "right")), len(chances) - 1)
        n -= int(out[k])
    return out


def shuffle_into_shards(docs: DataFrame, shards: int = 8, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and row of every row of ``docs`` (doc_id, text), in a uniform random order.

    ``row`` is the whole row, its text and further columns included, whatever their names: whole rows are exchanged, so a
    shard holds its texts, and size and checksum are taken from the texts that arrived.

    Shard sizes differ by one row at most, and slots of a shard run from 0 without gaps. Rows are dealt one by one, so
    equal texts and repeated rows may fall into different shards. The rows are written to the checkpoint folder before
    they are counted, so a partition that is computed again holds the same rows in the same order.

    A null text has no bytes: size 1, text_crc32 0. A null doc_id is allowed; an empty table gives no rows.
    """
    whole = cut(docs.select(F.struct("*").alias("row")))
    bytes_of = F.coalesce(F.sum(F.octet_length(F.col("row.text").cast("string"))), F.lit(0))
    found = whole.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), bytes_of.alias("bytes")).collect()  # two numbers a partition
    counts = {r.p: r.n for r in found}
    parts = sorted(counts)
    matrix = communication_matrix([counts[p] for p in parts], shards, seed)
    of = whole.sparkSession.sparkContext.broadcast({p: matrix[k] for k, p in enumerate(parts)})
    runs = max(1, -(-sum(counts.values()) // (shards * RUN_ROWS)), -(-sum(r.bytes for r in found) // (shards * RUN_BYTES)))

    def places(p: int) -> tuple[np.ndarray, np.ndarray]:
        """Shard and key of each row of a partition, in the order of its rows."""
        random = np.random.default_rng([seed, 1, p])
        shard = random.permutation(np.repeat(np.arange(shards), of.value[p]))
        return shard, random.integers(0, 1 << 62, len(shard))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, at = TaskContext.get().partitionId(), 0
        if p not in of.value:
            return
        shard, key = places(p)
        for x in batches:
            here = slice(at, at + x.num_rows)
            columns = [shard[here].astype(np.int32), key[here] % runs, key[here] // runs, np.arange(here.start, here.stop) + p * (1 << 32)]
            yield pa.RecordBatch.from_arrays([*x.columns, *map(pa.array, columns)], ["row", "shard", "run", "key", "at"])
            at = here.stop

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for p in x.column(0).to_pylist():
                shard, key = places(parts[p])
                n = np.bincount(shard * runs + key % runs, minlength=shards * runs)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array((some // runs).astype(np.int32)), pa.array(some % runs), pa.array(n[some])], ["shard", "run", "n"])

    schema = StructType(whole.schema.fields + [StructField("shard", IntegerType()), *(StructField(c, LongType()) for c in ("run", "key", "at"))])
    dealt = whole.mapInArrow(lambda x: released(deal(x)), schema)
    known = whole.sparkSession.range(len(parts)).mapInArrow(count, "shard int, run long, n long")  # without reading a row
    sizes = cut(known.groupBy("shard", "run").agg(F.sum("n").alias("n")))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "run").orderBy("key", "at")) - 1
    placed = dealt.withColumn("within", within).join(F.broadcast(starts), ["shard", "run"])
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")
    return placed.select(F.col("row.doc_id").cast("long").alias("doc_id"), size, crc, "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), "row")


def op8(spark, sf_dir: str) -> DataFrame:
    placed = shuffle_into_shards(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
