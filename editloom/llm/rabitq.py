"""Nearest vectors by largest inner product, over randomly rotated one-bit codes.

A vector's residual to the centroid of its list, rotated at random, is kept as the signs of its components, with its
length and its inner product with the code. From these follow an unbiased estimate of its inner product with any query
and a bound of the error. A search estimates all vectors of the lists that it probes, and computes the exact product of
those whose bound reaches the query's threshold: the k-th best product found so far, first of the list it probes first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from editloom.llm.common import cut, table
from editloom.llm.vectors import common_length, matrix, sorted_groups, takes_part

#: The most vectors that centroids and the number of probes are fitted on (those with the least hashes).
SAMPLE = 16_384
#: Rows of the sample that a list needs at least.
PER_LIST = 16
#: The recall that the number of probes must reach on the sample.
RECALL = 0.99
#: Standard deviations that the error bound spans.
SPAN = 3.0
#: What an estimate may lose by rounding, as a share of the lengths multiplied.
ROUNDING = 1e-12
#: Vectors and queries of one list that a task takes at once.
BLOCK, QUERIES = 4096, 512
SEED = 42


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Centroids by Lloyd's rounds from a random choice of the sample."""
    random = np.random.default_rng(seed)
    c = sample[random.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, c)
        n = np.bincount(near, minlength=lists)
        sums = np.zeros_like(c)
        np.add.at(sums, near, sample)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest(rows: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(rows @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


def probes_needed(sample: np.ndarray, c: np.ndarray, k: int, recall: float = RECALL, queries: int = 512) -> int:
    """Lists to probe so that ``recall`` of the sample's own k best are found, for queries drawn from it."""
    q = sample[:queries]
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(c)
    product = q @ sample.T
    product[np.arange(len(q)), np.arange(len(q))] = -np.inf
    best = np.argpartition(-product, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(q @ c.T), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, nearest(sample, c)[best], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


class Index:
    """Centroids and a rotation; ``encode`` gives codes, ``estimate`` products with their error bounds."""

    def __init__(self, c: np.ndarray, seed: int = SEED):
        self.c = c
        d = c.shape[1]
        q, r = np.linalg.qr(np.random.default_rng([seed, d]).standard_normal((d, d)))
        self.turn = q * np.sign(np.diag(r))

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, packed signs, length of the residual, and the inner product of its direction with its code."""
        at = nearest(rows, self.c)
        left = rows - self.c[at]
        size = np.sqrt((left * left).sum(axis=1))
        turned = (left / np.where(size > 0, size, 1)[:, None]) @ self.turn.T
        fit = np.abs(turned).sum(axis=1) / math.sqrt(rows.shape[1])
        return at, np.packbits(turned > 0, axis=1), size, np.where(size > 0, fit, 1.0)

    def estimate(self, queries: np.ndarray, at: int, bits: np.ndarray, size: np.ndarray, fit: np.ndarray, span: float = SPAN) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector): estimates, and what the truth differs by at most, but for rare cases."""
        d = queries.shape[1]
        code = (np.unpackbits(bits, axis=1, count=d).astype(np.float64) * 2 - 1) / math.sqrt(d)
        product = (queries @ self.turn.T) @ code.T / fit
        off = np.sqrt(np.maximum(1 - fit * fit, 0)) / fit / math.sqrt(max(d - 1, 1))
        return (queries @ self.c[at])[:, None] + size * product, span * np.sqrt((queries * queries).sum(axis=1))[:, None] * (size * off)


def exact(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, in double precision."""
    return np.einsum("ij,ij->i", queries, rows)


def _search(group: pa.Table, index: Index, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The k best pairs of each query of one group, of those that reach its threshold."""
    side = group.column(3).to_numpy()
    rows, asks = group.filter(side == 0), group.filter(side == 1)
    if not rows.num_rows or not asks.num_rows:
        return None
    d = index.c.shape[1]
    x, q = matrix(rows.column(5), d), matrix(asks.column(5), d)
    ids, names, least = rows.column(4).to_numpy(), asks.column(4).to_numpy(), asks.column(9).to_numpy()
    bits = np.frombuffer(b"".join(rows.column(6).to_pylist()), np.uint8).reshape(len(ids), -1)
    about, bound = index.estimate(q, group.column(0)[0].as_py(), bits, rows.column(7).to_numpy(), rows.column(8).to_numpy())
    other = names[:, None] != ids[None, :]
    # estimates and exact products are summed in different orders, so ties may differ by rounding
    c = index.c[group.column(0)[0].as_py()]
    slack = ROUNDING * np.sqrt((q * q).sum(axis=1))[:, None] * (math.sqrt(c @ c) + rows.column(7).to_numpy())
    high = np.where(other, about + bound + slack, -np.inf)
    first = min(4 * k, len(ids))
    lead = np.argpartition(-np.where(other, about, -np.inf), first - 1, axis=1)[:, :first]
    scores = exact(np.repeat(q, first, axis=0), x[lead.ravel()]).reshape(lead.shape)
    scores[~np.take_along_axis(other, lead, axis=1)] = -np.inf
    if first >= k:
        least = np.maximum(least, np.partition(scores, first - k, axis=1)[:, first - k])
    a, b = np.nonzero((high >= least[:, None]) & other)
    score = np.concatenate([exact(q[a[p : p + 100_000]], x[b[p : p + 100_000]]) for p in range(0, len(a), 100_000)] or [np.zeros(0)])
    hit = score >= least[a]
    a, b, score = a[hit], b[hit], score[hit]
    order = np.lexsort((ids[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    best = place < k
    return names[a[best]], ids[b[best]], score[best]


def nearest_vectors(vectors: DataFrame, is_query, k: int = 20, recall: float = RECALL, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors with the largest inner product for every row of ``vectors``
    (vec_id, embedding) that the condition ``is_query`` holds for, ties to smaller vec_id; its own vec_id is left out.

    Every row is indexed. Centroids and the number of lists to probe are fitted on a sample of up to SAMPLE rows, so
    that the recall there is ``recall``. Queries and rows meet by list, in blocks of bounded size.

    Vectors that are null, zero, of another length than most, or with components that are null or not finite take no
    part, nor do rows with a null vec_id; repeated rows are candidates each; with fewer candidates than ``k`` a query gets
    those there are; an empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & takes_part(F.col("embedding")))
    length = common_length(rows, "embedding")
    rows = rows.where(F.size("embedding") == length)
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(SAMPLE).select("embedding").collect() if n else []
    sample = np.array([x.embedding for x in drawn], dtype=np.float64).reshape(len(drawn), length)
    # about half the root of the number of rows, as far as the sample has enough rows for each list
    lists = min(max(1, len(sample) // PER_LIST), 1 << max(0, round(math.log2(max(math.sqrt(n) / 2, 1)))))
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    c = centroids_of(sample, lists, seed=seed)
    probes = probes_needed(sample, c, k, recall)
    index = Index(c, seed)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bits, size, fit = index.encode(matrix(b.column(1), length))
            yield pa.RecordBatch.from_arrays([pa.array(at), b.column(0), b.column(2), b.column(1), pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(size), pa.array(fit)], ["list", "id", "asks", "vector", "code", "size", "fit"])

    kind = rows.schema["embedding"].dataType.simpleString()
    indexed = cut(rows.select("vec_id", "embedding", "asks").mapInArrow(encode, f"list long, id long, asks boolean, vector {kind}, code binary, size double, fit double"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = np.argsort(-(matrix(b.column(1), length) @ c.T), axis=1, kind="stable")[:, :probes]
            probed = pa.ListArray.from_arrays(np.arange(0, order.size + 1, order.shape[1], dtype=np.int32), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), probed], ["id", "vector", "lists"])

    routed = indexed.where("asks").select("id", "vector").mapInArrow(route, f"id long, vector {kind}, lists array<long>")
    probed = routed.select("id", "vector", F.posexplode("lists").alias("turn", "list"))
    blocks = [(r["list"], math.ceil(r["n"] / BLOCK)) for r in indexed.groupBy("list").agg(F.count("*").alias("n")).collect()]  # as many as lists
    turns = {r["list"]: r for r in probed.groupBy("list").agg(F.sum((F.col("turn") == 0).cast("int")).alias("a"), F.sum((F.col("turn") > 0).cast("int")).alias("b")).collect()}
    flat = lambda pairs: F.broadcast(spark.createDataFrame(pairs or [(-1, 1)], "list long, parts int"))  # noqa: E731  1024 rows at most

    def compared(asks: DataFrame, which: str) -> DataFrame:
        """One step of the search: ``asks`` has id, vector, list and least."""
        parts = [(i, max(1, math.ceil(r[which] / QUERIES))) for i, r in turns.items() if r[which]]
        spread = lambda df, own, other: df.withColumn(own, F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(f"n_{other}") - 1)))
        both = [flat(blocks).withColumnRenamed("parts", "n_rows_at"), flat(parts).withColumnRenamed("parts", "n_asks_at")]
        sized = lambda df: df.join(both[0], "list").join(both[1], "list")
        left = spread(sized(indexed), "rows_at", "asks_at").select("list", "rows_at", "asks_at", F.lit(0).alias("side"), "id", "vector", "code", "size", "fit", F.lit(float("-inf")).alias("least"))
        right = spread(sized(asks), "asks_at", "rows_at").select("list", "rows_at", "asks_at", F.lit(1).alias("side"), "id", "vector", F.lit(None).cast("binary").alias("code"), F.lit(0.0).alias("size"), F.lit(1.0).alias("fit"), "least")
        keys = ["list", "rows_at", "asks_at"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in sorted_groups(batches, 3):
                if (found := _search(group, index, k)) is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

        return left.unionByName(right).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "query_id long, vec_id long, score double")

    def top(df: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    nothing = F.lit(float("-inf"))
    first = cut(top(compared(probed.where("turn = 0").select("id", "vector", "list", nothing.alias("least")), "a")))
    least = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    later = probed.where("turn > 0").join(least, "id", "left").select("id", "vector", "list", F.coalesce("least", nothing).alias("least"))
    found = first.select("query_id", "vec_id", "score").unionByName(compared(later, "b"))
    return top(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4(spark, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
