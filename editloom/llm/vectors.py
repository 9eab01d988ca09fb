"""What the operators on vectors share: which vectors take part, Arrow lists as matrices, runs of sorted groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def takes_part(vector: Column) -> Column:
    """Whether a vector has finite components only, and one other than zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def common_length(vectors: DataFrame, column: str) -> int:
    """The most frequent length of the vectors (the least of several); 0 if there are none."""
    first = vectors.groupBy(F.size(column).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return first.d if first else 0


def matrix(column: pa.Array, length: int) -> np.ndarray:
    """The lists of a column as rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), length)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, from batches that are sorted by their first ``keys`` columns of whole numbers."""
    held: list[pa.RecordBatch] = []
    now = None
    for x in batches:
        if not x.num_rows:
            continue
        by = np.stack([x.column(k).to_numpy(zero_copy_only=False) for k in range(keys)], axis=1)
        edges = np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *edges], [*edges, x.num_rows], strict=True):
            key = tuple(by[a])
            if key != now and held:
                yield pa.Table.from_batches(held)
                held = []
            now = key
            held.append(x.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
