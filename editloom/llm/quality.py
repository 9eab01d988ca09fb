"""Quality by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k sampling.

Both models are multinomials over hashed unigrams and bigrams of lower-cased pieces (runs of letters and digits, runs of
punctuation). The importance weight of a text is the ratio of its probabilities under them, tempered by its length: n-grams
of a text depend on each other, so n of them count as INFORMATION * ln(1 + n) independent ones, at every length. Keys of log
weight plus Gumbel noise make the k largest a sample without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from editloom.llm.common import cut, lowered, mixed, piece_spans, released, steps, table, word_hashes

#: Hash buckets of the two models, so the most counts that reach the driver.
BUCKETS = 1 << 16
#: The most labelled rows that the target model and the cut are fitted on (those with the least hashes of doc_id).
LABELLED = 16_384
#: Independent n-grams that a text holds for each unit of the logarithm of its length. Without this, sums over long texts
#: spread so far that with few labels a clean text of a rare topic lies below all junk, and nothing can be rejected.
INFORMATION = 16.0
#: What a lost clean text costs, in junk texts that stay.
CLEAN_COST = 20.0
SEED = 42


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of n-grams, and the row of each; together every n-gram of every row once."""
    held: tuple[int, np.uint64] | None = None  # row and hash of the last piece of the run before
    for rows, data, offsets in steps(texts):
        low = lowered(data)
        start, end, doc = piece_spans(low, offsets)
        h = word_hashes(low, start, end)
        doc = rows[doc]
        own, every = len(h), h
        if len(h) and held and held[0] == doc[0]:  # the text goes on
            every, doc = np.concatenate([[held[1]], h]), np.concatenate([doc[:1], doc])
        same = doc[1:] == doc[:-1]
        pairs = mixed(every[:-1] * np.uint64(3) + every[1:])[same]
        yield (np.concatenate([h, pairs]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([doc[len(doc) - own :], doc[1:][same]])
        if own:
            held = int(doc[-1]), h[-1]


def count_models(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket over all rows of ``docs`` (text, is_target) and over the target rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, BUCKETS), np.int64)
        for x in batches:
            target = x.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for bucket, doc in features(x.column(0)):
                counts[0] += np.bincount(bucket, minlength=BUCKETS)
                counts[1] += np.bincount(bucket[target[doc]], minlength=BUCKETS)
        here = np.flatnonzero(counts[0])
        yield pa.RecordBatch.from_arrays([pa.array(here), pa.array(counts[0][here]), pa.array(counts[1][here])], ["bucket", "raw", "target"])

    counted = docs.select(F.col("text").cast("string"), F.coalesce("is_target", F.lit(False))).mapInArrow(lambda x: released(run(x)), "bucket long, raw long, target long")
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, n, m in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # BUCKETS rows at most
        raw[bucket], target[bucket] = n, m
    return raw, target


def log_ratio(target: np.ndarray, raw: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log of the target probability over the raw probability, by bucket; all 0 without target text."""
    if not target.sum():
        return np.zeros(len(raw))
    return np.log((target + alpha) / (target.sum() + alpha * len(target))) - np.log((raw + alpha) / (raw.sum() + alpha * len(raw)))


def weights_of(texts: pa.Array, ratio: np.ndarray) -> np.ndarray:
    """The log importance weight of each text: the mean over its n-grams, times the independent ones that they count as;
    0 for a text without words.
    """
    sums, n = np.zeros(len(texts)), np.zeros(len(texts))
    for bucket, doc in features(texts):
        if len(doc):
            first = int(doc.min())
            here = np.bincount(doc - first)
            n[first : first + len(here)] += here
            sums[first : first + len(here)] += np.bincount(doc - first, weights=ratio[bucket])
    return sums / np.maximum(n, 1) * INFORMATION * np.log1p(n)


class ImportanceModel:
    """The fitted ratio, and the cut that its keys must clear; ``score`` and ``key`` are columns for any documents."""

    def __init__(self, docs: DataFrame, ratio: np.ndarray, seed: int):
        self.cut, self.seed = float("-inf"), seed
        shared = docs.sparkSession.sparkContext.broadcast(ratio)  # BUCKETS doubles

        @F.arrow_udf("double")
        def score(texts: pa.Array) -> pa.Array:
            return pa.array(weights_of(texts, shared.value))

        self._score = score

    def score(self) -> Column:
        return self._score(F.col("text").cast("string"))

    def gumbel(self) -> Column:
        """Standard Gumbel noise that depends on seed and doc_id only."""
        u = (F.pmod(F.xxhash64(F.lit(self.seed), F.col("doc_id").cast("long")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
        return -F.log(-F.log(u))


def labelled_sample(labels: DataFrame, most: int = LABELLED, seed: int = SEED) -> DataFrame:
    """(doc_id, good, fit): up to ``most`` labelled documents; three in four fit the target model, the others the cut."""
    once = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") > 0).alias("good"))
    h = F.xxhash64(F.lit(seed), "doc_id")
    return once.orderBy(h, "doc_id").limit(most).select("doc_id", "good", (F.pmod(F.shiftright(h, 7), F.lit(4)) > 0).alias("fit"))


def best_cut(keys: np.ndarray, good: np.ndarray, clean_cost: float = CLEAN_COST) -> float:
    """The lowest of the cheapest cuts between labelled keys; minus infinity if a class is missing."""
    if not good.any() or good.all():
        return float("-inf")
    order = np.argsort(keys, kind="stable")
    k, g = keys[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) / g.sum()
    stays = 1 - np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    at = int(np.argmin(clean_cost * lost + stays))
    if at == 0:
        return float("-inf")
    return float(k[-1] + 1 if at == len(k) else (k[at - 1] + k[at]) / 2)


def kth_largest(df: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a double column, by counting: 4096 bins a pass, no sort."""
    raw = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v"))
    lo, hi = raw.agg(F.min("_v"), F.max("_v")).first()
    if lo is None:
        return float("-inf")
    need = k
    while lo < hi:
        width = (hi - lo) / 4096
        if width <= 0 or lo + width == lo:
            break
        part = raw.where(F.col("_v").between(lo, hi)).select("_v", F.least(F.floor((F.col("_v") - lo) / width), F.lit(4095)).alias("_b"))
        bins = sorted(part.groupBy("_b").agg(F.count("*"), F.min("_v"), F.max("_v")).collect(), reverse=True)  # 4096 rows at most
        for _, n, least, most in bins:
            if need <= n:
                lo, hi = least, most
                break
            need -= n
        else:
            return lo
    return lo


def importance_resample(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> tuple[DataFrame, ImportanceModel]:
    """A score of every row of ``docs``, and the model with its cut.

    The target model is fitted on labelled clean documents (a sample bounded by LABELLED), the raw model on every
    document. Rows of the result: doc_id, log_weight, gumbel_key, kept; kept are the ``k`` largest keys, with all rows
    that tie with the last. Without ``k``, it is the number of keys that clear the cheapest cut between clean and junk
    among the labelled documents that the model was not fitted on.

    Null and empty texts weigh 0 (as likely target as raw) and are kept unless ``k`` says otherwise; very long texts are
    read whole; repeated doc_ids share their noise, so repeated rows stand or fall together; a null doc_id is allowed.
    Without labels of both kinds, or with empty tables, nothing is rejected. Further columns are ignored.
    """
    sample = F.broadcast(labelled_sample(labels, seed=seed))  # LABELLED rows at most
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(sample, "doc_id", "left")
    raw, target = count_models(known.select("text", (F.col("good") & F.col("fit")).alias("is_target")))
    model = ImportanceModel(docs, log_ratio(target, raw), seed)
    scored = cut(known.select("doc_id", "good", "fit", model.score().alias("log_weight")).withColumn("gumbel_key", F.col("log_weight") + model.gumbel()))
    if k is None:
        held = scored.where("not fit").groupBy("doc_id").agg(F.min("gumbel_key").alias("key"), F.first("good").alias("good")).collect()  # LABELLED rows at most
        model.cut = best_cut(np.array([x.key for x in held]), np.array([x.good for x in held], bool))
    else:
        model.cut = kth_largest(scored, "gumbel_key", k) if k > 0 else float("inf")
    return scored.select("doc_id", "log_weight", "gumbel_key", (F.col("gumbel_key") >= F.lit(model.cut)).alias("kept")), model


def resampled(docs: DataFrame, labels: DataFrame, k: int | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` that importance resampling keeps, with their columns."""
    _, model = importance_resample(docs, labels, k, seed)
    return docs.where(model.score() + model.gumbel() >= F.lit(model.cut)).select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]
