"""Near copies of whole texts: SimHash of five-word shingles for a similarity, with pigeonring pruning.

Two texts whose sets of shingles have the Jaccard similarity s differ in a share arccos(2 s / (1 + s)) / pi of the bits of
their fingerprints, give or take. At a similarity of 0.8 that is too many for keys that every pair must share, so keys
are samples of bits, in as many tables as it takes. In a bucket, the words of two fingerprints form a ring: a pair goes
on to the whole distance only if from some word on all sums of differences stay within proportional budgets.

Such keys find nearly all links. Those they leave out are found exactly: all fingerprints whose groups are still apart are
compared by keys that every near pair shares, sixteen bits of which few differ.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from editloom.llm.common import cut, lowered, mixed, released, steps, word_hashes, word_spans
from editloom.llm.graph import connected_components

WIDTH, SIMILARITY = 5, 0.8
#: Words of 64 bits in a fingerprint.
WORDS = 4
BITS = 64 * WORDS
#: Standard deviations of the distance that the limit leaves room for.
ROOM = 1.6
#: The share of pairs just at the similarity that may share no bucket, and are left to the search between groups.
MISS = 0.02
#: The most rows of a bucket that are compared with each other at once.
BLOCK = 1024
#: Rows of a part in the search between groups: a few parts, but as many as keep to the most rows.
PARTS, LEAST_ROWS, MOST_ROWS = 8, 8192, 200_000
#: A group with more rows than this in a task is held against other rows only; pairs that are expanded at once.
MANY, PAIRS = 2048, 1 << 19
SEED = 42


def share_apart(similarity: float) -> float:
    """The expected share of bits in which texts of that Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def limit_for(similarity: float) -> int:
    """The distance up to which texts are linked."""
    p = share_apart(similarity)
    return int(BITS * p + ROOM * math.sqrt(BITS * p * (1 - p)))


def tables_for(similarity: float, bits: int, miss: float = MISS) -> int:
    """Tables with keys of so many bits, of which a pair at the similarity misses all with probability ``miss``."""
    return math.ceil(math.log(miss) / math.log(1 - (1 - share_apart(similarity)) ** bits))


def _sets(texts: pa.Array, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and hashes of the distinct shingles of each text (of a shorter text the whole sequence), row by row."""
    held: list[np.ndarray] = []  # of a long text, which comes in pieces
    of = -1
    for rows, data, offsets in steps(texts, width - 1):
        if held and rows[0] != of:
            h = np.unique(np.concatenate(held))
            yield np.full(len(h), of), h
            held = []
        low = lowered(data)
        start, end, doc = word_spans(low, offsets)
        words = np.bincount(doc, minlength=len(rows))
        here = np.flatnonzero(words)
        if not len(here):
            continue
        each = word_hashes(low, start, end)
        made = np.maximum(words - (width - 1), 1)[here]
        first, last = (np.cumsum(words) - words)[here], np.cumsum(words)[here] - 1
        lead = np.arange(int(made.sum())) + np.repeat(first - (np.cumsum(made) - made), made)
        h = np.zeros(len(lead), np.uint64)
        for k in range(width):
            at = lead + k
            inside = at <= np.repeat(last, made)
            h = mixed(h + np.where(inside, each[np.minimum(at, len(each) - 1)], np.uint64(0)) + np.uint64(k + 1))
        if len(rows) == 1:
            held.append(h)
            of = int(rows[0])
            continue
        row = np.repeat(rows[here], made)
        order = np.lexsort((h, row))
        row, h = row[order], h[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (h[1:] != h[:-1])])
        yield row[new], h[new]
    if held:
        h = np.unique(np.concatenate(held))
        yield np.full(len(h), of), h


def fingerprints_of(texts: pa.Array, width: int = WIDTH) -> np.ndarray:
    """(text, word): the fingerprint of each text; zero for a text without words."""
    out = np.zeros((len(texts), WORDS), np.uint64)
    for rows, h in _sets(texts, width):
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        n = np.diff(np.append(first, len(rows)))
        for w in range(WORDS):
            salted = mixed(h + np.uint64(0x9E3779B97F4A7C15 * (w + 1) % 2**64))
            votes = np.zeros((len(first), 64), np.int64)
            for a in range(0, len(h), 1 << 16):  # so that the bits of a part exist at a time
                bits = np.unpackbits(salted[a : a + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                i, j = np.searchsorted(first, a, "right") - 1, np.searchsorted(first, a + len(bits), "left")
                votes[i:j] += np.add.reduceat(bits, np.maximum(first[i:j] - a, 0), axis=0, dtype=np.int64)
            out[rows[first], w] = np.packbits(2 * votes > n[:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def keys_of(fps: np.ndarray, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(text, table): the sampled bits of each table as a number; numbers of different tables differ."""
    random = np.random.default_rng([seed, bits])
    weights = np.zeros((BITS, tables))
    for t in range(tables):
        weights[random.choice(BITS, bits, replace=False), t] = 2.0 ** np.arange(bits)
    ones = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little").astype(np.float64)
    return (ones @ weights).astype(np.int64) * tables + np.arange(tables)


def near(a: np.ndarray, b: np.ndarray, limit: int) -> np.ndarray:
    """Whether fingerprints differ in ``limit`` bits at most: pairs that have no chain within its budgets are pruned first."""
    apart = np.bitwise_count(a ^ b).astype(np.int64)
    ring = np.concatenate([apart, apart[..., :-1]], axis=-1)
    chain = np.zeros(apart.shape[:-1], bool)
    for start in range(WORDS):
        sums = np.cumsum(ring[..., start : start + WORDS - 1], axis=-1)
        chain |= (sums * WORDS <= limit * np.arange(1, WORDS)).all(axis=-1)
    return chain & (apart.sum(axis=-1) <= limit)


def _spread(fps: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a group: the root (least position in reach) of each row, and the rows that together are near to all of them.

    A row that is near to none of those is compared with all rows; then rows of different components are compared, but
    for those of the largest component with each other. So components are exact, and a group of copies costs no square.
    """
    n = len(fps)
    root, lead = np.arange(n), np.zeros(n, bool)
    covered = np.zeros(n, bool)

    def join(k: int, others: np.ndarray) -> None:
        roots = np.unique(root[np.append(others, k)])
        if len(roots) > 1:
            root[np.isin(root, roots)] = roots[0]

    for k in range(n):
        if not covered[k]:
            hit = np.flatnonzero(near(fps, fps[k], limit))
            covered[hit] = lead[k] = True
            join(k, hit)
    names, counts = np.unique(root, return_counts=True)
    if len(names) > 1:
        small = np.flatnonzero((root != names[np.argmax(counts)]) & ~lead)
        for k in small:
            rest = np.flatnonzero(root != root[k])
            if len(hit := rest[near(fps[rest], fps[k], limit)]):
                join(k, hit)
    return root, np.flatnonzero(lead)


def _linked(groups: Iterator[pa.RecordBatch], limit: int, keys: int, few: int = 12) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of the rows of each group, and after them its leading rows, with their columns and no b.

    Batches are sorted by their first ``keys`` columns; then follow node and the words of the fingerprint.
    """

    def found(rows: pa.Table) -> pa.RecordBatch:
        by = np.stack([rows.column(k).to_numpy() for k in range(keys)], axis=1)
        node = rows.column(keys).to_numpy()
        fps = np.stack([rows.column(keys + 1 + w).to_numpy().view(np.uint64) for w in range(WORDS)], axis=1)
        first = np.flatnonzero(np.concatenate([[True], (by[1:] != by[:-1]).any(axis=1)]))
        size = np.diff(np.append(first, len(node)))
        sizes, group = np.repeat(size, size), np.repeat(np.arange(len(size)), size)
        out = [np.zeros((0, 2), np.int64)]
        leads = []
        for lag in range(1, few):  # small groups together: each row with the next, the one after, ...
            i = np.flatnonzero((group[lag:] == group[:-lag]) & (sizes[lag:] <= few))
            if not len(i):
                break
            i = i[near(fps[i], fps[i + lag], limit)]
            out.append(np.stack([node[i], node[i + lag]], axis=1))
        for g in np.flatnonzero(size > few):
            a, b = first[g], first[g] + size[g]
            root, lead = _spread(fps[a:b], limit)
            here = np.flatnonzero(root != np.arange(b - a))
            out.append(np.stack([node[a + here], node[a + root[here]]], axis=1))
            leads.append(a + lead)
        pairs, lead = np.concatenate(out), np.concatenate(leads) if leads else np.zeros(0, np.int64)
        a = np.concatenate([pairs[:, 0], node[lead]])
        b = pa.concat_arrays([pa.array(pairs[:, 1], pa.int64()), pa.nulls(len(lead), pa.int64())])
        rest = [pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array(x[lead], pa.int64())]) for x in (by[:, 0], *fps.view(np.int64).T)]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), b, *rest], ["a", "b", "key", *(f"f{w}" for w in range(WORDS))])

    held: list[pa.RecordBatch] = []
    for x in groups:
        if not x.num_rows:
            continue
        last = np.ones(x.num_rows, bool)  # rows of the last group, which may go on
        for k in range(keys):
            v = x.column(k).to_numpy()
            last &= v == v[-1]
        at = int(np.argmax(last))
        if at or held and any(held[-1].column(k)[0].as_py() != x.column(k)[0].as_py() for k in range(keys)):
            yield found(pa.Table.from_batches([*held, x.slice(0, at)]))
            held = []
        held.append(x.slice(at))
    if held:
        yield found(pa.Table.from_batches(held))


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each group, of batches sorted by their first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    name = None
    for x in batches:
        by = np.stack([x.column(k).to_numpy() for k in range(keys)], axis=1)
        edges = [*np.flatnonzero((by[1:] != by[:-1]).any(axis=1)) + 1, len(by)]
        for a, b in itertools.pairwise([0, *edges]):
            if b > a:
                if held and tuple(by[a]) != name:
                    yield pa.Table.from_batches(held)
                    held = []
                name = tuple(by[a])
                held.append(x.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _between(fps: np.ndarray, root: np.ndarray, others: np.ndarray, other_root: np.ndarray, limit: int) -> np.ndarray:
    """The distinct pairs of roots, of all pairs of a row and another one that are near and differ in root.

    If at most ``limit`` bits differ, then in one of the words of 32 bits no more than their share, and in one of its
    halves no more than half of that. So rows are sorted by each half, and looked up under all values so near to it.
    """
    in_word = limit // (2 * WORDS)
    masks = [sum(1 << k for k in bits) for n in range(min(16, in_word // 2) + 1) for bits in itertools.combinations(range(16), n)]
    halves, other_halves = fps.view(np.uint16), others.view(np.uint16)
    out = [np.zeros((0, 2), np.int64)]
    for h in range(4 * WORDS):
        order, other_order = np.argsort(halves[:, h], kind="stable"), np.argsort(other_halves[:, h], kind="stable")
        value = halves[order, h]
        rest, other_rest = halves[order, h ^ 1], other_halves[other_order, h ^ 1]  # of the same word
        begin = np.searchsorted(other_halves[other_order, h], np.arange((1 << 16) + 1))
        size = np.diff(begin)
        for mask in masks:
            at = value ^ np.uint16(mask)
            n, room = size[at], in_word - mask.bit_count()
            ends = np.cumsum(n)
            shift = begin[at] - (ends - n)
            cuts = [*np.searchsorted(ends, np.arange(PAIRS, ends[-1], PAIRS)), len(n)]
            for a, b in itertools.pairwise([0, *cuts]):
                if a == b:
                    continue
                before = int(ends[a - 1]) if a else 0
                i = np.repeat(np.arange(a, b), n[a:b])
                j = np.arange(before, int(ends[b - 1])) + shift[i]
                some = np.flatnonzero(np.bitwise_count(rest[i] ^ other_rest[j]) <= room)
                i, j = order[i[some]], other_order[j[some]]
                apart = root[i] != other_root[j]
                i, j = i[apart], j[apart]
                hit = np.bitwise_count(fps[i] ^ others[j]).sum(axis=1) <= limit
                if hit.any():
                    out.append(np.unique(np.stack([root[i[hit]], other_root[j[hit]]], axis=1), axis=0))
    return np.unique(np.concatenate(out), axis=0)


def _apart(fps: np.ndarray, root: np.ndarray, others: np.ndarray, other_root: np.ndarray, limit: int) -> np.ndarray:
    """``_between``, where pairs within large groups are not even looked at."""
    names, counts = np.unique(np.concatenate([root, other_root]), return_counts=True)
    large = names[counts > MANY]
    found = [np.zeros((0, 2), np.int64)]
    for name in [None, *large]:
        mine = ~np.isin(root, large) if name is None else root == name
        theirs = np.ones(len(others), bool) if name is None else other_root != name
        if mine.any() and theirs.any():
            found.append(_between(fps[mine], root[mine], others[theirs], other_root[theirs], limit))
    return np.concatenate(found)


def links_between(fps: DataFrame, limit: int, n: int) -> DataFrame:
    """Links (a, b) between roots: all of which two of the ``n`` rows of ``fps`` (node, root, f0, f1, ...) are near.

    This is exact. Rows are dealt into parts, and every pair of parts meets in a task, so no task holds more than two
    parts. Time grows with the square of n, by a few nanoseconds a pair; what is shuffled, with n and the number of parts.
    """
    parts = max(1, min(PARTS, n // LEAST_ROWS), -(-n // MOST_ROWS))
    words = [f"f{w}" for w in range(WORDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _grouped(batches, 2):
            i, j, own, root = (rows.column(k).to_numpy() for k in range(4))
            fps = np.stack([rows.column(4 + w).to_numpy().view(np.uint64) for w in range(WORDS)], axis=1)
            a, b = own == i, own == j
            pairs = _apart(fps[a], root[a], fps[b], root[b], limit)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    dealt = fps.withColumn("own", F.pmod(F.xxhash64("node"), F.lit(parts))).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    placed = dealt.select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "root", *words)
    met = placed.repartition(parts * (parts + 1), "i", "j").sortWithinPartitions("i", "j")
    return cut(met.mapInArrow(lambda x: released(run(x)), "a long, b long")).distinct()


def near_links(fps: DataFrame, similarity: float = SIMILARITY, miss: float = MISS, block: int = BLOCK, n: int | None = None) -> DataFrame:
    """Links (a, b) that span the near groups of ``fps`` (node, f0, f1, ...), distinct nodes with their fingerprints.

    Groups are exact: two nodes are joined if, and only if, a chain of fingerprints that differ in ``limit_for`` bits at most
    leads from one to the other. ``likely_links`` find most of it; ``links_between`` finds what is left.
    """
    n = fps.count() if n is None else n
    words = [f"f{w}" for w in range(WORDS)]
    roots = connected_components(likely_links(fps, similarity, miss, block, n))
    rooted = fps.select("node", *words).join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), *words)
    return roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links_between(rooted, limit_for(similarity), n))


def likely_links(fps: DataFrame, similarity: float, miss: float, block: int, n: int) -> DataFrame:
    """Links (a, b) of ``n`` nodes that meet in a bucket: nearly all that it takes to span the near groups.

    Keys have about as many bits as numbers of nodes, so buckets of unlike texts stay small, and tables grow with a power of the
    number of nodes below a quarter. A bucket of more than ``block`` rows holds copies: it is dealt out to blocks; of each
    block its leading rows, to which all others are near, meet again in a next round. If a round leaves more than half
    of the rows, all pairs of blocks are compared instead. So no task holds more than two blocks of a bucket.
    """
    bits = max(8, min(40, round(math.log2(max(n, 1))) - 2))  # about four unlike texts a bucket
    tables, limit = tables_for(similarity, bits, miss), limit_for(similarity)
    words = [f"f{w}" for w in range(WORDS)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for a in range(0, x.num_rows, 2048):
                y = x.slice(a, 2048)
                keys = keys_of(np.stack([c.to_numpy().view(np.uint64) for c in y.columns[1:]], axis=1), tables, bits)
                at = np.repeat(np.arange(y.num_rows), tables)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(c.take(pa.array(at)) for c in y.columns)], ["key", "node", *words])

    schema = "node long, " + ", ".join(f"{w} long" for w in words)
    keyed = fps.select("node", *words).mapInArrow(lambda x: released(place(x)), "key long, " + schema)
    found, rows, turn, paired = None, None, 0, False
    while True:
        sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block)
        large = cut(sizes.select("key", F.ceil(F.col("n") / block).cast("int").alias("blocks"), "n"))
        some = large.agg(F.sum("n")).first()[0]
        if some:
            placed = keyed.join(large.select("key", "blocks"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
            paired = rows is not None and some > rows / 2
            own = F.pmod(F.xxhash64(F.lit(turn), "node"), F.col("blocks")).cast("int")
            if paired:
                both = placed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                placed = both.withColumn("i", F.least("own", "other").cast("long")).withColumn("j", F.greatest("own", "other").cast("long"))
            else:
                placed = placed.withColumn("i", own.cast("long")).withColumn("j", F.lit(0).cast("long"))
        else:
            placed = keyed.withColumn("i", F.lit(0).cast("long")).withColumn("j", F.lit(0).cast("long"))
        by = ["key", "i", "j"]
        grouped = placed.select(*by, "node", *words).repartition(*by).sortWithinPartitions(*by)
        out = cut(grouped.mapInArrow(lambda batches: released(_linked(batches, limit, 3)), "a long, b long, key long, " + ", ".join(f"{w} long" for w in words)))
        links = out.where("b is not null").select("a", "b").distinct()
        found = links if found is None else found.unionByName(links)
        if not some or paired:
            return found
        rows, turn = some, turn + 1
        keyed = out.where("b is null").join(large.select("key"), "key", "left_semi").select("key", F.col("a").alias("node"), *words)


def near_copies(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """(doc_id, digest, rows, kept) for the distinct pairs of doc_id and text of ``docs``: digest is the MD5 of the text
    (null for a null text), rows how often the pair occurs; of each group of near copies one pair is kept.

    Texts are linked when the fingerprints of their shingles of ``width`` words differ in no more bits than a Jaccard
    similarity of ``similarity`` lets expect (``limit_for``); groups are what links join. Kept is the least doc_id that
    is not null, of several texts under it the one with the least digest.

    Equal texts are one node. Texts without words, null ones included, are copies of each other; very long texts are taken
    whole; a null doc_id stands behind all others; an empty table gives no rows; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            fps = fingerprints_of(x.column(2), width).view(np.int64)
            yield pa.RecordBatch.from_arrays([*x.columns[:2], *(pa.array(f) for f in fps.T)], ["doc_id", "digest", *words])

    words = [f"f{w}" for w in range(WORDS)]
    text = F.col("text").cast("string")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("digest"), text.alias("text"))
    thin = cut(given.mapInArrow(lambda x: released(run(x)), "doc_id long, digest string, " + ", ".join(f"{w} long" for w in words)))
    pairs = thin.groupBy("digest", "doc_id").agg(F.count("*").alias("rows"))
    nodes = cut(thin.groupBy(*words).agg(F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    roots = connected_components(near_links(nodes, similarity, miss, block))
    named = nodes.join(roots, "node", "left").select(*words, F.coalesce("root", "node").alias("root"))
    texts = thin.select("digest", *words).distinct().join(named, words).select("digest", "root")
    rooted = pairs.join(texts, pairs.digest.eqNullSafe(texts.digest)).select("doc_id", pairs.digest, "rows", "root")
    order = F.struct(F.col("doc_id").isNull().alias("x"), F.coalesce("doc_id", F.lit(0)).alias("y"), F.coalesce("digest", F.lit("")).alias("z"))
    least = rooted.groupBy("root").agg(F.min(order).alias("least"))
    return rooted.join(least, "root").select("doc_id", "digest", "rows", (F.col("least") == order).alias("kept"))


def near_dedup(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` less near copies: of each group one row stays (``near_copies`` says which).

    What goes is decided for rows by doc_id and text, so a doc_id with several texts keeps those that are copies of
    nothing. Of rows that agree in both, one stays.
    """
    p = "_"
    while any(c.startswith(p) for c in docs.columns):  # names that no column of docs has
        p += "_"
    kept = cut(near_copies(docs, width, similarity).where("kept").select(F.col("doc_id").alias(p + "id"), F.col("digest").alias(p + "digest"), F.col("rows").alias(p + "rows")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(p + "id")) & F.md5(F.col("text").cast("string")).eqNullSafe(F.col(p + "digest"))
    joined = docs.join(kept, same)
    once = joined.where(F.col(p + "rows") == 1).select(*docs.columns)
    if kept.where(F.col(p + "rows") > 1).isEmpty():
        return once
    again = joined.where(F.col(p + "rows") > 1).dropDuplicates([p + "id", p + "digest"])
    return once.unionByName(again.select(*docs.columns))
