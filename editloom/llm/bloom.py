"""URL filters by a cascade of Bloom filters: exact membership over a known universe of keys, without a join.

The first level encodes the listed keys. The keys of the universe that pass it without being listed are encoded in the
second, the listed ones that pass the second in the third, and so on until nobody passes wrongly. A key is listed if the
first level that it fails has an even number (counted from one), or if it passes them all and their number is odd.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from editloom.llm.common import cut, table

#: The most bytes of levels that are broadcast at once; a cascade that needs more is built and asked in parts, by hash.
CASCADE_BYTES = 64 << 20
#: Keys that a task takes at once while a cascade is built.
TASK_KEYS = 500_000
SEED = 42

#: (verdict, host, path prefix): a rule fits a host and its subdomains, if the path starts with the prefix.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Hosts that are blocked, with their subdomains, where no rule fits.
LISTED_HOSTS = tuple(f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org"))


def host_of(url: Column) -> Column:
    """From behind the first ``://`` to the first of ``/?#``, in lower case (A-Z); empty without ``://``."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From behind the host to the first of ``?#``; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def domains(host: Column) -> Column:
    """The host and every domain that it is in, longest first; nothing for an empty host."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    every = F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, k, n), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(every)


def positions(hashes: np.ndarray, level: int, bits: int, count: int) -> np.ndarray:
    """(key, function): where a level with so many bits and functions has the keys."""
    h = hashes ^ np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(count, dtype=np.uint64)[None, :] * step[:, None]) % np.uint64(bits)).astype(np.int64)


class Cascade:
    """Levels as arrays of bytes, with their number of hash functions."""

    def __init__(self, levels: list[tuple[np.ndarray, int]]):
        self.levels = levels

    def passes(self, hashes: np.ndarray, level: int) -> np.ndarray:
        data, count = self.levels[level]
        at = positions(hashes, level, 8 * len(data), count)
        return ((data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each key is listed: exact for every key of the universe that the cascade was built for."""
        alive = np.ones(len(hashes), bool)
        listed = np.full(len(hashes), len(self.levels) % 2 == 1)
        for level in range(len(self.levels)):
            here = np.flatnonzero(alive)
            if not len(here):
                break
            out = here[~self.passes(hashes[here], level)]
            alive[out] = False
            listed[out] = level % 2 == 1
        return listed


def _shape(n: int, rate: float) -> tuple[int, int]:
    """Bits and hash functions of a level for ``n`` keys with a rate of false positives."""
    bits = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / 64) * 64)
    return bits, max(1, round(bits / n * math.log(2)))


def _first_rate(inside: int, outside: int) -> float:
    """The first level's rate follows from the ratio of listed to other keys, so that all levels together are small."""
    return min(0.5, max(1e-4, math.sqrt(0.5) * inside / max(outside, 1)))


def _levels(coded, inside: int, outside: int, level, passing) -> Cascade:
    """Levels until nobody passes wrongly. ``level`` makes one for keys, ``passing`` gives the keys that pass the last
    level of a cascade, with their number; keys are of any kind that the two agree on.
    """
    levels: list[tuple[np.ndarray, int]] = []
    here, n, other = coded[True], inside, coded[False]
    while n:
        if len(levels) == 64:
            raise SameHash
        bits, count = _shape(n, 0.5 if levels else _first_rate(inside, outside))
        levels.append((level(here, len(levels), bits, count), count))
        (wrong, n), here = passing(other, Cascade(levels)), here
        here, other = wrong, here
    return Cascade(levels or [(np.zeros(8, np.uint8), 1)])


class SameHash(ValueError):
    """A listed key and another key of the universe have the same hash."""


def small_cascade(listed: np.ndarray, others: np.ndarray) -> Cascade:
    """A cascade for few keys, given as hashes."""

    def level(keys: np.ndarray, at: int, bits: int, count: int) -> np.ndarray:
        out = np.zeros(bits, bool)
        out[positions(keys, at, bits, count)] = True
        return np.packbits(out, bitorder="little")

    def passing(keys: np.ndarray, cascade: Cascade) -> tuple[np.ndarray, int]:
        wrong = keys[cascade.passes(keys, len(cascade.levels) - 1)]
        return wrong, len(wrong)

    return _levels({True: listed, False: others}, len(listed), len(others), level, passing)


def _level(keys: DataFrame, at: int, bits: int, count: int) -> np.ndarray:
    """The level's bytes: tasks send words of 64 bits, which are combined before the shuffle and once more after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            where = np.unique(positions(x.column(0).to_numpy().view(np.uint64), at, bits, count))
            word, first = np.unique(where >> 6, return_index=True)
            value = np.bitwise_or.reduceat(np.left_shift(np.uint64(1), (where & 63).astype(np.uint64)), first) if len(where) else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(value.view(np.int64))], ["word", "value"])

    out = np.zeros(bits // 64, np.int64)
    found = keys.select("h").mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    out[found["word"].to_numpy()] = found["value"].to_numpy()
    return out.view(np.uint8)


def _passing(keys: DataFrame, cascade: Cascade) -> tuple[DataFrame, int]:
    shared, at = keys.sparkSession.sparkContext.broadcast(cascade), len(cascade.levels) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = shared.value.passes(x.column(0).to_numpy().view(np.uint64), at)
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(ok))], ["h"])

    wrong = cut(keys.select("h").mapInArrow(run, "h long"))
    n = wrong.count()
    return wrong.coalesce(max(1, -(-n // TASK_KEYS))), n


def build_cascades(universe: DataFrame, most_bytes: int = CASCADE_BYTES) -> list[Cascade]:
    """Cascades for the distinct keys of ``universe`` (h, listed): h is a 64-bit hash of a key. All keys are tested at
    every level. A key with hash h belongs to the cascade at h modulo their number; there is one, unless its levels
    would exceed ``most_bytes``.
    """
    counts = {r.listed: r.n for r in universe.groupBy("listed").agg(F.count("*").alias("n")).collect()}
    inside, outside = counts.get(True, 0), counts.get(False, 0)
    if not inside:
        return [Cascade([(np.zeros(8, np.uint8), 1)])]
    # the first level, and at most as much again for the others, of which each codes half of the keys before
    parts = max(1, math.ceil(2 * (_shape(inside, _first_rate(inside, outside))[0] / 8) / most_bytes))
    few = universe.coalesce(max(1, -(-(inside + outside) // TASK_KEYS)))
    out = []
    for p in range(parts):
        own = few.where(F.pmod("h", F.lit(parts)) == p) if parts > 1 else few
        sizes = {r.listed: r.n for r in own.groupBy("listed").agg(F.count("*").alias("n")).collect()} if parts > 1 else counts
        out.append(_levels({True: own.where("listed"), False: own.where("not listed")}, sizes.get(True, 0), sizes.get(False, 0), _level, _passing))
    return out


def _rule_of(keys: pa.Array, sizes: np.ndarray, fits: np.ndarray) -> dict[int, int]:
    """For each row with a key that fits, the position of the one that counts: the longest, of equal ones that with the
    longer host."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    best: dict[int, tuple[int, int, str, int]] = {}
    for k, key in zip(fits, keys.take(pa.array(fits)).to_pylist(), strict=True):
        rank = (len(key), key.find("/"), key, int(k))
        best[row[k]] = max(rank, best.get(row[k], rank))
    return {r: b[3] for r, b in best.items()}


def filter_urls(pages: DataFrame, rules=RULES, listed_hosts=LISTED_HOSTS, url: str = "url", most_bytes: int = CASCADE_BYTES) -> DataFrame:
    """The columns page_id, host, path, rule, verdict of every row of ``pages``.

    ``listed_hosts`` are names, or a table of them of any size (host). Keys of a page are its domains followed by each
    prefix of its path that is as long as some rule's, and its domains alone. One cascade tells rules among all keys of
    the corpus, one the blocking rules among the rules, and one the listed hosts among all domains, each exact over what
    it is asked; what is listed is marked once, when a cascade is built. Of several rules the longest key wins (of equal
    ones that with the longer host); without a rule, a page is blocked if a domain of its host is listed.

    A null url, and one without ``://``, has an empty host and path, fits nothing and is allowed; repeated rows each
    give a row; very long urls are taken whole; an empty table gives no rows; further columns are ignored. What is
    broadcast at once has ``most_bytes`` at most: a list that needs more is asked in parts, one after the other.
    """
    spark: SparkSession = pages.sparkSession
    lengths = sorted({len(p) for _, _, p in rules})
    parsed = pages.select("page_id", host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    prefixes = F.array_distinct(F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda p: p.isNotNull()))
    keyed = parsed.withColumn("domains", domains(F.col("host"))).withColumn("prefixes", prefixes)
    keys = F.flatten(F.transform("domains", lambda d: F.transform("prefixes", lambda p: F.concat(d, p))))
    keyed = keyed.withColumn("keys", keys)
    of_rule = {h.lower() + p: v for v, h, p in rules}
    named = lambda names: spark.createDataFrame([(x,) for x in sorted(names)], "key string")
    hosts = listed_hosts.select(F.lower("host").alias("key")).distinct() if isinstance(listed_hosts, DataFrame) else named({h.lower() for h in listed_hosts})

    def cascades(column: str, listed: DataFrame, seed: int) -> list[Cascade]:
        every = keyed.select(F.explode(column).alias("key")).distinct().join(listed.withColumn("listed", F.lit(True)), "key", "left")
        return build_cascades(cut(every.select(F.xxhash64(F.lit(seed), "key").alias("h"), F.coalesce("listed", F.lit(False)).alias("listed"))), most_bytes)

    seed = SEED
    while True:  # with another seed, if a listed key shares its hash with another key
        flagged = spark.createDataFrame(list(of_rule.items()) or [("", "")], "key string, verdict string").select(F.xxhash64(F.lit(seed), "key"), F.col("verdict") == "block").collect()
        try:
            rules_among = cascades("keys", named(of_rule), seed)[0]  # of few rules, so never in parts
            blocks_among = small_cascade(*(np.array([h for h, v in flagged if v == block], np.int64).view(np.uint64) for block in (True, False)))
            hosts_among = cascades("domains", hosts, seed)
            break
        except SameHash:
            seed += 1
    hashed = lambda c: F.transform(c, lambda key: F.xxhash64(F.lit(seed), key))
    parts = len(hosts_among)
    rows = keyed.select("page_id", "host", "path", "keys", hashed("keys").alias("of_keys"), hashed("domains").alias("of_domains"), F.lit(False).alias("listed"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)

    def marked(x: pa.RecordBatch, among: Cascade, part: int) -> np.ndarray:
        """Which rows have a domain that is listed, as far as this part of the hashes tells or those before did."""
        of = np.repeat(np.arange(x.num_rows), pc.list_value_length(x.column(5)).to_numpy(zero_copy_only=False))
        h = _hashes(x.column(5))
        own = np.flatnonzero(h.view(np.int64) % parts == part)
        out = x.column(6).to_numpy(zero_copy_only=False).copy()
        out[of[own[among.contains(h[own])]]] = True
        return out

    for part in range(1, parts):
        one = spark.sparkContext.broadcast(hosts_among[part])

        def mark(batches: Iterator[pa.RecordBatch], part: int = part, one=one) -> Iterator[pa.RecordBatch]:
            for x in batches:
                yield pa.RecordBatch.from_arrays([*x.columns[:6], pa.array(marked(x, one.value, part))], x.schema.names)

        rows = cut(rows.mapInArrow(mark, schema))
        one.destroy()
    shared = spark.sparkContext.broadcast((rules_among, blocks_among, hosts_among[0]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        among, blocking, listed = shared.value
        for x in batches:
            keys, sizes = x.column(3).flatten(), pc.list_value_length(x.column(3)).to_numpy(zero_copy_only=False)
            hashes = _hashes(x.column(4))
            best = _rule_of(keys, sizes, np.flatnonzero(among.contains(hashes)))
            at = np.fromiter(best.values(), np.int64, len(best))
            blocked = marked(x, listed, 0)
            blocked[np.fromiter(best, np.int64, len(best))] = blocking.contains(hashes[at])
            names = dict(zip(best, keys.take(pa.array(at)).to_pylist(), strict=True))
            verdicts = pa.array(np.where(blocked, "block", "allow"), pa.string())
            yield pa.RecordBatch.from_arrays([*x.columns[:3], pa.array([names.get(k) for k in range(x.num_rows)], pa.string()), verdicts], ["page_id", "host", "path", "rule", "verdict"])

    return rows.mapInArrow(judge, f"page_id {rows.schema[0].dataType.simpleString()}, host string, path string, rule string, verdict string")


def _hashes(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def op9(spark, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


def op9_sql() -> str:
    """The same over a view ``pages``, for DuckDB: rules and listed hosts are compared one by one."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    hosts = ", ".join(f"('{h}')" for h in LISTED_HOSTS)
    fits = lambda host: f"(host = {host} or ends_with(host, '.' || {host}))"
    return f"""
with rules(verdict, h, p) as (values {rules}), listed(name) as (values {hosts}),
parsed as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path from pages),
best as (select *, (select arg_max({{'rule': h || p, 'verdict': verdict}}, length(h || p) * 1000 + length(h)) from rules where {fits('h')} and starts_with(path, p)) r from parsed)
select page_id, host, path, r.rule as rule, coalesce(r.verdict, case when exists (select 1 from listed where {fits('name')}) then 'block' else 'allow' end) verdict from best"""
