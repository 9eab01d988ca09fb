"""Local alignment of short references (index sequences, amplicons) with reads, on both strands.

The only kernel of the library that is not a built-in expression. References are few and configured, so they travel with
the function; reads come in Arrow batches. Reads of a batch of similar length are aligned with one reference at once:
the dynamic programme runs along the reference, vectorised over reads and read positions. A reference that shares no
seed with a read is skipped where a seed is asked for. For each pair the best hit is returned, in the long layout, with
the read as subject and coordinates on the read's given strand (sstart > send where the read's reverse strand matches).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HITS = "qseqid string, sseqid string, qstart int, qend int, qlen int, sstart int, send int, slen int, mismatch int, gapopen int, score int, sseq string, qseq string"
#: Match, mismatch, first and further column of a gap.
SCORES = (2, -3, -5, -2)
_COMPLEMENT = bytes.maketrans(b"ACGTN", b"TGCAN")
#: Cells of the programme that are held at once, for the way back.
CELLS = 24_000_000


def _codes(reads: list[bytes], width: int) -> np.ndarray:
    out = np.zeros((len(reads), width), np.uint8)
    for k, r in enumerate(reads):
        out[k, : len(r)] = np.frombuffer(r, np.uint8)
    return out


def _gap_cost(h: np.ndarray, first: int, more: int) -> np.ndarray:
    """Best score of a gap that ends at each position and runs along the read: a running maximum, without a loop."""
    at = np.arange(h.shape[1], dtype=np.int32) * -more
    best = np.maximum.accumulate(h + at, axis=1)
    out = np.full_like(h, -(1 << 20))
    out[:, 1:] = best[:, :-1] + first - more - at[1:]
    return out


Hit = tuple[int, int, int, int, int, int, int, str, str]


def reach(query: bytes, scores: tuple[int, int, int, int] = SCORES) -> int:
    """The most positions of a read that a local alignment with ``query`` spans: gaps cost more than matches give beyond."""
    return len(query) + max(0, (len(query) * scores[0] + scores[3] - scores[2]) // -scores[3]) + 1


def align_long(query: bytes, read: bytes, scores: tuple[int, int, int, int] = SCORES, least: int = 1) -> Hit | None:
    """As ``align_many`` for one read of any length, in windows that overlap by all that an alignment can span."""
    span = reach(query, scores)
    width = max(2 * span, CELLS // (2 * (len(query) + 1)))
    best, order = None, None
    for a in range(0, max(1, len(read) - span), width - span):
        (hit,) = align_many(query, [read[a : a + width]], scores, least)
        if hit:
            score, qs, qe, ss, se, *rest = hit
            if order is None or (-score, qe, se + a) < order:
                best, order = (score, qs, qe, ss + a, se + a, *rest), (-score, qe, se + a)
    return best


def align_many(query: bytes, reads: list[bytes], scores: tuple[int, int, int, int] = SCORES, least: int = 1) -> list[Hit | None]:
    """Best local alignment of ``query`` with each read: score, qstart, qend, sstart, send, mismatches, gaps, and both rows.

    Positions are from 1. Of equal scores, the one that ends first on the query, then on the read, is taken. Scores below
    ``least`` count as none, and are not traced back.
    """
    match, miss, first, more = scores
    width = max(map(len, reads), default=0)
    if not width or not query:
        return [None] * len(reads)
    codes = _codes(reads, width)
    n, m = len(reads), len(query)
    h = np.zeros((m + 1, n, width + 1), np.int32)
    down = np.full((n, width + 1), -(1 << 20), np.int32)  # gaps that run along the query
    downs = np.empty((m + 1, n, width + 1), np.int32)
    downs[0] = down
    for i, c in enumerate(query, 1):
        down = np.maximum(h[i - 1] + first, down + more)
        step = np.where((codes == c) & (c != 78), match, miss).astype(np.int32)
        row = np.maximum(down, 0)
        row[:, 1:] = np.maximum(row[:, 1:], h[i - 1][:, :-1] + step)
        row[:, 0] = 0
        row = np.maximum(row, _gap_cost(row, first, more))
        h[i], downs[i] = row, down
    lengths = np.array([len(r) for r in reads])
    flat = np.where(np.arange(width + 1)[None, None, :] <= lengths[None, :, None], h, 0).transpose(1, 0, 2).reshape(n, -1)
    best = flat.argmax(axis=1)
    good = flat[np.arange(n), best] >= max(least, 1)
    return [_way_back(query, r, h[:, k], downs[:, k], int(b) // (width + 1), int(b) % (width + 1), scores) if ok else None for k, (r, b, ok) in enumerate(zip(reads, best, good, strict=True))]


def _way_back(query: bytes, read: bytes, h: np.ndarray, down: np.ndarray, i: int, j: int, scores: tuple[int, int, int, int]):
    match, miss, first, more = scores
    score, qend, send = int(h[i, j]), i, j
    top, low = [], []
    while i and j and h[i, j] > 0:
        here = h[i, j]
        if here == h[i - 1, j - 1] + (match if query[i - 1] == read[j - 1] and query[i - 1] != 78 else miss):
            i, j = i - 1, j - 1
            top.append(query[i])
            low.append(read[j])
        elif here == down[i, j]:  # the read lacks bases of the query
            while True:
                opened = down[i, j] == h[i - 1, j] + first
                i -= 1
                top.append(query[i])
                low.append(45)
                if opened:
                    break
        else:  # the read has bases more
            k = 1
            while here != h[i, j - k] + first + (k - 1) * more:
                k += 1
            for _ in range(k):
                j -= 1
                top.append(45)
                low.append(read[j])
    q, s = bytes(reversed(top)), bytes(reversed(low))
    mismatches = sum(a != b and a != 45 and b != 45 for a, b in zip(q, s, strict=True))
    gaps = sum(x == 45 and (k == 0 or r[k - 1] != 45) for r in (q, s) for k, x in enumerate(r))
    return score, i + 1, qend, j + 1, send, mismatches, gaps, q.decode(), s.decode()


def _numbered(seqs: list[list[str]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each list, (row, word) of every place of a word of length ``k``; equal numbers are equal words in all lists."""
    texts = [np.frombuffer("".join(x).encode("utf-32-le"), np.uint32) for x in seqs]
    seen = np.zeros(1 + max((int(x.max()) for x in texts if len(x)), default=0), bool)
    for x in texts:
        seen[x] = True
    letters, rank = max(1, int(seen.sum())), np.cumsum(seen) - 1
    rows, codes = [], []
    for x, of in zip(texts, seqs, strict=True):
        sizes = np.fromiter(map(len, of), np.int64, len(of))
        row, ends = np.repeat(np.arange(len(of)), sizes), np.cumsum(sizes)
        at = np.flatnonzero(np.arange(len(x)) + k <= ends[row])
        rows.append((row[at], at))
        codes.append(rank[x].astype(np.int64))
    found, most = [np.zeros(len(at), np.int64) for _, at in rows], 1
    for j in range(k):
        if most * letters >= 1 << 62:  # too many possible words for a number: those that occur are numbered anew
            known = np.unique(np.concatenate(found))
            found, most = [np.searchsorted(known, f) for f in found], len(known)
        found, most = [f * letters + c[at + j] for f, c, (_, at) in zip(found, codes, rows, strict=True)], most * letters
    return [(row, f) for f, (row, _) in zip(found, rows, strict=True)]


def _seeded(queries: list[bytes], reads: list[bytes], seed: int) -> list[list[int]]:
    """For each query, the reads that share a word of length ``seed`` with it; the reads' words are looked up once for all queries."""
    (row, word), (query, theirs) = _numbered([[x.decode("latin-1") for x in side] for side in (reads, queries)], seed)
    pairs = np.unique(theirs * len(queries) + query)
    theirs, query = pairs // len(queries), pairs % len(queries)
    known, first, n = np.unique(theirs, return_index=True, return_counts=True)
    if not len(known):
        return [[] for _ in queries]
    at = np.minimum(np.searchsorted(known, word), len(known) - 1)
    hit = known[at] == word
    pairs = np.unique(at[hit] * len(reads) + row[hit])  # a word counts once a read
    at, row = pairs // len(reads), pairs % len(reads)
    many = n[at]
    of = query[np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())]
    pairs = np.unique(of * len(reads) + np.repeat(row, many))
    cuts = np.searchsorted(pairs, np.arange(len(queries) + 1) * len(reads))
    return [(pairs[a:z] % len(reads)).tolist() for a, z in zip(cuts, cuts[1:])]


def align_reads(reads: DataFrame, references: list[tuple[str, str]], seed: int = 0, min_score: int = 1, scores: tuple[int, int, int, int] = SCORES) -> DataFrame:
    """The best hit of each reference (id, sequence) with each row of ``reads`` (id, seq), on either strand; see HITS.

    With ``seed`` a pair needs a common word of that length. Null and empty sequences have no hits. Reads are dealt out
    evenly first, since a small file of short reads, which one task would read, is much work.
    A read that is too long for the cells is aligned in windows, so memory is bounded whatever its length.
    """
    known = [(name, seq.upper().encode()) for name, seq in references]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            names = x.column(0).to_pylist()
            seqs = [(s or "").upper().encode() for s in x.column(1).to_pylist()]
            order = sorted((k for k, s in enumerate(seqs) if s), key=lambda k: len(seqs[k]))
            out: list[tuple] = []
            at = 0
            while at < len(order):
                longest = max((len(q) for _, q in known), default=1)
                b = at + 1  # reads of similar length, as many as the cells allow
                while b < len(order) and (b + 1 - at) * (len(seqs[order[b]]) + 1) * (longest + 1) * 2 <= CELLS:
                    b += 1
                run_of = order[at:b]
                at = b
                both = [(k, strand, seqs[k] if strand == "+" else seqs[k].translate(_COMPLEMENT)[::-1]) for k in run_of for strand in "+-"]
                picked = _seeded([q for _, q in known], [s for _, _, s in both], seed) if seed and known else [range(len(both))] * len(known)
                for (name, query), some in zip(known, picked, strict=True):
                    found: dict[int, tuple] = {}
                    wide = len(run_of) == 1 and (len(seqs[run_of[0]]) + 1) * (longest + 1) * 2 > CELLS
                    hits = [align_long(query, both[i][2], scores, min_score) for i in some] if wide else align_many(query, [both[i][2] for i in some], scores, min_score)
                    for i, hit in zip(some, hits, strict=True):
                        k, strand, _ = both[i]
                        if hit and (k not in found or hit[0] > found[k][1][0]):
                            found[k] = (strand, hit)
                    for k, (strand, (score, qs, qe, ss, se, mis, gaps, q, s)) in found.items():
                        n = len(seqs[k])
                        a, z = (ss, se) if strand == "+" else (n - ss + 1, n - se + 1)
                        out.append((name, names[k], qs, qe, len(query), a, z, n, mis, gaps, score, s, q))
            fields = [f.split() for f in HITS.split(", ")]
            kinds = {"string": pa.string(), "int": pa.int32()}
            columns = list(zip(*out, strict=True)) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields, strict=True)], [f for f, _ in fields])

    rows = reads.select(F.col("id").cast("string").alias("id"), F.col("seq").cast("string").alias("seq"))
    spark = reads.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return rows.repartition(parts).mapInArrow(run, HITS)


#: Letters of a block of sequences, and rows that are joined at once, where sequences are compared by their words.
LETTERS, JOINED = 2_000_000, 4_000_000


def _words(seqs: list[list[str]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """As ``_numbered``, each word once a row; sorted by row."""
    out = []
    for row, f in _numbered(seqs, k):
        order = np.lexsort((f, row))
        f, row = f[order], row[order]
        new = np.ones(len(f), bool)
        new[1:] = (f[1:] != f[:-1]) | (row[1:] != row[:-1])
        out.append((row[new], f[new]))
    return out


def _common(left: tuple[pa.Array, pa.Array], right: tuple[pa.Array, pa.Array], k: int) -> Iterator[tuple[pa.Array, pa.Array, np.ndarray]]:
    """Ids of both sides and the number of common words, for the pairs of two blocks (ids, sequences) that have any."""
    names, seqs, owner = [], [], []
    for ids, texts in (left, right):
        known = ids.dictionary_encode(null_encoding="encode")
        of = known.indices.to_numpy()
        order = np.argsort(of, kind="stable")  # rows of one id are neighbours
        names.append(known.dictionary)
        owner.append(of[order])
        seqs.append(texts.take(pa.array(order)).to_pylist())
    (row, word), (other, theirs) = _words(seqs, k)
    row, other = owner[0][row], owner[1][other]
    order = np.argsort(theirs, kind="stable")
    theirs, other = theirs[order], other[order]
    order = np.argsort(word, kind="stable")  # sorted words are found faster
    first, n = np.empty(len(word), np.int64), np.empty(len(word), np.int64)
    first[order] = np.searchsorted(theirs, word[order])
    n[order] = np.searchsorted(theirs, word[order], "right") - first[order]
    hit = n > 0
    row, first, n = row[hit], first[hit], n[hit]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.empty(0, np.int64)
    before = np.r_[0, np.cumsum(n)]
    a = 0
    while a < len(starts):  # whole ids, as many as may be joined at once
        b = max(a + 1, int(np.searchsorted(before[starts], before[starts[a]] + JOINED, "right")) - 1)
        if b >= len(starts) - 1 and before[-1] - before[starts[a]] <= JOINED:
            b = len(starts)
        x, z = starts[a], starts[b] if b < len(starts) else len(row)
        many = n[x:z]
        at = np.arange(before[z] - before[x]) + np.repeat(first[x:z] - (before[x:z] - before[x]), many)
        pairs = np.repeat(row[x:z].astype(np.int64) * len(names[1]), many) + other[at]
        pairs.sort()
        new = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        counts, pairs = np.diff(np.r_[new, len(pairs)]), pairs[new]
        yield names[0].take(pa.array(pairs // len(names[1]))), names[1].take(pa.array(pairs % len(names[1]))), counts
        a = b


def shared_words(left: DataFrame, right: DataFrame, k: int = 11) -> DataFrame:
    """Pairs of ids with the number of distinct words of length ``k`` that both sequences have: the seed phase as a join.

    Rows are dealt out by id to blocks of about ``LETTERS`` letters, and every pair of blocks meets in one task, which
    joins their words in parts: memory is bounded, and neither words nor single matches are shuffled. Of a table with
    itself each two blocks meet once. The pairs themselves grow with the square of the rows.
    """
    same = left is right
    kind, other = left.schema["id"].dataType.simpleString(), right.schema["id"].dataType.simpleString()
    long = [df.where(F.length("seq") >= k).select("id", "seq") for df in ([left] if same else [left, right])]
    letters = [df.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0] for df in long]
    blocks = [max(1, -(-n // LETTERS), min(4, -(-n * 8 // LETTERS))) for n in letters]
    (nl, nr), (l, r) = (blocks * 2)[:2], (long * 2)[:2]
    mine = lambda n: F.pmod(F.hash("id"), F.lit(n))
    line, none = (lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))), lambda t: F.lit(None).cast(t)
    a = l.select("id", "seq", mine(nl).alias("_a"), line(nr).alias("_b")).select("_a", "_b", F.lit(0).alias("_side"), F.col("id").alias("left_id"), none(other).alias("right_id"), "seq")
    b = r.select("id", "seq", mine(nr).alias("_b"), line(nl).alias("_a")).select("_a", "_b", F.lit(1).alias("_side"), none(kind).alias("left_id"), F.col("id").alias("right_id"), "seq")
    met = a.unionByName(b).withColumn("_pair", F.col("_a") * nr + F.col("_b"))
    met = met.where("_a < _b or _a = _b and _side = 0") if same else met

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(pair: int, held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = pa.Table.from_batches(held)
            one = [table.filter(pa.compute.equal(table["_side"], s)) for s in (0, 1)]
            alone = same and pair // nr == pair % nr
            sides = [(x[name].combine_chunks(), x["seq"].combine_chunks()) for x, name in ((one[0], "left_id"), (one[0] if alone else one[1], "left_id" if alone else "right_id"))]
            for ids, others, n in _common(*sides, k):
                for start in range(0, len(n), 100_000):
                    x, y, c = (z.slice(start, 100_000) for z in (ids, others, pa.array(n, pa.int64())))
                    for p, q in ((x, y), (y, x)) if same and not alone else ((x, y),):
                        yield pa.RecordBatch.from_arrays([p, q, c], ["left_id", "right_id", "n_words"])

        at, held = -1, []
        for batch in batches:
            pairs = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]]) if len(pairs) else []
            for x, z in zip(cuts, [*cuts[1:], len(pairs)], strict=True):
                if pairs[x] != at:
                    if held:
                        yield from done(at, held)
                    at, held = int(pairs[x]), []
                held.append(batch.slice(x, z - x))
        if held:
            yield from done(at, held)

    rows = met.select("_pair", "_side", "left_id", "right_id", "seq").repartition(min(nl * nr, 4096), "_pair").sortWithinPartitions("_pair")
    return rows.mapInArrow(run, f"left_id {kind}, right_id {other}, n_words long")
