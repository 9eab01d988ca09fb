"""Sequence files as DataFrames (id, seq, ordinal): FASTA, FASTQ, BAM; split and read by Spark, from any of its stores."""

from __future__ import annotations

import math
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _records(spark: SparkSession, path: str | list[str], mark: str) -> DataFrame:
    """Records that begin with ``mark`` at the start of a line, without it, with plain line ends."""
    rows = spark.read.option("lineSep", f"\n{mark}").text(path)
    return rows.select(F.regexp_replace(F.regexp_replace("value", "\r", ""), f"^{mark}|\n+$", "").alias("value"))


def read_fasta(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id is the first word of the header line. ordinal rises with the order in a file that is read in one piece."""
    rows = _records(spark, path, ">").where("trim(value) <> ''")
    parts = rows.select(F.split("value", "\n", 2).alias("p"))
    seq = F.regexp_replace(F.coalesce(F.get("p", F.lit(1)), F.lit("")), r"\s", "")
    return parts.select(F.regexp_extract(F.col("p")[0], r"^\s*(\S*)", 1).alias("id"), seq.alias("seq"), F.monotonically_increasing_id().alias("ordinal"))


def read_fastq(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Four-line records without their qualities. A quality line that begins with @ splits off and is left out."""
    lines = F.split("value", "\n")
    rows = _records(spark, path, "@").select(lines.alias("p")).where((F.size("p") >= 3) & F.col("p")[2].startswith("+"))
    return rows.select(F.regexp_extract(F.col("p")[0], r"^\s*(\S*)", 1).alias("id"), F.trim(F.col("p")[1]).alias("seq"), F.monotonically_increasing_id().alias("ordinal"))


#: The letters of four-bit bases, and the sizes of tag values by type.
_BASES, _SIZES = "=ACMGRSVTWYHKDBN", {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_LETTERS = str.maketrans("0123456789abcdef", _BASES)
_NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}


def unblocked(data: bytes | memoryview, step: int = 1 << 16) -> Iterator[bytes]:
    """The content of a file of gzip members, one after the other, in time that grows with the file.

    A member that tells its size in the extra field BC is cut out by it; others are fed in steps until they end.
    """
    view = memoryview(data)
    at, end = 0, len(view)
    while at < end:
        extra = struct.unpack_from("<H", view, at + 10)[0] if at + 18 <= end and view[at + 3] & 4 else 0
        if extra >= 6 and bytes(view[at + 12 : at + 16]) == b"BC\x02\x00":
            size = struct.unpack_from("<H", view, at + 16)[0] + 1
            yield zlib.decompress(view[at : at + size], 31)
            at += size
            continue
        member = zlib.decompressobj(31)
        while at < end and not member.eof:
            part = view[at : at + step]
            yield member.decompress(part)
            at += len(part) - len(member.unused_data)


def mean_quality(qualities: bytes) -> float | None:
    """The quality that belongs to the mean error probability; None where there are no qualities."""
    if not qualities or qualities[0] == 255:
        return None
    return -10 * math.log10(sum(qualities.count(q) * 10 ** (-q / 10) for q in set(qualities)) / len(qualities))


class _Stream:
    """Bytes from parts that come one after the other; what was read is let go."""

    def __init__(self, parts: Iterator[bytes]):
        self.parts, self.held, self.at = parts, b"", 0

    def take(self, n: int) -> bytes:
        """The next ``n`` bytes; fewer at the end."""
        if len(self.held) - self.at < n:
            have = [self.held[self.at :]]
            size = len(have[0])
            while size < n and (part := next(self.parts, None)) is not None:
                have.append(part)
                size += len(part)
            self.held, self.at = b"".join(have), 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def number(self) -> int:
        return struct.unpack("<i", self.take(4))[0]


def bam_records(data: bytes | memoryview) -> Iterator[tuple[str, str, int | None, float | None]]:
    """Name, sequence, tag dx and mean quality of every record; about a record is held inflated at a time."""
    stream = _Stream(unblocked(data))
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(stream.number())
    for _ in range(stream.number()):
        stream.take(stream.number() + 4)
    while len(head := stream.take(4)) == 4:
        record = stream.take(struct.unpack("<i", head)[0])
        _, _, name_size, _, _, cigar, _, n = struct.unpack_from("<iiBBHHHi", record)
        p = 32 + name_size + 4 * cigar
        name = record[32 : 32 + name_size - 1].decode()
        seq = record[p : p + (n + 1) // 2].hex().translate(_LETTERS)[:n]
        p += (n + 1) // 2
        quality = mean_quality(record[p : p + n])
        yield name, seq, _tag_dx(record, p + n), quality


def _tag_dx(record: bytes, p: int) -> int | None:
    """The value of the tag dx, if it is a number."""
    while p < len(record):
        tag, kind = record[p : p + 2], chr(record[p + 2])
        p += 3
        if tag == b"dx" and kind in _NUMBERS:
            return struct.unpack_from("<" + _NUMBERS[kind], record, p)[0]
        if kind in "ZH":
            p = record.index(b"\0", p) + 1
        elif kind == "B":
            p += 5 + _SIZES[chr(record[p])] * struct.unpack_from("<i", record, p + 1)[0]
        else:
            p += _SIZES[kind]
    return None


def read_bam(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """id, seq, dx (null without the tag) and mean_q. A task takes a file (up to 2 GB) and inflates it block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for content in x.column(0):
                rows: list[tuple] = []
                for record in bam_records(content.as_buffer()):
                    rows.append(record)
                    if len(rows) == 5000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "id string, seq string, dx int, mean_q double")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["id", "seq", "dx", "mean_q"])


def without_parents(reads: DataFrame) -> DataFrame:
    """Without the simplex parents of duplex reads, which carry dx = -1."""
    return reads.where("dx is null or dx <> -1")


def good_quality(reads: DataFrame, least: float = 10) -> DataFrame:
    """Reads with a mean quality of ``least`` or more, or without one."""
    return reads.where(F.col("mean_q").isNull() | (F.col("mean_q") >= F.lit(float(least))))


def size_selected(reads: DataFrame, low: float = 0, high: float = float("inf")) -> DataFrame:
    """Reads whose length lies between the bounds, both included; Spark reads this before any Python function."""
    return reads.where((F.length("seq") >= F.lit(float(low))) & (F.length("seq") <= F.lit(float(high))))
