"""Column functions on sequences, alignment strings and genotype labels. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nucleotide codes and their complements.
CODES, COMPLEMENTS = "ACGTUNRYSWKMBDHVacgtunryswkmbdhv", "TGCAANYRSWMKVHDBtgcaanyrswmkvhdb"
#: Classes of alleles in the order in which a genotype lists them.
CLASSES = ("ref", "sub", "ins", "del", "indel")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def is_dna(seq: Column) -> Column:
    """Whether a string has nucleotide codes, gaps and stops only."""
    return seq.rlike("^[ACGTRYSWKMBDHVNacgtryswkmbdhvn.+-]*$")


def gap_count(seq: Column) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit("-")))


def ungapped(seq: Column) -> Column:
    return F.replace(seq, F.lit("-"), F.lit(""))


def slice_of(seq: Column, first: Column, last: Column) -> Column:
    """Positions first to last, from 1, both included; empty if they cross."""
    return F.substring(seq, first, F.greatest(last - first + 1, F.lit(0)))


def gap_window(ref: Column, read: Column, start: Column, span: int) -> Column:
    """struct(read_seq, ref_seq): the columns of an alignment over the ``span`` reference bases from ``start``, and one more.

    ``start`` counts bases of the reference; gaps before it move it to the right, once. From there the window reaches to
    the base that completes ``span`` bases of the reference, and one column beyond; an alignment that ends before gives
    what is left.
    """
    at = start + gap_count(F.substring(ref, F.lit(1), F.greatest(start - 1, F.lit(0))))
    rest = F.substring(ref, at, F.length(ref))
    whole = F.length(F.regexp_extract(rest, f"^(?:-*[^-]){{{span}}}.?", 0))
    size = F.when(whole > 0, whole).otherwise(F.length(rest))
    return F.struct(F.substring(read, at, size).alias("read_seq"), F.substring(ref, at, size).alias("ref_seq"))


def allele_class(pattern: Column, window: Column, intact: Column) -> Column:
    """ref, sub, ins, del or indel. An insertion shows as a net gain in bases, a deletion as a gap."""
    lost, gained = F.instr(pattern, "-") > 0, F.length(ungapped(pattern)) > F.length(window)
    return F.when(intact, "ref").when(lost & gained, "indel").when(lost, "del").when(gained, "ins").otherwise("sub")


def class_rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), kind).cast("int")


def allele_label(kind: Column, pattern: Column, window: Column, true_indels: bool = False) -> Column:
    """The class with its sizes. For an indel the net gain stands twice; with ``true_indels``, gain and gaps."""
    gain = (F.length(ungapped(pattern)) - F.length(window)).cast("string")
    gaps = gap_count(pattern).cast("string")
    indel = F.concat(F.lit("indel"), gain, F.lit("-"), gaps if true_indels else gain)
    return F.when(kind == "del", F.concat(kind, gaps)).when(kind == "ins", F.concat(kind, gain)).when(kind == "indel", indel).otherwise(kind)


def significant(x: Column, digits: int = 3) -> Column:
    """``x`` rounded to significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def percent(part: Column, whole: Column) -> Column:
    return significant(part / whole) * 100
