"""Scalar functions on DNA strings, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases that fit into one packed number, two bits each.
PACKED = 30
_LOW_BITS = int("01" * 31, 2)


def complement(bases: Column) -> Column:
    """A<->T, C<->G; anything else stays."""
    return F.translate(bases, "ATCGatcg", "TAGCtagc")


def reverse_complement(bases: Column) -> Column:
    return F.reverse(complement(bases))


def count_unknown(bases: Column) -> Column:
    """Number of N."""
    return F.length(bases) - F.length(F.replace(bases, F.lit("N"), F.lit("")))


def packed(bases: Column) -> Column:
    """Up to ``PACKED`` bases as a number in base 4 with A 0, T 1, C 2, G 3; N counts as A (see ``unknown_bits``)."""
    return F.conv(F.translate(bases, "ATCGN", "01230"), 4, 10).cast("long")


def kmer_code(bases: Column, length: int) -> Column:
    """The number of a k-mer, -1 if it has another length or holds anything but the four bases."""
    return F.when((F.length(bases) == length) & bases.rlike("^[ATCG]*$"), packed(bases)).otherwise(F.lit(-1).cast("long"))


def unknown_bits(bases: Column) -> Column:
    """A 1 in the lower bit of every packed base that is N."""
    return F.when(F.instr(bases, "N") > 0, F.conv(F.translate(bases, "ATCGN", "00001"), 4, 10).cast("long")).otherwise(F.lit(0).cast("long"))


def packed_distance(x: Column, y: Column, unknown: Column | None = None) -> Column:
    """Mismatches between two packed strings of one length; ``unknown`` marks bases that match nothing."""
    differ = x.bitwiseXOR(y)
    low = differ.bitwiseOR(F.shiftrightunsigned(differ, 1)).bitwiseAND(F.lit(_LOW_BITS))
    return F.bit_count(low if unknown is None else low.bitwiseOR(unknown))


def hamming(a: Column, b: Column) -> Column:
    """Mismatches between two strings of one length, of any content."""
    pairs = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.aggregate(pairs, F.lit(0), lambda s, x: s + x)


def bases_at(sequence_bytes: Column, start0: Column, length: Column | int) -> Column:
    """``length`` bases from a 0-based start. The sequence is binary, so that the cost doesn't depend on the start."""
    size = F.lit(length) if isinstance(length, int) else length
    return F.substring(sequence_bytes, start0 + 1, size).cast("string")
