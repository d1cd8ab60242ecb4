"""Base counts at loci, and allele frequencies from them.

Reads: read_id, chr, start_pos, end_pos, seq, mapq, unmapped, duplicate and optionally secondary and cigar (parsed; a read
without it is one stretch of matches).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinstrand.functions import cigar as cg
from kinstrand.functions.dna import complement
from kinstrand.operators.intervals import stab_join

BASES = ("A", "T", "C", "G", "N")


def usable(reads: DataFrame, min_mapq: int = -1) -> DataFrame:
    """Mapped, primary, first copies with at least ``min_mapq``."""
    good = ~F.coalesce(F.col("unmapped"), F.lit(False)) & ~F.coalesce(F.col("duplicate"), F.lit(False)) & (F.col("mapq") >= min_mapq) & (F.col("end_pos") >= F.col("start_pos"))
    if "secondary" in reads.columns:
        good &= ~F.coalesce(F.col("secondary"), F.lit(False))
    return reads.where(good)


def read_base(reads: DataFrame, position: Column) -> Column:
    if "cigar" in reads.columns:
        return cg.base_at(F.col("seq"), F.col("cigar"), F.col("start_pos"), position)
    return F.substring("seq", (position - F.col("start_pos") + 1).cast("int"), F.lit(1))


def covering(loci: DataFrame, reads: DataFrame) -> DataFrame:
    """Pairs of a locus (chr, pos, ...) and a read over it, with the read's ``base`` there."""
    side = reads.withColumnRenamed("chr", "read_chr")
    both = stab_join(loci, side, [("chr", "read_chr")], F.col("pos"), (F.col("start_pos"), F.col("end_pos")))
    return both.withColumn("base", read_base(reads, F.col("pos")))


def base_counts(loci: DataFrame, reads: DataFrame, min_mapq: int = -1, keep_uncovered: bool = False) -> DataFrame:
    """A, T, C, G and N of usable reads at each different locus (chr, pos)."""
    places = loci.select("chr", "pos").distinct()
    seen = covering(places, usable(reads, min_mapq)).groupBy("chr", "pos").agg(*(F.count_if(F.col("base") == b).alias(f"n_{b.lower()}") for b in BASES))
    if not keep_uncovered:
        return seen
    counts = [f"n_{b.lower()}" for b in BASES]
    return places.join(seen, ["chr", "pos"], "left").select("chr", "pos", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts))


def count_of(base: Column) -> Column:
    return F.when(base == "A", F.col("n_a")).when(base == "T", F.col("n_t")).when(base == "C", F.col("n_c")).when(base == "G", F.col("n_g")).otherwise(F.lit(0))


def coverage() -> Column:
    return F.col("n_a") + F.col("n_t") + F.col("n_c") + F.col("n_g")


def four_places(x: Column) -> Column:
    """Rounded half up to four places, as a number."""
    return F.floor(x * 10000 + 0.5) / 10000


def four_places_text(x: Column) -> Column:
    """Rounded half to even to four places, as sinks write it."""
    return F.replace(F.format_number(x, 4), F.lit(","), F.lit(""))


def naive_frequency(variants: DataFrame, counts: DataFrame) -> DataFrame:
    """Variants with ``n_alt, cov, naive_baf``: the share of the alternative base; 0 without coverage."""
    both = variants.join(counts, ["chr", "pos"], "left")
    alt, cov = F.coalesce(count_of(F.col("alt_base")), F.lit(0)), F.coalesce(coverage(), F.lit(0))
    return both.select(*variants.columns, alt.alias("n_alt"), cov.alias("cov"), F.when(cov == 0, F.lit(0.0)).otherwise(four_places(alt / cov)).alias("naive_baf"))


def pooled_frequency(variants: DataFrame, links: DataFrame, counts: DataFrame) -> DataFrame:
    """Allele frequency pooled over a variant and its links.

    ``links``: var_id, to_chr, to_pos, to_ref, to_alt. A link's counts are added if its bases are those of the variant, and
    with exchanged strands if they are their complements; others add nothing, but every link counts in the factor n + 1.
    Returns the variants with ``n_links, pooled_alt, pooled_cov, pooled_baf``.
    """
    own = variants.join(counts, ["chr", "pos"], "left").select("var_id", "ref_base", "alt_base", F.coalesce(count_of(F.col("alt_base")), F.lit(0)).alias("alt"), F.coalesce(coverage(), F.lit(0)).alias("cov"))
    there = counts.withColumnRenamed("chr", "to_chr").withColumnRenamed("pos", "to_pos")
    far = links.join(own.select("var_id", "ref_base", "alt_base"), "var_id").join(there, ["to_chr", "to_pos"], "left")
    same = (F.col("to_ref") == F.col("ref_base")) & (F.col("to_alt") == F.col("alt_base"))
    turned = (F.col("to_ref") == complement(F.col("ref_base"))) & (F.col("to_alt") == complement(F.col("alt_base")))
    alt = F.when(same, count_of(F.col("alt_base"))).when(turned, count_of(complement(F.col("alt_base")))).otherwise(0)
    cov = F.when(same | turned, coverage()).otherwise(0)
    added = far.groupBy("var_id").agg(F.count("*").alias("n_links"), F.sum(F.coalesce(alt, F.lit(0))).alias("far_alt"), F.sum(F.coalesce(cov, F.lit(0))).alias("far_cov"))
    both = own.join(added, "var_id", "left")
    n, a, c = F.coalesce("n_links", F.lit(0)), F.col("alt") + F.coalesce("far_alt", F.lit(0)), F.col("cov") + F.coalesce("far_cov", F.lit(0))
    return both.select(
        "var_id", n.cast("long").alias("n_links"), a.cast("long").alias("pooled_alt"), c.cast("long").alias("pooled_cov"),
        F.when(c == 0, F.lit(0.0)).otherwise(four_places((n + 1) * a / c)).alias("pooled_baf"),
    )
