"""Reads from a genome, and every place where they match with few substitutions.

A genome is ``chr, seq``; starts are 1-based in results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinstrand.functions.dna import PACKED, bases_at, count_unknown, packed, packed_distance, reverse_complement, unknown_bits
from kinstrand.operators.entries import ANCHORS
from kinstrand.operators.intervals import stab_join, union_runs
from kinstrand.plans.storage import materialize


def genome_stats(genome: DataFrame) -> DataFrame:
    return genome.select("chr", F.length("seq").cast("long").alias("length"), count_unknown(F.col("seq")).cast("long").alias("n_unknown"))


#: Bases of a genome in one tile.
TILE = 1 << 16


def tiles(genome: DataFrame, overlap: int = 0, size: int = TILE) -> DataFrame:
    """``chr, first, b, length``: pieces of ``size`` bases from 0-based ``first`` on and ``overlap`` more, spread over the
    tasks of a shuffle, so that nothing after this handles a chromosome as one value. ``length``: of the chromosome."""
    n = F.length("seq")
    firsts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size)))
    cut = genome.select("chr", F.col("seq").cast("binary").alias("b"), n.alias("length"), F.explode(firsts).alias("first"))
    cut = cut.select("chr", "first", F.substring("b", F.col("first") + 1, F.lit(size + overlap)).alias("b"), "length")
    return cut.repartition(int(genome.sparkSession.conf.get("spark.sql.shuffle.partitions")), "chr", "first")


def windows(genome: DataFrame, length: int, stride: int = 1, offset: int = 0, size: int = TILE) -> DataFrame:
    """``chr, p, w``: windows from 0-based ``offset`` on, every ``stride``; the very last position is not a window."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    # the first window of a tile, and its last one: within the tile and short of the very last position
    low = F.greatest(F.col("first"), F.lit(offset))
    start = low + F.pmod(F.lit(offset) - low, F.lit(stride))
    last = F.least(F.col("first") + size, F.col("length") - length) - 1
    each = tiles(genome, length - 1, size).select("chr", "first", "b", F.explode(F.when(last >= start, F.sequence(start, last, F.lit(stride)))).alias("p"))
    return each.select("chr", F.col("p").cast("long").alias("p"), bases_at(F.col("b"), F.col("p") - F.col("first"), length).alias("w"))


def reference_under(spans: DataFrame, genome: DataFrame, size: int = TILE) -> DataFrame:
    """``chr, start, span, reference``: the genome's bases of each different span (1-based start), put together from the
    tiles that it touches. A genome may come in pieces: ``at`` is then where each begins, a multiple of ``size`` from 0."""
    from_tile, to_tile = F.floor((F.col("start") - 1) / size) * size, F.floor((F.col("start") + F.col("span") - 2) / size) * size
    touched = spans.select("chr", "start", "span").distinct().where("span > 0 AND start > 0").withColumn("first", F.explode(F.sequence(from_tile, to_tile, F.lit(size).cast("long"))))
    whole = genome if "at" in genome.columns else genome.withColumn("at", F.lit(0))
    names = F.struct("chr", F.col("at").cast("long").alias("at"))
    cut = tiles(whole.select(names.alias("chr"), "seq"), 0, size).select("chr.chr", (F.col("chr.at") + F.col("first")).alias("first"), "b")
    both = touched.join(cut, ["chr", "first"])
    inside = F.greatest(F.col("start") - 1 - F.col("first"), F.lit(0))
    until = F.least(F.col("start") - 1 + F.col("span") - F.col("first"), F.lit(size))
    pieces = both.select("chr", "start", "span", "first", F.substring("b", (inside + 1).cast("int"), (until - inside).cast("int")).cast("string").alias("piece"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "piece"))), lambda x: x["piece"]), "")
    return pieces.groupBy("chr", "start", "span").agg(joined.alias("reference"))


def read_name(length: int, chromosome: Column, start: Column) -> Column:
    return F.concat(F.lit(f">T{length};"), chromosome.cast("string"), F.lit(":"), start.cast("string"), F.lit("-"), (start + length - 1).cast("string"))


def generate_reads(genome: DataFrame, length: int, divisor: int, offset: int = 0) -> DataFrame:
    """Every ``divisor``-th window without N: ``read_name, chr, start, end, seq``."""
    clean = windows(genome, length, divisor, offset).where(~F.col("w").contains("N"))
    start = F.col("p") + 1
    return clean.select(read_name(length, F.col("chr"), start).alias("read_name"), "chr", start.alias("start"), (F.col("p") + length).alias("end"), F.col("w").alias("seq"))


def generate_pairs(genome: DataFrame, length: int, divisor: int, insert: int, offset: int = 0) -> DataFrame:
    """Pairs whose outer distance is ``insert``; the second read is reverse-complemented. Neither has N."""
    if insert < length:
        raise ValueError("an insert is at least a read long")
    whole = windows(genome, insert, divisor, offset)
    one, two = F.substring("w", 1, length), F.substring("w", insert - length + 1, length)
    pairs = whole.select("chr", (F.col("p") + 1).alias("start"), (F.col("p") + insert - length + 1).alias("start2"), one.alias("seq"), two.alias("raw2"))
    clean = pairs.where(~F.col("seq").contains("N") & ~F.col("raw2").contains("N"))
    name = F.concat(read_name(length, F.col("chr"), F.col("start")), F.lit(";"), F.substring_index(read_name(length, F.col("chr"), F.col("start2")), ";", -1))
    return clean.select(name.alias("read_name"), "chr", "start", "start2", "seq", reverse_complement(F.col("raw2")).alias("seq2"))


def within_regions(reads: DataFrame, bed: DataFrame) -> DataFrame:
    """Reads both ends of which lie in ``bed`` (chr, start0, end0 half-open)."""
    regions = union_runs(bed.select("chr", (F.col("start0") + 1).alias("s"), F.col("end0").alias("e")), ["chr"], "s", "e").withColumnRenamed("chr", "bed_chr")
    columns = reads.columns
    kept = stab_join(reads, regions, [("chr", "bed_chr")], F.col("start"), (F.col("s"), F.col("e"))).select(*columns)
    return stab_join(kept, regions, [("chr", "bed_chr")], F.col("end"), (F.col("s"), F.col("e"))).select(*columns)


def kmer_counts(genome: DataFrame, k: int) -> DataFrame:
    """Occurrences of each k-mer without N; as in ``windows``, the very last position is left out."""
    return windows(genome, k).where(F.col("w").rlike("^[ATCG]*$")).groupBy(F.col("w").alias("kmer")).agg(F.count("*").alias("n"))


def _seeded(df: DataFrame, length: int, ear: int, prefix: str) -> DataFrame:
    """The seed (head and tail of a window) and what is between, packed."""
    w = F.col("w")
    seed = F.concat(F.substring(w, 1, ear), F.substring(w, length - ear + 1, ear))
    middle = [(k, min(PACKED, length - ear - k)) for k in range(ear, length - ear, PACKED)]
    out = [packed(F.substring(w, k + 1, n)).alias(f"{prefix}m{i}") for i, (k, n) in enumerate(middle)]
    out += [unknown_bits(F.substring(w, k + 1, n)).alias(f"{prefix}u{i}") for i, (k, n) in enumerate(middle)]
    # a seed with N finds nothing
    key = packed(seed) if 2 * ear <= PACKED else seed
    return df.where(~seed.contains("N")).select(*(c for c in df.columns if c != "w"), key.alias("seed"), *out)


def hits(reads: DataFrame, genome: DataFrame, length: int, ear: int, mismatches: int, both_strands: bool = False) -> DataFrame:
    """Every window that a read (chr, start, seq) matches: same head and tail of ``ear`` bases, at most ``mismatches``
    differing bases in between. The read's own place is no hit.

    Returns ``origin_chr, origin_start`` (the read), ``align_chr, align_start``, ``strand``, ``mismatches``. The join is on
    the seed alone; windows travel as packed numbers.
    """
    asked = reads.select(F.col("chr").alias("origin_chr"), F.col("start").alias("origin_start"), F.lit("+").alias("strand"), F.col("seq").alias("w"))
    if both_strands:
        asked = asked.unionByName(asked.withColumn("strand", F.lit("-")).withColumn("w", reverse_complement(F.col("w"))))
    left = _seeded(asked, length, ear, "a")
    right = _seeded(windows(genome, length).select(F.col("chr").alias("align_chr"), (F.col("p") + 1).alias("align_start"), "w"), length, ear, "b")
    n = len(range(ear, length - ear, PACKED))
    distance = sum((packed_distance(F.col(f"am{i}"), F.col(f"bm{i}"), F.col(f"au{i}").bitwiseOR(F.col(f"bu{i}"))) for i in range(n)), F.lit(0))
    found = left.join(right, "seed").withColumn("mismatches", distance.cast("int")).where(F.col("mismatches") <= mismatches)
    own = (F.col("strand") == "+") & (F.col("origin_chr") == F.col("align_chr")) & (F.col("origin_start") == F.col("align_start"))
    return found.where(~own).select("origin_chr", "origin_start", "align_chr", "align_start", "strand", "mismatches")


def cap_hits(found: DataFrame, reads: DataFrame, too_many: int, close: int = 1) -> tuple[DataFrame, DataFrame]:
    """Hits of reads with at most ``too_many`` close hits (at most ``close`` mismatches), and the other reads, which count
    as unmapped at their own place."""
    key = ["origin_chr", "origin_start"]
    over = found.where(F.col("mismatches") <= close).groupBy(*key).agg(F.count("*").alias("n_close")).where(F.col("n_close") > too_many)
    names = reads.select(F.col("chr").alias("origin_chr"), F.col("start").alias("origin_start"))
    return found.join(over, key, "left_anti"), names.join(over, key).select(*key, "n_close")


def capped_hits(reads: DataFrame, genome: DataFrame, length: int, ear: int, mismatches: int, too_many: int, both_strands: bool = False, close: int = 1) -> tuple[DataFrame, DataFrame]:
    """``hits`` and ``cap_hits`` in one, without building the hits of reads over the cap.

    Reads with over ``too_many`` exact copies are over the cap without being joined, so that no seed joins more copies of
    itself than that. The others' close hits are only counted, where they are found; who is over the cap then is stored, and
    only the rest is joined for all hits.
    """
    key = ["origin_chr", "origin_start"]
    named = [F.col("chr").alias("origin_chr"), F.col("start").alias("origin_start")]
    copies = windows(genome, length).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") - 1 > too_many)
    crowded = materialize(copies.withColumnRenamed("w", "seq"), "crowded-windows")
    few = reads.join(crowded.select("seq"), "seq", "left_anti")
    near = hits(few, genome, length, ear, min(close, mismatches), both_strands).groupBy(*key).agg(F.count("*").alias("n_close")).where(F.col("n_close") > too_many)
    over = materialize(near, "over-the-cap")
    kept = few.join(over.select(F.col("origin_chr").alias("chr"), F.col("origin_start").alias("start")), ["chr", "start"], "left_anti")
    certain = reads.join(crowded, "seq").select(*named, (F.col("n") - 1).alias("n_close"))
    return hits(kept, genome, length, ear, mismatches, both_strands), over.unionByName(certain)


def unaligned(reads: DataFrame, found: DataFrame) -> DataFrame:
    """Reads without a hit, fused into regions ``chr, start0, end0``."""
    key = ["origin_chr", "origin_start"]
    lost = reads.select(F.col("chr").alias("origin_chr"), F.col("start").alias("origin_start"), "end").join(found.select(*key).distinct(), key, "left_anti")
    runs = union_runs(lost.select(F.col("origin_chr").alias("chr"), F.col("origin_start").alias("s"), F.col("end").alias("e")), ["chr"], "s", "e")
    return runs.select("chr", (F.col("s") - 1).alias("start0"), F.col("e").alias("end0"))


def anchors_between(align_seq: Column, origin_seq: Column, strand: Column, align_start: Column, origin_start: Column, length: int) -> Column:
    """An anchor for every base in which the align region differs from the origin region (both as the genome has them)."""
    seen = F.when(strand == "+", origin_seq).otherwise(reverse_complement(origin_seq))
    turned = lambda base: F.when(strand == "+", base).otherwise(F.translate(base, "ATCG", "TAGC"))

    def one(i: Column) -> Column:
        a, o = F.substring(align_seq, i + 1, F.lit(1)), F.substring(seen, i + 1, F.lit(1))
        position = F.when(strand == "+", origin_start + i).otherwise(origin_start + length - 1 - i)
        return F.struct(
            (align_start + i).cast("long").alias("align_pos"), position.cast("long").alias("origin_pos"), a.alias("align_ref"), o.alias("align_alt"),
            turned(o).alias("origin_ref"), turned(a).alias("origin_alt"),
        )

    each = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), one)
    return F.filter(each, lambda x: x["align_ref"] != x["align_alt"]).cast(ANCHORS)


def entries_of_hits(found: DataFrame, genome: DataFrame, length: int) -> DataFrame:
    """Hits as entries with anchors. Sequences are fetched by joins on windows, once for either side."""
    w = windows(genome, length).select("chr", (F.col("p") + 1).alias("start"), "w")
    both = found.join(w.select(F.col("chr").alias("align_chr"), F.col("start").alias("align_start"), F.col("w").alias("_a")), ["align_chr", "align_start"]).join(
        w.select(F.col("chr").alias("origin_chr"), F.col("start").alias("origin_start"), F.col("w").alias("_o")), ["origin_chr", "origin_start"]
    )
    anchors = anchors_between(F.col("_a"), F.col("_o"), F.col("strand"), F.col("align_start"), F.col("origin_start"), length)
    end = lambda c: (F.col(c) + length - 1)
    return both.select(
        "align_chr", "align_start", end("align_start").alias("align_end"), "origin_chr", "origin_start", end("origin_start").alias("origin_end"),
        F.col("mismatches").alias("penalty"), "strand", anchors.alias("anchors"),
    )


def sam_rows(found: DataFrame, length: int) -> DataFrame:
    """Hits as alignment rows: flags tell strand and whether the place is the read's own; mapping quality is the number of
    matching bases."""
    primary = (F.col("origin_chr") == F.col("align_chr")) & (F.col("origin_start") == F.col("align_start")) & (F.col("strand") == "+")
    flag = F.when(F.col("strand") == "-", 16).otherwise(0) + F.when(primary, 0).otherwise(256)
    return found.select(
        _qname(length).alias("qname"), flag.alias("flag"), F.col("align_chr").cast("string").alias("rname"),
        F.col("align_start").alias("pos"), (F.lit(length) - F.col("mismatches")).alias("mapq"), F.lit(f"{length}M").alias("cigar"), F.repeat(F.lit("s"), F.lit(length)).alias("qual"),
    )


def _qname(length: int) -> Column:
    return F.substring(read_name(length, F.col("origin_chr"), F.col("origin_start")), 2, 1 << 20)


def all_sam_rows(reads: DataFrame, found: DataFrame, over: DataFrame, length: int) -> DataFrame:
    """Every read in ``sam_rows``: its own place, which is primary, and its hits; or, with too many close hits, one row
    that is unmapped."""
    key = ["origin_chr", "origin_start"]
    names = reads.select(F.col("chr").alias("origin_chr"), F.col("start").alias("origin_start"))
    crowded = over.select(*key).distinct()
    own = names.join(crowded, key, "left_anti").select(*key, F.col("origin_chr").alias("align_chr"), F.col("origin_start").alias("align_start"), F.lit("+").alias("strand"), F.lit(0).alias("mismatches"))
    lost = crowded.select(
        _qname(length).alias("qname"), F.lit(4).alias("flag"), F.lit("*").alias("rname"), F.lit(0).cast("long").alias("pos"), F.lit(0).alias("mapq"), F.lit("*").alias("cigar"), F.repeat(F.lit("s"), F.lit(length)).alias("qual")
    )
    return sam_rows(own.unionByName(found.select(*own.columns)), length).unionByName(lost)
