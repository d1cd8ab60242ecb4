"""Comparing calls with a truth set, linking sites into clusters, looking up ids, and smaller table operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinstrand.functions import cigar as cg
from kinstrand.operators.annotate import LINKED, has_filter, is_indel
from kinstrand.operators.entries import is_trivial
from kinstrand.operators.intervals import depth_runs, fuse, out_of_order, overlap_semi, stab_join, union_runs
from kinstrand.plans.graph import connected_components
from kinstrand.plans.storage import leaving_nothing, materialize

_SITE = ["chr", "pos"]


# ---- truth sets ---------------------------------------------------------------------------------------------------


def classify_calls(called: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    """Called single-base variants (var_id, chr, pos, ref_base, alt_base, filt) as TP, FP or TPlinked.

    ``links``: var_id, rank (0-based), to_chr, to_pos; they count only for calls whose FILTER holds the exact token of
    linked variants. Adds ``n_links`` and ``true_rank``: the first link that is in the truth set, -1 if none.
    """
    known = truth.select(*_SITE).distinct()
    single = called.where(~is_indel())
    direct = single.join(known.withColumn("_true", F.lit(True)), _SITE, "left")
    hit = links.join(known.select(F.col("chr").alias("to_chr"), F.col("pos").alias("to_pos"), F.lit(True).alias("_hit")), ["to_chr", "to_pos"], "left")
    per = hit.groupBy("var_id").agg(F.count("*").alias("_n"), F.min(F.when(F.col("_hit"), F.col("rank"))).alias("_rank"))
    both = direct.join(per, "var_id", "left")
    counts = has_filter(F.col("filt"), LINKED)
    kind = F.when(F.col("_true"), "TP").when(counts & F.col("_rank").isNotNull(), "TPlinked").otherwise("FP")
    return both.select(
        *called.columns, kind.alias("kind"), F.when(counts, F.coalesce("_n", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
        F.when(counts, F.coalesce("_rank", F.lit(-1))).otherwise(-1).cast("long").alias("true_rank"),
    )


def missed(truth: DataFrame, called: DataFrame, links: DataFrame) -> DataFrame:
    """Truth rows that no called single-base variant shares the place of, nor a link of a linked one."""
    single = called.where(~is_indel())
    reached = links.join(single.where(has_filter(F.col("filt"), LINKED)).select("var_id"), "var_id", "left_semi").select(F.col("to_chr").alias("chr"), F.col("to_pos").alias("pos"))
    return truth.join(single.select(*_SITE).unionByName(reached).distinct(), _SITE, "left_anti")


def truth_totals(called: DataFrame, truth: DataFrame, links: DataFrame) -> DataFrame:
    kinds = classify_calls(called, truth, links).groupBy("kind").agg(F.count("*").alias("n"))
    fn = missed(truth, called, links).agg(F.count("*").alias("n")).select(F.lit("FN").alias("kind"), "n")
    spark = called.sparkSession
    grid = spark.createDataFrame([("TP",), ("FP",), ("FN",), ("TPlinked",)], "kind string")
    return grid.join(kinds.unionByName(fn), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


# ---- networks -----------------------------------------------------------------------------------------------------


def called_edges(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """Links (from_id, to_id) between two called vertices (id), in both directions, each once and without self links."""
    inner = links.where("from_id <> to_id").join(vertices.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(vertices.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return inner.select("from_id", "to_id").unionByName(inner.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))).distinct()


def clusters(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """``id, cluster``: the smallest called id reachable over called edges."""
    found = connected_components(called_edges(vertices, links), "from_id", "to_id")
    return vertices.join(found, vertices["id"] == found["vertex"], "left").select("id", F.coalesce("component", "id").alias("cluster"))


def network_nodes(variants: DataFrame, links: DataFrame) -> DataFrame:
    """All nodes of a network: called ones and, where links go elsewhere, uncalled ones. Repeated links count once."""
    called = variants.select(F.col("id"), F.lit(True).alias("called")).distinct()
    others = links.select(F.col("to_id").alias("id")).distinct().join(called.select("id"), "id", "left_anti")
    degree = links.select("from_id", "to_id").distinct().groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("n_links"))
    return called.unionByName(others.withColumn("called", F.lit(False))).join(degree, "id", "left").select("id", "called", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


# ---- ids ----------------------------------------------------------------------------------------------------------


def annotate_ids(sites: DataFrame, database: DataFrame, order: str = "row_no") -> DataFrame:
    """Sites (chr, pos, ...) with ``id`` from ``database`` (chr, pos, id): the one of the last row, ``.`` if none."""
    last = database.groupBy(*_SITE).agg(F.max_by("id", order).alias("id"))
    return sites.join(last, _SITE, "left").withColumn("id", F.coalesce("id", F.lit(".")))


# ---- summaries, subsets, checks -----------------------------------------------------------------------------------


def covered_regions(entries: DataFrame, side: str = "align") -> DataFrame:
    """Union of the align or origin regions as BED rows (chr, start0, end0 half-open)."""
    runs = union_runs(entries.where(F.col(f"{side}_chr").isNotNull()).select(F.col(f"{side}_chr").alias("chr"), F.col(f"{side}_start").alias("s"), F.col(f"{side}_end").alias("e")), ["chr"], "s", "e")
    return runs.select("chr", (F.col("s") - 1).alias("start0"), F.col("e").alias("end0"))


#: Places along either side that meet in one cell when entries of the two strands are looked for that cross.
CELL = 1024


def distinct_coverage(entries: DataFrame) -> DataFrame:
    """How many different origin positions each base of the align regions corresponds to, as runs (chr, start, end, cov).

    Entries of one diagonal and strand are fused first; then no two of a strand give a base the same origin position. A
    forward and a reverse one do so in one base at most, where they cross, and such bases count one less.
    """
    plus = F.coalesce(F.col("strand") == "+", F.lit(False))
    diagonal = F.when(plus, F.col("origin_start") - F.col("align_start")).otherwise(F.col("origin_start") + F.col("align_end"))
    spans = entries.where("origin_chr IS NOT NULL AND align_start <= align_end").select(
        F.col("align_chr").alias("chr"), "origin_chr", plus.alias("plus"), diagonal.cast("long").alias("diagonal"), F.col("align_start").alias("start"), F.col("align_end").alias("end")
    )
    with leaving_nothing(entries.sparkSession):
        runs = materialize(fuse(spans, ["chr", "origin_chr", "plus", "diagonal"]), "coverage")
        crossed = materialize(_crossings(runs), "crossings")
    steps = runs.select("chr", "start", "end", F.lit(1).alias("n")).unionByName(crossed.select("chr", F.col("p").alias("start"), F.col("p").alias("end"), F.lit(-1).alias("n")))
    return depth_runs(steps, ["chr"], weight="n").withColumnRenamed("depth", "cov")


def _crossings(runs: DataFrame) -> DataFrame:
    """``chr, p``: a row for each base at which a forward and a reverse run have the same origin position."""
    cells = runs.withColumn("_p", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor(F.col("end") / CELL))))
    cells = cells.withColumn("low", F.greatest("start", F.col("_p") * CELL)).withColumn("high", F.least("end", F.col("_p") * CELL + CELL - 1))
    origin = F.when(F.col("plus"), F.col("diagonal") + F.col("low")).otherwise(F.col("diagonal") - F.col("high"))
    cells = cells.withColumn("_o", F.explode(F.sequence(F.floor(origin / CELL), F.floor((origin + F.col("high") - F.col("low")) / CELL))))
    side = lambda plus, p: cells.where(F.col("plus") == plus).select("chr", "origin_chr", "_p", "_o", *(F.col(c).alias(p + c) for c in ("diagonal", "low", "high")))
    both = side(True, "").join(side(False, "r"), ["chr", "origin_chr", "_p", "_o"])
    apart = F.col("rdiagonal") - F.col("diagonal")
    p = F.shiftright(apart, 1)
    inside = (apart % 2 == 0) & p.between(F.greatest("low", "rlow"), F.least("high", "rhigh")) & (F.floor((p + F.col("diagonal")) / CELL) == F.col("_o"))
    return both.where(inside).select("chr", p.alias("p"))


def depth_coverage(entries: DataFrame) -> DataFrame:
    return depth_runs(entries.select(F.col("align_chr").alias("chr"), F.col("align_start").alias("start"), F.col("align_end").alias("end")), ["chr"])


def subset_entries(entries: DataFrame, bed: DataFrame) -> DataFrame:
    """Entries whose align region has a base in the regions (chr, start0, end0)."""
    regions = bed.select(F.col("chr").alias("bed_chr"), (F.col("start0") + 1).alias("bed_start"), F.col("end0").alias("bed_end")).where("bed_start <= bed_end")
    return overlap_semi(entries, regions, [("align_chr", "bed_chr")], (F.col("align_start"), F.col("align_end")), (F.col("bed_start"), F.col("bed_end")))


def parse_region(text: str) -> tuple[str, int, int]:
    """``chr1:1000-2000`` as chromosome and half-open start and end, as given."""
    chromosome, _, span = text.rpartition(":")
    low, _, high = span.partition("-")
    return chromosome, int(low), int(high)


def order_faults(entries: DataFrame, row: str = "row_id") -> DataFrame:
    return out_of_order(entries, row, ["align_chr", "align_start", "origin_chr", "origin_start"])


def trivial_entries(entries: DataFrame, row: str = "row_id") -> DataFrame:
    """Self links, but for the very first row."""
    return entries.where(is_trivial() & (F.col(row) > 0))


# ---- rankings -----------------------------------------------------------------------------------------------------


def rank_hits(hits: DataFrame, read: str, score: str) -> DataFrame:
    """Hits with their ranks among those of the read by falling score: ``best_rank`` counts ties for the hit, ``worst_rank``
    against it; ``n_hits`` and how far the score is ``below_best``."""
    by = W.partitionBy(read).orderBy(F.desc(score))
    return hits.select(
        "*", F.rank().over(by).alias("best_rank"), F.count("*").over(by.rangeBetween(W.unboundedPreceding, W.currentRow)).alias("worst_rank"),
        F.count("*").over(W.partitionBy(read)).alias("n_hits"), (F.first(score).over(by) - F.col(score)).alias("below_best"),
    )


def route_hits(ranked: DataFrame, elements: Column | None = None, longest_indel: int = 10, most: int = 1) -> DataFrame:
    """``route``: ``indel`` with a long insertion or deletion, ``good`` for a best hit that at most ``most`` share, else ``bad``."""
    indel = cg.has_long_indel(elements, longest_indel) if elements is not None else F.lit(False)
    return ranked.withColumn("route", F.when(indel, "indel").when((F.col("best_rank") == 1) & (F.col("worst_rank") <= most), "good").otherwise("bad"))


def unmatched_reads(reads: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    return reads.join(hits.select(key).distinct(), key, "left_anti")


# ---- patterns -----------------------------------------------------------------------------------------------------


def count_patterns(table: DataFrame, first: Column, second: Column) -> DataFrame:
    """How many rows do and don't match either of two conditions; null counts as no match. Always four rows."""
    hit = table.select(F.coalesce(first, F.lit(False)).alias("pattern_a"), F.coalesce(second, F.lit(False)).alias("pattern_b"))
    n = hit.groupBy("pattern_a", "pattern_b").agg(F.count("*").alias("n"))
    grid = table.sparkSession.createDataFrame([(a, b) for a in (False, True) for b in (False, True)], "pattern_a boolean, pattern_b boolean")
    return grid.join(n, ["pattern_a", "pattern_b"], "left").select("pattern_a", "pattern_b", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def column_matches(line: Column, pattern: str, column: int = 0, separator: str = "\t") -> Column:
    """A regular expression is found in the line, or in its ``column``-th part (from 1); a missing part matches nothing."""
    part = line if column < 1 else F.get(F.split(line, "\\Q" + separator + "\\E"), F.lit(column - 1))
    return F.coalesce(part.rlike(pattern), F.lit(False))


# ---- simulation ---------------------------------------------------------------------------------------------------


def _drawn(seed: int, *parts: Column | str) -> Column:
    """A number below 2**52 that depends on the seed and the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 13), 16, 10).cast("long")


def mutate(genome: DataFrame, per_million: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Single-base changes at about ``per_million`` of a million positions: the truth (chr, pos, ref_base, alt_base) and the
    changed genome. Positions are drawn by hash, so any number of tasks draws the same; an N that is drawn stays."""
    size = 1 << 13
    pieces = genome.select("chr", F.col("seq").cast("binary").alias("b"), F.explode(F.sequence(F.lit(0), F.greatest(F.length("seq") - 1, F.lit(0)), F.lit(size))).alias("k"))
    text = F.substring(F.col("b"), F.col("k") + 1, F.lit(size)).cast("string")
    bases = pieces.select("chr", "k", F.posexplode(F.split(text, "")).alias("i", "base")).where("base <> ''").withColumn("pos", (F.col("k") + F.col("i") + 1).cast("long"))
    chosen = _drawn(seed, F.col("chr").cast("string"), F.col("pos").cast("string"))
    others = F.regexp_replace(F.lit("ATCG"), F.col("base"), F.lit(""))
    drawn = bases.withColumn("_r", chosen).withColumn("hit", (F.pmod("_r", F.lit(1_000_000)) < per_million) & F.col("base").isin("A", "T", "C", "G"))
    new = F.substring(others, (F.floor(F.col("_r") / 1_000_000) % 3 + 1).cast("int"), F.lit(1))
    drawn = drawn.withColumn("alt", F.when(F.col("hit"), new).otherwise(F.col("base")))
    truth = drawn.where("hit").select("chr", "pos", F.col("base").alias("ref_base"), F.col("alt").alias("alt_base"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "alt"))), lambda x: x["alt"]), "")
    parts = drawn.groupBy("chr", "k").agg(ordered.alias("part"))
    changed = parts.groupBy("chr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "").alias("seq"))
    return truth, genome.select("chr").join(changed, "chr", "left").select("chr", F.coalesce("seq", F.lit("")).alias("seq"))


def random_links(variants: DataFrame, bed: DataFrame, seed: int) -> DataFrame:
    """A null model: for each variant (var_id, n_links) as many positions drawn evenly from the regions (chr, start0, end0).

    Regions are numbered along a line of all their bases; a drawn number finds its region by a stab join. Returns
    ``var_id, rank, to_chr, to_pos``.
    """
    regions = bed.where("end0 > start0").groupBy("chr", "start0", "end0").agg(F.count("*").alias("copies"))
    # cumulative lengths in two steps: within a chromosome, and over the few chromosomes
    size = (F.col("end0") - F.col("start0")) * F.col("copies")
    inner = W.partitionBy("chr").orderBy("start0", "end0").rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = regions.withColumn("size", size).withColumn("upto", F.sum("size").over(inner))
    totals = lines.groupBy("chr").agg(F.max("upto").alias("total")).withColumn("before", F.sum("total").over(W.orderBy("chr").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("total"))
    whole = totals.agg(F.sum("total")).first()[0] or 0
    if not whole:
        return variants.select("var_id").limit(0).selectExpr("var_id", "0L AS rank", "NULL AS to_chr", "0L AS to_pos")
    lines = lines.join(totals, "chr").select("chr", "start0", "end0", (F.col("before") + F.col("upto") - F.col("size")).alias("low"), (F.col("before") + F.col("upto") - 1).alias("high"))
    asked = variants.where("n_links > 0").select("var_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_links").cast("long") - 1)).alias("rank"))
    asked = asked.withColumn("at", F.pmod(_drawn(seed, F.col("var_id").cast("string"), F.col("rank").cast("string")), F.lit(int(whole))))
    found = stab_join(asked, lines, [], F.col("at"), (F.col("low"), F.col("high")))
    width = F.col("end0") - F.col("start0")
    return found.select("var_id", "rank", F.col("chr").alias("to_chr"), (F.col("start0") + 1 + (F.col("at") - F.col("low")) % width).cast("long").alias("to_pos"))
