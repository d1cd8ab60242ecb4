"""Which called variants may really lie elsewhere: variants x similarity table x reads.

Everything is one plan of binned joins and aggregations keyed by variant. Only reads that show the alternative base take
part in the join with entries, so that the threefold join stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinstrand.config import EngineConfig
from kinstrand.functions import cigar as cg
from kinstrand.functions.dna import complement
from kinstrand.operators.align import reference_under
from kinstrand.operators.entries import lift_base, lift_position, lift_span, self_overlaps
from kinstrand.operators.intervals import overlap_join, overlap_semi, stab_join
from kinstrand.operators.pileup import covering, usable
from kinstrand.plans.storage import materialize

# FILTER tokens and the genotype key of annotated variants.
LINKED, HARD, MANY, COUNT_KEY = "thesaurus", "thesaurushard", "thesaurusmany", "TS"


def is_indel() -> Column:
    return (F.length("ref_base") > 1) | (F.length("alt_base") > 1)


def split_alleles(variants: DataFrame) -> DataFrame:
    """One row per alternative of a comma-separated list."""
    return variants.withColumn("alt_base", F.explode(F.split("alt_base", ",")))


def add_filter(filt: Column, token: Column) -> Column:
    """``pass`` turns ``.`` into PASS and leaves others; another token replaces ``.`` and PASS and is appended to others."""
    blank = filt.isNull() | filt.isin(".", "PASS")
    return F.when(token == "pass", F.when(filt.isNull() | (filt == "."), F.lit("PASS")).otherwise(filt)).otherwise(F.when(blank, token).otherwise(F.concat(filt, F.lit(";"), token)))


def has_filter(filt: Column, token: str) -> Column:
    return F.array_contains(F.split(F.coalesce(filt, F.lit("")), ";"), token)


def tag_genotype(fmt: Column, genotype: Column, n: Column) -> tuple[Column, Column]:
    """FORMAT and genotype with the number of links; a number that is there already is replaced."""
    keys = F.split(fmt, ":")
    there = F.array_position(keys, COUNT_KEY)
    value = n.cast("string")
    replaced = F.array_join(F.transform(F.split(genotype, ":"), lambda x, k: F.when(k + 1 == there, value).otherwise(x)), ":")
    new = F.coalesce(there, F.lit(0)) == 0
    return F.when(new, F.concat(fmt, F.lit(f":{COUNT_KEY}"))).otherwise(fmt), F.when(new, F.concat(genotype, F.lit(":"), value)).otherwise(replaced)


def _entries(entries: DataFrame) -> DataFrame:
    return entries.where("origin_chr IS NOT NULL")


def near_entries(variants: DataFrame, entries: DataFrame, width: int) -> DataFrame:
    """Pairs of a variant and an entry whose align region is at most ``width`` bases away."""
    return overlap_join(variants, entries, [("chr", "align_chr")], (F.col("pos") - width, F.col("pos") + width), (F.col("align_start"), F.col("align_end")))


def lifted_links(variants: DataFrame, entries: DataFrame) -> DataFrame:
    """Links from the similarity table alone: each entry over a variant gives the place that corresponds to it.

    Returns ``var_id, to_chr, to_pos, to_ref, to_alt``; a place counts once, with its least bases, and not the variant's own.
    """
    both = stab_join(variants, _entries(entries), [("chr", "align_chr")], F.col("pos"), (F.col("align_start"), F.col("align_end")))
    placed = both.select(
        "var_id", "chr", "pos", F.col("origin_chr").alias("to_chr"), lift_position(F.col("pos")).cast("long").alias("to_pos"),
        lift_base(F.col("ref_base")).alias("to_ref"), lift_base(F.col("alt_base")).alias("to_alt"),
    )
    return _distinct_places(placed)


def _distinct_places(placed: DataFrame) -> DataFrame:
    far = placed.where((F.col("to_chr") != F.col("chr")) | (F.col("to_pos") != F.col("pos")))
    least = F.min(F.struct("to_ref", "to_alt")).alias("x")
    return far.groupBy("var_id", "to_chr", "to_pos").agg(least).select("var_id", "to_chr", "to_pos", "x.to_ref", "x.to_alt")


def clipped(pairs: DataFrame, genome: DataFrame, clip: int) -> DataFrame:
    """Pairs of variant and read with the read soft-clipped at its ends, unless that would take the variant's base, and the
    number of the read's mismatches. Needs ``cigar``; what ``genome`` (chr, seq) has under the reads is joined by tiles."""
    spanned = pairs.withColumn("_span", cg.reference_span(F.col("cigar")).cast("long"))
    under = reference_under(spanned.select("chr", F.col("start_pos").cast("long").alias("start"), F.col("_span").alias("span")), genome)
    under = under.select(F.col("chr").alias("_chr"), F.col("start").alias("_from"), F.col("span").alias("_of"), F.col("reference").alias("_ref"))
    same = (spanned["chr"] == under["_chr"]) & (spanned["start_pos"] == under["_from"]) & (spanned["_span"] == under["_of"])
    work = spanned.join(under, same).drop("_chr", "_from", "_of", "_span")
    work = work.withColumn("n_mismatches", cg.mismatch_count(F.col("seq"), F.col("cigar"), F.col("start_pos"), F.col("_ref")))
    work = work.withColumn("_clip", cg.soft_clip(F.col("seq"), F.col("cigar"), F.col("start_pos"), F.col("_ref"), clip))
    keep = F.col("pos").between(F.col("_clip.start"), F.col("_clip.end"))
    after = F.substring(F.col("_ref"), (F.col("_clip.start") - F.col("start_pos") + 1).cast("int"), (F.col("_clip.end") - F.col("_clip.start") + 1).cast("int"))
    inner = cg.mismatch_count(F.col("seq"), F.col("_clip.cigar"), F.col("_clip.start"), after)
    return (
        work.withColumn("n_mismatches", F.when(keep, inner).otherwise(F.col("n_mismatches")))
        .withColumn("_start", F.when(keep, F.col("_clip.start").cast("long")).otherwise(F.col("start_pos")))
        .withColumn("_end", F.when(keep, F.col("_clip.end").cast("long")).otherwise(F.col("end_pos")))
        .withColumn("cigar", F.when(keep, F.col("_clip.cigar")).otherwise(F.col("cigar")))
        .withColumn("start_pos", F.col("_start")).withColumn("end_pos", F.col("_end")).drop("_start", "_end", "_clip", "_ref")
    )


def origin_tolerance(pairs: DataFrame, variants: DataFrame, tolerance: int, most: int) -> DataFrame:
    """``pairs`` (pair_id and an entry with a span ``start_pos, end_pos`` inside its align region) with ``allowed``: the
    tolerance, raised by the variants called in the lifted span, at most ``most``."""
    low, high = lift_span(F.col("start_pos"), F.col("end_pos"))
    spans = pairs.select("pair_id", "origin_chr", low.alias("_low"), high.alias("_high"))
    called = variants.select(F.col("chr").alias("_vchr"), F.col("pos").alias("_vpos"))
    n = stab_join(called, spans, [("_vchr", "origin_chr")], F.col("_vpos"), (F.col("_low"), F.col("_high"))).groupBy("pair_id").agg(F.count("*").alias("n_called"))
    return pairs.join(n, "pair_id", "left").withColumn("n_called", F.coalesce("n_called", F.lit(0))).withColumn(
        "allowed", F.least(F.lit(most), F.lit(tolerance) + F.col("n_called")) if most > tolerance else F.lit(tolerance)
    )


def _read_shows(anchor: Column) -> Column:
    """The read has the origin's base at an anchor."""
    plain = F.substring(F.col("seq"), (anchor["align_pos"] - F.col("start_pos") + 1 + F.col("_lead")).cast("int"), F.lit(1))
    return plain == anchor["align_alt"]


def supported_links(variants: DataFrame, entries: DataFrame, reads: DataFrame, genome: DataFrame, cfg: EngineConfig, tolerance: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Links that enough reads support, and per variant ``near, n_alt, n_clean, threshold``.

    ``reads`` need ``cigar``; with ``mate_chr, mate_start`` a mate on the same chromosome must lie near an entry that is near
    some variant. ``entries`` need ``anchors``.
    """
    tolerance = cfg.tolerance if tolerance is None else tolerance
    known = _entries(entries).withColumn("entry_id", F.monotonically_increasing_id())
    # stored: both are used several times, and entries keep the number that they get here
    near = materialize(near_entries(variants, known, cfg.read_length).select("var_id", "entry_id", *known.drop("entry_id").columns), "near-entries")
    good = usable(reads, cfg.min_mapping_quality)
    mates = [c for c in ("mate_chr", "mate_start") if c in reads.columns]
    pairs = clipped(covering(variants, good), genome, cfg.clip).select("var_id", "chr", "pos", "ref_base", "alt_base", "read_id", "start_pos", "end_pos", "seq", "cigar", "base", "n_mismatches", *mates)
    pairs = materialize(pairs, "pairs")
    shows = F.col("base") == F.col("alt_base")
    clean = shows & ~cg.has_indel_or_splice(F.col("cigar")) & (F.col("n_mismatches") <= cfg.max_tolerance + 1)
    per = pairs.groupBy("var_id").agg(F.count_if(shows).alias("n_alt"), F.count_if(clean).alias("n_clean"))
    threshold = F.greatest(F.lit(cfg.hit_count), F.floor(F.lit(cfg.hit_proportion) * F.coalesce("n_alt", F.lit(0))).cast("int"))
    per = variants.select("var_id").distinct().join(near.select("var_id").distinct().withColumn("near", F.lit(True)), "var_id", "left").join(per, "var_id", "left").select(
        "var_id", F.coalesce("near", F.lit(False)).alias("near"), F.coalesce("n_alt", F.lit(0)).alias("n_alt"), F.coalesce("n_clean", F.lit(0)).alias("n_clean"), threshold.alias("threshold")
    )
    supporters = pairs.where(clean).withColumn("_lead", F.when(F.element_at("cigar", 1)["op"] == "S", F.element_at("cigar", 1)["len"]).otherwise(0))
    if "mate_chr" in reads.columns:
        around = near_entries(variants, known, cfg.insert_size).select("align_chr", "align_start", "align_end")
        same = F.col("mate_chr").eqNullSafe(F.col("chr"))
        length = F.length("seq")
        candidates = supporters.select("read_id", "chr", "mate_chr", "mate_start", length.alias("_len")).distinct().where(same)
        ok = overlap_semi(candidates, around, [("chr", "align_chr")], (F.col("mate_start"), F.col("mate_start") + F.col("_len") - 1), (F.col("align_start"), F.col("align_end")))
        supporters = supporters.join(ok.select("read_id", F.lit(True).alias("_mate")).distinct(), "read_id", "left").withColumn("mate_ok", ~same | F.coalesce("_mate", F.lit(False)))
    else:
        supporters = supporters.withColumn("mate_ok", F.lit(True))
    columns = ["var_id", "read_id", "chr", "pos", "ref_base", "alt_base", "start_pos", "end_pos", "seq", "_lead", "mate_ok"]
    within = supporters.select(*columns).join(near, "var_id").where((F.col("start_pos") >= F.col("align_start")) & (F.col("end_pos") <= F.col("align_end")))
    within = within.where(F.col("mate_ok") | self_overlaps())
    inside = F.filter("anchors", lambda a: a["align_pos"].between(F.col("start_pos"), F.col("end_pos")))
    within = within.withColumn("_inside", inside).withColumn("_here", F.size("_inside")).withColumn("_shown", F.size(F.filter("_inside", _read_shows)))
    within = materialize(within, "readings")
    within = origin_tolerance(within.withColumn("pair_id", F.struct("var_id", "read_id", "entry_id")), variants, tolerance, cfg.max_tolerance)
    support = within.where((F.col("_here") <= F.col("allowed")) | (F.col("_shown") >= F.col("_here") - F.col("allowed")))
    keys = ["var_id", "entry_id"]
    agreed = support.groupBy(*keys).agg(F.count("*").alias("n_support"), F.min("start_pos").alias("span_start"), F.max("end_pos").alias("span_end"))
    agreed = agreed.join(per.select("var_id", "threshold"), "var_id").where(F.col("n_support") >= F.col("threshold"))
    linked = agreed.join(near, keys).join(variants.select("var_id", "chr", "pos", "ref_base", "alt_base"), "var_id")
    on_anchor = F.exists("anchors", lambda a: (a["align_pos"] == F.col("pos")) & (a["align_alt"] == F.col("alt_base")))
    place = F.struct(F.col("origin_chr").alias("to_chr"), lift_position(F.col("pos")).cast("long").alias("to_pos"), lift_base(F.col("ref_base")).alias("to_ref"), lift_base(F.col("alt_base")).alias("to_alt"))
    places = F.when(on_anchor, anchor_places()).otherwise(F.array(place))
    placed = linked.select("var_id", "chr", "pos", F.explode(places).alias("x")).select("var_id", "chr", "pos", "x.*")
    return materialize(_distinct_places(placed), "links"), materialize(per, "support")


def anchor_places() -> Column:
    """For a variant on an anchor: every anchor in the span of the supporting reads may be the variant. The only one in the
    span takes the variant's own alternative. Anchors whose bases turn out equal are none."""
    spanned = F.filter("anchors", lambda a: a["align_pos"].between(F.col("span_start"), F.col("span_end")))

    def one(a: Column) -> Column:
        sole = (F.size(spanned) == 1) & (a["align_pos"] == F.col("pos"))
        own = F.when(F.col("strand") == "+", F.col("alt_base")).otherwise(complement(F.col("alt_base")))
        return F.struct(F.col("origin_chr").alias("to_chr"), a["origin_pos"].cast("long").alias("to_pos"), a["origin_ref"].alias("to_ref"), F.when(sole, own).otherwise(a["origin_alt"]).alias("to_alt"))

    return F.filter(F.transform(spanned, one), lambda x: x["to_ref"] != x["to_alt"])


def annotate(variants: DataFrame, entries: DataFrame, reads: DataFrame | None, genome: DataFrame | None, cfg: EngineConfig) -> tuple[DataFrame, DataFrame]:
    """Variants (var_id, chr, pos, ref_base, alt_base, filt) with ``token, n_links, filt``; and the links of linked ones.

    In this order: indels and variants without an entry nearby pass; too few clean reads make one hard; more links than
    ``cfg.too_many``, or an entry over it whose origin is unknown, make one many; none pass; the others are linked. Without
    reads all entries over a variant count.
    """
    single = variants.where(~is_indel())
    unknown = stab_join(single, entries.where("origin_chr IS NULL"), [("chr", "align_chr")], F.col("pos"), (F.col("align_start"), F.col("align_end"))).select("var_id").distinct().withColumn("unknown", F.lit(True))
    if reads is None:
        links = lifted_links(single, entries)
        over = stab_join(single, entries, [("chr", "align_chr")], F.col("pos"), (F.col("align_start"), F.col("align_end"))).select("var_id").distinct()
        state = over.select("var_id", F.lit(True).alias("near"), F.lit(0).alias("n_clean"), F.lit(0).alias("threshold"))
    else:
        links, state = supported_links(single, entries, reads, genome, cfg)
        strict = max(cfg.tolerance, cfg.max_tolerance - 1)
        if strict != cfg.tolerance:
            # variants with too many links are inferred again with the stricter rule
            crowded = links.groupBy("var_id").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.too_many).select("var_id")
            again, _ = supported_links(single.join(crowded, "var_id", "left_semi"), entries, reads, genome, cfg, strict)
            links = links.join(crowded, "var_id", "left_anti").unionByName(again)
    n = links.groupBy("var_id").agg(F.count("*").alias("n"))
    work = variants.join(state, "var_id", "left").join(n, "var_id", "left").join(unknown, "var_id", "left")
    count = F.coalesce("n", F.lit(0))
    token = (
        F.when(is_indel() | ~F.coalesce("near", F.lit(False)), "pass")
        .when(F.col("n_clean") < F.col("threshold"), HARD)
        .when((count > cfg.too_many) | F.coalesce("unknown", F.lit(False)), MANY)
        .when(count == 0, "pass")
        .otherwise(LINKED)
    )
    work = work.withColumn("token", token).withColumn("n_links", F.when(F.col("token").isin(LINKED, MANY), count).otherwise(0).cast("long"))
    columns = [c for c in variants.columns if c != "filt"]
    annotated = work.select(*columns, "token", "n_links", add_filter(F.col("filt"), F.col("token")).alias("filt"))
    kept = links.join(annotated.where(F.col("token") == LINKED).select("var_id"), "var_id", "left_semi")
    return annotated, kept
