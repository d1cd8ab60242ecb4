"""Command line: ``python -m kinstrand.cli COMMAND ...``; inputs and outputs are paths that Spark reads and writes."""

from __future__ import annotations

import argparse
import dataclasses
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinstrand import __version__
from kinstrand.config import EngineConfig
from kinstrand.functions import cigar as cg
from kinstrand.operators import align, annotate, build, entries, evaluate, intervals, pileup
from kinstrand.plans.storage import materialize
from kinstrand.sources import bam, text

PREFERENCES = Path.home() / ".kinstrand.json"


def _config(a: argparse.Namespace) -> EngineConfig:
    """Stored preferences, changed by the options of this call."""
    known = {f.name for f in dataclasses.fields(EngineConfig)}
    return dataclasses.replace(EngineConfig.load(PREFERENCES), **{k: v for k, v in vars(a).items() if k in known and v is not None})


def _reads(spark: SparkSession, path: str) -> DataFrame:
    return bam.read_bam(spark, path) if path.endswith(".bam") else text.read_sam(spark, path)


def _tables(spark: SparkSession, paths: str) -> DataFrame:
    return reduce(DataFrame.unionByName, (text.read_table(spark, p) for p in paths.split(","))).where("is_whole").drop("is_whole")


def configure(spark, a):
    cfg = EngineConfig() if a.reset else _config(a)
    if not a.show:
        cfg.save(PREFERENCES)
    print(cfg)


def generate(spark, a):
    cfg = _config(a)
    genome = text.read_fasta(spark, cfg.genome)
    if a.insert_size:
        pairs = align.generate_pairs(genome, cfg.read_length, cfg.divisor, a.insert_size, cfg.offset)
        for seq, part in (("seq", "1"), ("seq2", "2")):
            text.write_reads(pairs.select("read_name", F.col(seq).alias("seq")), f"{a.output}.{part}", cfg.rows_per_file)
        return
    reads = align.generate_reads(genome, cfg.read_length, cfg.divisor, cfg.offset)
    if a.bed:
        reads = align.within_regions(reads, text.read_bed(spark, a.bed))
    text.write_reads(reads, a.output, cfg.rows_per_file)


def align_reads(spark, a):
    cfg = _config(a)
    genome, reads = text.read_fasta(spark, cfg.genome), text.read_reads(spark, a.input)
    found, over = align.capped_hits(reads, genome, cfg.read_length, cfg.ear_length, cfg.mismatches, cfg.too_many_hits, both_strands=True)
    found = materialize(found, "hits")  # used twice
    lengths = genome.select("chr", F.length("seq").alias("length"))
    from pyspark.sql import Window as W

    chromosomes = lengths.withColumn("chr_idx", F.row_number().over(W.orderBy("chr")))
    text.write_sam(align.all_sam_rows(reads, found, over, cfg.read_length), a.output, chromosomes)
    text.write_bed(align.unaligned(reads, found), f"{a.output}.unaligned")


def write(spark, a):
    cfg = _config(a)
    genome = text.read_fasta(spark, cfg.genome)
    rows = materialize(reduce(DataFrame.unionByName, (_reads(spark, p) for p in a.bam)), "alignments")
    place = r"^T\d+;(.*):(\d+)-(\d+)"
    plain = ~F.col("unmapped") & cg.is_plain(F.col("cigar")) & (F.col("mapq") >= cfg.min_mapping_quality)
    found = rows.where(plain).select(
        F.regexp_extract("qname", place, 1).alias("origin_chr"), F.regexp_extract("qname", place, 2).cast("long").alias("origin_start"), F.col("chr").alias("align_chr"),
        F.col("start_pos").alias("align_start"), F.when(F.col("reverse"), "-").otherwise("+").alias("strand"), (cfg.read_length - F.col("mapq")).alias("mismatches"),
    )
    made = build.first_pass(align.entries_of_hits(found.where(F.col("mismatches") <= cfg.penalty), genome, cfg.read_length), cfg.read_length, cfg.penalty)
    made = made.select(*(F.col(c).cast("long").alias(c) if c.endswith(("start", "end")) or c == "penalty" else F.col(c) for c in made.columns))
    if a.greedy:
        merged = build.greedy_merge(made, genome, cfg.read_length, cfg.penalty, cfg.bucket)
    else:
        merged = build.extend(entries.merge_diagonals(made).drop("n_merged"), genome, cfg.read_length, cfg.penalty, bucket=cfg.bucket)
    # reads without a place: regions, and entries whose origin is unknown
    start = F.regexp_extract("qname", place, 2).cast("long")
    lost = rows.where("unmapped").select(F.regexp_extract("qname", place, 1).alias("chr"), start.alias("s"), (start + cfg.read_length - 1).alias("e")).where("s IS NOT NULL")
    regions = intervals.union_runs(lost, ["chr"], "s", "e").select("chr", (F.col("s") - 1).alias("start0"), F.col("e").alias("end0"))
    text.write_bed(regions, f"{a.output}.unmapped.bed")
    merged = merged.unionByName(build.unmapped_entries(regions).select(*merged.columns))
    text.write_table(entries.in_table_order(merged), a.output, [f"readlength={cfg.read_length}", f"maxpenalty={cfg.penalty}"])


def merge2chrom(spark, a):
    text.write_by_chromosome(reduce(DataFrame.unionByName, (text.read_table(spark, p) for p in a.inputs)).drop("is_whole"), a.output)


def summarize(spark, a):
    table = _tables(spark, a.table)
    if a.what == "coverage":
        text.write_coverage(evaluate.distinct_coverage(table), a.output)
    else:
        text.write_bed(evaluate.covered_regions(table, a.what), a.output)


def filter_variants(spark, a):
    cfg = _config(a)
    genome = text.read_fasta(spark, cfg.genome)
    variants, header = text.read_vcf(spark, a.vcf)
    reads = _reads(spark, a.bam) if a.bam else None
    single = annotate.split_alleles(variants)
    done, links = annotate.annotate(single, _tables(spark, a.table), reads, genome, cfg)
    done, links = materialize(done, "annotated"), materialize(links, "links")
    fmt, genotype = annotate.tag_genotype(F.coalesce("format", F.lit("GT")), F.coalesce("genotype", F.lit(".")), F.col("n_links"))
    text.write_vcf(done.withColumn("_f", fmt).withColumn("_g", genotype).drop("format", "genotype").withColumnsRenamed({"_f": "format", "_g": "genotype"}), f"{a.output}.vcf", header, text.FILTER_LINES)
    sites = links.join(done.select("var_id", "chr", "pos"), "var_id")
    text.write_links(sites, f"{a.output}.vtf")
    report = done.select("var_id", "chr", "pos", "ref_base", "alt_base", "n_links")
    # fixed values: the report's column names, here and below
    names = ["chr", "position", "ref", "alt", "thesaurus.synonyms"]
    for label, path in [*([(a.label, a.bam)] if a.bam else []), *zip(a.compare_label, a.compare_bam, strict=True)]:
        places = done.select("chr", "pos").unionByName(links.select(F.col("to_chr").alias("chr"), F.col("to_pos").alias("pos")))
        counts = pileup.base_counts(places, _reads(spark, path), 0)
        plain = pileup.naive_frequency(done, counts).select("var_id", "naive_baf", F.col("cov").alias("naive_cov"))
        pooled = pileup.pooled_frequency(done, links, counts).select("var_id", "pooled_baf", "pooled_cov")
        both = plain.join(pooled, "var_id")
        names += [f"{label}.naive.BAF", f"{label}.thesaurus.BAF", f"{label}.naive.cov", f"{label}.thesaurus.cov"]
        figures = (pileup.four_places_text(F.col("naive_baf")), pileup.four_places_text(F.col("pooled_baf")), F.col("naive_cov"), F.col("pooled_cov"))
        report = report.join(both.select("var_id", *(x.alias(f"c{len(names) - 4 + k}") for k, x in enumerate(figures))), "var_id")
    text.write_report(report.orderBy("chr", "pos").drop("var_id"), f"{a.output}.baf", names)


def annotate_vtf(spark, a):
    links, known = text.read_links(spark, a.vtf), text.read_ids(spark, a.database)
    own = evaluate.annotate_ids(links.select("chr", "pos", "to_chr", "to_pos", "rank"), known).withColumnRenamed("id", "own_id")
    far = known.select(F.col("chr").alias("to_chr"), F.col("pos").alias("to_pos"), "id", "row_no").groupBy("to_chr", "to_pos").agg(F.max_by("id", "row_no").alias("to_id"))
    both = own.join(far, ["to_chr", "to_pos"], "left").withColumn("to_id", F.coalesce("to_id", F.lit(".")))
    name = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c))
    lines = both.groupBy("chr", "pos", "own_id").agg(F.array_sort(F.collect_list(F.struct("rank", name("to_chr", "to_pos", "to_id").alias("t")))).alias("x"))
    text.write_lines(lines.select(F.concat_ws("\t", name("chr", "pos", "own_id"), F.array_join(F.transform("x", lambda s: s["t"]), "\t")).alias("value")), a.output)


def network(spark, a):
    variants, _ = text.read_vcf(spark, a.vcf)
    place = lambda c, p: F.struct(F.col(c).cast("string").alias("chr"), F.col(p).cast("long").alias("pos"))
    called = variants.where(~annotate.is_indel()).select(place("chr", "pos").alias("id")).distinct()
    links = text.read_links(spark, a.vtf or a.vcf.replace(".vcf", ".vtf")).select(place("chr", "pos").alias("from_id"), place("to_chr", "to_pos").alias("to_id"))
    found = evaluate.clusters(called, links)
    text.write_report(found.select("id.chr", "id.pos", F.concat_ws(":", "cluster.chr", F.col("cluster.pos").cast("string")).alias("cluster")).orderBy("chr", "pos"), a.output, ["chr", "position", "cluster"])


def details(spark, a):
    variants, _ = text.read_vcf(spark, a.vcf)
    counts = pileup.base_counts(variants, _reads(spark, a.bam), a.min_mapping_quality or -1, keep_uncovered=True)
    text.write_report(counts.orderBy("chr", "pos"), a.output, "chr position A T C G N".split())


def random_vtf(spark, a):
    variants, _ = text.read_vcf(spark, a.vcf)
    keys = F.split("format", ":")
    n = F.get(F.split("genotype", ":"), F.array_position(keys, annotate.COUNT_KEY).cast("int") - 1).cast("long")
    linked = variants.where(annotate.has_filter(F.col("filt"), annotate.LINKED)).select("var_id", "chr", "pos", F.coalesce(n, F.lit(0)).alias("n_links"))
    found = evaluate.random_links(linked, text.read_bed(spark, a.bed), a.seed)
    text.write_links(found.join(linked.select("var_id", "chr", "pos"), "var_id"), a.output)


def reorder(spark, a):
    table = text.read_table(spark, a.table).drop("is_whole").withColumn("row_id", F.monotonically_increasing_id())
    moved = entries.reordered(table, text.read_fai(spark, a.genome + ".fai"))
    text.write_table(moved.orderBy("new_rank"), a.output)


def subset(spark, a):
    if a.bed:
        regions = text.read_bed(spark, a.bed)
    else:
        regions = spark.createDataFrame([evaluate.parse_region(r) for r in a.region], "chr string, start0 long, end0 long")
    text.write_table(evaluate.subset_entries(_tables(spark, a.table), regions), a.output)


def compare(spark, a):
    (called, header), (truth, _) = text.read_vcf(spark, a.vcf), text.read_vcf(spark, a.ref)
    empty = "var_id long, rank long, to_chr string, to_pos long"
    links = text.read_links(spark, a.vtf).join(called.select("var_id", "chr", "pos"), ["chr", "pos"]).select("var_id", "rank", "to_chr", "to_pos") if a.vtf else spark.createDataFrame([], empty)
    kinds = evaluate.classify_calls(called, truth, links)
    for kind, name in (("TP", "TP"), ("FP", "FP"), ("TPlinked", "TPthesaurus")):
        text.write_vcf(kinds.where(F.col("kind") == kind), f"{a.output}.compare.{name}.vcf", header)
    text.write_vcf(evaluate.missed(truth, called, links), f"{a.output}.compare.FN.vcf", header)
    log = kinds.where(annotate.has_filter(F.col("filt"), annotate.LINKED)).select("chr", "pos", "n_links", "true_rank")
    text.write_report(log, f"{a.output}.compare.log", "chr position NumSynonyms TrueSynonym".split())
    for r in evaluate.truth_totals(called, truth, links).collect():
        print(r["kind"], r["n"], sep="\t")


def _numbered(table: DataFrame) -> DataFrame:
    """Rows with ``row_id`` from 0 in the order of the files: what is before a partition, and the place in it."""
    from pyspark.sql import Window as W

    placed = materialize(table.withColumn("row_id", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("row_id", 33)), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("n"), F.min("row_id").alias("_first"))  # a row a partition
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    shifts = F.broadcast(sizes.select("_part", (before - F.col("_first")).alias("_shift")))
    return placed.join(shifts, "_part").withColumn("row_id", F.col("row_id") + F.col("_shift")).drop("_part", "_shift")


def check(spark, a):
    table = _numbered(text.read_table(spark, a.table))
    if a.check == "order":
        evaluate.order_faults(table).select("row_id", "align_chr", "align_start").show(20, False)
    evaluate.trivial_entries(table).select("align_chr", "align_start", "align_end").show(20, False)


def count_patterns(spark, a):
    lines = spark.read.text(a.input).where(~F.col("value").startswith(a.ignore))
    patterns, columns = (a.pattern or ["."]) * 2, (a.column or [-1]) * 2
    found = evaluate.count_patterns(lines, *(evaluate.column_matches(F.col("value"), p, c, a.sep) for p, c in zip(patterns[:2], columns[:2], strict=True)))
    text.write_report(found, a.output, "patternA patternB count".split())


def new_genome(spark, a):
    truth, changed = evaluate.mutate(text.read_fasta(spark, _config(a).genome), round(a.density * 1_000_000), a.seed)
    text.write_fasta(changed, f"{a.output}.fa")
    none = F.lit(".")
    rows = truth.select("chr", "pos", none.alias("id"), "ref_base", "alt_base", none.alias("qual"), none.alias("filt"), none.alias("info"))
    text.write_vcf(rows, f"{a.output}.vcf", ["##fileformat=VCFv4.1", "#" + "\t".join("CHROM POS ID REF ALT QUAL FILTER INFO".split())])


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kinstrand", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, run, *options, **extra):
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for o in options:
            flag, kind = o.rstrip("*!"), extra.get(o.strip("-*!").replace("-", "_"), str)
            more = {"action": "store_true"} if o.endswith("!") else {"type": kind, "required": o.endswith("*")}
            p.add_argument(f"--{flag}", dest=flag.replace("-", "_"), **more)
        return p

    integers = dict.fromkeys("read_length divisor offset insert_size rows_per_file mismatches ear_length too_many_hits penalty bucket min_mapping_quality tolerance max_tolerance hit_count too_many clip seed".split(), int)
    add("configure", configure, "reset!", "show!", "genome", "read-length", "divisor", "offset", "penalty", **integers)
    add("generate", generate, "genome", "output*", "bed", "read-length", "divisor", "offset", "insert-size", "rows-per-file", **integers)
    add("align", align_reads, "genome", "input*", "output*", "read-length", "mismatches", "ear-length", "too-many-hits", **integers)
    p = add("write", write, "genome", "output*", "read-length", "penalty", "bucket", "greedy!", **integers)
    p.add_argument("--bam", action="append", required=True)
    p = add("merge2chrom", merge2chrom)
    p.add_argument("output")
    p.add_argument("inputs", nargs="+")
    p = add("summarize", summarize, "table*", "output*")
    p.add_argument("--what", choices=("align", "origin", "coverage"), default="align")
    p = add("filter", filter_variants, "bam", "genome", "output*", "table*", "vcf*", "insert-size", "clip", "min-mapping-quality", "read-length", "tolerance", "max-tolerance", "hit-count", "hit-proportion", "too-many", hit_proportion=float, **integers)
    p.add_argument("--label", default="sample")
    p.add_argument("--compare-bam", action="append", default=[])
    p.add_argument("--compare-label", action="append", default=[])
    add("annotatevtf", annotate_vtf, "vtf*", "output*", "database*")
    add("network", network, "vcf*", "vtf", "output*")
    add("details", details, "bam*", "vcf*", "output*", "min-mapping-quality", **integers)
    add("randomVTF", random_vtf, "bed*", "vcf*", "output*", "seed", **integers).set_defaults(seed=0)
    add("reorder", reorder, "table*", "genome*", "output*")
    add("subset", subset, "table*", "bed", "output*").add_argument("--region", action="append", default=[])
    add("compare", compare, "ref*", "vcf*", "output*", "vtf")
    add("check", check, "table*").add_argument("--check", choices=("order", "trivial"), default="order")
    p = add("countpatterns", count_patterns, "input*", "output*")
    p.add_argument("--pattern", action="append")
    p.add_argument("--column", action="append", type=int)
    p.add_argument("--sep", default="\t")
    p.add_argument("--ignore", default="#")
    add("newgenome", new_genome, "genome", "output*", "density*", "seed", density=float, **integers).set_defaults(seed=0)
    commands.add_parser("version").set_defaults(run=lambda spark, a: print(__version__))
    return top


def main(arguments: list[str] | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = None if a.command in ("version", "configure") else SparkSession.builder.appName(f"kinstrand {a.command}").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
