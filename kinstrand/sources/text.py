"""Readers and writers of line-based formats. All coordinates become 1-based and inclusive inside, except BED columns, which
keep their names ``start0, end0``. Compression follows the file's extension."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinstrand.functions import cigar as cg
from kinstrand.operators.entries import ANCHORS

# The header of a similarity table, and the marks for what is missing.
TABLE_HEADER = (
    "Align.chr Align.start Align.end Origin.chr Origin.start Origin.end Mismatches Align.strand "
    "Align.position Align.refBase Align.altBase Origin.position Origin.refBase Origin.altBase"
).split()
NO_CHROMOSOME, NO_POSITION, NO_BASE = "NA", "NA", "N"


def _lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    return reader.text(path)


def _fields(df: DataFrame, names: list[str], separator: str = "\t") -> DataFrame:
    parts = F.split("value", re.escape(separator))
    return df.select(*(F.get(parts, F.lit(k)).alias(n) for k, n in enumerate(names) if n != "_"))


def write_lines(lines: DataFrame, path: str, header: list[str] | None = None, gzip: bool = True, rows_per_file: int | None = None) -> None:
    """Write a single column of lines; ``header`` lines go into a part of their own that sorts first.

    Rows are written by as many tasks as the data has; ``rows_per_file`` rolls files within each.
    """
    out = lines.select(lines.columns[0])
    writer = out.write.option("compression", "gzip" if gzip else "none")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if header:
        lines.sparkSession.createDataFrame([(h,) for h in header], "value string").coalesce(1).write.option("compression", "gzip" if gzip else "none").text(f"{path}/part=0-header")
        writer.text(f"{path}/part=1-rows")
    else:
        writer.text(path)


def _row(*columns: Column) -> Column:
    return F.concat_ws("\t", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).alias("value")


# ---- FASTA --------------------------------------------------------------------------------------------------------


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """``chr, seq`` of every record; a record is a whole chromosome, so its sequence is one value."""
    record = _lines(spark, path, ">").where(F.length(F.trim("value")) > 0)
    head = F.substring_index("value", "\n", 1)
    body = F.regexp_replace(F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)"), r"\s", "")
    return record.select(F.regexp_extract(head, r"^(\S+)", 1).alias("chr"), F.upper(body).alias("seq"))


def read_reads(spark: SparkSession, path: str) -> DataFrame:
    """Generated reads with the place in their names: ``read_name, chr, start, end, seq``."""
    name = F.concat(F.lit(">"), F.col("chr"))
    place = F.regexp_extract("chr", r"^T\d+;(.*):(\d+)-(\d+)", 1)
    at = lambda k: F.regexp_extract("chr", r"^T\d+;(.*):(\d+)-(\d+)", k).cast("long")
    return read_fasta(spark, path).select(name.alias("read_name"), place.alias("place"), at(2).alias("start"), at(3).alias("end"), "seq").withColumnRenamed("place", "chr")


def write_fasta(genome: DataFrame, path: str, width: int = 50) -> None:
    folded = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    write_lines(genome.select(F.concat(F.lit(">"), F.col("chr").cast("string"), F.lit("\n"), folded).alias("value")), path, gzip=False)


def write_reads(reads: DataFrame, path: str, rows_per_file: int) -> None:
    write_lines(reads.select(F.concat_ws("\n", "read_name", "seq").alias("value")), path, rows_per_file=rows_per_file)


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """``chr, length, chr_idx`` in the order of the file."""
    rows = _fields(_lines(spark, path), ["chr", "length"]).where("chr <> ''").select("chr", F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("k"))
    from pyspark.sql import Window as W

    # an index has a row per chromosome
    return rows.select("chr", "length", (F.row_number().over(W.orderBy("k")) - 1).alias("chr_idx"))


# ---- regions and ids ----------------------------------------------------------------------------------------------


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where("trim(value) <> '' AND value NOT LIKE '#%' AND value NOT LIKE 'track%' AND value NOT LIKE 'browser%'")
    return _fields(rows, ["chr", "a", "b"]).select("chr", F.col("a").cast("long").alias("start0"), F.col("b").cast("long").alias("end0"))


def write_bed(regions: DataFrame, path: str) -> None:
    write_lines(regions.select(_row(F.col("chr"), F.col("start0"), F.col("end0"))), path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    rows = _lines(spark, path).where("value NOT LIKE '#%'").withColumn("row_no", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    return rows.select(F.get(parts, F.lit(0)).alias("chr"), F.get(parts, F.lit(1)).cast("long").alias("pos"), F.get(parts, F.lit(2)).alias("id"), "row_no")


# ---- the similarity table -----------------------------------------------------------------------------------------


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Entries with anchors; rows that are too short or unknown origins follow ``is_whole`` and nulls.

    Comment lines (``##``) and the header are skipped; a table without the header is refused.
    """
    lines = _lines(spark, path)
    if lines.where(F.col("value").startswith("Align.chr")).isEmpty() and not lines.where("value NOT LIKE '##%'").isEmpty():
        raise ValueError(f"{path} has no header of a similarity table")
    names = ["align_chr", "align_start", "align_end", "origin_chr", "origin_start", "origin_end", "penalty", "strand", "ap", "ar", "aa", "op", "orf", "oa"]
    rows = _fields(lines.where("value NOT LIKE '##%' AND value NOT LIKE 'Align.chr%' AND value <> ''"), names)
    whole = F.col("oa").isNotNull()
    parts = [F.split(c, ";") for c in ("ap", "op", "ar", "aa", "orf", "oa")]
    zipped = F.arrays_zip(*(p.alias(n) for p, n in zip(parts, ("p", "q", "r", "s", "t", "u"), strict=True)))
    anchors = F.transform(
        zipped, lambda x: F.struct(x["p"].cast("long").alias("align_pos"), x["q"].cast("long").alias("origin_pos"), x["r"].alias("align_ref"), x["s"].alias("align_alt"), x["t"].alias("origin_ref"), x["u"].alias("origin_alt"))
    )
    zipped_ok = whole & (F.col("ap") != NO_POSITION)
    number = lambda c: F.expr(f"try_cast({c} AS BIGINT)").alias(c)
    known = lambda c: F.nullif(F.col(c), F.lit(NO_CHROMOSOME)).alias(c)
    return rows.select(
        known("align_chr"), number("align_start"), number("align_end"), known("origin_chr"), number("origin_start"), number("origin_end"), number("penalty"), "strand",
        F.when(zipped_ok, anchors).otherwise(F.array().cast(ANCHORS)).cast(ANCHORS).alias("anchors"), whole.alias("is_whole"),
    )


def table_line() -> Column:
    """An entry as the line of a table."""
    listed = lambda f, empty: F.when(F.size("anchors") > 0, F.array_join(F.transform("anchors", lambda a: a[f].cast("string")), ";")).otherwise(F.lit(empty))
    c = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(NO_CHROMOSOME))
    return F.concat_ws(
        "\t", c("align_chr"), c("align_start"), c("align_end"), c("origin_chr"), c("origin_start"), c("origin_end"), c("penalty"), "strand",
        listed("align_pos", NO_POSITION), listed("align_ref", NO_BASE), listed("align_alt", NO_BASE), listed("origin_pos", NO_POSITION), listed("origin_ref", NO_BASE), listed("origin_alt", NO_BASE),
    ).alias("value")


def write_table(entries: DataFrame, path: str, comments: list[str] | None = None) -> None:
    write_lines(entries.select(table_line()), path, [*(f"##{c}" for c in comments or []), "\t".join(TABLE_HEADER)])


def write_by_chromosome(entries: DataFrame, path: str) -> None:
    """One folder of table lines per align chromosome; rows without one go to ``unmapped``."""
    from kinstrand.operators.entries import split_names

    split_names(entries.select("*", table_line())).select("value", "part").write.option("compression", "gzip").partitionBy("part").text(path)


# ---- variants and links -------------------------------------------------------------------------------------------

_VCF = ["chr", "pos", "id", "ref_base", "alt_base", "qual", "filt", "info", "format", "genotype"]


def read_vcf(spark: SparkSession, path: str) -> tuple[DataFrame, list[str]]:
    """Rows (``var_id`` in order of the file) and the header lines."""
    lines = _lines(spark, path)
    header = [r["value"] for r in lines.where("value LIKE '#%'").collect()]  # a header has a few lines
    rows = _fields(lines.where("value NOT LIKE '#%' AND value <> ''").withColumn("k", F.monotonically_increasing_id()), _VCF)
    return rows.withColumn("pos", F.col("pos").cast("long")).withColumn("var_id", F.monotonically_increasing_id()), header


def write_vcf(variants: DataFrame, path: str, header: list[str], added: list[str] | None = None) -> None:
    """Rows with the header; ``added`` lines go in before the column line."""
    columns = [h for h in header if h.startswith("#") and not h.startswith("##")] or ["#" + "\t".join("CHROM POS ID REF ALT QUAL FILTER INFO FORMAT SAMPLE".split())]
    lines = [h for h in header if h.startswith("##")] + [a for a in added or [] if a not in header] + columns
    present = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in _VCF if c in variants.columns]
    write_lines(variants.orderBy("chr", "pos").select(F.concat_ws("\t", *present).alias("value")), path, lines)


# Header lines of annotated variant files.
FILTER_LINES = [
    '##FILTER=<ID=thesaurus,Description="Other positions in the genome look like this one">',
    '##FILTER=<ID=thesaurushard,Description="Too few plain reads to find other positions">',
    '##FILTER=<ID=thesaurusmany,Description="Too many other positions">',
    '##FORMAT=<ID=TS,Number=1,Type=Integer,Description="Number of other positions">',
]


def read_links(spark: SparkSession, path: str) -> DataFrame:
    """Link lists ``chr:pos<tab>chr:pos...``: one row per link, ``chr, pos, rank, to_chr, to_pos``."""
    parts = F.split("value", "\t")
    rows = _lines(spark, path).where("value NOT LIKE '#%' AND value <> ''").select(F.get(parts, F.lit(0)).alias("own"), F.posexplode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("rank", "to"))
    name, place = (lambda c: F.regexp_extract(c, r"^(.*?):(\d+)(?::.*)?$", 1)), (lambda c: F.regexp_extract(c, r"^(.*?):(\d+)(?::.*)?$", 2).cast("long"))
    return rows.select(name("own").alias("chr"), place("own").alias("pos"), F.col("rank").cast("long").alias("rank"), name("to").alias("to_chr"), place("to").alias("to_pos"))


def link_lines(links: DataFrame) -> DataFrame:
    """One line per site (chr, pos) with its links in order of place."""
    key = F.concat_ws(":", F.col("chr").cast("string"), F.col("pos").cast("string"))
    sites = links.groupBy("chr", "pos").agg(F.array_sort(F.collect_set(F.struct("to_chr", "to_pos"))).alias("x"))
    return sites.select("chr", "pos", F.concat_ws("\t", key, F.array_join(F.transform("x", lambda s: F.concat_ws(":", s["to_chr"].cast("string"), s["to_pos"].cast("string"))), "\t")).alias("value"))


def write_links(links: DataFrame, path: str, comments: list[str] | None = None) -> None:
    write_lines(link_lines(links).orderBy("chr", "pos").select("value"), path, [f"##{c}" for c in comments or []] or None)


# ---- alignments ---------------------------------------------------------------------------------------------------

_SAM = ["qname", "flag", "rname", "pos", "mapq", "cigar_text", "rnext", "pnext", "tlen", "seq", "qual"]


def as_reads(rows: DataFrame) -> DataFrame:
    """Alignment rows (the eleven SAM columns) as sequencing reads, with flags as booleans and the CIGAR parsed."""
    flag = F.col("flag").cast("int")
    bit = lambda b: flag.bitwiseAND(F.lit(b)) != 0
    elements = cg.parse(F.col("cigar_text"))
    mate = F.when(F.col("rnext") == "=", F.col("rname")).when(F.col("rnext") == "*", F.lit(None)).otherwise(F.col("rnext"))
    start = F.col("pos").cast("long")
    return rows.select(
        F.xxhash64(*_SAM).alias("read_id"), "qname", F.col("rname").alias("chr"), start.alias("start_pos"), (start + cg.reference_span(elements) - 1).alias("end_pos"),
        "seq", F.col("mapq").cast("int").alias("mapq"), bit(0x4).alias("unmapped"), bit(0x400).alias("duplicate"), bit(0x100).alias("secondary"), bit(0x10).alias("reverse"),
        elements.alias("cigar"), mate.alias("mate_chr"), F.col("pnext").cast("long").alias("mate_start"), flag.alias("flag"),
    )


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    return as_reads(_fields(_lines(spark, path).where("value NOT LIKE '@%' AND value <> ''"), _SAM))


def write_sam(rows: DataFrame, path: str, chromosomes: DataFrame, group: str = "reads") -> None:
    """Rows of ``kinstrand.operators.align.sam_rows`` with a header made of the genome's index."""
    header = ["@HD\tVN:1.6"] + [f"@SQ\tSN:{r['chr']}\tLN:{r['length']}" for r in chromosomes.orderBy("chr_idx").collect()] + [f"@RG\tID:{group}"]
    seq = F.col("seq") if "seq" in rows.columns else F.lit("*")
    line = F.concat_ws("\t", "qname", F.col("flag").cast("string"), "rname", F.col("pos").cast("string"), F.col("mapq").cast("string"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), seq, "qual", F.lit(f"RG:Z:{group}"))
    write_lines(rows.select(line.alias("value")), path, header)


_PSL = (
    "matches mismatches rep_matches n_count q_gaps q_gap_bases t_gaps t_gap_bases strand q_name q_size q_start q_end t_name t_size t_start t_end n_blocks sizes q_starts t_starts"
).split()


def read_psl(spark: SparkSession, path: str) -> DataFrame:
    """Block alignments; ``/1`` and ``/2`` go from read names, short rows are left out."""
    rows = _fields(_lines(spark, path), _PSL).where("t_starts IS NOT NULL").where(F.col("matches").rlike(r"^\s*\d+\s*$"))
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("int")).alias(c)
    texts = ("strand", "q_name", "t_name")
    out = rows.select(*(numbers(c) if c in ("sizes", "q_starts", "t_starts") else F.col(c) if c in texts else F.trim(c).cast("long").alias(c) for c in _PSL))
    return out.withColumn("q_name", F.regexp_replace("q_name", "/[12]$", "")).withColumn("cigar", cg.from_blocks(F.col("q_size"), F.col("sizes"), F.col("q_starts"), F.col("t_starts")))


# ---- reports ------------------------------------------------------------------------------------------------------


def write_report(df: DataFrame, path: str, names: list[str] | None = None) -> None:
    """A tab-separated table with a header line."""
    write_lines(df.select(_row(*(F.col(c) for c in df.columns))), path, ["\t".join(names or df.columns)])


def write_coverage(runs: DataFrame, path: str) -> None:
    """Run-length coverage, a folder per chromosome."""
    lines = runs.select(_row(F.col("start"), F.col("end"), F.col("cov")), F.col("chr").cast("string").alias("chr"))
    lines.write.option("compression", "gzip").partitionBy("chr").text(path)
