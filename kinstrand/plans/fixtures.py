"""Genomic relations derived from the driver's tables: texts become DNA, orders variants, line items similarity entries,
events sequencing reads, parts regions and ids. Each is a DataFrame here and a common table expression in ``CTE``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_TO = "ATCGATCGATCGATCGATCGATCGATATCGATCGATCGATCGATCGATCGAT"

#: Chromosome ``c`` repeats this; base ``p`` is the one at ``(p - 1 + 13 c) % 97``.
MOTIF = "GCCTGACGCGTATGCTCTATACGAAATAGGAGTCTATAGGGGGAATCCCGCACTCCCTAGGAATGAGTATTACAGCGCAGCTCCGGGTTGCTTTACC"
_REFERENCE = f"substr(repeat('{MOTIF}', 3), CAST((event_id*10 + (event_id // 100 % 5)*13) % 97 + 1 AS INT), 60)"
# reads that cover a position 280 k + 1 show the complement there, but for every third
_ALTERED = (
    f"CASE WHEN event_id % 3 <> 0 AND (280 - event_id*10 % 280) % 280 < 60 THEN concat(substr({_REFERENCE}, 1, CAST((280 - event_id*10 % 280) % 280 AS INT)),"
    f" translate(substr({_REFERENCE}, CAST((280 - event_id*10 % 280) % 280 + 1 AS INT), 1), 'ATCG', 'TAGC'), substr({_REFERENCE}, CAST((280 - event_id*10 % 280) % 280 + 2 AS INT))) ELSE {_REFERENCE} END"
)
_CALLED = f"substr('{MOTIF}', CAST((o_orderkey*7 + ((o_orderkey*7 + 1) // 1000 % 5)*13) % 97 + 1 AS INT), 1)"

_SELECTS = {
    "genome": ("documents", f"SELECT doc_id AS chr, translate(regexp_replace(text,'[^A-Za-z]',''{{g}}),'{_FROM}','{_TO}') AS seq FROM documents WHERE text IS NOT NULL"),
    "entries": (
        "lineitem",
        "SELECT CAST((l_partkey*50 + 1) // 1000 % 5 AS BIGINT) AS align_chr, CAST(l_partkey*50+1 AS BIGINT) AS align_start, CAST(l_partkey*50+1+l_quantity*4 AS BIGINT) AS align_end,"
        " CAST(l_orderkey % 5 AS BIGINT) AS origin_chr, CAST((l_orderkey*7) % 100000 + 1 AS BIGINT) AS origin_start, CAST((l_orderkey*7) % 100000 + 1 + l_quantity*4 AS BIGINT) AS origin_end,"
        " CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END AS strand, CAST(l_linenumber-1 AS BIGINT) AS penalty FROM lineitem",
    ),
    "variants": (
        "orders",
        "SELECT o_orderkey AS var_id, CAST(o_custkey % 5 AS BIGINT) AS chr, CAST(o_orderkey*7+1 AS BIGINT) AS pos, substr('ATCG', CAST(o_custkey % 4 + 1 AS INT), 1) AS ref_base,"
        " substr('ATCG', CAST((o_custkey + 1 + o_orderkey % 3) % 4 + 1 AS INT), 1) AS alt_base,"
        " CASE WHEN o_orderstatus='P' THEN 'thesaurus' WHEN o_orderstatus='F' THEN 'PASS' ELSE '.' END AS filt, o_orderpriority AS priority FROM orders",
    ),
    "reads": (
        "events",
        "SELECT event_id AS read_id, CAST(event_id // 100 % 5 AS BIGINT) AS chr, CAST(event_id*10+1 AS BIGINT) AS start_pos, CAST(event_id*10+100 AS BIGINT) AS end_pos,"
        " substr(repeat('ATCG', 26), CAST(event_id % 4 + 1 AS INT), 100) AS seq, CAST(event_id % 61 AS INT) AS mapq,"
        " event_type='error' AS unmapped, event_type='signup' AS duplicate FROM events",
    ),
    # reads with CIGARs of every kind, an unknown base each, and the reference under them with some bases changed
    "aligned": (
        "events",
        "SELECT event_id AS read_id, CAST(event_id // 100 % 5 AS BIGINT) AS chr, CAST(event_id*10+1 AS BIGINT) AS start_pos,"
        " CASE CAST(event_id % 8 AS INT) WHEN 0 THEN '60M' WHEN 1 THEN '7S53M' WHEN 2 THEN '25M3I32M' WHEN 3 THEN '20M4D40M' WHEN 4 THEN '20M2I3D38M'"
        " WHEN 5 THEN '3S27M8D24M6S' WHEN 6 THEN '12M100N30M4I14M' ELSE '2M1D58M' END AS cigar,"
        " concat(substr(repeat('ATCG', 20), CAST(event_id % 4 + 1 AS INT), CAST(event_id % 23 + 2 AS INT)), 'N',"
        " substr(repeat('ATCG', 30), CAST(event_id % 4 + event_id % 23 + 4 AS INT), CAST(57 - event_id % 23 AS INT))) AS seq,"
        " concat(substr(repeat('ATCG', 20), CAST(event_id % 4 + 1 AS INT), CAST(event_id % 11 + 1 AS INT)), 'C',"
        " substr(repeat('ATCG', 60), CAST(event_id % 4 + event_id % 11 + 3 AS INT), 160)) AS reference FROM events",
    ),
    "chromosomes": ("region", f"SELECT CAST(r_regionkey AS BIGINT) AS chr, substr(repeat('{MOTIF}', 14000), CAST(r_regionkey*13 + 1 AS INT), 1300000) AS seq FROM region"),
    "calls": (
        "orders",
        f"SELECT o_orderkey AS var_id, CAST((o_orderkey*7 + 1) // 1000 % 5 AS BIGINT) AS chr, CAST(o_orderkey*7+1 AS BIGINT) AS pos, {_CALLED} AS ref_base,"
        f" concat(translate({_CALLED}, 'ATCG', 'TAGC'), CASE WHEN o_orderkey % 600 = 0 THEN 'A' ELSE '' END) AS alt_base, '.' AS filt FROM orders WHERE o_orderkey % 40 = 0 OR o_orderkey % 29 = 0",
    ),
    "mated": (
        "events",
        "SELECT read_id, chr, start_pos, start_pos + CASE cigar WHEN '60M' THEN 59 WHEN '7S53M' THEN 52 ELSE 56 END AS end_pos, cigar, mapq, unmapped, duplicate, mate_chr, mate_start,"
        " CASE cigar WHEN '60M' THEN whole WHEN '7S53M' THEN concat('GGGGGGN', substr(whole, 1, 53)) ELSE concat(substr(whole, 1, 25), 'TTT', substr(whole, 26, 32)) END AS seq FROM"
        " (SELECT event_id AS read_id, CAST(event_id // 100 % 5 AS BIGINT) AS chr, CAST(event_id*10+1 AS BIGINT) AS start_pos, CAST(event_id % 61 AS INT) AS mapq, event_type='error' AS unmapped,"
        " event_type='signup' AS duplicate, CAST((event_id // 100 + event_id % 7 // 6) % 5 AS BIGINT) AS mate_chr, CAST(event_id*10 + 1 + event_id % 5 * 90 AS BIGINT) AS mate_start,"
        f" CASE CAST(event_id % 8 AS INT) WHEN 0 THEN '7S53M' WHEN 1 THEN '25M3I32M' ELSE '60M' END AS cigar, {_ALTERED} AS whole FROM events) t",
    ),
    "likeness": (
        "lineitem",
        "SELECT CAST((l_partkey*50 + 1) // 1000 % 5 AS BIGINT) AS align_chr, CAST(l_partkey*50+1 AS BIGINT) AS align_start, CAST(l_partkey*50+1+100+l_quantity*8 AS BIGINT) AS align_end,"
        " CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_orderkey % 5 AS BIGINT) END AS origin_chr, CAST((l_orderkey*7) % 100000 + 1 AS BIGINT) AS origin_start,"
        " CAST((l_orderkey*7) % 100000 + 101 + l_quantity*8 AS BIGINT) AS origin_end, CASE WHEN l_returnflag='R' THEN '-' ELSE '+' END AS strand, CAST(l_linenumber-1 AS BIGINT) AS penalty,"
        " CAST(l_partkey*50 + 20 AS BIGINT) AS a1, CAST(l_partkey*50 + 31 + l_orderkey % 60 AS BIGINT) AS a2, CAST((l_partkey*50 + 279) // 280 * 280 + 1 AS BIGINT) AS a3 FROM lineitem WHERE l_orderkey % 53 < 2",
    ),
    "alleles": (
        "orders",
        "SELECT o_orderkey AS var_id, CAST(o_custkey % 5 AS VARCHAR(20)) AS chr, CAST(o_orderkey*7+1 AS BIGINT) AS pos, substr('ATCG', CAST(o_custkey % 4 + 1 AS INT), CAST(o_orderkey % 3 // 2 + 1 AS INT)) AS ref_base,"
        " CASE WHEN o_orderkey % 4 = 0 THEN 'G,TT' WHEN o_orderkey % 4 = 1 THEN 'C' WHEN o_orderkey % 4 = 2 THEN 'A,C,G' ELSE 'AC' END AS alt_base FROM orders",
    ),
    "links": (
        "orders",
        "SELECT DISTINCT o_orderkey AS from_id, (o_orderkey*37 + k*11) % 1500 AS to_id, CAST(k-1 AS BIGINT) AS rank FROM orders"
        " JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3) n ON k <= o_custkey % 3 + 1 WHERE o_orderstatus='P'",
    ),
    "bed": ("part", "SELECT CAST(p_partkey % 5 AS BIGINT) AS chr, CAST(p_partkey*40 AS BIGINT) AS start0, CAST(p_partkey*40 + p_size*6 AS BIGINT) AS end0 FROM part"),
    "ids": ("part", "SELECT CAST(p_partkey % 5 AS BIGINT) AS chr, CAST((p_partkey // 2)*7+1 AS BIGINT) AS pos, concat('rs', CAST(p_partkey AS VARCHAR(20))) AS id, p_partkey AS row_no FROM part"),
}

CTE = {name: f"{name} AS ({sql.format(g=chr(44) + chr(39) + 'g' + chr(39)) if '{g}' in sql else sql})" for name, (_, sql) in _SELECTS.items()}


def with_views(*names: str) -> str:
    """The WITH clause of these relations for the checking engine."""
    return "WITH " + ",\n".join(CTE[n] for n in names)


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, sql = _SELECTS[name]
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    sql = sql.format(g="") if "{g}" in sql else sql
    return spark.sql(sql.replace("//", " DIV ").replace(f"FROM {table}", "FROM {source}"), source=df)
