"""A small genome with planted repeats, from reads to annotated variants."""

import random

import pytest
from pyspark.sql import functions as F

from kinstrand.config import EngineConfig
from kinstrand.functions import cigar as cg
from kinstrand.operators import align, annotate, build, entries, evaluate, pileup

L, EAR = 20, 5
TURN = str.maketrans("ATCG", "TAGC")


def rc(s):
    return s.translate(TURN)[::-1]


@pytest.fixture(scope="module")
def sequences():
    rng = random.Random(7)
    base = lambda n: "".join(rng.choice("ATCG") for _ in range(n))
    copy = base(60)
    changed = copy[:29] + ("A" if copy[29] != "A" else "C") + copy[30:]
    one = base(50) + copy + base(40) + "N" * 5 + base(45)
    two = base(30) + changed + base(30) + rc(copy) + base(30)
    return {"1": one, "2": two}


@pytest.fixture(scope="module")
def genome(spark, sequences):
    return spark.createDataFrame(list(sequences.items()), "chr string, seq string").cache()


def brute_hits(seqs, stride, most):
    windows = [(c, k + 1, s[k : k + L]) for c, s in seqs.items() for k in range(len(s) - L)]
    out = set()
    for c, s in seqs.items():
        for k in range(0, len(s) - L, stride):
            read = s[k : k + L]
            if "N" in read:
                continue
            for strand, w in (("+", read), ("-", rc(read))):
                for ac, a, x in windows:
                    if w[:EAR] == x[:EAR] and w[-EAR:] == x[-EAR:] and not (strand == "+" and (ac, a) == (c, k + 1)):
                        d = sum(p != q for p, q in zip(w, x, strict=True))
                        if d <= most:
                            out.add((c, k + 1, ac, a, strand, d))
    return out


@pytest.fixture(scope="module")
def table(genome):
    reads = align.generate_reads(genome, L, 1)
    found = align.hits(reads, genome, L, EAR, 2, both_strands=True)
    made = build.first_pass(align.entries_of_hits(found, genome, L), L, 2)
    return made.select(*(F.col(c).cast("long").alias(c) if c.endswith(("start", "end")) or c == "penalty" else F.col(c) for c in made.columns)).cache()


def test_hits(genome, sequences):
    for stride in (1, 3):
        reads = align.generate_reads(genome, L, stride)
        got = {tuple(r) for r in align.hits(reads, genome, L, EAR, 2, both_strands=True).select("origin_chr", "origin_start", "align_chr", "align_start", "strand", "mismatches").collect()}
        assert got == brute_hits(sequences, stride, 2) and any(x[4] == "-" for x in got) and any(x[5] == 1 for x in got)


def test_reads_and_pairs(genome, sequences):
    reads = {r["read_name"]: r["seq"] for r in align.generate_reads(genome, L, 7, 2).collect()}
    want = {f">T{L};{c}:{k + 1}-{k + L}": s[k : k + L] for c, s in sequences.items() for k in range(2, len(s) - L, 7) if "N" not in s[k : k + L]}
    assert reads == want
    for r in align.generate_pairs(genome, L, 5, 50).collect():
        s = sequences[r["chr"]]
        assert r["seq"] == s[r["start"] - 1 : r["start"] - 1 + L] and rc(r["seq2"]) == s[r["start2"] - 1 : r["start2"] - 1 + L] and r["start2"] - r["start"] == 50 - L


def test_entries_describe_the_genome(table, sequences):
    """Each anchor is a difference, and everything else is equal; the table is its own mirror image."""
    rows = table.collect()
    for r in rows:
        s, o = sequences[r["align_chr"]], sequences[r["origin_chr"]]
        a = {x["align_pos"]: x for x in r["anchors"]}
        for k in range(L):
            p = r["align_start"] + k
            q = r["origin_start"] + k if r["strand"] == "+" else r["origin_end"] - k
            seen = o[q - 1] if r["strand"] == "+" else o[q - 1].translate(TURN)
            assert (p in a) == (s[p - 1] != seen)
            if p in a:
                assert (a[p]["origin_pos"], a[p]["align_ref"], a[p]["align_alt"], a[p]["origin_ref"]) == (q, s[p - 1], seen, o[q - 1])
    key = lambda df: sorted(str(r) for r in df.collect())
    assert key(entries.reversed_entries(entries.reversed_entries(table))) == key(table)
    assert set(key(table.distinct())) == set(key(entries.reversed_entries(table).distinct()))


def test_merge_and_extend(table, genome, sequences):
    merged = entries.merge_diagonals(table)
    long = [r for r in merged.collect() if r["align_end"] - r["align_start"] >= 50]
    assert {(r["align_chr"], r["origin_chr"], r["strand"]) for r in long} >= {("1", "2", "+"), ("2", "1", "+"), ("1", "2", "-"), ("2", "1", "-"), ("2", "2", "-")}
    assert any(r["penalty"] == 1 and r["anchors"][0]["align_pos"] == 80 for r in long if r["align_chr"] == "1")
    for r in merged.collect():
        starts = sorted((x["align_start"] for x in table.collect() if (x["align_chr"], x["origin_chr"], x["strand"]) == (r["align_chr"], r["origin_chr"], r["strand"]) and (x["align_start"] - x["origin_start"] if x["strand"] == "+" else x["align_end"] + x["origin_start"]) == (r["align_start"] - r["origin_start"] if r["strand"] == "+" else r["align_end"] + r["origin_start"]) and r["align_start"] <= x["align_start"] <= r["align_end"]))
        assert starts[0] == r["align_start"] and starts[-1] + L - 1 == r["align_end"] and all(b - a < L for a, b in zip(starts, starts[1:], strict=False))
    grown = build.extend(merged.drop("n_merged"), genome, L, 2).collect()
    for r in grown:
        s, o = sequences[r["align_chr"]], sequences[r["origin_chr"]]
        assert r["align_end"] - r["align_start"] == r["origin_end"] - r["origin_start"] and r["penalty"] == len(r["anchors"])
        differing = 0
        for k in range(r["align_end"] - r["align_start"] + 1):
            seen = o[r["origin_start"] - 1 + k] if r["strand"] == "+" else o[r["origin_end"] - 1 - k].translate(TURN)
            differing += s[r["align_start"] - 1 + k] != seen
        assert differing == len(r["anchors"])
    bounded = build.extend(merged.drop("n_merged"), genome, L, 2, bucket=50).collect()
    old = {(r["align_chr"], r["align_end"] // 50) for r in merged.collect()}
    assert old and all(r["align_start"] >= 1 for r in bounded)


def test_greedy_merge(table, genome):
    got = build.greedy_merge(table, genome, L, 2, bucket=1000).collect()
    assert any(r["align_end"] - r["align_start"] >= 55 for r in got) and len(got) < table.count() / 3
    a = {"align_chr": "1", "origin_chr": "2", "strand": "+", "align_start": 1, "align_end": 10, "origin_start": 101, "origin_end": 110, "anchors": [], "penalty": 0}
    b = a | {"align_start": 10, "align_end": 19, "origin_start": 110, "origin_end": 119}
    assert build.merge_pair(a, b)["align_end"] == 19
    assert build.merge_pair(a, b | {"align_start": 11, "origin_start": 111}) is None
    assert build.merge_pair(a, b | {"origin_start": 109, "origin_end": 118}) is None
    assert build.merge_pair(a, b | {"strand": "-"}) is None


def test_unaligned_and_caps(genome):
    reads = align.generate_reads(genome, L, 1)
    found = align.hits(reads, genome, L, EAR, 2)
    for r in align.unaligned(reads, found).collect():
        assert r["end0"] - r["start0"] >= L
    few, over = align.capped_hits(reads, genome, L, EAR, 2, 0)
    close = found.where("mismatches <= 1").select("origin_chr", "origin_start").distinct().count()
    assert over.count() == close and few.where("mismatches <= 1").count() == 0
    assert build.unmapped_entries(align.unaligned(reads, found)).where("origin_chr IS NULL").count() > 0


CFG = EngineConfig(read_length=L, ear_length=EAR, clip=3, hit_count=2, insert_size=40)


def make_reads(spark, sequences, chromosome, pos, alt, starts, cigar=f"{L}M", extra=()):
    rows = []
    for k, s in enumerate(starts):
        seq = list(sequences[chromosome][s - 1 : s - 1 + L])
        if s <= pos < s + L:
            seq[pos - s] = alt
        rows.append((k, chromosome, s, s + L - 1, "".join(seq), 60, False, False, cigar, chromosome, s + 10))
    df = spark.createDataFrame([*rows, *extra], "read_id long, chr string, start_pos long, end_pos long, seq string, mapq int, unmapped boolean, duplicate boolean, c string, mate_chr string, mate_start long")
    return df.withColumn("cigar", cg.parse(F.col("c"))).drop("c")


def test_annotate_with_reads(spark, genome, table, sequences):
    merged = entries.merge_diagonals(table).drop("n_merged")
    pos = 95  # inside the copy of chromosome 1, beside the anchor at 80
    ref = sequences["1"][pos - 1]
    alt = next(b for b in "ATCG" if b != ref)
    variants = spark.createDataFrame([(1, "1", pos, ref, alt, "."), (2, "1", 10, "A", "C", "q10"), (3, "1", pos, "AT", "A", "."), (4, "1", 60, sequences["1"][59], "N", ".")], "var_id long, chr string, pos long, ref_base string, alt_base string, filt string")
    reads = make_reads(spark, sequences, "1", pos, alt, range(82, 92))
    done, links = annotate.annotate(variants, merged, reads, genome, CFG)
    got = {r["var_id"]: (r["token"], r["n_links"], r["filt"]) for r in done.collect()}
    assert got[1] == ("thesaurus", 2, "thesaurus") and got[2] == ("pass", 0, "q10") and got[3] == ("pass", 0, "PASS")
    assert got[4][0] == "thesaurushard"
    places = {(r["to_chr"], r["to_pos"]): (r["to_ref"], r["to_alt"]) for r in links.collect()}
    offset = pos - 51
    plus, minus = 31 + offset, 30 + 60 + 30 + 60 - offset
    assert places == {("2", plus): (ref, alt), ("2", minus): (ref.translate(TURN), alt.translate(TURN))}
    # one read is not enough, and reads with a deletion or many mismatches don't count
    assert annotate.annotate(variants, merged, reads.limit(1), genome, CFG)[0].where("var_id = 1").first()["token"] == "thesaurushard"
    indel = make_reads(spark, sequences, "1", pos, alt, range(82, 92), f"{L - 5}M2D5M")
    assert annotate.annotate(variants, merged, indel, genome, CFG)[0].where("var_id = 1").first()["token"] == "thesaurushard"
    # a mate far from every entry speaks against a read
    far = reads.withColumn("mate_start", F.lit(5000).cast("long"))
    assert annotate.annotate(variants, merged, far, genome, CFG)[0].where("var_id = 1").first()["token"] == "pass"


def test_variant_on_an_anchor(spark, genome, table, sequences):
    merged = entries.merge_diagonals(table).drop("n_merged")
    anchor = next(r for r in merged.collect() if r["align_chr"] == "1" and r["origin_chr"] == "2" and r["strand"] == "+" and r["penalty"] == 1)["anchors"][0]
    pos, ref, alt = anchor["align_pos"], anchor["align_ref"], anchor["align_alt"]
    variants = spark.createDataFrame([(1, "1", pos, ref, alt, ".")], "var_id long, chr string, pos long, ref_base string, alt_base string, filt string")
    reads = make_reads(spark, sequences, "1", pos, alt, range(pos - 15, pos - 4))
    done, links = annotate.annotate(variants, merged, reads, genome, CFG)
    # the alternative is what the other copy has: there it would be no variant
    assert ("2", anchor["origin_pos"]) not in {(r["to_chr"], r["to_pos"]) for r in links.collect()}
    other = next(b for b in "ATCG" if b not in (ref, alt))
    variants = variants.withColumn("alt_base", F.lit(other))
    done, links = annotate.annotate(variants, merged, make_reads(spark, sequences, "1", pos, other, range(pos - 15, pos - 4)), genome, CFG)
    assert ("2", anchor["origin_pos"]) in {(r["to_chr"], r["to_pos"]) for r in links.collect()}


def test_limits_and_unknown_origins(spark, table):
    merged = entries.merge_diagonals(table).drop("n_merged")
    variants = spark.createDataFrame([(1, "1", 70, "A", "C", "PASS")], "var_id long, chr string, pos long, ref_base string, alt_base string, filt string")
    assert annotate.annotate(variants, merged, None, None, CFG)[0].first()["token"] == "thesaurus"
    one = EngineConfig(read_length=L, ear_length=EAR, too_many=1)
    assert annotate.annotate(variants, merged, None, None, one)[0].first()["filt"] == "thesaurusmany"
    lost = spark.createDataFrame([("1", 60, 80, None, None, None, 0, "+")], "align_chr string, align_start long, align_end long, origin_chr string, origin_start long, origin_end long, penalty long, strand string").withColumn("anchors", F.array().cast(entries.ANCHORS))
    assert annotate.annotate(variants, merged.unionByName(lost), None, None, CFG)[0].first()["token"] == "thesaurusmany"


def test_filters_and_genotypes(spark):
    df = spark.createDataFrame([(".", "pass"), ("PASS", "pass"), ("q10", "pass"), (".", "x"), ("PASS", "x"), ("q10", "x"), (None, "x")], "f string, t string")
    assert [r[0] for r in df.select(annotate.add_filter(F.col("f"), F.col("t"))).collect()] == ["PASS", "PASS", "q10", "x", "x", "q10;x", "x"]
    df = spark.createDataFrame([("GT", "0/1", 3), ("GT:TS:DP", "0/1:9:7", 3)], "f string, g string, n int")
    got = [tuple(r) for r in df.select(*annotate.tag_genotype(F.col("f"), F.col("g"), F.col("n"))).collect()]
    assert got == [("GT:TS", "0/1:3"), ("GT:TS:DP", "0/1:3:7")]
    assert evaluate.parse_region("chr1:5-9") == ("chr1", 5, 9)
    assert [r["alt_base"] for r in annotate.split_alleles(spark.createDataFrame([("A,C",)], "alt_base string")).collect()] == ["A", "C"]


def test_simulate_and_score(spark, genome, sequences):
    truth, changed = evaluate.mutate(genome, 50_000, 3)
    new = {r["chr"]: r["seq"] for r in changed.collect()}
    found = {(c, k + 1, a, b) for c, s in sequences.items() for k, (a, b) in enumerate(zip(s, new[c], strict=True)) if a != b}
    assert found == {tuple(r) for r in truth.collect()} and found
    called = truth.withColumn("var_id", F.monotonically_increasing_id()).withColumn("filt", F.lit("."))
    none = spark.createDataFrame([], "var_id long, rank long, to_chr string, to_pos long")
    totals = {r["kind"]: r["n"] for r in evaluate.truth_totals(called, truth, none).collect()}
    assert totals == {"TP": len(found), "FP": 0, "FN": 0, "TPlinked": 0}
    some = called.where("pos % 2 = 0")
    totals = {r["kind"]: r["n"] for r in evaluate.truth_totals(some, truth, none).collect()}
    assert totals["TP"] + totals["FN"] == len(found)


def test_pooled_equals_naive_without_links(spark, sequences):
    variants = spark.createDataFrame([(1, "1", 95, "A", "C", ".")], "var_id long, chr string, pos long, ref_base string, alt_base string, filt string")
    reads = make_reads(spark, sequences, "1", 95, "C", range(80, 90))
    counts = pileup.base_counts(variants, reads)
    none = spark.createDataFrame([], "var_id long, to_chr string, to_pos long, to_ref string, to_alt string")
    assert pileup.naive_frequency(variants, counts).first()["naive_baf"] == pileup.pooled_frequency(variants, none, counts).first()["pooled_baf"] == 1.0
    assert spark.range(1).select(pileup.four_places_text(F.lit(0.03125))).first()[0] == "0.0312"
