import random

import pytest
from pyspark.sql import functions as F

from kinstrand.operators import intervals as iv


@pytest.fixture(scope="module")
def spans():
    rng = random.Random(4)
    return [(k, rng.randint(0, 1), s := rng.randint(1, 400), s + rng.choice([-1, 0, 3, 10, 60])) for k in range(120)]


def frame(spark, spans, p=""):
    return spark.createDataFrame(spans, f"{p}id long, {p}chr long, {p}start long, {p}end long")


@pytest.mark.parametrize("size", [7, 64, 1000])
def test_joins(spark, spans, size):
    a, b = frame(spark, spans[:60]), frame(spark, spans[60:], "r")
    got = iv.overlap_join(a, b, [("chr", "rchr")], (F.col("start"), F.col("end")), (F.col("rstart"), F.col("rend")), size)
    want = sorted((x[0], y[0]) for x in spans[:60] for y in spans[60:] if x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3])
    assert sorted((r["id"], r["rid"]) for r in got.collect()) == want
    got = iv.stab_join(a, b, [("chr", "rchr")], F.col("start"), (F.col("rstart"), F.col("rend")), size)
    want = sorted((x[0], y[0]) for x in spans[:60] for y in spans[60:] if x[1] == y[1] and y[2] <= x[2] <= y[3])
    assert sorted((r["id"], r["rid"]) for r in got.collect()) == want
    twice = a.unionAll(a)
    got = iv.overlap_semi(twice, b, [("chr", "rchr")], (F.col("start"), F.col("end")), (F.col("rstart"), F.col("rend")), size)
    want = [x[0] for x in spans[:60] if any(x[1] == y[1] and x[2] <= x[3] and y[2] <= y[3] and x[2] <= y[3] and y[2] <= x[3] for y in spans[60:])]
    assert sorted(r["id"] for r in got.collect()) == sorted(want * 2)


def runs_of(flags, one):
    out, begin = [], None
    for k, f in enumerate([*flags, None]):
        if begin is not None and f != one:
            out.append((begin, k - 1))
            begin = None
        if begin is None and f == one:
            begin = k
    return out


@pytest.mark.parametrize("tile", [5, 16, 1 << 16])
def test_unions_and_depths(spark, spans, tile):
    df = frame(spark, spans)
    for chromosome in (0, 1):
        own = [(s, e) for _, c, s, e in spans if c == chromosome and s <= e]
        depth = [sum(s <= k <= e for s, e in own) for k in range(600)]
        got = iv.union_runs(df, ["chr"], tile=tile).where(F.col("chr") == chromosome).orderBy("start").collect()
        assert [(r["start"], r["end"]) for r in got] == runs_of([d > 0 for d in depth], True)
        got = iv.depth_runs(df, ["chr"], tile=tile).where(F.col("chr") == chromosome).collect()
        want = sorted((a, b, d) for d in set(depth) - {0} for a, b in runs_of(depth, d))
        assert sorted((r["start"], r["end"], r["depth"]) for r in got) == want
        # a shared base is needed: extend each by a half base to either side in a doubled axis
        fused = []
        for s, e in sorted(own):
            if fused and s <= fused[-1][1]:
                fused[-1][1] = max(fused[-1][1], e)
            else:
                fused.append([s, e])
        got = iv.union_runs(df, ["chr"], touching=False, tile=tile).where(F.col("chr") == chromosome).orderBy("start").collect()
        assert [[r["start"], r["end"]] for r in got] == fused


def test_plans_are_equi_joins(spark, spans):
    a, b = frame(spark, spans[:60]), frame(spark, spans[60:], "r")
    for df in (
        iv.overlap_join(a, b, [("chr", "rchr")], (F.col("start"), F.col("end")), (F.col("rstart"), F.col("rend"))),
        iv.stab_join(a, b, [("chr", "rchr")], F.col("start"), (F.col("rstart"), F.col("rend"))),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_order(spark):
    rows = [3, 1, 2, 2, 9, 8, 8, 1]
    df = spark.createDataFrame(list(enumerate(rows)), "row_id long, x long")
    for chunk in (2, 3, 100):
        assert sorted(r["row_id"] for r in iv.out_of_order(df, "row_id", ["x"], chunk).collect()) == [1, 5, 7]


def test_values(spark):
    pts = spark.createDataFrame([(1, 5), (1, 50)], "chr long, p long")
    reg = spark.createDataFrame([(1, 9, 1, "a"), (1, 2, 100, "b"), (2, 1, 9, "c")], "rchr long, s long, e long, name string")
    got = {r["p"]: (r["labels"], r["n_intervals"]) for r in iv.values_at(pts, reg, [("chr", "rchr")], "p", "s", "e", "name").collect()}
    assert got == {5: ("a,b", 2), 50: ("b", 1)}


def test_tiles_of_a_genome(spark):
    """Windows and references do not depend on where tiles end."""
    import random

    from kinstrand.operators import align

    rng = random.Random(9)
    seqs = {c: "".join(rng.choice("ATCGN") for _ in range(n)) for c, n in (("a", 157), ("b", 64), ("c", 3), ("d", 0), ("e", 65))}
    genome = spark.createDataFrame([*seqs.items(), ("f", None)], "chr string, seq string")
    for size in (5, 16, 64, 1000):
        for length, stride, offset in ((7, 1, 0), (4, 3, 2), (20, 9, 50), (1, 64, 0)):
            got = sorted(map(tuple, align.windows(genome, length, stride, offset, size).collect()))
            assert got == sorted((c, p, s[p : p + length]) for c, s in seqs.items() for p in range(offset, len(s) - length, stride)), (size, length)
        spans = [("a", 1, 157), ("a", 60, 10), ("a", 64, 1), ("a", 16, 17), ("b", 64, 1), ("c", 1, 3), ("a", 60, 10)]
        got = sorted(map(tuple, align.reference_under(spark.createDataFrame(spans, "chr string, start long, span long"), genome, size).collect()))
        assert got == sorted({(c, s, n, seqs[c][s - 1 : s - 1 + n]) for c, s, n in spans})
    plan = align.generate_reads(genome, 7, 2)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(chr" in plan


def test_alignment_rows_of_every_read(spark):
    from kinstrand.operators import align

    reads = spark.createDataFrame([("a", 1, "x"), ("a", 11, "x"), ("b", 5, "x")], "chr string, start long, seq string")
    found = spark.createDataFrame([("a", 1, "b", 7, "-", 2)], "origin_chr string, origin_start long, align_chr string, align_start long, strand string, mismatches int")
    over = spark.createDataFrame([("b", 5, 900)], "origin_chr string, origin_start long, n_close long")
    got = sorted((r["qname"], r["flag"], r["rname"], r["pos"], r["mapq"], r["cigar"]) for r in align.all_sam_rows(reads, found, over, 10).collect())
    assert got == [("T10;a:1-10", 0, "a", 1, 10, "10M"), ("T10;a:1-10", 272, "b", 7, 8, "10M"), ("T10;a:11-20", 0, "a", 11, 10, "10M"), ("T10;b:5-14", 4, "*", 0, 0, "*")]


@pytest.mark.parametrize("cell", [8, 1024])
def test_distinct_coverage_where_strands_cross(spark, monkeypatch, cell):
    """Every base against sets of its origin positions: long entries, and strands that give a base the same one."""
    from kinstrand.operators import evaluate

    monkeypatch.setattr(evaluate, "CELL", cell)
    rng = random.Random(6)
    rows = [(rng.randint(0, 1), s := rng.randint(1, 90), s + (n := rng.choice([-1, 0, 5, 30])), rng.choice([0, 1, None]), o := rng.randint(1, 60), o + n, rng.choice("+-")) for _ in range(160)]
    e = spark.createDataFrame(rows, "align_chr long, align_start long, align_end long, origin_chr long, origin_start long, origin_end long, strand string")
    places = {}
    for a, s, t, c, o, _, strand in rows:
        for p in range(s, t + 1) if c is not None else ():
            places.setdefault((a, p), set()).add((c, o + p - s if strand == "+" else o + t - p))
    got = {(r["chr"], p): r["cov"] for r in evaluate.distinct_coverage(e).collect() for p in range(r["start"], r["end"] + 1)}
    assert got == {k: len(v) for k, v in places.items()}


def test_distinct_coverage_makes_no_row_for_each_base(spark):
    from kinstrand.operators import evaluate

    e = spark.createDataFrame([(0, 1, 10**7, 1, 5, 10**7 + 4, "+"), (0, 3, 10**7, 1, 7, 10**7 + 4, "+")], "align_chr long, align_start long, align_end long, origin_chr long, origin_start long, origin_end long, strand string")
    made = evaluate.distinct_coverage(e)
    assert [tuple(r) for r in made.collect()] == [(0, 1, 10**7, 1)]
    assert "sequence(align_start" not in made._jdf.queryExecution().toString()


def test_semi_join_of_rows_in_another_order_each_time(spark):
    """On a cluster, rows that were shuffled come in another order whenever they are read."""

    def shuffled(batches):
        import numpy as np

        for batch in batches:
            yield batch.take(np.random.default_rng().permutation(len(batch)))

    left = spark.range(0, 4000, 1, 2).selectExpr("id % 3 AS chr", "id * 10 AS s", "id * 10 + 4 AS e", "id % 7 AS n")
    left = left.mapInArrow(shuffled, left.schema)
    right = spark.range(0, 400).selectExpr("id % 3 AS rchr", "id * 97 AS rs", "id * 97 + 20 AS re")
    got = iv.overlap_semi(left, right, [("chr", "rchr")], (F.col("s"), F.col("e")), (F.col("rs"), F.col("re")))
    spans = [(k % 3, k * 97, k * 97 + 20) for k in range(400)]
    rows = [(k % 3, k * 10, k * 10 + 4, k % 7) for k in range(4000)]
    want = [r for r in rows if any(r[0] == c and r[1] <= e and s <= r[2] for c, s, e in spans)]
    assert got.columns == ["chr", "s", "e", "n"] and sorted(map(tuple, got.collect())) == sorted(want) != []
