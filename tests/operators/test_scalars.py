import random

import pytest
from pyspark.sql import functions as F

from kinstrand.functions import cigar as cg
from kinstrand.functions import dna


def test_dna(spark):
    rng = random.Random(1)
    pairs = [("".join(rng.choice("ATCG") for _ in range(30)), "".join(rng.choice("ATCG") for _ in range(30))) for _ in range(200)]
    df = spark.createDataFrame([(a, b) for a, b in pairs], "a string, b string")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", dna.hamming(a, b).alias("h"), dna.packed_distance(dna.packed(a), dna.packed(b)).alias("p"), dna.reverse_complement(dna.reverse_complement(a)).alias("rr"), dna.kmer_code(F.substring(a, 1, 4), 4).alias("k")).collect()
    for r in rows:
        want = sum(x != y for x, y in zip(r["a"], r["b"], strict=True))
        assert r["h"] == r["p"] == want and r["rr"] == r["a"]
        code = 0
        for c in r["a"][:4]:
            code = code * 4 + "ATCG".index(c)
        assert r["k"] == code
    odd = spark.createDataFrame([("ANT",), ("AT",), ("ATC",)], "a string").select(dna.kmer_code(a, 3).alias("k"), dna.count_unknown(a).alias("n")).collect()
    assert [tuple(r) for r in odd] == [(-1, 1), (-1, 0), (6, 0)]
    masked = spark.createDataFrame([("ANTC", "ACTG")], "a string, b string").select(
        dna.packed_distance(dna.packed(a), dna.packed(b), dna.unknown_bits(a).bitwiseOR(dna.unknown_bits(b))).alias("d")
    )
    assert masked.first()["d"] == 2


def walk(cigar, start):
    """Reference position of each base of a read."""
    import re

    out, at = [], start
    for n, op in re.findall(r"(\d+)([MIDNS])", cigar):
        for _ in range(int(n)):
            if op in "MDN":
                if op == "M":
                    out.append(at)
                at += 1
            else:
                out.append(-1)
    return out, at - 1


CIGARS = ["10M", "4M3D6M", "4M2I4M", "3S7M", "4M5N6M", "2S3M1I2M2D1M1S", "3M1D1I6M"]


def test_cigar_walk(spark):
    df = spark.createDataFrame([(c, "ACGTACGTAC") for c in CIGARS], "c string, s string").withColumn("e", cg.parse(F.col("c")))
    start = F.lit(5)
    got = df.select("c", cg.to_text(F.col("e")).alias("t"), cg.base_positions(F.col("e"), start).alias("p"), cg.reference_span(F.col("e")).alias("n"), cg.has_indel_or_splice(F.col("e")).alias("i"), cg.is_complex(F.col("e")).alias("x"), cg.has_long_indel(F.col("e"), 2).alias("l"), *(cg.base_at(F.col("s"), F.col("e"), start, F.lit(k)).alias(f"b{k}") for k in range(4, 22))).collect()
    for r in got:
        positions, end = walk(r["c"], 5)
        assert r["t"] == r["c"] and r["p"] == positions and r["n"] == end - 4
        assert r["i"] == any(x in r["c"] for x in "IDN") and r["x"] == ("1D1I" in r["c"]) and r["l"] == ("3D" in r["c"])
        for k in range(4, 22):
            assert r[f"b{k}"] == ("ACGTACGTAC"[positions.index(k)] if k in positions else "N")


def test_soft_clip_equals_scan(spark):
    """Against a plain scan: first and last row of enough matches."""
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        cigar = rng.choice(CIGARS[:6])
        _, end = walk(cigar, 1)
        seq = ["A"] * 10
        for k in rng.sample(range(10), rng.randint(0, 4)):
            seq[k] = "C"
        rows.append((cigar, "".join(seq), "A" * end))
    df = spark.createDataFrame(rows, "c string, s string, r string").withColumn("e", cg.parse(F.col("c")))
    got = df.select("c", "s", cg.soft_clip(F.col("s"), F.col("e"), F.lit(1), F.col("r"), 3).alias("x"), cg.mismatch_count(F.col("s"), F.col("e"), F.lit(1), F.col("r")).alias("m")).collect()
    for r in got:
        positions, end = walk(r["c"], 1)
        good = [p > 0 and r["s"][k] == "A" for k, p in enumerate(positions)]
        rows_of = [k for k in range(8) if all(good[k : k + 3])]
        left = rows_of[0] if rows_of else 0
        right = rows_of[-1] + 2 if rows_of else left
        x = r["x"]
        text = "".join(f"{e['len']}{e['op']}" for e in x["cigar"])
        if positions[left] < 0 or positions[right] < 0 or (left == 0 and right == 9):
            assert (x["start"], x["end"], text) == (1, end, r["c"])
        else:
            assert (x["start"], x["end"]) == (positions[left], positions[right])
            inner, last = walk(text, x["start"])
            assert inner == [p if left <= k <= right else -1 for k, p in enumerate(positions)] and last == x["end"]
        differing = sum(p > 0 and c != "A" for p, c in zip(positions, r["s"], strict=True))
        assert r["m"] == differing + sum(op in "IDN" for op in r["c"])


def test_blocks(spark):
    df = spark.createDataFrame([(20, [5, 10], [2, 8], [100, 105]), (10, [10], [0], [7])], "n int, s array<int>, q array<int>, t array<int>")
    assert [r[0] for r in df.select(cg.from_blocks(F.col("n"), F.col("s"), F.col("q"), F.col("t"))).collect()] == ["2S5M1I10M2S", "10M"]


def test_config(tmp_path):
    from kinstrand.config import EngineConfig

    cfg = EngineConfig(read_length=50, penalty=3)
    cfg.save(tmp_path / "x.json")
    assert EngineConfig.load(tmp_path / "x.json") == cfg and EngineConfig.load(tmp_path / "no") == EngineConfig()
    with pytest.raises(ValueError):
        EngineConfig(divisor=0)
