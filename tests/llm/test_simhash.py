from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tests_llm_helpers import brute_components, brute_print

from kinstrand.llm import simhash


def test_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    prints = {r["doc_id"]: brute_print(r["text"]) for r in df.collect()}
    want = brute_components(prints)
    got = simhash.near_duplicates(df, segment=40).collect()
    assert {r["doc_id"]: r["fp"] & (2**64 - 1) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(want)


def test_edges(spark):
    rows = [(5, None), (3, ""), (9, " \n"), (4, "one"), (8, "ONE"), (7, "a b c d"), (7, "e f g h i"), (2, "e f g h i"), (6, "a b c d"), (None, "a b c d"), (10, "long words here " * 20000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(df).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    class_of = {(r["doc_id"], r["fp"]): r["component_id"] for r in got}
    assert {class_of[d, 0] for d in (3, 5, 9)} == {3}
    assert {v for (d, _), v in class_of.items() if d in (4, 8)} == {4}
    assert {v for (d, _), v in class_of.items() if d in (2, 6, 7)} == {2}
    assert {v for (d, _), v in class_of.items() if d is None} == {None}
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_segments(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 6)
    rows = []
    for k in range(900):
        fp = int(base[k % 6])
        for b in rng.choice(64, rng.integers(0, 8), replace=False):
            fp ^= 1 << int(b)
        rows.append((k, fp - (1 << 64) if fp >> 63 else fp))
    rows = list({fp: (k, fp) for k, fp in rows}.values())
    want = brute_components({k: fp & (2**64 - 1) for k, fp in rows})
    from kinstrand.plans.graph import connected_components

    for segment, tasks in ((7, 1), (100, 3), (10_000, 4)):
        links = simhash.near_links(spark.createDataFrame(rows, "name long, fp long"), segment=segment, tasks=tasks)
        got = {k: k for k, _ in rows} | {r["vertex"]: r["component"] for r in connected_components(links).collect()}
        assert got == want


def test_the_index_prunes_most_groups():
    """Of all pairs of leaves of random fingerprints only few are compared."""
    rng = np.random.default_rng(8)
    fp = rng.integers(0, 2**64, 1 << 15, dtype=np.uint64)
    fp = fp[np.argsort(simhash.gray_rank(fp), kind="stable")]
    index = simhash.GrayIndex(fp)
    n = len(index.levels[0][0])
    compared = sum(len(a) for a, _ in index.leaf_pairs(index, 4, simhash._lead(2), 2))
    assert compared < 0.06 * n * n


def test_common_fingerprints_and_names(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    rows = [(k, "" if k % 2 else f"some words {k} of their own here {k * 7}") for k in range(40)]
    df = spark.createDataFrame([(d, t, 1, 2, 3) for d, t in rows], "doc_id long, text string, gone int, place int, `place~` int")
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert got == brute_components({d: brute_print(t) for d, t in rows})
    kept = simhash.keep_first(df.unionByName(df))
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(got.values()))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=6), st.lists(st.tuples(st.integers(0, 5), st.sets(st.integers(0, 63), max_size=5)), max_size=90), st.integers(0, 6))
def test_index_equals_all_pairs(base, flips, distance):
    fp = np.array(sorted({base[k % len(base)] ^ sum(1 << b for b in bits) for k, bits in flips} | set(base)), np.uint64)
    half, found = (len(fp) + 1) // 2, []
    for by in (0, 32):
        turned = simhash._turned(fp, by)
        own, asking = (g[np.argsort(simhash.gray_rank(turned[g]), kind="stable")] for g in (np.arange(half), np.arange(len(fp))))
        number = np.concatenate([own, asking])
        found += [(int(number[x]), int(number[y])) for x, y in simhash.forest_links(turned[own], turned[asking], distance)]
    a, b = simhash.Forest(len(fp)), simhash.Forest(len(fp))
    assert all(int(fp[x] ^ fp[y]).bit_count() <= distance for x, y in found)
    near = [(i, j) for i in range(half) for j in range(len(fp)) if int(fp[i] ^ fp[j]).bit_count() <= distance]
    for forest, pairs in ((a, found), (b, near)):
        for i, j in pairs:
            forest.join(np.array([i]), np.array([j]))
    every = np.arange(len(fp))
    assert a.roots(every).tolist() == b.roots(every).tolist()
