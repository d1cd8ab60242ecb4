from collections import defaultdict

import numpy as np

from kinstrand.llm import neighbours


def brute(rows, k=5, every=50):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    u = x / np.sqrt((x * x).sum(1))[:, None]
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = u @ u[q]
        out[int(ids[q])] = sorted((-s[j], int(ids[j])) for j in range(len(ids)) if ids[j] != ids[q])[:k]
    return out


def by_query(found):
    out = defaultdict(list)
    for r in found.orderBy("query_id", "rank").collect():
        out[r["query_id"]].append((-r["score"], r["vec_id"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = by_query(neighbours.nearest(df))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 5 for q in want]) >= 0.9
    scores = {q: dict((i, s) for s, i in brute_all) for q, brute_all in want.items()}
    for q, own in got.items():
        for s, i in own:
            assert i not in scores[q] or abs(scores[q][i] - s) < 1e-12


def test_clusters_and_common_vector(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_QUERIES", 8)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(30, 16))
    rows = [(k, (centres[k % 30] + 0.2 * rng.normal(size=16)).tolist()) for k in range(2000)]
    rows += [(k, rows[3][1]) for k in range(2000, 3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = brute(rows), by_query(neighbours.nearest(df, sample=1200, cell_vectors=64))
    assert set(got) == set(want)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 5 for q in want]) >= 0.9
    assert [i for _, i in got[2500]] == [3, 2000, 2001, 2002, 2003] and [i for _, i in got[2000]] == [3, 2001, 2002, 2003, 2004]


def test_visits_are_a_part_of_the_table(spark):
    """The tree carries the result: a search of a quarter of the leaves of the cells that it visits finds nine in ten."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    x = neighbours._units(np.array([r["embedding"] for r in df.collect()], float))
    tree = neighbours.fit_tree(x, 250)
    share = neighbours.calibrate(tree, x, 5)
    assert tree.visits / tree.n_leaves * share < 0.45


def test_cells_split_until_they_are_small(spark):
    rng = np.random.default_rng(6)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    want = brute([(r["vec_id"], r["embedding"]) for r in df.collect()])
    got = by_query(neighbours.nearest(df, sample=300, cell_vectors=100))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 5 for q in want]) >= 0.9


def test_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (100, None), (150, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (2, [0.0, 1.0])]
    df = spark.createDataFrame([(*r, 9) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = by_query(neighbours.nearest(df))
    assert {q: [i for _, i in v] for q, v in got.items()} == {0: [1, 50, 2], 50: [0, 1, 2]}
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.where("vec_id = 0")).count() == 0
