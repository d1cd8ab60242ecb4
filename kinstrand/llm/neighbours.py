"""Approximate nearest neighbours by cosine with a hierarchical k-means tree.

The upper tree is fitted on a bounded sample of directions; every vector goes down it into one cell. A cell with more
vectors than one task should hold is split by a tree of its own, fitted in a task on a sample of that cell, and so on, so
the tree grows with the data. The lowest tree of each cell is fitted on all its vectors when the cell is searched.

A query visits bins best first: branches wait in a priority queue by the similarity that their best member can be expected
to have, told by the centre's similarity, how closely the members lie about it, and how many they are. How many cells
and which share of a cell's leaves a query visits is calibrated: both are widened on queries of the sample until their
recall against brute force is reached. Candidates are scored on the original vectors in double precision.

Equal vectors are one entry with its smallest ids, both as candidates and as queries, so that a vector that a third of all
rows share costs as much as any other. A cell that very many queries visit is searched in blocks of them.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.plans.storage import materialize

#: Vectors on which one tree is fitted at most.
SAMPLE = 20_000
BRANCHES = 8
#: Vectors of the sample in a cell of an upper tree, and vectors in a leaf of a lowest tree.
CELL_SAMPLE, LEAF = 1000, 16
#: Recall of cells and of answers that the visits are calibrated to on the sample, and how many of its vectors are asked.
CELL_RECALL, RECALL, CALIBRATION = 0.98, 0.93, 400
#: Vectors of one cell, and queries that one task searches it for.
CELL_VECTORS, CELL_QUERIES = 16_384, 2048


@dataclass
class KMeansTree:
    """``children[k]`` of inner node k are nodes; a leaf has none and its number in ``leaf``. ``tight``: mean cosine of a
    node's members to its centre; ``size``: how many they are."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: list[int]
    tight: np.ndarray
    size: np.ndarray
    visits: int = 1

    @property
    def n_leaves(self) -> int:
        return max(self.leaf) + 1

    def assign(self, units: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector."""
        at = np.zeros(len(units), np.int64)
        out = np.zeros(len(units), np.int64)
        todo = [(0, np.arange(len(units)))]
        while todo:
            node, rows = todo.pop()
            own = self.children[node]
            if not own:
                out[rows] = self.leaf[node]
                continue
            at[rows] = np.argmax(units[rows] @ self.centres[own].T, axis=1)
            todo += [(child, rows[at[rows] == k]) for k, child in enumerate(own) if (at[rows] == k).any()]
        return out

    def promise(self, units: np.ndarray) -> np.ndarray:
        """The similarity that the best member of each node can be expected to have to each query."""
        near = np.clip(units @ self.centres.T, -1, 1)
        spread = np.sqrt((1 - self.tight**2) / max(1, self.centres.shape[1] - 1) * 2 * np.log(self.size + 1))
        return near * self.tight + np.sqrt(1 - near * near) * spread

    def best_bins(self, promise: list[float], most: int, least: int = 0) -> list[int]:
        """The first ``most`` leaves of a best-bin-first search with these promises of all nodes, and more until they hold
        ``least`` of the vectors that the tree was fitted on."""
        queue, found, held = [(0.0, 0)], [], 0
        while queue and (len(found) < most or held < least):
            node = heapq.heappop(queue)[1]
            if self.children[node]:
                for child in self.children[node]:
                    heapq.heappush(queue, (-promise[child], child))
            else:
                found.append(self.leaf[node])
                held += self.size[node]
        return found


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def fit_tree(units: np.ndarray, leaf: int = CELL_SAMPLE, seed: int = 7) -> KMeansTree:
    """Split recursively by spherical k-means into ``BRANCHES`` until a node holds at most ``leaf`` of the vectors."""
    rng = np.random.default_rng(seed)
    dim = units.shape[1] if units.ndim == 2 else 0
    centres, children, leaf_of, tight, size = [np.zeros(dim)], [[]], [-1], [0.0], [len(units)]
    todo, leaves = [(0, np.arange(len(units)))], 0
    while todo:
        node, rows = todo.pop()
        parts = _k_means(units[rows], BRANCHES, rng) if len(rows) > leaf else []
        if len(parts) < 2:
            leaf_of[node] = leaves
            leaves += 1
            continue
        for centre, own in parts:
            children[node].append(len(centres))
            todo.append((len(centres), rows[own]))
            centres.append(centre)
            children.append([])
            leaf_of.append(-1)
            tight.append(float(np.clip((units[rows[own]] @ centre).mean(), 0, 1)))
            size.append(len(own))
    return KMeansTree(np.array(centres), children, leaf_of, np.array(tight), np.array(size))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> list[tuple[np.ndarray, np.ndarray]]:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        label = np.argmax(x @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        norm = np.sqrt((sums * sums).sum(1))
        centres = np.where(norm[:, None] > 0, sums / np.maximum(norm, 1e-300)[:, None], centres)
    label = np.argmax(x @ centres.T, axis=1)
    return [(centres[c], np.flatnonzero(label == c)) for c in range(len(centres)) if (label == c).any()]


def _ranks(tree: KMeansTree, promise: np.ndarray) -> np.ndarray:
    """For each query the place of every leaf in its search."""
    out = np.full((len(promise), tree.n_leaves), tree.n_leaves)
    for row, own in enumerate(promise.tolist()):
        order = tree.best_bins(own, tree.n_leaves)
        out[row, order] = np.arange(len(order))
    return out


def calibrate_cells(tree: KMeansTree, units: np.ndarray, k: int, queries: int = CALIBRATION) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set ``tree.visits`` to the fewest cells, widened by an eighth at a time, with which the first of the vectors that
    the tree was fitted on find the cells of their ``k`` nearest. Returns those, the cell of each vector, and the ranks."""
    n, cell, q = tree.n_leaves, tree.assign(units), units[:queries]
    scores = q @ units.T
    scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
    truth = np.argpartition(-scores, k, axis=1)[:, :k]
    rank = _ranks(tree, tree.promise(q))
    needed = rank[np.arange(len(q))[:, None], cell[truth]]
    visits = 1
    while visits < n and (needed < visits).mean() < CELL_RECALL:
        visits += max(1, visits // 8)
    tree.visits = min(visits, n)
    return truth, cell, rank


def calibrate(tree: KMeansTree, units: np.ndarray, k: int, recall: float = RECALL, queries: int = CALIBRATION) -> float:
    """Set ``tree.visits``, and return the least share of the leaves of a visited cell, widened by an eighth at a time, with
    which the first vectors of the sample find ``recall`` of their ``k`` nearest."""
    if len(units) <= k + 1:
        tree.visits = tree.n_leaves
        return 1.0
    truth, cell, rank = calibrate_cells(tree, units, k, queries)
    q, share_needed = units[:queries], np.full(truth.shape, np.inf)
    for c in np.unique(cell[truth]).tolist():
        rows = np.flatnonzero(cell == c)
        lowest = fit_tree(units[rows], LEAF)
        within = np.full(len(units), -1)
        within[rows] = lowest.assign(units[rows])
        asks = np.flatnonzero((rank[:, c] < tree.visits) & (cell[truth] == c).any(1))
        place = _ranks(lowest, lowest.promise(q[asks]))
        for at, own in zip(asks, place, strict=True):
            hit = np.flatnonzero(cell[truth[at]] == c)
            share_needed[at, hit] = (own[within[truth[at, hit]]] + 1) / lowest.n_leaves
    share = 1 / 64
    while share < 1 and (share_needed <= share).mean() < recall:
        share *= 1.125
    return min(1.0, share)


def _valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, v, a, b`` (the vector's key) of rows that take part."""
    # floats stay floats on their way; every calculation is in double precision
    v = F.col("embedding") if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else F.col("embedding").cast("array<double>")
    good = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0"
        " AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    usual = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return good.where(F.size("v") == (usual["n"] if usual else 0)).select("vec_id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit("second"), "v").alias("b"))


def _least_ids(valid: DataFrame, most: int) -> DataFrame:
    """One row for each different vector: ``a, b, v, ids`` with its ``most`` smallest ids.

    Ids are cut back where they are read and again by shares, so that no task gathers those of a very common vector.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = pd.DataFrame({c: batch.column(c).to_numpy() for c in ("a", "b", "vec_id")})
            first = keys.sort_values("vec_id").drop_duplicates().groupby(["a", "b"], sort=False).head(most).index
            yield batch.take(pa.array(np.sort(first.to_numpy())))

    reduced = valid.mapInArrow(run, valid.schema)
    least = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, most)
    shares = reduced.groupBy("a", "b", F.pmod("vec_id", F.lit(61)).alias("share")).agg(F.any_value("v").alias("v"), least(F.collect_list("vec_id")).alias("ids"))
    return shares.groupBy("a", "b").agg(F.any_value("v").alias("v"), least(F.flatten(F.collect_list("ids"))).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _grow(indexed: DataFrame, visits: DataFrame, kind: str, sample: int, most: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Split the cells with more than ``most`` vectors by a tree each, until none is left that a tree can split; the
    queries that visit such a cell visit cells of its tree, best first, as many as its own sample needs."""
    rounds = 0
    while True:
        big = materialize(indexed.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > most), "big-cells")
        rounds += 1
        if big.isEmpty() or rounds > 12:
            return indexed, visits
        drawn = indexed.join(big, "cell").where(F.pmod(F.xxhash64("a", "b", F.lit(rounds)), F.lit(1 << 30)) < F.lit(sample * (1 << 30)) / F.col("n")).select("cell", "v")

        def fitted(group: pa.Table) -> pa.Table:
            units = _units(_matrix(group.column("v").combine_chunks())[: 2 * sample])
            below = fit_tree(units, max(LEAF, len(units) // 64))
            below.visits = below.n_leaves
            if len(units) > k + 1:
                calibrate_cells(below, units, k)
            return pa.table({"cell": group.column("cell")[:1], "tree": pa.array([pickle.dumps(below)], pa.binary())})

        # a tree in a row: bounded by the sample
        trees = materialize(drawn.groupBy("cell").applyInArrow(fitted, "cell string, tree binary"), "cell-trees")
        parts = big.join(trees, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(F.col("n") / most).cast("int"))))

        def moved(search: bool):
            def run(own: pa.Table, tree: pa.Table) -> pa.Table:
                own = own.drop_columns(["part"])
                if not len(own) or not len(tree):
                    return own.slice(0, len(own))
                below = pickle.loads(tree.column("tree")[0].as_py())
                units = _units(_matrix(own.column("v").combine_chunks()))
                if search:
                    bins = [below.best_bins(p, below.visits, k + 1) for p in below.promise(units).tolist()]
                else:
                    bins = [[x] for x in below.assign(units).tolist()]
                own = own.take(pa.array(np.repeat(np.arange(len(bins)), [len(x) for x in bins])))
                cells = [f"{c}.{x}" for c, x in zip(own.column("cell").to_pylist(), (x for b in bins for x in b), strict=True)]
                return own.set_column(own.schema.get_field_index("cell"), "cell", pa.array(cells, pa.string()))

            return run

        def lower(rows: DataFrame, schema: str, search: bool) -> DataFrame:
            keyed = rows.join(F.broadcast(big) if big.count() < 100_000 else big, "cell", "left")
            part = F.when(F.col("n").isNull(), -1).otherwise(F.pmod(F.xxhash64("a", "b"), F.floor(F.col("n") / most) + 1)).cast("int")
            keyed = materialize(keyed.withColumn("part", part).drop("n"), "keyed")
            inside = keyed.where("part >= 0").groupBy("cell", "part").cogroup(parts.select("cell", "part", "tree").groupBy("cell", "part"))
            return materialize(keyed.where("part < 0").drop("part").select(*_names(schema)).unionByName(inside.applyInArrow(moved(search), schema)), "cells")

        def _names(schema: str) -> list[str]:
            return [x.split()[0] for x in schema.split(", ")]

        indexed = lower(indexed.select("a", "b", "v", "ids", "cell"), f"a long, b long, v {kind}, ids array<long>, cell string", False)
        visits = lower(visits.select("a", "b", "v", "cell"), f"a long, b long, v {kind}, cell string", True)


def _search_cell(x: np.ndarray, ids: list[list[int]], q: np.ndarray, share: float, k: int) -> list[list[tuple[float, int]]]:
    """The best ``k`` (falling similarity, id) of each query in the leaves that it visits of the cell's own tree."""
    units = _units(x)
    tree = fit_tree(units, LEAF)
    leaf = tree.assign(units)
    # members of each leaf, those with small ids first
    order = np.lexsort(([i[0] for i in ids], leaf))
    at = np.searchsorted(leaf[order], np.arange(tree.n_leaves + 1))
    x = x.astype(np.float64)
    size = np.sqrt((x * x).sum(1))
    most = max(1, -int(-share * tree.n_leaves // 1))
    out = []
    for s in range(0, len(q), 256):
        block = q[s : s + 256].astype(np.float64)
        for row, promise in zip(block, tree.promise(_units(block)).tolist(), strict=True):
            rows = np.concatenate([order[at[b] : at[b + 1]] for b in tree.best_bins(promise, most, k)])
            score = (x[rows] @ row) / (size[rows] * np.sqrt(row @ row))
            edge = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else -np.inf
            top = rows[score >= edge]
            out.append(sorted((-float(f), i) for r, f in zip(top, score[score >= edge], strict=True) for i in ids[r])[:k])
    return out


def nearest(vectors: DataFrame, k: int = 5, query_every: int = 50, sample: int = SAMPLE, recall: float = RECALL, cell_vectors: int = CELL_VECTORS) -> DataFrame:
    """The ``k`` nearest by cosine of every row of ``vectors`` (vec_id, embedding) whose id ``query_every`` divides.

    Returns ``query_id long, rank int, vec_id long, score double``: candidates are all rows with other ids, nearest first,
    ties to the smaller id; fewer if there are fewer. Vectors that are null, empty, zero, or hold null or non-finite
    components take no part, nor do those of another length than the most frequent one and rows without id. Rows that
    repeat an id count once for each different vector. An empty table gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    valid = _valid(vectors)
    kind = valid.schema["v"].dataType.simpleString()
    distinct = materialize(_least_ids(valid, k + 1), "vectors")
    n = distinct.count()
    taken = min(1 << 30, sample * (1 << 30) // max(1, n))
    drawn = distinct.where(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 30)) < taken).orderBy("a", "b").limit(2 * sample).select("v").toArrow()
    units = _units(_matrix(drawn.column("v").combine_chunks())) if len(drawn) else np.zeros((0, 0))
    tree = fit_tree(units, min(CELL_SAMPLE, max(LEAF, len(units) // 8)))
    share = calibrate(tree, units, k, recall) if n > k + 1 else 1.0
    shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cell = shared.value.assign(_units(_matrix(batch.column("v"))))
                yield batch.append_column("cell", pa.array([str(c) for c in cell.tolist()], pa.string()))

    indexed = materialize(distinct.mapInArrow(index, f"a long, b long, v {kind}, ids array<long>, cell string"), "cells")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(s, 256) for s in range(0, batch.num_rows, 256)):
                own = shared.value
                bins = [own.best_bins(p, own.visits, k + 1) for p in own.promise(_units(_matrix(part.column("v")))).tolist()]
                take = pa.array(np.repeat(np.arange(len(bins)), [len(x) for x in bins]))
                yield part.take(take).append_column("cell", pa.array([str(c) for b in bins for c in b], pa.string()))

    asked = valid.where(F.col("vec_id") % query_every == 0)
    keys = asked.select("a", "b").distinct()
    queries = distinct.join(keys, ["a", "b"], "left_semi").select("a", "b", "v")
    visits = materialize(queries.mapInArrow(search, f"a long, b long, v {kind}, cell string"), "visits")
    indexed, visits = _grow(indexed, visits, kind, sample, cell_vectors, k)
    held = indexed.groupBy("cell").agg(F.ceil(F.count("*") / cell_vectors).cast("int").alias("vector_parts"))
    asks = visits.groupBy("cell").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("query_parts"))
    cells = materialize(held.join(asks, "cell"), "cell-parts")  # two numbers a cell
    if cells.count() < 100_000:
        cells = F.broadcast(cells)
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("b", "a"), F.col(c)).cast("int")
    left = indexed.join(cells, "cell").withColumn("vp", own("vector_parts")).select("cell", "vp", every("query_parts").alias("qp"), "v", "ids")
    right = visits.join(cells, "cell").withColumn("qp", own("query_parts")).select("cell", every("vector_parts").alias("vp"), "qp", "a", "b", "v")
    best = pa.struct([("far", pa.float64()), ("id", pa.int64())])

    def score(members: pa.Table, asking: pa.Table) -> pa.Table:
        if not (len(members) and len(asking)):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "best": pa.array([], pa.list_(best))})
        x, q = (_matrix(t.column("v").combine_chunks()) for t in (members, asking))
        out = [[{"far": far, "id": i} for far, i in found] for found in _search_cell(x, members.column("ids").to_pylist(), q, share, k + 1)]
        return pa.table({"a": asking.column("a"), "b": asking.column("b"), "best": pa.array(out, pa.list_(best))})

    scored = left.groupBy("cell", "vp", "qp").cogroup(right.groupBy("cell", "vp", "qp")).applyInArrow(score, "a long, b long, best array<struct<far:double,id:long>>")
    merged = scored.groupBy("a", "b").agg(F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k + 1).alias("best"))
    answers = asked.select(F.col("vec_id").alias("query_id"), "a", "b").distinct().join(merged, ["a", "b"])
    others = F.slice(F.filter("best", lambda x: x["id"] != F.col("query_id")), 1, k)
    return answers.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.far")).alias("score")
    )
