"""Near-duplicate documents by SimHash fingerprints and a Gray-order hierarchical index.

All fingerprints are sorted by Gray rank, in which neighbours share long bit patterns. A node of the index keeps the bits
that all its fingerprints share and their mask; upper nodes factor what lower ones have in common. A search compares
nodes from above: as it goes down the shared masks grow, the differences add up, and a pair of nodes that differs too often
already is pruned with all below.

Two fingerprints with at most ``distance`` differing bits have at most half of those in one half of the bits. So there are
two orders, each led by another half, and in each a pair of nodes is pruned as soon as the leading half alone differs in
more than half of ``distance``; no link is lost and far more is pruned than by one order.

The order is cut into ranges of bounded size, the segments. Their masks are the upper nodes, a row each, that every task
shares; a fingerprint travels only to the segments that they don't rule out. A segment is searched by several tasks, each
for a slice of what has come. A task reports a spanning forest of the links that it finds, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinstrand.llm.arrow_text import bounded_batches, slices
from kinstrand.llm.rows import unused, without
from kinstrand.plans.graph import connected_components
from kinstrand.plans.storage import materialize

SEED = 42
BITS = 64
WORDS = 4
DISTANCE = 4
#: Bit orders of the index, each led by another part of the bits.
ORDERS = 2
#: Fingerprints of one segment on average, and tasks that search it at least.
SEGMENT, SLICES = 1 << 18, 8
#: Fingerprints in a leaf, children of a node, and pairs of nodes that are held at once.
LEAF, FAN, PAIRS = 8, 8, 1 << 16
#: Bytes of a text whose shingles are hashed at once.
BLOCK = 1 << 20
#: Rows with one fingerprint from which on they are joined where they are.
HOT_ROWS = 100_000


def _digests(text: str, words: int) -> Iterator[list[int]]:
    """The hashes of a text's shingles, block by block; of the whole sequence if it has fewer words."""
    import xxhash

    raw, tokens, k, some = text.encode().lower(), [], 0, False
    digest = xxhash.xxh64_intdigest
    while k < len(raw):
        end = min(len(raw), k + BLOCK)
        while end < len(raw) and not raw[end : end + 1].isspace():
            end += 1
        tokens += raw[k:end].split()
        k = end
        if len(tokens) >= words:
            some = True
            joined = b" ".join(tokens)
            size = np.fromiter(map(len, tokens), np.int64, len(tokens))
            ends = np.cumsum(size + 1) - 1
            yield [digest(joined[a:b], SEED) for a, b in zip((ends - size)[: len(tokens) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)]
            tokens = tokens[len(tokens) - words + 1 :]
    if tokens and not some:
        yield [digest(b" ".join(tokens), SEED)]


def shingle_fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text: a bit is 1 if it is set in over half the hashes of its word shingles."""
    ones, n = np.zeros(BITS, np.int64), 0
    for hashes in _digests(text or "", words):
        raw = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
        n += len(raw)
        for k in range(0, len(raw), 65536):
            ones += np.unpackbits(raw[k : k + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id long, fp long`` (the 64 bits as a signed number) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fp = np.array([shingle_fingerprint(t, words) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the order of the reflected Gray code."""
    rank = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


def _rank_column(fp: Column) -> Column:
    """The Gray rank of the 64 bits as a number that sorts as they do without sign."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


class Forest:
    """Disjoint sets with the least member as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, k: np.ndarray) -> np.ndarray:
        """The root of each of ``k``."""
        at = self.up[k]
        while not np.array_equal(above := self.up[at], at):
            at = above
        self.up[k] = at
        return at

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join pairs; which of them made one set of two."""
        x, y = self.roots(a), self.roots(b)
        apart = np.flatnonzero(x != y)
        low, high = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        _, first = np.unique(low * len(self.up) + high, return_index=True)
        made = []
        for k in first.tolist():
            p, q = int(low[k]), int(high[k])
            while self.up[p] != p:
                p = int(self.up[p])
            while self.up[q] != q:
                q = int(self.up[q])
            if p != q:
                self.up[max(p, q)] = min(p, q)
                made.append(int(apart[k]))
        return np.array(made, np.int64)


class GrayIndex:
    """Nodes over fingerprints in Gray order, or over given ``ones`` (bits that are 1 in all below) and ``some`` (in any).

    Level 0 are leaves of ``leaf`` members each, others have ``FAN`` children. A node's mask are the bits that all share.
    """

    def __init__(self, ones: np.ndarray, some: np.ndarray | None = None, leaf: int = LEAF):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        ones, some = self._fold(ones, ones if some is None else some, leaf)
        self.levels.append((ones | ~some, ones))
        while len(ones) > 1:
            ones, some = self._fold(ones, some, FAN)
            self.levels.append((ones | ~some, ones))

    @staticmethod
    def _fold(ones: np.ndarray, some: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(0, len(ones), by)
        return np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(some, at)

    def leaf_pairs(self, other: "GrayIndex", distance: int, lead: np.uint64, bound: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of leaves whose shared bits differ in at most ``distance``, and in at most ``bound`` of those in ``lead``;
        some thousands at a time."""
        todo = [(len(self.levels) - 1, len(other.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            i, j, a, b = todo.pop()
            if len(a) > PAIRS:
                half = len(a) // 2
                todo += [(i, j, a[half:], b[half:]), (i, j, a[:half], b[:half])]
                continue
            (mask_a, ones_a), (mask_b, ones_b) = self.levels[i], other.levels[j]
            differ = (ones_a[a] ^ ones_b[b]) & mask_a[a] & mask_b[b]
            keep = (np.bitwise_count(differ) <= distance) & (np.bitwise_count(differ & lead) <= bound)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if i == 0 and j == 0:
                yield a, b
            elif i >= j:
                a, b = self._below(a, b, len(self.levels[i - 1][0]))
                todo.append((i - 1, j, a, b))
            else:
                b, a = self._below(b, a, len(other.levels[j - 1][0]))
                todo.append((i, j - 1, a, b))

    @staticmethod
    def _below(a: np.ndarray, b: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        child = a[:, None] * FAN + np.arange(FAN)
        real = child < most
        return child[real], np.broadcast_to(b[:, None], child.shape)[real]


def _turned(fp: np.ndarray, by: int) -> np.ndarray:
    return fp if by == 0 else (fp << np.uint64(by)) | (fp >> np.uint64(BITS - by))


def _lead(orders: int) -> np.uint64:
    """The leading bits of an order: its share of all."""
    width = BITS // orders
    return np.uint64(((1 << width) - 1) << (BITS - width))


def forest_links(fp: np.ndarray, asking: np.ndarray, distance: int = DISTANCE, orders: int = ORDERS) -> list[tuple[int, int]]:
    """Links that connect whatever is connected by pairs of one of ``fp`` and one of ``asking`` with at most ``distance``
    differing bits, at most ``distance // orders`` of them leading. Both are turned and sorted by Gray rank.

    Numbers beyond ``len(fp)`` stand for ``asking``. At most one link fewer than members is given.
    """
    index, forest, links, n = GrayIndex(fp), Forest(len(fp) + len(asking)), [], len(fp)
    inside = np.arange(LEAF)
    for s in range(0, len(asking), 1 << 14):
        block = asking[s : s + (1 << 14)]
        for a, b in index.leaf_pairs(GrayIndex(block), distance, _lead(orders), distance // orders):
            for k in range(0, len(a), PAIRS // 4):
                i = (a[k : k + PAIRS // 4, None] * LEAF + inside)[:, :, None]
                j = (b[k : k + PAIRS // 4, None] * LEAF + inside)[:, None, :]
                near = np.bitwise_count(fp[np.minimum(i, n - 1)] ^ block[np.minimum(j, len(block) - 1)]) <= distance
                near &= (i < n) & (j < len(block))
                at, p, q = np.nonzero(near)
                x, y = i[at, p, 0], n + s + j[at, 0, q]
                made = forest.join(x, y)
                links += zip(x[made].tolist(), y[made].tolist(), strict=True)
    return links


def _segments(turned: DataFrame, n: int, segment: int) -> list[int]:
    """The ranks where each segment but the first begins: so many numbers as there are segments."""
    count = -(-n // segment)
    if count <= 1:
        return []
    shares = [k / count for k in range(1, count)]
    return sorted(set(turned.agg(F.percentile_approx("rank", shares, max(10_000, 20 * count)).alias("x")).first()["x"]))


def _order_links(prints: DataFrame, n: int, order: int, orders: int, distance: int, segment: int, tasks: int) -> DataFrame:
    """The links that one order of the bits finds."""
    spark = prints.sparkSession
    by = BITS * order // orders
    code = F.col("fp") if by == 0 else F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", BITS - by))
    turned = prints.select("name", code.alias("code")).withColumn("rank", _rank_column(F.col("code")))
    bounds = spark.sparkContext.broadcast(np.array(_segments(turned, n, segment), np.int64))  # a number a segment
    homes = max(1, len(bounds.value) + 1)

    def home(ranks: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds.value, ranks, side="right")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, code = home(batch.column("rank").to_numpy()), batch.column("code").to_numpy()
                order = np.argsort(at, kind="stable")
                own, first = np.unique(at[order], return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own), pa.array(np.bitwise_and.reduceat(code[order], first)), pa.array(np.bitwise_or.reduceat(code[order], first))], names=["segment", "ones", "some"]
                )

    lead, bound = _lead(orders), distance // orders
    if homes == 1:
        routed = turned.select(F.lit(0).cast("long").alias("segment"), F.lit(0).alias("side"), "code", "name")
    else:
        nodes = turned.mapInArrow(summary, "segment long, ones long, some long").groupBy("segment").agg(F.bit_and("ones").alias("ones"), F.bit_or("some").alias("some"))
        upper = nodes.toArrow().sort_by("segment")  # a row a segment
        own = [upper.column(c).to_numpy().view(np.uint64) for c in ("ones", "some")]
        shared = spark.sparkContext.broadcast((upper.column("segment").to_numpy(), GrayIndex(*own, leaf=1)))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number, nodes = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                batch = batch.take(pa.array(np.argsort(batch.column("rank").to_numpy(), kind="stable")))
                code, at = batch.column("code").to_numpy().view(np.uint64), home(batch.column("rank").to_numpy())
                yield _routed(batch, np.arange(len(at)), at, 0)
                for a, b in nodes.leaf_pairs(GrayIndex(code), distance, lead, bound):
                    row = (b[:, None] * LEAF + np.arange(LEAF)).ravel()
                    to = np.repeat(number[a], LEAF)
                    real = row < len(at)
                    row, to = row[real], to[real]
                    later = to > at[row]
                    yield _routed(batch, row[later], to[later], 1)

        def _routed(batch: pa.RecordBatch, row: np.ndarray, to: np.ndarray, side: int) -> pa.RecordBatch:
            own = batch.take(pa.array(row))
            return pa.RecordBatch.from_arrays([pa.array(to.astype(np.int64)), pa.array(np.full(len(row), side, np.int32)), own.column("code"), own.column("name")], names=["segment", "side", "code", "name"])

        routed = materialize(turned.mapInArrow(route, "segment long, side int, code long, name long"), "routed")
    if homes == 1:
        spread = routed.withColumn("tasks", F.lit(tasks))
    else:
        counts = routed.groupBy("segment").agg(F.ceil(F.count("*") / segment).cast("int").alias("loads"))
        parts = materialize(counts.select("segment", (F.col("loads") * tasks).alias("tasks")), "segment-tasks")  # a row a segment
        spread = routed.join(F.broadcast(parts) if homes < 100_000 else parts, "segment")
    # members go to every task of their segment, what asks to one; members ask in one of them as well
    copies = spread.where("side = 0").select("segment", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"), "tasks", "side", "code", "name")
    asks = spread.where("side = 1").select("segment", F.pmod(F.xxhash64("code"), F.col("tasks")).cast("int").alias("task"), "tasks", "side", "code", "name")

    def search(group: pa.Table) -> pa.Table:
        side, code, name = group.column("side").to_numpy(), group.column("code").to_numpy().view(np.uint64), group.column("name").to_numpy()
        task, tasks = group.column("task")[0].as_py(), group.column("tasks")[0].as_py()
        order = np.argsort(gray_rank(code), kind="stable")
        own = order[side[order] == 0]
        runs = np.arange(len(own)) * tasks // max(1, len(own)) == task
        asking = np.concatenate([own[runs], order[side[order] == 1]])
        if len(asking) > runs.sum():
            asking = asking[np.argsort(gray_rank(code[asking]), kind="stable")]
        links = forest_links(code[own], code[asking], distance, orders)
        names = np.concatenate([name[own], name[asking]])
        pairs = np.array([(names[x], names[y]) for x, y in links if names[x] != names[y]], np.int64).reshape(-1, 2)
        return pa.table({"src": pa.array(pairs[:, 0]), "dst": pa.array(pairs[:, 1])})

    return copies.unionByName(asks).groupBy("segment", "task").applyInArrow(search, "src long, dst long")


def near_links(prints: DataFrame, distance: int = DISTANCE, orders: int = ORDERS, segment: int = SEGMENT, tasks: int = SLICES) -> DataFrame:
    """Links (``src, dst``) between the names of different fingerprints (stored: ``name long, fp long``) that suffice to
    connect all that are connected by pairs of at most ``distance`` differing bits."""
    n = prints.count()
    found = [_order_links(prints, n, k, orders, distance, segment, tasks) for k in range(orders)]
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links.distinct()


def near_duplicates(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE, segment: int = SEGMENT) -> DataFrame:
    """One row per document: ``doc_id long, fp long, component_id long`` (the smallest doc_id it is linked to, itself included).

    Equal fingerprints are one vertex, so copies are never paired. A text without words has fingerprint 0 and is linked
    like any other. Rows that repeat a doc_id are returned each; rows with a null doc_id keep their fingerprint and have
    a null component. An empty table gives no rows; further columns are ignored.
    """
    prints = materialize(fingerprints(docs, words), "fingerprints")
    vertices = materialize(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("name"), F.count("*").alias("n")), "vertices")
    links = near_links(vertices.select("name", "fp"), distance, segment=segment)
    # a document that comes with several texts links their fingerprints
    several = prints.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("doc_id")
    own = prints.join(several, "doc_id", "left_semi").join(vertices, "fp").select(F.col("doc_id").alias("src"), F.col("name").alias("dst"))
    classes = connected_components(links.unionByName(own))
    found = materialize(vertices.join(classes, vertices["name"] == classes["vertex"], "left").select("fp", "n", F.coalesce("component", "name").alias("component_id")), "components")
    known = prints.where("doc_id IS NOT NULL")
    # very common fingerprints (at most one of HOT_ROWS rows each) go to their rows instead of the rows to them
    hot = F.broadcast(found.where(F.col("n") > HOT_ROWS).drop("n"))
    rest = known.join(hot, "fp", "left_anti").join(found.where(F.col("n") <= HOT_ROWS).drop("n"), "fp")
    known = rest.unionByName(known.join(hot, "fp").select(*rest.columns))
    return known.select("doc_id", "fp", "component_id").unionByName(prints.where("doc_id IS NULL").withColumn("component_id", F.lit(None).cast("long")))


def keep_first(docs: DataFrame, words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that are first in their near-duplicate group: those with its
    smallest doc_id, and of rows that repeat that id the one with the least text. Rows without doc_id stay.
    """
    found = materialize(near_duplicates(docs, words, distance).where("doc_id IS NOT NULL"), "classes")
    kept = without(docs, materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "later-copies"))
    repeated = materialize(found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    name = unused(docs.columns, "place")
    again = kept.join(repeated, "doc_id", "left_semi").select(*docs.columns)
    order = W.partitionBy("doc_id").orderBy("text", *(c for c in docs.columns if c not in ("doc_id", "text")))
    first = again.withColumn(name, F.row_number().over(order)).where(F.col(name) == 1).drop(name)
    return without(kept, repeated).unionByName(first)
