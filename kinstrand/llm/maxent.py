"""Language-model scores from a hashed maximum-entropy model.

The probability of a word is factored through classes, down to the word: the most frequent words and the rare classes are
the leaves of a tree with ``FAN`` branches a node, and a softmax over the branches of each node on the way sees hashed
features of the words before: the last one, the last two together, the one before the last (a skip), and the classes of
both. The tree is learned from contexts: each leaf has a sketch of its neighbours' counts over the whole corpus, and
halves along the main direction of these sketches make it. A word that is not among the most frequent belongs to the rare
class of its last letters, in which each has the share (c + 1) / Z of its count c, and all unseen words together the share
1 / Z. So the whole is a distribution over the known words and, in each rare class, an unseen one.

Training: counts of all tokens by one aggregation, sketches by a second; weights by distributed gradient updates. Documents
are dealt by a hash to trainers, each of which goes over its documents in batches with steps scaled by the past gradients
of a row. The trainers' changes of a row are averaged, each weighted by its share of that row's gradients, and lengthened
as long as the row is young: what only one of them saw keeps its full change. They are added up in a tree of tasks. Files
and tasks have no say in the result.

The number of rows and of trainers grows with the corpus. Scoring: sparse numpy batches. Counts of the most frequent words
travel with the model; those of the others are joined by token, so nothing that grows without bound is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.arrow_text import bounded_batches, flat, slices
from kinstrand.llm.langid import fold_number
from kinstrand.plans.storage import materialize

FAN = 16
#: Classes of the words that have no leaf of their own, by their last letters; words that have one.
RARE = 1024
HEAD = FAN**4 - RARE
#: Numbers of a sketch (a power of two).
SKETCH = 32
#: Features, and how many of them the nodes of each level see; the lower levels see the first ones.
FEATURES, SEEN = 4, (4, 4, 2, 2)
#: log2 of the least and the most rows of feature weights, and tokens for each row.
LEAST_BITS, MOST_BITS, TOKENS_A_ROW = 18, 21, 2
BATCH = 1024
#: Batches whose rows are found at once.
AT_ONCE = 8
RATE = 0.8
#: Characters of text for one trainer, trainers at least, and sorted shares of one trainer's documents.
TRAINER_CHARS, TRAINERS, SHARES = 160_000_000, 3, 16
#: Sum of squared gradients of a row in a trainer up to which the trainers' changes largely add up.
YOUNG = 10.0
#: Rows of weights or leaves in a block, and blocks that one task adds up.
BLOCK_ROWS, ADDED = 1024, 64
#: Bytes whose tokens are found at once; their numbers take some dozen times that.
BLOCK = 1 << 18
#: Bytes of a block whose numbers stay near the processor while they are added up.
PIECE = 1 << 13

END = np.uint64(0x27D4EB2F165667C5)
_BASE = 0x9FB21C651E98DF25
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_M3, _M4 = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
_S = np.uint64(33)

_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _S)) * _M1
    h = (h ^ (h >> _S)) * _M2
    return h ^ (h >> _S)


_kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``n`` or more powers of the base, of its inverse, and room for as many sums; kept unless a block is unusually long."""
    size = 1 << max(19, (n - 1).bit_length())
    if _kept and len(_kept[0][0]) == size:
        return _kept[0]
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    made = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64), np.zeros(size, np.uint64)
    if size == 1 << 19:
        _kept.append(made)
    return made


def _block_tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, rare class and position of each word of a block that begins and ends between words."""
    blank = np.ones(len(raw) + 2, bool)
    np.less(raw - np.uint8(9), 5, out=blank[1:-1])
    blank[1:-1] |= raw == 32
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), start
    up, down, total = _powers(len(raw) + 1)  # the first sum is zero and stays so
    for k in range(0, len(raw), PIECE):
        value = _LOWER.take(raw[k : k + PIECE])
        value *= up[k : k + len(value)]
        value[:1] += total[k]
        np.cumsum(value, out=total[k + 1 : k + 1 + len(value)])
    h = _mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _M2)
    last = _LOWER[raw[end - 1]]
    before = np.where(end - start > 1, _LOWER[raw[np.maximum(end - 2, 0)]], np.uint64(0))
    return h, ((_mix(last * np.uint64(512) + before) >> np.uint64(20)) % np.uint64(RARE)).astype(np.int64), start


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and rare classes of the tokens of all texts (each one's words, then ``END``), and where each text begins."""
    plain = pc.fill_null(texts.cast(pa.large_binary()), b"")
    raw, at = flat(pc.binary_join_element_wise(pa.scalar(b"\n", pa.large_binary()), plain, pa.scalar(b"", pa.large_binary())))
    pieces, k = [], 0
    while k < len(raw):
        end = min(len(raw), k + BLOCK)
        while end < len(raw) and not _BLANK[raw[end]]:
            ahead = np.flatnonzero(_BLANK[raw[end : end + PIECE]])
            end = end + int(ahead[0]) if len(ahead) else min(len(raw), end + PIECE)
        h, shared, start = _block_tokens(raw[k:end])
        pieces.append((h, shared, start + k))
        k = end
    words, shared, start = (np.concatenate(x) for x in zip(*pieces, strict=True)) if pieces else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.searchsorted(start, at[1:])  # words before each text's end
    n = len(ends)
    closing = ends + np.arange(n)
    h, cls = np.empty(len(words) + n, np.uint64), np.empty(len(words) + n, np.int64)
    word = np.ones(len(h), bool)
    word[closing] = False
    h[word], h[closing] = words, END
    cls[word], cls[closing] = shared, 0
    return h, cls, np.concatenate([[0], closing[:-1] + 1]) if n else np.zeros(0, np.int64)


def _before(x: np.ndarray, first: np.ndarray, edge: int) -> tuple[np.ndarray, np.ndarray]:
    """What stands one and two places before each token, ``edge`` beyond where its text begins."""
    edge = x.dtype.type(edge)
    one = np.concatenate([[edge], x[:-1]])
    two = np.concatenate([[edge, edge], x[:-2]])[: len(x)]
    one[first] = edge
    two[first] = edge
    two[np.minimum(first + 1, len(x) - 1)] = edge
    return one, two


def features(h: np.ndarray, first: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Hashes (32 bits) of the features of each token's context: ``FEATURES`` rows."""
    one, two = _before(h, first, int(END))
    near, far = _before((code >> 8).astype(np.uint64), first, 999)
    found = np.empty((FEATURES, len(h)), np.uint32)
    for own, x in zip(found, (one * _M1, _mix(one * _M2 + two), two * _M2 + _M1, (near * np.uint64(1009) + far + np.uint64(7)) * _M2), strict=True):
        own[:] = x >> np.uint64(32)
    return found


@dataclass
class Head:
    """The most frequent words with their counts, found by hash in two tables; what neither holds counts as rare."""

    hashes: np.ndarray
    counts: np.ndarray
    tables: tuple[np.ndarray, np.ndarray]

    MASK = (1 << 20) - 1

    @classmethod
    def of(cls, hashes: np.ndarray, counts: np.ndarray) -> "Head":
        """From words in order of falling counts."""
        left, kept, tables = np.arange(len(hashes)), np.zeros(len(hashes), bool), []
        for k in range(2):
            slot = cls._slot(hashes[left], k)
            _, first = np.unique(slot, return_index=True)
            table = np.full(cls.MASK + 1, -1, np.int32)
            table[slot[first]] = left[first]
            kept[left[first]] = True
            tables.append(table)
            left = np.delete(left, first)
        number = np.cumsum(kept) - 1  # in order of falling counts, without those that both tables have no room for
        tables = tuple(np.where(t >= 0, number[np.maximum(t, 0)] if len(hashes) else 0, 0).astype(np.int32) for t in tables)
        if not kept.any():
            return cls(np.zeros(1, np.uint64), np.zeros(1), tables)
        return cls(hashes[kept], counts[kept].astype(np.float64), tables)

    @classmethod
    def _slot(cls, h: np.ndarray, k: int) -> np.ndarray:
        return ((h >> np.uint64(20 * k)) & np.uint64(cls.MASK)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        at = self.tables[0][self._slot(h, 0)]
        miss = np.flatnonzero(self.hashes[at] != h)
        again = self.tables[1][self._slot(h[miss], 1)]
        at[miss] = np.where(self.hashes[again] == h[miss], again, -1)
        return at


def class_tree(sketches: np.ndarray) -> tuple[np.ndarray, int]:
    """A code for each leaf, its path in base ``FAN``, and the number of digits: halves along the main direction of the
    sketches (a row a leaf), so that leaves with like neighbours share the beginning of their paths."""
    n = len(sketches)
    depth = max(1, int(np.ceil(np.log(max(2, n)) / np.log(FAN) - 1e-9)))
    code, todo = np.zeros(n, np.int64), [(np.arange(n), 4 * depth - 1)]
    start = np.random.default_rng(3).normal(size=sketches.shape[1])
    while todo:
        rows, bit = todo.pop()
        if bit < 0 or len(rows) < 2:
            continue
        x = sketches[rows]
        x = x - x.mean(0)
        along = start
        for _ in range(8):
            along = x.T @ (x @ along)
            size = np.sqrt(along @ along)
            if size < 1e-12:
                along = start
                break
            along = along / size
        order = rows[np.argsort(x @ along, kind="stable")]
        half = -(-len(rows) // 2)
        code[order[half:]] += 1 << bit
        todo += [(order[:half], bit - 1), (order[half:], bit - 1)]
    return code, depth


@dataclass
class Model:
    """``code``: paths of the rare classes and then of the head's words; ``bias``: log of the shares of each node's
    branches; ``mass``: sum of c + 1 over the words of each rare class, and 1 for unseen ones."""

    head: Head
    total: int
    distinct: int
    mass: np.ndarray
    code: np.ndarray
    depth: int
    bias: np.ndarray
    #: Rows of weights, as whole numbers and their units.
    weights: np.ndarray
    units: np.ndarray
    rows: int

    def full(self) -> np.ndarray:
        """The weights as floats; calculated once in a process."""
        if "_full" not in self.__dict__:
            self._full = self.weights * self.units.astype(np.float32)[:, None]
        return self._full

    def codes(self, found: np.ndarray, rare: np.ndarray) -> np.ndarray:
        """The path of each token, whose number in the head (or -1) and rare class are given."""
        return self.code[np.where(found >= 0, found + RARE, rare)]

    def levels(self, f: np.ndarray, code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each node on the way: the rows of its features (one line a feature), the node, and the branch taken."""
        left, base = np.uint32(33 - self.rows.bit_length()), 0
        for level in range(self.depth):
            node = (code >> (4 * (self.depth - level))) + base
            branch = (code >> (4 * (self.depth - level - 1))) & (FAN - 1)
            x = f[: SEEN[min(level, len(SEEN) - 1)]] ^ ((node + 1).astype(np.uint32) * _M3)
            x ^= x >> np.uint32(15)
            x *= _M4
            x >>= left
            yield x.astype(np.int64), node, branch
            base += FAN**level

    def batches(self, f: np.ndarray, code: np.ndarray, out: np.ndarray) -> Iterator[tuple[list[tuple[np.ndarray, ...]], np.ndarray]]:
        """For each ``BATCH`` of tokens what ``levels`` gives (found for some batches at once), and its part of ``out``."""
        for k in range(0, len(code), AT_ONCE * BATCH):
            end = min(len(code), k + AT_ONCE * BATCH)
            whole = list(self.levels(f[:, k:end], code[k:end]))
            for j in range(0, end - k, BATCH):
                yield [tuple(x[..., j : j + BATCH] for x in level) for level in whole], out[k + j : min(end, k + j + BATCH)]


#: Weights of a batch's rows, odds, and changes of one feature's weights.
_own = np.empty((FEATURES * BATCH, FAN), np.float32)
_out, _change = np.empty((2, BATCH, FAN), np.float32)
#: Where each token's branches begin among all of a batch.
_begin = np.arange(0, BATCH * FAN, FAN)


def _odds(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Odds of the branches of each node, and the weights of each feature; both are overwritten by the next call."""
    out, own = _out[: len(node)], _own[: rows.size].reshape(*rows.shape, FAN)
    np.take(bias, node, axis=0, out=out, mode="clip")
    np.take(weights, rows, axis=0, out=own, mode="clip")
    for x in own:
        out += x
    np.minimum(out, 40, out=out)  # so that their squares are numbers, too
    np.exp(out, out=out)
    return out, own


def path_log10(model: Model, f: np.ndarray, code: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's path."""
    out, weights = np.ones(len(code)), model.full()
    for steps, p in model.batches(f, code, out):
        for rows, node, branch in steps:
            odds, _ = _odds(model.bias, weights, rows, node)
            p *= odds.reshape(-1)[_begin[: len(p)] + branch] / np.einsum("ij->i", odds)
    return np.log10(np.maximum(out, 1e-300))


class Trainer:
    """Gradient steps on weights of its own; a step is scaled by the past gradients of its row. Of the tokens of a batch
    that share a row the last one moves it; batches are small."""

    def __init__(self, model: Model):
        self.model = model
        self.weights = np.zeros((model.rows, FAN), np.float32)
        #: The same weights, each row as one item.
        self.places = self.weights.reshape(-1).view(f"V{4 * FAN}")
        self.past = np.zeros(model.rows, np.float32)

    def batch(self, steps: list[tuple[np.ndarray, ...]]) -> None:
        for rows, node, branch in steps:
            g, own = _odds(self.model.bias, self.weights, rows, node)
            total = np.einsum("ij->i", g)
            g.reshape(-1)[_begin[: len(g)] + branch] -= total  # the gradient, times the total
            part = np.float32(1) / total
            past = self.past.take(rows, mode="clip")
            past += np.einsum("ij,ij->i", g, g) * part * part + np.float32(1e-4)
            self.past.put(rows, past, mode="clip")
            np.sqrt(past, out=past)
            np.divide(part * np.float32(RATE), past, out=past)
            for x, step in zip(own, past, strict=True):
                x -= np.multiply(g, step[:, None], out=_change[: len(g)])
            self.places.put(rows, own.reshape(-1).view(self.places.dtype), mode="clip")

    def text(self, h: np.ndarray, rare: np.ndarray, first: np.ndarray) -> None:
        code = self.model.codes(self.model.head.find(h), rare)
        for steps, _ in self.model.batches(features(h, first, code), code, code):
            self.batch(steps)


#: Different tokens that a task gathers before it hands on their counts.
GATHERED = 400_000


def count_tokens(train: DataFrame) -> DataFrame:
    """``token long, class int, n long`` of the texts of ``train``."""

    def added(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        h, rare, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        found = pa.array(h).dictionary_encode()
        key, at = found.dictionary.to_numpy(), found.indices.to_numpy()
        own = np.empty(len(key), rare.dtype)
        own[at] = rare
        return key, own, np.bincount(at, n, len(key)).astype(np.int64)

    def handed(h: np.ndarray, rare: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(rare.astype(np.int32)), pa.array(n)], names=["token", "class", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for part in slices(batch, "text"):
                h, rare, _ = tokens(part.column("text"))
                held.append(added([(h, rare, np.ones(len(h)))]))
                if sum(len(x[0]) for x in held) > GATHERED:
                    held = [added(held)]
                    if len(held[0][0]) > GATHERED // 2:
                        yield handed(*held.pop())
        if held:
            yield handed(*added(held))

    return train.mapInArrow(run, "token long, class int, n long").groupBy("token").agg(F.first("class").alias("class"), F.sum("n").alias("n"))


_SUMS = "block int, member int, weight binary, value binary"


def _added(parts: DataFrame, add, members: int) -> DataFrame:
    """Blocks (``_SUMS``) added up over their members by ``add``, ``ADDED`` at a time, in so many steps as that takes."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("member")
        weight, value = add(group.column("weight").to_pylist(), group.column("value").to_pylist())
        member = group.column("member")[0].as_py() // ADDED
        return pa.table({"block": group.column("block")[:1], "member": pa.array([member], pa.int32()), "weight": pa.array([weight], pa.binary()), "value": pa.array([value], pa.binary())})

    while True:
        parts = parts.groupBy("block", F.floor(F.col("member") / ADDED)).applyInArrow(run, _SUMS)
        members = -(-members // ADDED)
        if members <= 1:
            return parts


def _sketches(train: DataFrame, head: Head) -> np.ndarray:
    """For each leaf signed counts of its neighbours, by a hash of them into ``SKETCH`` numbers; whole numbers, so that their
    sums do not depend on an order."""
    n = RARE + len(head.hashes)
    shared = train.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out = np.zeros(n * SKETCH, np.int32)
        for batch in batches:
            for part in slices(batch, "text"):
                h, rare, first = tokens(part.column("text"))
                found = shared.value.find(h)
                at = np.where(found >= 0, found + RARE, rare) * SKETCH
                one, _ = _before(h, first, int(END))
                after = np.concatenate([h[1:], [END]]) if len(h) else h
                after[first[1:] - 1] = END
                for k, near in enumerate((one, after)):
                    z = _mix(near + np.uint64(k + 1)).view(np.int64)
                    np.add.at(out, at + (z & (SKETCH - 1)), ((z >> 19) & 2).astype(np.int32) - np.int32(1))
        blocks = [out[k : k + BLOCK_ROWS * SKETCH].astype(np.int64).tobytes() for k in range(0, len(out), BLOCK_ROWS * SKETCH)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(len(blocks)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(blocks), pa.int32()), pa.array([b""] * len(blocks), pa.binary()), pa.array(blocks, pa.binary())],
            names=["block", "member", "weight", "value"],
        )

    def add(_: list[bytes], values: list[bytes]) -> tuple[bytes, bytes]:
        return b"", sum(np.frombuffer(v, np.int64) for v in values).tobytes()

    found = _added(train.mapInArrow(run, _SUMS), add, train.rdd.getNumPartitions()).toArrow().sort_by("block")  # of fixed size
    if not len(found):
        return np.zeros((n, SKETCH))
    total = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in found.column("value")]).reshape(-1, SKETCH).astype(np.float64)
    return total / np.maximum(1, np.sqrt((total * total).sum(1, keepdims=True)))


def _packed(change: np.ndarray) -> bytes:
    """Changes of rows as whole numbers up to 127 and their units."""
    unit = (np.abs(change).max(1) / 127).astype(np.float16)
    return unit.tobytes() + np.rint(change / np.maximum(unit.astype(np.float32), 1e-7)[:, None]).clip(-127, 127).astype(np.int8).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // (FAN + 2)
    return np.frombuffer(raw, np.int8, offset=2 * n).reshape(n, FAN), np.frombuffer(raw, np.float16, n)


def _trained(texts: DataFrame, model: Model, trainers: int) -> tuple[np.ndarray, np.ndarray]:
    """The weights (whole numbers and units) after the updates of ``trainers`` trainers on ``texts`` (doc_id, text)."""
    shared = texts.sparkSession.sparkContext.broadcast(model)  # of fixed size, its weights still one row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        trainer = Trainer(shared.value)
        for batch in batches:
            for part in slices(batch, "text"):
                trainer.text(*tokens(part.column("text")))
        at = range(0, len(trainer.past), BLOCK_ROWS)
        for k in at:
            past = trainer.past[k : k + BLOCK_ROWS]
            if past.any():
                columns = [pa.array([k // BLOCK_ROWS], pa.int32()), pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([np.minimum(past, 6e4).astype(np.float16).tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([_packed(trainer.weights[k : k + BLOCK_ROWS])], pa.binary())], names=["block", "member", "weight", "value"])

    def add(weights: list[bytes], values: list[bytes]) -> tuple[bytes, bytes]:
        # sums of squared gradients and of their powers of 1.5: a trainer tells the former, a sum of trainers both
        sums, change = np.zeros((2, BLOCK_ROWS)), np.zeros((BLOCK_ROWS, FAN))
        for w, v in zip(weights, values, strict=True):
            one = len(w) == 2 * BLOCK_ROWS
            past = np.frombuffer(w, np.float16).astype(np.float64) if one else np.frombuffer(w, np.float32)[:BLOCK_ROWS]
            sums += np.stack([past, past**1.5]) if one else np.frombuffer(w, np.float32).reshape(2, -1)
            whole, unit = _unpacked(v)
            change += whole * (unit * past)[:, None]
        return sums.astype(np.float32).tobytes(), _packed(change / np.maximum(sums[0], 1e-30)[:, None])

    # the same documents in the same order for every trainer, however they are stored
    dealt = texts.withColumn("key", F.xxhash64("doc_id", "text")).repartition(trainers * SHARES, "key").sortWithinPartitions("key", "doc_id").coalesce(trainers)
    merged = _added(dealt.select("text").mapInArrow(run, _SUMS), add, trainers).toArrow()  # of fixed size
    weights, units = np.zeros((model.rows, FAN), np.int8), np.zeros(model.rows, np.float16)
    for block, sums, value in zip(*(merged.column(c).to_pylist() for c in ("block", "weight", "value")), strict=True):
        past, more = np.frombuffer(sums, np.float32).reshape(2, -1)
        # steps grow with the root of what a row has seen; one trainer would have seen all of it. A settled row needs no more
        longer = np.maximum(1, past**1.5 / np.maximum(more, 1e-30))
        longer = 1 + (longer - 1) * YOUNG / (YOUNG + past / longer**2)
        at = slice(block * BLOCK_ROWS, (block + 1) * BLOCK_ROWS)
        weights[at], unit = _unpacked(value)
        units[at] = unit * longer
    return weights, units


def _bias(code: np.ndarray, depth: int, mass: np.ndarray) -> np.ndarray:
    """Logs of the shares of the branches of every node, level by level."""
    levels = []
    for level in range(depth):
        total = np.bincount(code >> (4 * (depth - level - 1)), mass, minlength=FAN ** (level + 1)).reshape(-1, FAN)
        with np.errstate(divide="ignore"):
            levels.append(np.maximum(-30, np.log(total / np.maximum(total.sum(1, keepdims=True), 1e-9))))
    return np.concatenate(levels).astype(np.float32)


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the texts of ``docs`` (doc_id, text), and the stored counts of all tokens."""
    spark = docs.sparkSession
    bounded_batches(spark)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counts = materialize(count_tokens(texts.select("text")), "token-counts")
    sums = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    top = counts.orderBy(F.desc("n"), "token").limit(HEAD).select("token", "n").toArrow()
    head = Head.of(top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy())
    mass = np.ones(RARE)
    own = F.broadcast(spark.createDataFrame(pa.table({"token": pa.array(head.hashes.view(np.int64))})))  # at most HEAD numbers
    for r in counts.join(own, "token", "left_anti").groupBy("class").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():  # a row per class
        mass[r["class"]] += r["n"] + r["v"]
    code, depth = class_tree(_sketches(texts.select("text"), head))
    bias = _bias(code, depth, np.concatenate([mass, head.counts]))
    total = int(sums["n"] or 0)
    bits = min(MOST_BITS, max(LEAST_BITS, (total // TOKENS_A_ROW).bit_length()))
    model = Model(head, total, int(sums["v"]), mass, code, depth, bias, np.zeros((1, FAN), np.int8), np.zeros(1, np.float16), 1 << bits)
    chars = texts.agg(F.sum(F.length("text"))).first()[0] or 0
    model.weights, model.units = _trained(texts, model, max(TRAINERS, -(-int(chars) // TRAINER_CHARS)))
    return model, counts


_PARTS = "row long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<long>"


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """Sums of each text without what depends on the counts of its rare tokens, and those tokens."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        whole = np.log10(model.total + model.distinct + 1)
        more, mass = np.log10(model.head.counts + 1), np.log10(model.mass)
        for batch in batches:
            for part in slices(batch, "text"):
                h, own, first = tokens(part.column("text"))
                if not len(first):
                    continue
                found = model.head.find(h)
                code, known = model.codes(found, own), found >= 0
                value = np.where(known, more[np.maximum(found, 0)], 0.0)
                score = path_log10(model, features(h, first, code), code) - np.where(known, 0.0, mass[own])
                size = np.diff(np.concatenate([first, [len(h)]]))
                rare = np.concatenate([[0], np.cumsum(~known)])[np.concatenate([first, [len(h)]])]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), pa.array(size), pa.array(np.add.reduceat(known.astype(np.int64), first)),
                        pa.array(np.add.reduceat(value, first) - size * whole), pa.array(np.add.reduceat(score, first)),
                        pa.ListArray.from_arrays(pa.array(rare.astype(np.int32)), pa.array(h[~known].view(np.int64))),
                    ],
                    names=["row", "doc_id", "n_tokens", "n_known", "base", "score", "rare"],
                )

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(run, _PARTS)


def score_texts(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """Scores of every whole text of ``docs`` (doc_id, text).

    Returns ``doc_id, n_tokens, n_known, train_tokens long, base_score, score double``. Null and empty texts are one end
    token; repeated rows and null ids are scored each; an empty table gives no rows; further columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    parts = materialize(_scored(docs, model), "scored")
    rare = parts.select("row", F.explode("rare").alias("token"))
    known = rare.join(counts.select("token", "n"), "token")
    late = known.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1)).alias("late"), F.count("*").alias("late_known"))
    late_value = F.coalesce("late", F.lit(0.0))
    return parts.drop("rare").join(late, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("late_known", F.lit(0))).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base") + late_value).alias("base_score"), (F.col("score") + late_value).alias("score"),
    )


def score_held_out(docs: DataFrame, folds: int = 7, held: int = 2) -> DataFrame:
    """Learn from the documents outside fold ``held`` of ``folds`` and score all; ``held_out`` tells that fold."""
    model, counts = train(docs.where(fold_number("doc_id", folds) != held))
    return score_texts(docs, model, counts).withColumn("held_out", fold_number("doc_id", folds) == held)
