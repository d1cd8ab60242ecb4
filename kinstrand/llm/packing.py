"""Packing documents into token windows of one length with little padding.

Best-fit decreasing: documents are first cut into full windows; what remains of each is placed, longest first, into the
open window whose remaining capacity is the smallest that suffices. A segment tree over the capacities 0 .. window finds
that window in O(log window) steps.

Pieces are dealt over shards of some thousands by a hash, and each shard is packed on its own: enough pieces to leave
almost no padding, few enough for one task, however many rows share a document id, a source or a length.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.arrow_text import bounded_batches, slices
from kinstrand.plans.storage import materialize

WINDOW = 2048
END_ID = 1
#: Pieces that one shard holds on average.
SHARD_PIECES = 4096
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteBpe:
    """Token ids of the byte-level BPE in a ``tokenizers`` file, just as ``encode(text, add_special_tokens=False)`` gives them.

    Where the same vocabulary lies beside it as ranks, they serve every text without the string of an added token: the ids
    are equal and come several times as fast. A text with such a string goes to the general tokenizer, which gives the
    string the added token's id.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.general = Tokenizer.from_file(path)
        self.added = [t.content for t in self.general.get_added_tokens_decoder().values()]
        self.quick = None
        try:
            import public_tokenizers
            import tiktoken

            with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (ImportError, FileNotFoundError):
            pass

    def ids(self, text: str) -> np.ndarray:
        if self.quick is None or any(t in text for t in self.added):
            return np.array(self.general.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.quick.encode_ordinary(text), np.uint32)


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def document_ids(text: str | None, vocabulary: str) -> np.ndarray:
    """The ids of a whole text and then the end id. Null counts as empty."""
    return np.append(_tokenizer(vocabulary).ids(text or ""), np.uint32(END_ID))


def cut(docs: DataFrame, vocabulary: str, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Tokenize whole texts and cut them: full windows first, then the rest. One row per piece (``PIECES``), and ``ids``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part in slices(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = document_ids(text, vocabulary).astype("<u4")
                    out += [
                        (doc, k, min(window, len(ids) - k), zlib.crc32(ids[k : k + window].tobytes()), len(ids), ids[k : k + window] if with_ids else None)
                        for k in range(0, len(ids), window)
                    ]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids]
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kinds[k]) for k in range(len(names))], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES + ", ids array<int>" * with_ids)


class CapacityTree:
    """A segment tree over remaining capacities; each leaf stacks the windows that have that much room."""

    def __init__(self, window: int):
        self.base = 1 << window.bit_length()
        self.open = [0] * (2 * self.base)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        k = self.base + room
        while k:
            self.open[k] += by
            k >>= 1

    def push(self, room: int, window: int) -> None:
        self.stacks[room].append(window)
        self._add(room, 1)

    def tightest(self, need: int) -> int | None:
        """Take out the window with the least room of at least ``need``."""
        k = self.base + need
        if not self.open[k]:
            while k > 1 and (k & 1 or not self.open[k + 1]):
                k >>= 1
            if k <= 1:
                return None
            k += 1
            while k < self.base:
                k = 2 * k if self.open[2 * k] else 2 * k + 1
        room = k - self.base
        self._add(room, -1)
        return self.stacks[room].pop()


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """For pieces of these lengths (1 .. window), already ordered by falling length: window number and offset of each."""
    tree, used = CapacityTree(window), []
    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        w = tree.tightest(n)
        if w is None:
            w = len(used)
            used.append(0)
        number[k], offset[k] = w, used[w]
        used[w] += n
        if used[w] < window:
            tree.push(window - used[w], w)
    return number, offset


def place(pieces: DataFrame, window: int = WINDOW, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Give every piece of a stored table its sequence and offset (``PACKED``)."""
    shards = max(1, pieces.count() // shard_pieces)

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        shard, length = group.column("shard")[0].as_py(), group.column("length").to_numpy()
        order = np.lexsort((*(group.column(c).fill_null(-1).to_numpy() for c in ("ids_crc32", "start", "doc_id")), -length))
        number, offset = best_fit_decreasing(length[order], window)
        group = group.take(pa.array(order)).drop_columns(["shard"])
        ids = (np.int64(shard) << 32) + number
        return group.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offset))

    # the table is stored, so that a lost task numbers its rows as before
    shard = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(shards))
    return pieces.withColumn("shard", shard).groupBy("shard").applyInArrow(run, PACKED)


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """Pack all ``docs`` (doc_id, text) into sequences of at most ``window`` tokens. One row per piece (``PACKED``).

    A document is its ids and then ``END_ID``; ``start`` counts its ids before the piece, ``offset`` is gapless from 0
    in each sequence. Padding to ``window`` is left to ``render_sequences``. Null and empty texts are one end id;
    repeated rows are packed each; a null doc_id is kept; an empty table gives no rows; further columns are ignored.
    """
    vocabulary = vocabulary or default_vocabulary()
    return place(materialize(cut(docs, vocabulary, window), "pieces"), window)


def render_sequences(docs: DataFrame, packed: DataFrame, vocabulary: str | None = None, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """The ids of each packed sequence: ``sequence_id long, n_tokens long, ids array<int>``.

    A sequence is padded to ``window`` unless its length is a power of two. A piece takes its ids from any document with
    its doc_id, place and digest, so null and repeated ids do no harm.
    """
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    own = cut(docs, vocabulary or default_vocabulary(), window, True).dropDuplicates(key).select(*(F.col(c).alias(f"own {c}") for c in key), F.col("ids").alias("part"))
    same = [F.col(c).eqNullSafe(F.col(f"own {c}")) for c in key]
    parts = packed.select("sequence_id", "offset", *key).join(own, same).select("sequence_id", "offset", "part")
    ordered = F.array_sort(F.collect_list(F.struct("offset", "part")))
    whole = parts.groupBy("sequence_id").agg(F.flatten(F.transform(ordered, lambda x: x["part"])).alias("ids"))
    n = F.size("ids")
    bare = F.expr("size(ids) & (size(ids) - 1)") == 0
    padded = F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - n))
    return whole.select("sequence_id", n.cast("long").alias("n_tokens"), F.when(bare, F.col("ids")).otherwise(padded).alias("ids"))
