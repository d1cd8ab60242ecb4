"""Language identification by prediction by partial matching over bytes.

Each language has a context tree over the last 0 to 3 bytes. A byte that was seen in a context has the share
c / (n + d) there (c: its count, n: the sum of counts, d: the number of different bytes); the escape d / (n + d) goes to
the shorter context, with the bytes already excluded, and in the end to all bytes alike. The statistics are frozen after
training, so the code length of every byte in every kept context is computed once; a text's code length is then a sum
of looked-up numbers, exact for the tree. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.arrow_text import bounded_batches, flat, slices
from kinstrand.llm.rows import unused

ORDER = 3
#: The classifier is fitted on about so many documents of each language at most, chosen by a hash of their ids.
TRAIN_DOCS = 4000
#: A context is kept from so many occurrences on.
LEAST_COUNT = 2
#: Bytes of text that are looked up at once; their numbers take some dozen times that.
BLOCK = 1 << 18
UNDETERMINED = "und"
#: Bits a byte from which on a text counts as being in none of the languages: what coding each byte alike takes.
REJECT_BITS = float(np.log2(221))

PREDICTED = "doc_id long, lang_pred string, score double, bits_per_byte double"

# A-Z count as a-z, and all digits as one.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLD[48:58] = 48
#: Different bytes after folding.
FOLDED = 256 - 26 - 9
PAD = b" " * ORDER


def _padded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Folded bytes with three spaces before each text, and where those begin."""
    plain = pc.fill_null(texts.cast(pa.large_binary()), b"")
    raw, at = flat(pc.binary_join_element_wise(pa.scalar(PAD, pa.large_binary()), plain, pa.scalar(b"", pa.large_binary())))
    return FOLD[raw], at


def count_strings(train: DataFrame) -> DataFrame:
    """Occurrences of every four-byte string (three bytes of context and the next) of each language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang in batch.column("lang").unique().to_pylist():
                own = batch.filter(pc.equal(batch.column("lang"), lang))
                for part in slices(own, "text"):
                    b, at = _padded(part.column("text"))
                    b = b.astype(np.uint32)
                    key = (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]
                    real = np.ones(len(key) + ORDER, bool)
                    for k in range(ORDER):  # strings that end in a pad
                        real[at[:-1] + k] = False
                    key, n = np.unique(key[real[ORDER:]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key.astype(np.int64)), pa.array(n)], names=["lang", "key", "n"])

    return train.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))


class ContextTrees:
    """The frozen trees of all languages as one table of code lengths: a row for each kept context and next byte, so its
    size is bounded by the sample that the trees are fitted on."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique().tolist())
        key = counts["key"].to_numpy(np.int64)
        quad = np.stack([(key >> s) & 255 for s in (24, 16, 8, 0)], 1)
        seen = np.unique(quad)
        a = self.symbols = len(seen) + 1  # 0: a byte that no language has
        self.symbol = np.zeros(256, np.uint8)
        self.symbol[seen] = np.arange(1, a)
        s, n = self.symbol[quad].astype(np.int64), counts["n"].to_numpy(np.float64)
        which = np.searchsorted(self.langs, counts["lang"].to_numpy(str)) if self.langs else np.zeros(0, np.int64)
        contexts = self._contexts(s, n, a)
        self.deepest = np.zeros(a**ORDER, np.int32)  # of three symbols: the row of the longest kept context
        every = np.arange(a**ORDER)
        for k in range(1, ORDER + 1):
            row = np.zeros(a**k, np.int32)
            row[contexts[k]] = self._first[k] + np.arange(len(contexts[k]))
            found = row[every % a**k]
            self.deepest = np.where(found > 0, found, self.deepest)
        lengths = [self._code_lengths(s[which == x], n[which == x], contexts, a) for x in range(len(self.langs))]
        self.bits = np.ascontiguousarray(np.stack(lengths, -1).reshape(-1, len(lengths)), np.float32) if lengths else np.zeros((a, 0), np.float32)

    def _contexts(self, s: np.ndarray, n: np.ndarray, a: int) -> dict[int, np.ndarray]:
        """The contexts of each length that are kept, each with its shorter ones."""
        kept, first, self._first = {0: np.zeros(1, np.int64)}, 1, {0: 0}
        for k in range(1, ORDER + 1):
            code = sum(s[:, ORDER - k + j] * a ** (k - 1 - j) for j in range(k))
            total = np.bincount(code, n, minlength=a**k) if len(code) else np.zeros(a**k)
            good = np.flatnonzero(total >= LEAST_COUNT)
            if k > 1:
                good = good[np.isin(good % a ** (k - 1), kept[k - 1])]
            kept[k], self._first[k] = good, first
            first += len(good)
        return kept

    def _code_lengths(self, s: np.ndarray, n: np.ndarray, contexts: dict[int, np.ndarray], a: int) -> np.ndarray:
        even = np.full(a, 1.0 / FOLDED)
        above, levels = even[None, :], []
        for k in range(ORDER + 1):
            code = sum((s[:, ORDER - k + j] * a ** (k - 1 - j) for j in range(k)), np.zeros(len(s), np.int64))
            own = contexts[k]
            at = np.searchsorted(own, code)
            there = (at < len(own)) & (own[np.minimum(at, max(0, len(own) - 1))] == code) if len(own) else np.zeros(len(code), bool)
            c = np.bincount(at[there] * a + s[there, ORDER], n[there], minlength=len(own) * a).reshape(len(own), a)
            parent = above if k <= 1 else above[np.searchsorted(contexts[k - 1], own % a ** (k - 1))]
            parent = np.broadcast_to(parent, c.shape)
            total, different = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
            left = 1.0 - (parent * (c > 0)).sum(1, keepdims=True)
            share = np.divide(different, total + different, out=np.ones_like(total), where=total > 0)
            escaped = parent * share / np.maximum(left, 1e-12)
            above = np.where(c > 0, c / np.maximum(total + different, 1), escaped)
            levels.append(above)
        return -np.log2(np.concatenate(levels))

    def code_lengths(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits of each text in each language, and its bytes."""
        raw, at = _padded(texts)
        total, pads = np.zeros((len(at) - 1, len(self.langs))), (at[:-1, None] + np.arange(ORDER)).ravel()
        for k in range(ORDER, len(raw), BLOCK):
            end = min(len(raw), k + BLOCK)
            s = self.symbol[raw[k - ORDER : end]].astype(np.int32)
            row = self.deepest[(s[:-3] * self.symbols + s[1:-2]) * self.symbols + s[2:-1]]
            bits = np.take(self.bits, row * self.symbols + s[ORDER:], axis=0, mode="clip")
            bits[pads[np.searchsorted(pads, k) : np.searchsorted(pads, end)] - k] = 0
            # texts that lie in this block, and where each begins in it
            first = np.searchsorted(at, k, side="right") - 1
            texts_in = np.arange(first, np.searchsorted(at[:-1], end))
            total[texts_in] += np.add.reduceat(bits, np.maximum(at[texts_in] - k, 0), axis=0, dtype=np.float64)
        return total, np.diff(at) - ORDER


def learn(labelled: DataFrame, train_docs: int = TRAIN_DOCS) -> ContextTrees:
    """Fit the trees on (doc_id, text, lang): about ``train_docs`` documents of each language, or all if fewer.

    Rows without text or lang are left out. What comes to the driver is bounded by that sample.
    """
    bounded_batches(labelled.sparkSession)
    usable = labelled.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string")).where("lang IS NOT NULL AND text IS NOT NULL")
    per_lang = {r["lang"]: r["n"] for r in labelled.where("lang IS NOT NULL").groupBy(F.col("lang").cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    share = F.lit(0)
    for lang, n in sorted(per_lang.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1 << 30, train_docs * (1 << 30) // n))).otherwise(share)
    chosen = usable.where(F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30)) < share)
    return ContextTrees(count_strings(chosen.select("lang", "text")).toArrow().to_pandas())


def predict(docs: DataFrame, trees: ContextTrees) -> DataFrame:
    """The language of every whole text (``PREDICTED``); only doc_id and text are read.

    ``score`` is the probability of the language given the text, all languages being equally likely before; ties go to
    the first in order. A text that is null or has no letters is ``und`` with score 0, as is any if nothing was learned.
    Repeated rows and null ids give a row each.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        names = np.array([*trees.langs, UNDETERMINED], object)
        for batch in batches:
            for part in slices(batch, "text"):
                bits, size = trees.code_lengths(part.column("text"))
                lettered = part.column("lettered").to_numpy(zero_copy_only=False).astype(bool)
                if not trees.langs:
                    best, score, least, lettered = np.zeros(len(size), int), np.zeros(len(size)), np.zeros(len(size)), np.zeros(len(size), bool)
                else:
                    best = bits.argmin(1)
                    least = bits[np.arange(len(bits)), best]
                    score = 1.0 / np.exp2(np.minimum(0.0, least[:, None] - bits)).sum(1)
                picked = names[np.where(lettered, best, -1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(picked, pa.string()), pa.array(np.where(lettered, score, 0.0)), pa.array(least / np.maximum(size, 1))],
                    names=["doc_id", "lang_pred", "score", "bits_per_byte"],
                )

    letters = F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), letters.alias("lettered")).mapInArrow(run, PREDICTED)


def fold_number(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``. A null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(0))


def identify(docs: DataFrame, folds: int = 5, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn from the documents outside fold 0 and predict all: ``PREDICTED`` and ``held_out``."""
    trees = learn(docs.where(fold_number("doc_id", folds) != 0), train_docs)
    return predict(docs, trees).withColumn("held_out", fold_number("doc_id", folds) == 0)


def accepted(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) whose text is in one of the learned languages.

    Rejected are texts that are null or have no letters, and those whose code in every language is no shorter than
    coding every byte alike. Rows pass or go where they are read, without a shuffle.
    """
    trees = learn(docs.where(fold_number("doc_id", folds) != 0))
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                bits, size = trees.code_lengths(part.column("text"))
                lettered = part.column(part.num_columns - 1).to_numpy(zero_copy_only=False).astype(bool)
                good = lettered & (bits.min(1, initial=np.inf) < REJECT_BITS * size)
                yield pa.RecordBatch.from_arrays(part.columns[:-1], schema=pa.schema(list(part.schema)[:-1])).filter(pa.array(good))

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias(unused(docs.columns, "lettered"))
    return docs.select("*", lettered).mapInArrow(run, docs.schema)
