"""Benchmark decontamination by template windows.

Texts are brought to a canonical form: words in lower case without punctuation, and typed placeholders for numbers, for
the unit after a number, and for names (a capitalised word inside a sentence). Windows of the canonical form are hashed
and joined by hash; so a question that was given other numbers or names still meets its template. What stood in the
placeholders is compared afterwards: along an alignment, each value of the benchmark must always have become the same
value in the document; windows that hold another than most do count for nothing. Every window is also hashed with its
names, and with all its words, as they are, so that a verbatim copy is found whatever its words look like.

A bitmap of fixed size, set from the benchmark's hashes, decides in the scan which windows can have a partner at all; the
exact hash join then sees only those, whatever the size of either side.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.llm.arrow_text import bounded_batches, flat, slices
from kinstrand.plans.storage import materialize

WINDOW = 8
#: An item is found if so large a share of its windows is, or so many of them.
SHARE, ENOUGH = 0.5, 6
#: Placeholders that a window may have at most, as a share of its length: the rest must agree literally.
MOST_SLOTS = 0.5
#: Shorter items are found as they are only: a template of them says too little.
LEAST_WORDS = 3
#: log2 of the bits in the bitmap.
BITMAP = 22
#: Benchmark windows up to which their table is broadcast; a shuffled join serves larger ones.
BROADCAST_ROWS = 200_000
#: Bytes whose words are found at once; their numbers take some dozen times that.
BLOCK = 1 << 18

# Units that may follow a number.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t lb lbs oz pound pounds ton tons ml cl dl l "
    "liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month "
    "months year years c f k hz khz mhz ghz w kw mw kwh v mv a ma j kj cal kcal pa kpa n percent dollars dollar euro euros cents "
    "meter meters metre metres kilometer kilometers gram grams kilogram kilograms degrees"
).split()

NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
_BASE, _STEP = 0x5851F42D4C957F2D, np.uint64(0xD6E8FEB86659FD93)

_LOWER = np.arange(256, dtype=np.uint64) + 1
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_PLAIN = np.ones(256, bool)  # neither white space nor ASCII punctuation or control
_PLAIN[:128] = False
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * _STEP
    return h ^ (h >> np.uint64(29))


def _block_words(raw: np.ndarray, opening: bool) -> tuple[np.ndarray, ...]:
    """Words of a block that begins and ends between words: hash, has a digit, is a name by its form, follows a sentence
    end, byte position. ``opening``: the first word opens a sentence."""
    blank = _BLANK[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return tuple(np.zeros(0, t) for t in (np.uint64, bool, bool, bool, np.int64))
    keep = _PLAIN[raw]
    value = _LOWER[raw]
    upper = (raw >= 65) & (raw <= 90)
    if raw.max() > 127:  # capitals of two bytes: À to Þ
        lead = np.concatenate([[False], raw[:-1] == 0xC3]) & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
        value[lead] += np.uint64(32)
        upper = upper | np.concatenate([lead[1:], [False]])
    rank = np.concatenate([np.zeros(1, np.int32), np.cumsum(keep, dtype=np.int32)])
    size = 1 << max(16, int(rank[-1] + 2).bit_length())
    up, down = _powers(size)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[keep] * up[: rank[-1]], dtype=np.uint64)])
    first, last = rank[start], rank[end]
    hashed = mix((total[last] - total[first]) * down[first])

    def count(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros(1, np.int32), np.cumsum(mask[keep], dtype=np.int32)])
        return sums[last] - sums[first]

    digit, capitals = count(_DIGIT[raw]) > 0, count(upper)
    letters = count((raw < 0x80) | (raw > 0xBF))
    where = np.flatnonzero(keep)
    real = last > first
    begins = upper[where[np.minimum(first, len(where) - 1)]] if len(where) else np.zeros(len(start), bool)
    stopped = np.concatenate([[opening], _STOP[raw[end[:-1] - 1]]])
    newline = raw[np.maximum(start - 1, 0)] == 10
    name = begins & (capitals == 1) & (letters > 1) & ~digit
    return hashed[real], digit[real], name[real], (stopped | newline)[real], start[real]


def words(raw: np.ndarray, at: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, ...]:
    """Canonical words of all texts in a flat array, each of which begins with white space: canonical hash, literal hash,
    is a placeholder, is a name, may be a name or just open a sentence, and how many words precede each text.

    Where more than three words in a row look like names, as in a heading or a text in capitals, none of them is one.
    """
    pieces, k = [], 0
    while k < len(raw):
        end = min(len(raw), k + block)
        while end < len(raw) and not _BLANK[raw[end]]:
            ahead = np.flatnonzero(_BLANK[raw[end : end + block]])
            end = end + int(ahead[0]) if len(ahead) else min(len(raw), end + block)
        h, digit, name, opens, start = _block_words(raw[k:end], k == 0)
        pieces.append((h, digit, name, opens, start + k))
        k = end
    if not pieces:
        empty = np.zeros(0, np.uint64)
        return empty, empty, *(np.zeros(0, bool) for _ in range(3)), np.zeros(len(at), np.int64)
    h, digit, name, opens, start = (np.concatenate(x) for x in zip(*pieces, strict=True))
    first = np.searchsorted(start, at)
    opens[first[:-1][first[:-1] < len(opens)]] = True
    opener = name & opens
    name &= ~opens
    edge = np.flatnonzero(np.diff(np.concatenate([[False], name, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        if b - a > 3:
            name[a:b] = False
    unit = np.zeros(len(h), bool)
    unit[1:] = digit[:-1] & np.isin(h[1:], _unit_hashes()) & ~digit[1:]
    canonical = np.where(digit, NUMBER, np.where(unit, UNIT, np.where(name, NAME, h)))
    return canonical, h, digit | unit | name, name & ~digit & ~unit, opener & ~digit & ~unit, first


@lru_cache(maxsize=1)
def _unit_hashes() -> np.ndarray:
    return np.concatenate([_block_words(np.frombuffer(u.encode(), np.uint8), True)[0] for u in UNITS])


def window_hashes(canonical: np.ndarray, length: int) -> np.ndarray:
    """A hash of every run of ``length`` words."""
    n = len(canonical) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(length))
    for k in range(length):
        out = out * _STEP + canonical[k : k + n]
    return mix(out)


def _windows(length: int, canonical: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Windows inside one text each: text number, hash, and where their words are."""
    h = window_hashes(canonical, length)
    k = np.arange(len(h))
    text = np.searchsorted(first, k, side="right") - 1
    good = k + length <= first[np.minimum(text + 1, len(first) - 1)]
    return text[good], h[good], k[good]


def _with_blank(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    plain = pc.fill_null(texts.cast(pa.large_binary()), b"")
    return flat(pc.binary_join_element_wise(pa.scalar(b"\n", pa.large_binary()), plain, pa.scalar(b"", pa.large_binary())))


_FOUND = "id long, copy long, length int, position long, hash long, slots array<long>, n_windows long, n_templates long"


def template_windows(texts: DataFrame, id_column: str, lengths: tuple[int, ...] | None = None, bitmap=None) -> DataFrame:
    """Template windows (``_FOUND``) of ``texts`` (the id and text).

    With ``lengths``, windows of those lengths that the broadcast ``bitmap`` lets through; without, all windows of
    ``WINDOW`` words, or the whole text as one window if it is shorter. Each is hashed with placeholders for numbers, units
    and names, also with one for a capitalised word that opens a sentence, with names as they are, and with all words as
    they are; what says too little as a template (``MOST_SLOTS``, ``LEAST_WORDS``) only as it is. ``n_templates``: how many say enough. ``copy`` tells rows of one id apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = None if bitmap is None else bitmap.value
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = _with_blank(part.column("text"))
                canonical, literal, slot, name, opener, first = words(raw, at)
                sizes = np.diff(first)
                rows: list[tuple[np.ndarray, ...]] = []
                lists: list[np.ndarray] = []
                kinds = ((canonical, slot, None), (np.where(name, literal, canonical), slot & ~name, name), (literal, np.zeros(len(slot), bool), slot & ~name), (np.where(opener, NAME, canonical), slot | opener, opener))
                for n in lengths or sorted({WINDOW, *(int(x) for x in np.unique(sizes) if 0 < x < WINDOW)}):
                    templates = np.zeros(len(sizes), np.int64)
                    for own, filled, other in kinds:
                        if other is not None and not other.any():
                            continue  # as the kind before
                        text, h, k = _windows(n, own, first)
                        slots = np.concatenate([[0], np.cumsum(filled)])
                        take = slots[k + n] - slots[k] <= (MOST_SLOTS * n if n >= LEAST_WORDS else 0)
                        if there is None:
                            take &= (sizes[text] == n) | (n == WINDOW)
                        if other is None:
                            templates = np.bincount(text[take], minlength=len(sizes))
                        else:
                            others = np.concatenate([[0], np.cumsum(other)])
                            take &= others[k + n] > others[k]
                        if there is not None:
                            take &= there[(h & np.uint64((1 << BITMAP) - 1)).astype(np.int64)]
                        if take.any():
                            text, h, k = text[take], h[take], k[take]
                            rows.append((text, np.full(len(h), n, np.int32), k - first[text], h, templates[text]))
                            lists += [literal[x : x + n].view(np.int64)[filled[x : x + n]] for x in k.tolist()]
                if not rows:
                    continue
                text, n, position, h, templates = (np.concatenate(x) for x in zip(*rows, strict=True))
                copies = {t: zlib.crc32(raw[at[t] : at[t + 1]].tobytes()) for t in np.unique(text).tolist()}
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id").take(pa.array(text)), pa.array([copies[t] for t in text.tolist()], pa.int64()), pa.array(n), pa.array(position),
                        pa.array(h.view(np.int64)), pa.array(lists, pa.list_(pa.int64())), pa.array(np.maximum(1, sizes[text] - n + 1)),
                        pa.array(templates),
                    ],
                    names=["id", "copy", "length", "position", "hash", "slots", "n_windows", "n_templates"],
                )

    bounded_batches(texts.sparkSession)
    return texts.select(F.col(id_column).cast("long").alias("id"), F.col("text").cast("string")).mapInArrow(run, _FOUND)


_SETTLED = "doc_id long, copy long, item_id long, length int, n_windows long, n_templates long, positions array<long>, other boolean"


def consistent(windows: list[tuple[int, list[int], list[int]]]) -> tuple[list[int], bool]:
    """Positions of an alignment's windows (position, values of the item, values of the document) that hold for each value
    of the item the one that most windows hold there, and whether any of them is another than the item's. A window whose
    words all agree has no values and always counts."""
    votes: dict[int, Counter] = defaultdict(Counter)
    for _, slots, values in windows:
        for slot, value in zip(slots, values, strict=True):
            votes[slot][value] += 1
    kept = {slot: max(n, key=lambda v: (n[v], v == slot, v)) for slot, n in votes.items()}
    good = [w for w in windows if all(kept[slot] == value for slot, value in zip(w[1], w[2], strict=True))]
    return sorted({w[0] for w in good}), any(w[1] != w[2] for w in good)


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [consistent([(w["item_position"], w["slots"], w["values"]) for w in windows.as_py()]) for windows in batch.column("windows")]
        keys = ["doc_id", "copy", "item_id", "length", "n_windows", "n_templates"]
        own = [pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.bool_())]
        yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + own, names=[*keys, "positions", "other"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Benchmark items (item_id, text) that occur in documents (doc_id, text), one row per pair.

    Returns ``doc_id long, item_id long, n_windows long, n_found long, reparameterised boolean``: the item's windows, how
    many of them the document has in consistent alignments, and whether a placeholder holds another value there. A pair is
    reported if half of the item's windows, or six of them, are found; or half or six of those that can match with other
    values, if what is found covers half of the item's words. Items of one or two words are found as they are. Null and
    empty texts have none; rows with a null id take no part; repeated rows are reported once; an empty table gives no rows;
    further columns are ignored.
    """
    spark = docs.sparkSession
    items = materialize(template_windows(benchmark, "item_id").where("id IS NOT NULL").distinct(), "benchmark-windows")
    bits = items.select(F.col("hash").bitwiseAND(F.lit((1 << BITMAP) - 1)).cast("int").alias("bit")).distinct().toArrow()
    bitmap = np.zeros(1 << BITMAP, bool)
    bitmap[bits.column("bit").to_numpy()] = True
    lengths = tuple(sorted(r["length"] for r in items.select("length").distinct().collect()))
    if not lengths:
        lengths = (WINDOW,)
    found = template_windows(docs.where("doc_id IS NOT NULL"), "doc_id", lengths, spark.sparkContext.broadcast(bitmap))
    found = found.select(F.col("id").alias("doc_id"), "copy", "position", "hash", F.col("length"), F.col("slots").alias("values")).distinct()
    items = items.select(F.col("id").alias("item_id"), F.col("position").alias("item_position"), "hash", "length", "slots", "n_windows", "n_templates")
    if items.count() <= BROADCAST_ROWS:
        items = F.broadcast(items)
    aligned = found.join(items, ["hash", "length"]).withColumn("shift", F.col("position") - F.col("item_position"))
    # no more windows than the item has, each in the kinds that it is hashed in
    alignments = aligned.groupBy("doc_id", "copy", "item_id", "length", "n_windows", "n_templates", "shift").agg(
        F.collect_set(F.struct("item_position", "slots", "values")).alias("windows")
    )
    alignments = alignments.mapInArrow(_settled, _SETTLED)
    per_copy = alignments.groupBy("doc_id", "copy", "item_id", "length", "n_windows", "n_templates").agg(
        F.array_distinct(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("other").alias("reparameterised")
    )
    per_copy = per_copy.withColumn("n_found", F.size("positions").cast("long"))
    enough = lambda n: F.least(F.lit(ENOUGH), F.ceil(F.col(n) * SHARE))
    covered = F.size(F.array_distinct(F.flatten(F.transform("positions", lambda p: F.sequence(p, p + F.col("length") - 1)))))
    as_template = (F.col("n_templates") > 0) & (F.col("n_found") >= enough("n_templates")) & (covered >= (F.col("n_windows") + F.col("length") - 1) * SHARE)
    return (
        per_copy.where((F.col("n_found") >= enough("n_windows")) | as_template)
        .groupBy("doc_id", "item_id")
        .agg(F.max("n_windows").alias("n_windows"), F.max("n_found").alias("n_found"), F.min("reparameterised").alias("reparameterised"))
    )
