"""CIGAR functions as Column expressions. A parsed CIGAR is ``array<struct<len:int,op:string>>``; positions are 1-based."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_ELEMENTS = "array<struct<len:int,op:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once however often it is named there."""
    return F.transform(F.array(value), body)[0]


def parse(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0)),
        lambda x: F.struct(F.regexp_replace(x, "[^0-9]", "").cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")),
    )


def to_text(elements: Column) -> Column:
    return F.array_join(F.transform(elements, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def _total(elements: Column, ops: str) -> Column:
    return F.aggregate(elements, F.lit(0), lambda s, x: s + F.when(x["op"].isin(*ops), x["len"]).otherwise(0))


def reference_span(elements: Column) -> Column:
    """Bases of the reference that the read covers."""
    return _total(elements, "MDN=X")


def read_span(elements: Column) -> Column:
    """Bases that the read holds, clipped ones included."""
    return _total(elements, "MIS=X")


def is_plain(elements: Column) -> Column:
    """One stretch of matches and nothing else."""
    return (F.size(elements) == 1) & (F.element_at(elements, 1)["op"] == "M")


def has_indel_or_splice(elements: Column) -> Column:
    return F.exists(elements, lambda x: x["op"].isin("I", "D", "N"))


def count_indels(elements: Column) -> Column:
    return F.size(F.filter(elements, lambda x: x["op"].isin("I", "D", "N")))


def has_long_indel(elements: Column, longest: int) -> Column:
    return F.exists(elements, lambda x: x["op"].isin("I", "D") & (x["len"] > longest))


def is_complex(elements: Column) -> Column:
    """Two neighbouring elements of which neither is a stretch of matches."""
    return F.exists(
        F.zip_with(F.slice(elements, 1, F.size(elements)), F.slice(elements, 2, F.size(elements)), lambda a, b: (a["op"] != "M") & (b["op"] != "M")),
        lambda x: F.coalesce(x, F.lit(False)),
    )


def base_positions(elements: Column, start: Column) -> Column:
    """The reference position of each base of the read; -1 for inserted and clipped ones."""
    none = F.array().cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        aligned, skipped = x["op"].isin("M", "=", "X"), x["op"].isin("D", "N")
        own = (
            F.when(aligned, F.transform(F.sequence(F.lit(0), F.greatest(x["len"], F.lit(1)) - 1), lambda k: acc["at"] + k))
            .when(x["op"].isin("I", "S"), F.array_repeat(F.lit(-1), x["len"]))
            .otherwise(none)
        )
        return F.struct((acc["at"] + F.when(aligned | skipped, x["len"]).otherwise(0)).alias("at"), F.concat(acc["out"], own).alias("out"))

    return F.aggregate(elements, F.struct(start.cast("int").alias("at"), none.alias("out")), step, lambda acc: acc["out"])


def base_at(sequence: Column, elements: Column, start: Column, position: Column) -> Column:
    """The read's base at a reference position; N where it has none (deleted, skipped or outside)."""
    direct = F.substring(sequence, (position - start + 1).cast("int"), F.lit(1))
    walked = F.array_position(base_positions(elements, start), position.cast("int"))
    inside = (position >= start) & (position < start + reference_span(elements))
    found = F.when(is_plain(elements), direct).when(walked > 0, F.substring(sequence, walked.cast("int"), F.lit(1)))
    return F.when(inside, F.coalesce(found, F.lit("N"))).otherwise(F.lit("N"))


def matches(sequence: Column, elements: Column, start: Column, reference: Column) -> Column:
    """For each base ``1`` if it equals the reference (a string from ``start`` on), else ``0``; unaligned ones are ``-``."""
    one = lambda p, k: (
        F.when(p < 0, "-").when(F.substring(sequence, k + 1, F.lit(1)) == F.substring(reference, p - start.cast("int") + 1, F.lit(1)), "1").otherwise("0")
    )
    return F.array_join(F.transform(base_positions(elements, start), one), "")


def mismatch_count(sequence: Column, elements: Column, start: Column, reference: Column) -> Column:
    """Differing bases and events of insertion, deletion or splice; 0 for a complex CIGAR."""
    differing = F.length(F.regexp_replace(matches(sequence, elements, start, reference), "[^0]", ""))
    return F.when(is_complex(elements), F.lit(0)).otherwise(differing + count_indels(elements))


def soft_clip(sequence: Column, elements: Column, start: Column, reference: Column, clip: int) -> Column:
    """Clip both ends up to the first ``clip`` matches in a row: ``struct<start,end,cigar>``.

    Reads shorter than twice ``clip`` and those with a complex CIGAR stay as they are; one without such a row keeps a
    single base.
    """
    end = start + reference_span(elements) - 1
    as_is = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), elements.cast(_ELEMENTS).alias("cigar"))
    if clip < 1:
        return as_is
    row = "1" * clip
    offsets = F.aggregate(
        elements,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<len:int,op:string,from:int>>").alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.when(x["op"].isin("M", "I", "S", "=", "X"), x["len"]).otherwise(0)).alias("at"),
            F.concat(acc["out"], F.array(F.struct(x["len"].alias("len"), x["op"].alias("op"), acc["at"].alias("from")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    seen = F.struct(matches(sequence, elements, start, reference).alias("good"), base_positions(elements, start).alias("placed"), offsets.alias("offsets"))

    def bounds(s: Column) -> Column:
        left = F.greatest(F.instr(s["good"], row), F.lit(1))  # 1-based in the read
        from_right = F.instr(F.reverse(s["good"]), row)
        size = F.length(s["good"])
        right = F.when(from_right > 0, size - from_right + 1).otherwise(left)
        return F.struct(left.alias("left"), right.alias("right"), size.alias("size"), s["placed"].alias("placed"), s["offsets"].alias("offsets"))

    def result(s: Column) -> Column:
        left, right, size, placed = s["left"], s["right"], s["size"], s["placed"]

        def kept(x: Column) -> Column:
            within = F.least(x["from"] + x["len"], right) - F.greatest(x["from"], left - 1)
            whole = x["op"].isin("D", "N") & (x["from"] >= left) & (x["from"] < right)
            return F.struct(F.when(x["op"].isin("D", "N"), F.when(whole, x["len"]).otherwise(0)).otherwise(within).cast("int").alias("len"), x["op"].alias("op"))

        # clipped before means clipped after: such bases are part of the new ends
        core = F.filter(F.transform(F.filter(s["offsets"], lambda x: ~x["op"].isin("S", "H", "P")), kept), lambda x: x["len"] > 0)
        clips = lambda n: F.filter(F.array(F.struct(n.cast("int").alias("len"), F.lit("S").alias("op"))), lambda x: x["len"] > 0)
        new = F.struct(
            F.element_at(placed, left).alias("start"), F.element_at(placed, right).alias("end"),
            F.concat(clips(left - 1), core, clips(size - right)).cast(_ELEMENTS).alias("cigar"),
        )
        touched = (left > 1) | (right < size)
        usable = (size >= 2 * clip) & ~is_complex(elements) & (left <= right) & (F.element_at(placed, left) > 0) & (F.element_at(placed, right) > 0)
        return F.when(touched & usable, new).otherwise(as_is)

    return let(let(seen, bounds), result)


def from_blocks(read_length: Column, sizes: Column, read_starts: Column, target_starts: Column) -> Column:
    """CIGAR text of an alignment in blocks (0-based starts in the read and in the target)."""
    index = F.sequence(F.lit(2), F.size(sizes))
    at = lambda a, k: F.element_at(a, k)

    def joint(k: Column) -> Column:
        inserted = at(read_starts, k) - at(read_starts, k - 1) - at(sizes, k - 1)
        deleted = at(target_starts, k) - at(target_starts, k - 1) - at(sizes, k - 1)
        return F.concat(
            F.when(inserted > 0, F.concat(inserted.cast("string"), F.lit("I"))).otherwise(""),
            F.when(deleted > 0, F.concat(deleted.cast("string"), F.lit("D"))).otherwise(""),
            at(sizes, k).cast("string"), F.lit("M"),
        )

    joints = F.when(F.size(sizes) > 1, F.array_join(F.transform(index, joint), "")).otherwise("")
    head, last = at(read_starts, F.lit(1)), F.size(sizes)
    tail = read_length - at(read_starts, last) - at(sizes, last)
    clip = lambda n: F.when(n > 0, F.concat(n.cast("string"), F.lit("S"))).otherwise("")
    return F.concat(clip(head), at(sizes, F.lit(1)).cast("string"), F.lit("M"), joints, clip(tail))
