"""Interval algebra. Intervals are 1-based and inclusive; sources and sinks convert.

Joins cut the axis into bins and join on (chromosome, bin), so that they are hash or sort-merge joins. Unions and depths
cut it into tiles: what happens inside a tile has at most as many rows as the tile has bases once it is aggregated, and
only what touches a tile's edge is joined across tiles. So a chromosome or a place that holds a third of all rows is no
single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BIN = 1000
TILE = 1 << 16


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return (start <= other_end) & (other_start <= end)


def _bins(start: Column, end: Column, size: int) -> Column:
    """All bins of an interval; none if it is empty."""
    return F.when(start <= end, F.sequence(F.floor(start / size), F.floor(end / size))).otherwise(F.array().cast("array<bigint>"))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_span: tuple[Column, Column], right_span: tuple[Column, Column], size: int = BIN) -> DataFrame:
    """All pairs of rows with equal keys and overlapping spans; the sides' column names must differ."""
    ls, le = left_span
    rs, re = right_span
    a = left.withColumn("_ls", ls.cast("long")).withColumn("_le", le.cast("long")).withColumn("_lbin", F.explode(_bins(F.col("_ls"), F.col("_le"), size)))
    b = right.withColumn("_rs", rs.cast("long")).withColumn("_re", re.cast("long")).withColumn("_rbin", F.explode(_bins(F.col("_rs"), F.col("_re"), size)))
    same = F.col("_lbin") == F.col("_rbin")
    for x, y in keys:
        same &= a[x] == b[y]
    # a pair that shares several bins is kept in the first of them
    first = F.col("_lbin") == F.floor(F.greatest("_ls", "_rs") / size)
    return a.join(b, same & overlaps(F.col("_ls"), F.col("_le"), F.col("_rs"), F.col("_re")) & first).drop("_ls", "_le", "_rs", "_re", "_lbin", "_rbin")


def stab_join(points: DataFrame, intervals: DataFrame, keys: Sequence[tuple[str, str]], point: Column, span: tuple[Column, Column], size: int = BIN) -> DataFrame:
    """All pairs of a point and an interval that holds it; only the intervals are repeated per bin."""
    start, end = span
    a = points.withColumn("_p", point.cast("long")).withColumn("_lbin", F.floor(F.col("_p") / size))
    b = intervals.withColumn("_rs", start.cast("long")).withColumn("_re", end.cast("long")).withColumn("_rbin", F.explode(_bins(F.col("_rs"), F.col("_re"), size)))
    same = (F.col("_lbin") == F.col("_rbin")) & F.col("_p").between(F.col("_rs"), F.col("_re"))
    for x, y in keys:
        same &= a[x] == b[y]
    return a.join(b, same).drop("_p", "_lbin", "_rs", "_re", "_rbin")


def overlap_semi(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_span: tuple[Column, Column], right_span: tuple[Column, Column], size: int = BIN) -> DataFrame:
    """Rows of ``left`` (columns and repeats kept) that overlap any row of ``right``.

    ``right`` is fused into disjoint runs first, and each different span of ``left`` tests its bins against them. Rows are told
    by key and span: a number for each row would not be the same when a cluster computes ``left`` twice.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    runs = union_runs(right.select(*(F.col(y).alias(k) for k, (_, y) in zip(names, keys, strict=True)), right_span[0].alias("_s"), right_span[1].alias("_e")), names, "_s", "_e")
    cells = runs.withColumn("_rbin", F.explode(_bins(F.col("_s"), F.col("_e"), size)))
    span = [*names, "_ls", "_le"]
    marked = left.select("*", *(F.col(x).alias(k) for k, (x, _) in zip(names, keys, strict=True)), left_span[0].cast("long").alias("_ls"), left_span[1].cast("long").alias("_le"))
    bins = marked.select(*span).distinct().withColumn("_rbin", F.explode(_bins(F.col("_ls"), F.col("_le"), size)))
    hit = bins.join(cells, [*names, "_rbin"]).where(overlaps(F.col("_ls"), F.col("_le"), F.col("_s"), F.col("_e"))).select(*span).distinct()
    return marked.join(hit, span, "left_semi").select(*left.columns)


def _islands(df: DataFrame, keys: list[str], gap: int, extra: list[str]) -> DataFrame:
    """Fuse rows (``s``, ``e``) of one group whose distance is at most ``gap``."""
    order = W.partitionBy(*keys, *extra).orderBy("s", "e")
    reach = F.max("e").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.withColumn("_new", (F.col("s") > F.coalesce(reach, F.lit(-(1 << 62))) + gap).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, *extra, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("_island")


def fuse(df: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """As ``union_runs``, for many small groups: all rows of a group meet in one task, and are shuffled once."""
    spans = df.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    return _islands(spans, keys, 1, []).select(*keys, F.col("s").alias(start), F.col("e").alias(end))


def union_runs(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", touching: bool = True, tile: int = TILE) -> DataFrame:
    """The union of the intervals of each group as disjoint runs (``keys``, start, end).

    ``touching``: neighbours without a base between them fuse; else they need a base in common. Empty intervals and those
    with null ends count for nothing.
    """
    gap = 1 if touching else 0
    spans = df.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"))
    cut = spans.withColumn("_tile", F.explode(_bins(F.col("s"), F.col("e"), tile)))
    low, high = F.col("_tile") * tile, (F.col("_tile") + 1) * tile - 1
    if not touching:
        # an interval that goes on is told from one that ends at the edge by reaching one base over it
        high = high + 1
    cut = cut.select(*keys, "_tile", F.greatest("s", low).alias("s"), F.least("e", high).alias("e"))
    least = cut.groupBy(*keys, "_tile", "s").agg(F.max("e").alias("e"))  # at most a row per base of the tile
    inside = _islands(least, keys, gap, ["_tile"])
    edge = (F.col("s") == low) | (F.col("e") >= (F.col("_tile") + 1) * tile - 1)
    across = _islands(inside.where(edge).drop("_tile"), keys, gap, [])
    return inside.where(~edge).drop("_tile").unionByName(across).select(*keys, F.col("s").alias(start), F.col("e").alias(end))


def depth_runs(df: DataFrame, keys: list[str], start: str = "start", end: str = "end", tile: int = TILE, weight: str | None = None) -> DataFrame:
    """How many intervals cover each base, as runs of equal depth above 0 (``keys``, start, end, depth long). ``weight``: as
    how many an interval counts."""
    n = F.lit(1) if weight is None else F.col(weight).cast("int")
    spans = df.where(F.col(start) <= F.col(end)).select(*keys, F.col(start).cast("long").alias("s"), F.col(end).cast("long").alias("e"), n.alias("_n"))
    steps = spans.select(*keys, F.explode(F.array(F.struct(F.col("s").alias("at"), F.col("_n").alias("d")), F.struct((F.col("e") + 1).alias("at"), (-F.col("_n")).alias("d")))).alias("x"))
    steps = steps.groupBy(*keys, F.col("x.at").alias("at")).agg(F.sum("x.d").alias("d")).withColumn("_tile", F.floor(F.col("at") / tile))
    tiles = steps.groupBy(*keys, "_tile").agg(F.sum("d").alias("total"))
    before = W.partitionBy(*keys).orderBy("_tile")
    tiles = tiles.withColumn("base", F.coalesce(F.sum("total").over(before.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    tiles = tiles.withColumn("_next", F.lead("_tile").over(before))
    # a tile begins at the depth that the tiles before it leave, and a stretch without any step is one run
    opening = tiles.select(*keys, "_tile", (F.col("_tile") * tile).alias("at"), F.col("base").alias("d"))
    within = steps.select(*keys, "_tile", "at", "d").unionByName(opening).groupBy(*keys, "_tile", "at").agg(F.sum("d").alias("d"))
    order = W.partitionBy(*keys, "_tile").orderBy("at")
    runs = within.withColumn("depth", F.sum("d").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("e", F.coalesce(F.lead("at").over(order), (F.col("_tile") + 1) * tile) - 1)
    gaps = tiles.where(F.col("_next") > F.col("_tile") + 1).select(
        *keys, ((F.col("_tile") + 1) * tile).alias(start), (F.col("_next") * tile - 1).alias(end), (F.col("base") + F.col("total")).alias("depth")
    )
    flat = runs.select(*keys, F.col("at").alias(start), F.col("e").alias(end), "depth").unionByName(gaps).where("depth > 0")
    return union_runs(flat, [*keys, "depth"], start, end, tile=tile).select(*keys, start, end, F.col("depth").cast("long"))


def values_at(points: DataFrame, intervals: DataFrame, keys: Sequence[tuple[str, str]], point: str, start: str, end: str, value: str, size: int = BIN) -> DataFrame:
    """All values of the intervals that hold a point, in order and joined by commas; ends given in either order."""
    span = (F.least(start, end), F.greatest(start, end))
    found = stab_join(points, intervals, keys, F.col(point), span, size)
    return found.groupBy(*points.columns).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), ",").alias("labels"), F.count("*").alias("n_intervals"))


def out_of_order(df: DataFrame, row: str, order: list[str], chunk: int = TILE) -> DataFrame:
    """Rows (by their number ``row``) that sort before the row ahead of them.

    Neighbours meet by number, not in one sorted task: chunks of rows are windows of their own, and each also gets the
    first row of the next.
    """
    own = df.withColumn("_chunk", F.floor(F.col(row) / chunk))
    first = own.where(F.col(row) % chunk == 0).withColumn("_chunk", F.col("_chunk") - 1)
    window = W.partitionBy("_chunk").orderBy(row)
    key = F.struct(*order)
    both = own.unionByName(first).withColumn("_late", key < F.lag(key).over(window))
    return both.where("_late").drop("_late", "_chunk")
