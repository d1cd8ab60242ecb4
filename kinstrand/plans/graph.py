"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.plans.storage import materialize

#: Links of one vertex from which on it counts as hot: what it is joined with then goes to the links.
HOT_LINKS = 1_000_000


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Map every vertex that occurs in ``edges`` to the smallest vertex it can reach.

    Alternates two star contractions on the edge table until every vertex has one link, to a vertex without any; each
    round is two aggregations and two equi-joins, and the number of rounds grows with the logarithm of the longest path.
    Nothing but row counts comes to the driver. The links of a hot vertex stay where they are. Rows with a null end and
    self links add no connection; a vertex that has only a self link still gets a row.

    Returns ``vertex, component``.
    """
    clean = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    stored = materialize(clean.distinct(), "edges")
    alone = stored.where("a = b").select("a")
    links = stored.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    for _ in range(max_rounds):
        if _is_settled(links):
            break
        large = materialize(_large_star(links), "links")
        links = materialize(_small_star(large), "links")
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("vertex")).distinct().select("vertex", F.col("vertex").alias("component"))
    found = links.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots)
    lonely = alone.withColumnRenamed("a", "vertex").join(found.select("vertex"), "vertex", "left_anti")
    return found.unionByName(lonely.select("vertex", F.col("vertex").alias("component")))


def _is_settled(links: DataFrame) -> bool:
    """Whether no vertex has two links to smaller ones, or one and is itself the smaller end of another."""
    ends = links.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _joined(links: DataFrame, end: str, least: DataFrame) -> DataFrame:
    """``links`` with the ``m`` that ``least`` (x, m) has for the vertex at ``end``, or null. Hot vertices are at most one
    of ``HOT_LINKS`` links each, so what is broadcast for them is small beside the table."""
    least = least.withColumnRenamed("x", end)
    hot = links.groupBy(end).count().where(F.col("count") > HOT_LINKS).select(end)
    if hot.isEmpty():
        return links.join(least, end, "left")
    hot = F.broadcast(materialize(hot, "hot-vertices"))
    there = links.join(hot, end, "left_semi").join(F.broadcast(least.join(hot, end, "left_semi")), end, "left")
    return links.join(hot, end, "left_anti").join(least, end, "left").unionByName(there)


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a vertex is linked to the least of that vertex and its neighbours. (The least neighbour
    of a vertex that is smaller than it is the least smaller end of its links.)"""
    least = links.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    return _joined(links, "v", least).select("u", F.coalesce("m", "v").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each vertex and its smaller neighbours are linked to the least of them."""
    least = links.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
    moved = _joined(links, "u", least).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
