"""Building the similarity table: from hits to few long entries.

``kinstrand.operators.entries.merge_diagonals`` gives the set-based merge. This module adds extension along the genome
and the order-dependent greedy merge of a bucket, both on Arrow groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinstrand.operators.entries import ANCHORS, is_trivial, symmetrised

ENTRY = (
    "align_chr string, align_start bigint, align_end bigint, origin_chr string, origin_start bigint, origin_end bigint, penalty bigint, strand string, anchors " + ANCHORS
)
_TURN = str.maketrans("ATCGatcg", "TAGCtagc")


def first_pass(found: DataFrame, length: int, most_penalty: int) -> DataFrame:
    """Entries (with their mirror images) of hits with at most ``most_penalty`` mismatches, without trivial ones."""
    return symmetrised(found.where(F.col("penalty") <= most_penalty).where(~is_trivial()))


def unmapped_entries(regions: DataFrame) -> DataFrame:
    """Regions (chr, start0, end0) without a place as entries whose origin is unknown."""
    none = lambda t: F.lit(None).cast(t)
    return regions.select(
        F.col("chr").cast("string").alias("align_chr"), (F.col("start0") + 1).alias("align_start"), F.col("end0").alias("align_end"), none("string").alias("origin_chr"),
        none("bigint").alias("origin_start"), none("bigint").alias("origin_end"), F.lit(0).cast("bigint").alias("penalty"), F.lit("+").alias("strand"), F.array().cast(ANCHORS).alias("anchors"),
    )


class Growing:
    """An entry that grows base by base against two sequences (1-based positions)."""

    def __init__(self, row: dict, align: str, origin: str):
        self.row, self.align, self.origin = row, align, origin
        self.anchors = [dict(a) for a in row["anchors"]]

    def grow(self, left: bool, rate: float, in_a_row: int, stop: int) -> None:
        """To one side while mismatches stay below ``rate`` and no ``in_a_row`` stand together; not beyond ``stop``."""
        r, forward = self.row, self.row["strand"] == "+"
        edge = "align_start" if left else "align_end"
        at_edge = bool(self.anchors) and self.anchors[0 if left else -1]["align_pos"] == r[edge]
        run = int(at_edge)
        step = -1 if left else 1
        # the origin's end that moves along, and which way
        side, way = ("origin_start", -1) if left == forward else ("origin_end", 1)
        found = []
        while run < in_a_row:
            a, o = r[edge] + step, r[side] + way
            if (a < stop if left else a > stop) or not 1 <= a <= len(self.align) or not 1 <= o <= len(self.origin):
                break
            x, y = self.align[a - 1], self.origin[o - 1]
            seen = y if forward else y.translate(_TURN)
            if x == seen:
                run = 0
            else:
                run += 1
                if len(self.anchors) + len(found) + 1 >= rate * (1 + r["align_end"] - r["align_start"]):
                    break
                back = x if forward else x.translate(_TURN)
                found.append({"align_pos": a, "origin_pos": o, "align_ref": x, "align_alt": seen, "origin_ref": y, "origin_alt": back})
            r[edge], r[side] = a, o
        self.anchors = found[::-1] + self.anchors if left else self.anchors + found
        r["anchors"], r["penalty"] = self.anchors, len(self.anchors)


def extend(entries: DataFrame, genome: DataFrame, length: int, most_penalty: int, in_a_row: int = 2, bucket: int | None = None) -> DataFrame:
    """Extend entries (``ENTRY``) to both sides. With ``bucket``, none grows to the left of its bucket of align starts.

    The two sequences come by joins, so no genome is broadcast; each row is extended on its own.
    """
    rate = most_penalty / length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                align, origin = row.pop("_align"), row.pop("_origin")
                if origin is not None and align is not None:
                    g = Growing(row, align, origin)
                    g.grow(True, rate, in_a_row, 1 if bucket is None else max(1, row["align_start"] // bucket * bucket))
                    g.grow(False, rate, in_a_row, len(align))
                row["anchors"] = [dict(a) for a in row["anchors"]]
                out.append(row)
            yield pd.DataFrame(out, columns=list(batch.columns.drop(["_align", "_origin"])))

    chromosomes = genome.select(F.col("chr").cast("string").alias("chr"), "seq")
    work = entries.join(chromosomes.select(F.col("chr").alias("align_chr"), F.col("seq").alias("_align")), "align_chr", "left").join(
        chromosomes.select(F.col("chr").alias("origin_chr"), F.col("seq").alias("_origin")), "origin_chr", "left"
    )
    return work.select(*entries.columns, "_align", "_origin").mapInPandas(run, ENTRY)


def merge_pair(a: dict, b: dict) -> dict | None:
    """One entry for both if they lie on one diagonal of the same strand and share a base on either side, else none."""
    if any(a[k] != b[k] for k in ("align_chr", "origin_chr", "strand")):
        return None
    if a["align_start"] > b["align_end"] or b["align_start"] > a["align_end"] or a["origin_start"] > b["origin_end"] or b["origin_start"] > a["origin_end"]:
        return None
    forward = a["strand"] == "+"
    if forward and a["align_start"] - a["origin_start"] != b["align_start"] - b["origin_start"]:
        return None
    if not forward and a["align_end"] + a["origin_start"] != b["align_end"] + b["origin_start"]:
        return None
    whole = dict(a)
    for low, high in (("align_start", "align_end"), ("origin_start", "origin_end")):
        whole[low], whole[high] = min(a[low], b[low]), max(a[high], b[high])
    if forward and whole["align_chr"] == whole["origin_chr"] and whole["align_start"] == whole["origin_start"]:
        return None
    anchors = {tuple(sorted(x.items())): dict(x) for x in [*a["anchors"], *b["anchors"]]}
    whole["anchors"] = sorted(anchors.values(), key=lambda x: x["align_pos"])
    whole["penalty"] = len(whole["anchors"])
    return whole


def greedy_merge(entries: DataFrame, genome: DataFrame, length: int, most_penalty: int, bucket: int = 1_000_000) -> DataFrame:
    """The order-dependent merge: in each bucket of align starts and diagonal, extend, then take entries in order of
    their start and fuse each with the one before where that is possible.

    A task holds the entries of one diagonal in one bucket, of which there are at most ``bucket``.
    """
    from kinstrand.operators.entries import diagonal

    grown = extend(entries, genome, length, most_penalty, bucket=bucket)
    names = [f.split()[0] for f in ENTRY.split(" anchors ")[0].split(", ")] + ["anchors"]

    def fuse(group: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        rows = group[names].to_dict("records")
        rows.sort(key=lambda r: (r["align_start"], r["align_end"], r["origin_start"] if r["origin_start"] == r["origin_start"] else -1))
        for row in rows:
            row["anchors"] = [dict(a) for a in row["anchors"]]
            both = merge_pair(out[-1], row) if out else None
            if both is not None:
                out[-1] = both
            elif not (out and out[-1] == row):
                out.append(row)
        return pd.DataFrame(out, columns=names)

    keyed = grown.withColumn("_bucket", F.floor(F.col("align_start") / bucket)).withColumn("_diagonal", diagonal())
    return keyed.groupBy("align_chr", "origin_chr", "strand", "_bucket", "_diagonal").applyInPandas(fuse, ENTRY)
