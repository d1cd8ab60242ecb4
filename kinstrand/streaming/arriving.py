"""Links of variants that arrive as a stream, against a stored similarity table.

A stream-static join on (chromosome, bin): state-free, so every micro-batch is a plan of its own and nothing has to be kept
between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinstrand.operators.entries import lift_base, lift_position
from kinstrand.operators.intervals import stab_join


def arriving_links(variants: DataFrame, entries: DataFrame) -> DataFrame:
    """``var_id, to_chr, to_pos, to_ref, to_alt`` for each entry over each arriving variant, but for its own place."""
    both = stab_join(variants, entries.where("origin_chr IS NOT NULL"), [("chr", "align_chr")], F.col("pos"), (F.col("align_start"), F.col("align_end")))
    placed = both.select(
        "var_id", "chr", "pos", F.col("origin_chr").alias("to_chr"), lift_position(F.col("pos")).cast("long").alias("to_pos"),
        lift_base(F.col("ref_base")).alias("to_ref"), lift_base(F.col("alt_base")).alias("to_alt"),
    )
    return placed.where((F.col("to_chr") != F.col("chr")) | (F.col("to_pos") != F.col("pos"))).select("var_id", "to_chr", "to_pos", "to_ref", "to_alt")


def write_arriving(variants: DataFrame, entries: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Annotate what has arrived and append it to a Parquet table, each variant exactly once."""
    return arriving_links(variants, entries).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
