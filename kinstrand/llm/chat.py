"""Chat formatting by perspective rotation, in DataFrame functions alone.

For every participant of a conversation the whole dialogue is rendered with that speaker as assistant and the others as
named users; system turns stay system turns. The mask says which characters that assistant wrote: those of its turns'
text and end mark.

A dialogue is one row, or, from ``PART_TURNS`` turns on, several parts of so many turns each, so that one with a third of
all turns is rendered by many tasks. Parts are cut by the rank of a turn, whatever its number, and joined by line breaks
they are the dialogue: positions count from its first character. Ranks come from one sort of all turns by ranges; only the
first place of each long conversation in each range is counted, never a whole conversation in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinstrand.plans.storage import materialize

PART_TURNS = 256
BEGIN, END = "<|im_start|>", "<|im_end|>"
SYSTEM, NOBODY = "system", "unknown"
#: Rows of a small table up to which it is broadcast; a shuffled join serves more.
BROADCAST_ROWS = 100_000


def _head(role: Column, own: Column) -> Column:
    who = F.when(role == SYSTEM, F.lit(SYSTEM)).when(own, F.lit("assistant")).otherwise(F.concat(F.lit("user name="), role))
    return F.concat(F.lit(BEGIN), who, F.lit("\n"))


def _segment(turn: Column, speaker: Column) -> Column:
    """What a turn looks like to ``speaker``: its header, its body, and whether the mask covers the body."""
    own = turn["role"] == speaker
    return F.struct(_head(turn["role"], own).alias("head"), F.concat(turn["text"], F.lit(END)).alias("body"), own.alias("own"))


def _spans(segments: Column, begin: Column) -> Column:
    """First character and the one after the last of every body that the mask covers; the first segment is at ``begin``."""
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    start = F.struct(begin.cast("bigint").alias("at"), none.alias("spans"))

    def step(acc: Column, s: Column) -> Column:
        first = acc["at"] + F.length(s["head"])
        last = first + F.length(s["body"])
        span = F.array(F.struct(first.cast("bigint").alias("first"), last.cast("bigint").alias("last")))
        return F.struct((last + 1).cast("bigint").alias("at"), F.when(s["own"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(segments, start, step, lambda acc: acc["spans"])


def _ranked(turns: DataFrame, part_turns: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All turns with ``place`` (their order) and ``part``; turns of each role of a conversation; and of each conversation."""
    clean = turns.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce(F.col("role").cast("string"), F.lit(NOBODY)).alias("role"),
        F.replace(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"),
    )
    keys = ["conv_id", F.col("turn").asc_nulls_last(), F.md5(F.concat_ws("\n", "role", "text")), F.xxhash64("copy")]
    ordered = clean.withColumn("copy", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # stored: the place of a row must not change when a task is run again
    placed = materialize(ordered.select("conv_id", "role", "text", F.monotonically_increasing_id().alias("place")), "turns")
    per_role = materialize(placed.groupBy("conv_id", "role").agg(F.count("*").alias("n")), "roles")
    sizes = per_role.groupBy("conv_id").agg(F.sum("n").alias("n"))
    split = F.shiftright("place", 33).alias("range")
    runs = placed.join(sizes.where(F.col("n") > part_turns).select("conv_id"), "conv_id", "left_semi").groupBy("conv_id", split)
    earlier = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)  # a row per range
    runs = runs.agg(F.min("place").alias("first"), F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    runs = materialize(runs.select("conv_id", "range", (F.col("before") - F.col("first")).alias("shift")), "long-conversations")
    if runs.count() <= BROADCAST_ROWS:
        runs = F.broadcast(runs)
    ranked = placed.withColumn("range", split).join(runs, ["conv_id", "range"], "left")
    part = F.coalesce(F.floor((F.col("place") + F.col("shift")) / part_turns), F.lit(0)).cast("long")
    return ranked.select("conv_id", part.alias("part"), "place", "role", "text"), per_role, sizes


def _begins(ranked: DataFrame, seats: DataFrame, long: DataFrame) -> DataFrame:
    """Where each part of a long dialogue begins, for each perspective: ``conv_id, part, perspective, first_char``."""
    mine = ranked.join(long, "conv_id", "left_semi").groupBy("conv_id", "part", "role").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    head = lambda own: F.length(_head(F.col("role"), F.lit(own)))
    mine = materialize(
        mine.select("conv_id", "part", "role", (F.col("chars") + F.col("n") * (head(False) + len(END) + 1)).alias("size"), (F.col("n") * (head(True) - head(False))).alias("more")), "part-sizes"
    )
    whole = mine.groupBy("conv_id", "part").agg(F.sum("size").alias("size"))
    own = mine.select("conv_id", "part", F.col("role").alias("perspective"), "more")
    earlier = W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # a row per part
    rows = seats.join(long, "conv_id", "left_semi").join(whole, ["conv_id", "part"]).join(own, ["conv_id", "part", "perspective"], "left")
    return rows.select("conv_id", "part", "perspective", F.sum(F.col("size") + F.coalesce("more", F.lit(0))).over(earlier).alias("first_char"))


def rotate_perspectives(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """Render ``turns`` (conv_id, turn, role, text) once for every participant.

    Returns ``conv_id, perspective, part long, first_char long, n_turns long, text string, mask array<struct<first,last>>``; a
    dialogue is the text of its parts in their order, joined by line breaks. ``first_char`` and the mask are positions (code
    points) in the whole dialogue. Turns are in order of number, however far apart the numbers are, turns without a number
    last; those of one number by the md5 of role, line break and text; repeated rows are turns of their own. A null role
    counts as ``unknown`` and is a participant; a null text is empty; marks inside a text are defused by a space after
    ``<``. System turns are nobody's perspective, so a conversation of system turns alone has no rows; rows without conv_id
    belong to none. An empty table gives no rows; further columns are ignored.
    """
    ranked, per_role, sizes = _ranked(turns, part_turns)
    last = F.floor((F.col("n") - 1) / part_turns)
    voices = per_role.where(F.col("role") != SYSTEM).select("conv_id", F.col("role").alias("perspective"))
    seats = voices.join(sizes, "conv_id").select("conv_id", "perspective", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    long = materialize(sizes.where(F.col("n") > part_turns).select("conv_id"), "long-ids")
    if long.isEmpty():
        seats = seats.withColumn("first_char", F.lit(0).cast("long"))
    else:
        seats = seats.join(_begins(ranked, seats, long), ["conv_id", "part", "perspective"], "left").withColumn("first_char", F.coalesce("first_char", F.lit(0)).cast("long"))
    parts = ranked.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    rendered = parts.join(seats, ["conv_id", "part"]).withColumn("segments", F.transform("turns", lambda t: _segment(t, F.col("perspective"))))
    return rendered.select(
        "conv_id", "perspective", "part", "first_char", F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("segments", lambda s: F.concat(s["head"], s["body"])), "\n").alias("text"),
        _spans(F.col("segments"), F.col("first_char")).alias("mask"),
    )


def spans_text(mask: Column) -> Column:
    """A mask as text: ``first-last`` joined by commas."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string"))), ",")


#: What ``rotate_perspectives`` gives for ``conversations``, with the mask as text.
ORACLE = f"""
WITH clean AS (
  SELECT conv_id, turn, coalesce(role, '{NOBODY}') AS role, replace(coalesce(text, ''), '<|', '< |') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, md5(role || chr(10) || text)) AS k FROM clean),
segments AS (
  SELECT n.conv_id, p.role AS perspective, (n.k - 1) // {PART_TURNS} AS part, n.k, n.role = p.role AS own,
    '{BEGIN}' || CASE WHEN n.role = '{SYSTEM}' THEN '{SYSTEM}' WHEN n.role = p.role THEN 'assistant' ELSE 'user name=' || n.role END || chr(10) AS head,
    n.text || '{END}' AS body
  FROM numbered n JOIN (SELECT DISTINCT conv_id, role FROM clean WHERE role <> '{SYSTEM}') p ON n.conv_id = p.conv_id),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
    PARTITION BY conv_id, perspective ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot
  FROM segments)
SELECT conv_id, perspective, part, CAST(min(spot) AS BIGINT) AS first_char, CAST(count(*) AS BIGINT) AS n_turns,
  string_agg(head || body, chr(10) ORDER BY k) AS text,
  coalesce(string_agg(CAST(spot + length(head) AS BIGINT) || '-' || CAST(spot + length(head) + length(body) AS BIGINT), ',' ORDER BY k) FILTER (WHERE own), '') AS mask
FROM placed GROUP BY conv_id, perspective, part
"""
