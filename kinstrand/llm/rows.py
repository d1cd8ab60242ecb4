"""Rows of a large table by id, and names that a table does not use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids up to which they are broadcast (8 bytes each); a shuffled join serves more.
BROADCAST_IDS = 400_000


def unused(columns: list[str], name: str) -> str:
    """``name``, with as many marks after it as no column has, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "~"
    return name


def without(docs: DataFrame, ids: DataFrame, column: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not in the stored table ``ids`` (one column, distinct). Rows without id stay."""
    name = unused(docs.columns, "gone")
    ids = ids.select(F.col(ids.columns[0]).alias(name))
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[column] == ids[name], "left_anti")
