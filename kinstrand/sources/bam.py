"""Reading BAM files: blocked gzip holding binary alignment rows.

Files come through Spark's own file source, so they may be in any store it reads. Each file is one row and is decoded by one
task as a stream of records; split very large files beforehand.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from kinstrand.sources.text import _SAM, as_reads

_BASES, _OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"
_ROWS = 5000


def records(content: bytes) -> Iterator[tuple]:
    """The eleven SAM columns of every record, as text."""
    with gzip.open(io.BytesIO(content)) as f:
        if f.read(4) != b"BAM\x01":
            raise ValueError("not a BAM file")
        f.read(struct.unpack("<i", f.read(4))[0])
        names = []
        for _ in range(struct.unpack("<i", f.read(4))[0]):
            names.append(f.read(struct.unpack("<i", f.read(4))[0])[:-1].decode())
            f.read(4)
        while size := f.read(4):
            b = f.read(struct.unpack("<i", size)[0])
            ref, pos, n_name, mapq, _, n_ops, flag, n_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", b)
            at = 32 + n_name
            ops = struct.unpack_from(f"<{n_ops}I", b, at)
            at += 4 * n_ops
            packed = b[at : at + (n_seq + 1) // 2]
            seq = "".join(_BASES[x >> 4] + _BASES[x & 15] for x in packed)[:n_seq]
            name = lambda k: names[k] if k >= 0 else "*"  # noqa: B023, E731
            yield (
                b[32 : at - 4 * n_ops - 1].decode(), str(flag), name(ref), str(pos + 1), str(mapq), "".join(f"{o >> 4}{_OPS[o & 15]}" for o in ops) or "*",
                "=" if mate == ref and mate >= 0 else name(mate), str(mate_pos + 1), str(tlen), seq or "*", "*",
            )


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                rows: list[tuple] = []
                for r in records(bytes(content)):
                    rows.append(r)
                    if len(rows) == _ROWS:
                        yield pd.DataFrame(rows, columns=_SAM)
                        rows = []
                yield pd.DataFrame(rows, columns=_SAM)

    schema = ", ".join(f"{c} string" for c in _SAM)
    return as_reads(spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema))
