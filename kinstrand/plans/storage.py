"""Cutting lineage through the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a temporary one of a session whose executors are
    in the driver (tests); on a cluster there is no folder that all could share, so that is an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="kinstrand-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back, so that later stages survive lost executors.

    The table is removed by ``discard_written``, at the latest when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kinstrand-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def leaving_nothing(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table leaves the disk when the table is written, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, was)


def written() -> int:
    """How many tables this process has written and not removed."""
    return len(_written)


def discard_written(first: int = 0, last: int | None = None) -> None:
    """Delete the tables that ``materialize`` wrote in this process, in order from the ``first`` to before the ``last``."""
    for item in _written[first:last]:
        _written.remove(item)
        spark, path = item
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session may be gone already
            return


atexit.register(discard_written)
