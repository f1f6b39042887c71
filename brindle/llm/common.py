"""Helpers shared by the training-data operators: tables, scratch folders, folds, samples and widths."""

from __future__ import annotations

import atexit
import contextlib
import math
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch handed to Python; whole texts are long, so batches stay small.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Session settings that the Python operators rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; only in local mode, where it is unset (tests), one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        local = tempfile.mkdtemp(prefix="brindle-")
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        found = f"file://{local}"
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


_cleaned: set[str] = set()


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, under a folder of this application that goes when Python ends."""
    folder = f"{shared_dir(spark)}/brindle-{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_swept, spark, folder)
    path = f"{folder}/{what}-{uuid.uuid4().hex[:12]}"
    for made in _watching:
        made.append(path)
    return path


_watching: list[list[str]] = []


@contextlib.contextmanager
def sweeping(spark: SparkSession) -> Iterator[set[str]]:
    """Scratch paths made inside go at its end, but for those that the body adds to the set it is given.

    For bodies that return only what is stored or on the driver: nothing that is read later may stand on a path that goes.
    """
    made: list[str] = []
    keep: set[str] = set()
    _watching.append(made)
    try:
        yield keep
    finally:
        _watching.pop()  # made: bodies end in the order they began, the last first
        for path in made:
            if path not in keep:
                with contextlib.suppress(Exception):  # what is left goes with the application's folder
                    removed(spark, path)


def _swept(spark: SparkSession, folder: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        removed(spark, folder)


def stored(df: DataFrame, what: str, keep: set[str] | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage is cut, a lost executor costs nothing.

    keep: the set of a surrounding sweeping(), which then leaves the table alone.
    """
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    if keep is not None:
        keep.add(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a path that scratch() has given, through Spark's own file system layer."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def held_out(doc_id: Column, n: int, remainder: int) -> Column:
    """Whether a row is kept from training; a null doc_id never is."""
    return F.coalesce(crc_mod(doc_id, n) == remainder, F.lit(False))


def drawn(key: Column, share: Column | float, seed: int) -> Column:
    """Whether a row is in a sample of that share, by all 64 bits of a seeded hash of its key; a share of 1 or more takes all."""
    share = share if isinstance(share, Column) else F.lit(float(share))
    return (share >= 1) | (F.xxhash64(F.lit(seed), key).cast("double") < share * F.lit(2.0**64) - F.lit(2.0**63))


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_partition))


def shuffle_width(spark: SparkSession, amount: float = 0, per_task: float = 1) -> int:
    """The session's number of shuffle partitions, or as many more as it takes for each to hold at most ``per_task`` of ``amount``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(amount / per_task))
