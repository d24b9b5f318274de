"""Intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"

# Labels of tables with all columns of a delivery's rows.
WHOLE = {"delivery", "delivery-rows"}

# Of Spark: whether the shuffle files of a query go when it has ended, or some time after.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# Of each thread the paths given out in its open blocks, the innermost block last.
_given = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without the setting gets a temporary folder; on a cluster the
    executors could not all see one, so the missing setting is an error there.
    """
    named = spark.conf.get(CHECKPOINT_DIR, None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_DIR} to a folder that every executor can reach")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="meibo-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, label: str) -> str:
    """An unused path below the shared folder."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if blocks := getattr(_given, "blocks", None):
        blocks[-1].append(path)
    return path


@contextmanager
def discarding(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, what was staged in it; also when the block fails.

    Nothing that is read later may hang on a table staged inside: a job belongs into the block together
    with the writing of its result to a path that was named outside.
    """
    blocks = _given.__dict__.setdefault("blocks", [])
    blocks.append([])
    try:
        yield
    finally:
        for path in blocks.pop():
            discard(spark, path)


@contextmanager
def ending_shuffles(spark: SparkSession) -> Iterator[None]:
    """Within the block Spark deletes the shuffle files of each query when the query has ended.

    Otherwise they lie on the executors' disks until the driver collects garbage.
    """
    before = spark.conf.get(SHUFFLES_END, None)
    spark.conf.set(SHUFFLES_END, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END)
        else:
            spark.conf.set(SHUFFLES_END, before)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a staged table, if it is there."""
    files, at = _files(spark, path)
    files.delete(at, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` once as Parquet and read it back.

    Lineage ends at the written files, so later steps read columns instead of computing the
    rows again, and a lost executor costs nothing that was already written. What :data:`WHOLE` names
    is packed more densely than the session would.
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    writer = df.write.option("compression", "zstd") if label in WHOLE else df.write
    writer.parquet(path)
    # The schema is known; giving it saves the footer job of schema inference.
    return spark.read.schema(df.schema).parquet(path)


def _files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    files, at = _files(spark, path)
    return files.exists(at)


def children(spark: SparkSession, pattern: str) -> list[str]:
    """The names of the files and folders that a path pattern matches."""
    files, at = _files(spark, pattern)
    return sorted(found.getPath().getName() for found in files.globStatus(at) or [])


def sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """The bytes of the data files in a folder, by name."""
    files, at = _files(spark, folder)
    found = {each.getPath().getName(): each.getLen() for each in files.listStatus(at)}
    return {name: size for name, size in found.items() if name[0] not in "._"}


def move(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder. The target must not be there."""
    files, at = _files(spark, source)
    _, to = _files(spark, target)
    # Onto a folder that is there, a rename would go inside.
    if files.exists(to) or not files.rename(at, to):
        raise ValueError(f"cannot move {source} to {target}")
