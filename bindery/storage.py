"""Places that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Folders of the scratch blocks that are open, innermost last.
_open: list[list[str]] = []


def _is_local(master: str) -> bool:
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder name below ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors are one process, a temporary folder is
    made and set if the session names none; on a cluster that is an error, as no folder of
    one machine would do.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        base = context.getCheckpointDir()
        if not base:
            if not _is_local(context.master):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="bindery-"))
            base = context.getCheckpointDir()
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def _file_system(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    system, there = _file_system(spark, path)
    system.delete(there, True)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made within the block are deleted at its end, so a result has to be
    written or collected before."""
    _open.append([])
    try:
        yield
    finally:
        for path in _open.pop():
            remove(spark, path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text; None where there is none."""
    system, there = _file_system(spark, path)
    if not system.exists(there):
        return None
    stream = system.open(there)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; whole, and only if it is not there: of several writers of one name
    one is told True."""
    system, there = _file_system(spark, path)
    system.mkdirs(there.getParent())
    if system.getUri().getScheme() == "file":
        # Hadoop's local rename replaces what is there; a link does not.
        name = there.toUri().getPath()
        aside = f"{os.path.dirname(name)}/.{os.path.basename(name)}.{uuid.uuid4().hex}"
        with open(aside, "w", encoding="utf-8") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(aside, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(aside)
    jvm = spark._jvm
    aside = jvm.org.apache.hadoop.fs.Path(there.getParent(), f".{there.getName()}.{uuid.uuid4().hex}")
    stream = system.create(aside, True)
    stream.write(bytearray(text.encode("utf-8")))
    stream.close()
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, there, how)
        return True
    except Exception:
        system.delete(aside, False)
        if system.exists(there):
            return False
        raise


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file; it is there whole or not at all, and none is replaced."""
    if not create_text(spark, path, text):
        raise FileExistsError(path)


def names(spark: SparkSession, path: str) -> list[str]:
    """What is in a folder, sorted, but for hidden names; nothing where there is none."""
    system, there = _file_system(spark, path)
    if not system.exists(there):
        return []
    return sorted(n for s in system.listStatus(there) if not (n := s.getPath().getName()).startswith("."))


def materialize(df: DataFrame, label: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to a fresh shared folder and read it back.

    The result has no lineage before the files, so a lost executor costs a re-read and
    not a re-computation, and later plans start from exact sizes. ``discard`` deletes it.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    reader = spark.read if partition_by else spark.read.schema(df.schema)
    kept = reader.parquet(path)
    kept.written_to = path
    return kept


def many(df: DataFrame, label: str) -> DataFrame:
    """``materialize`` for a table with a row per book: joins of it are merged. Its files may be
    small, as columns repeat, while their rows would not fit the driver that broadcasts them."""
    return materialize(df, label).hint("merge")


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing reads any more."""
    remove(df.sparkSession, df.written_to)
