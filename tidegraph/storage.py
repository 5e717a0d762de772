"""Shared working folders and written tables.

Loops cut their lineage here: state goes to Parquet below the folder named by ``spark.checkpoint.dir``, which the
driver and all executors share, so losing an executor costs the tasks it ran and nothing that was written.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .session import ship

#: Rows of a few numbers up to which a join may broadcast a table: a few megabytes.
FEW = 100_000


def shared_root(spark: SparkSession) -> str:
    """The cluster's shared folder. Where it is unset, a local one is chosen if all runs in one process; a cluster's
    machines don't see each other's folders, so there it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    return root.rstrip("/")


def _hadoop(spark: SparkSession, uri: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_path(spark: SparkSession, uri: str) -> None:
    """Remove a folder or file of any file system that Spark reads."""
    try:
        fs, path = _hadoop(spark, uri)
        fs.delete(path, True)
    except Exception:  # the session has ended; the folder is left to the cluster's own cleaning
        pass


def drop_others(spark: SparkSession, folder: str, prefix: str, keep: list[str]) -> None:
    """Remove the files of a folder that start with a prefix, but for some."""
    fs, path = _hadoop(spark, f"{folder}/{prefix}*")
    names = {os.path.basename(x) for x in keep}
    for x in fs.globStatus(path) or []:
        if x.getPath().getName() not in names:
            fs.delete(x.getPath(), False)


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one, removed when the driver ends."""
    ship(spark)
    uri = f"{shared_root(spark)}/tidegraph/{name}-{uuid.uuid4().hex}"
    fs, path = _hadoop(spark, uri)
    fs.mkdirs(path)
    atexit.register(drop_path, spark, uri)
    return uri


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df as Parquet and read it again: cuts the lineage at a table that all executors see."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, kept from being broadcast by joins if it has more than FEW rows (rows: a bound of their number, else counted).

    Spark takes the size of files on disk, compressed, and of what a checkpoint was made from, for that in memory, and
    leaves out that an explode makes more rows. The driver builds whatever is broadcast.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > FEW else df


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI, on the driver or on an executor."""
    from pyarrow import fs

    if "://" not in uri or uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def open_new(uri: str):
    """A stream to a new file, with its folder."""
    fs, path = filesystem(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    return fs.open_output_stream(path)


def open_read(uri: str):
    fs, path = filesystem(uri)
    return fs.open_input_stream(path)


def finished_versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers of the subfolders of a folder that hold a completely written table "labels", rising."""
    fs, path = _hadoop(spark, f"{folder}/*/labels/_SUCCESS")
    found = [str(x.getPath().getParent().getParent().getName()) for x in fs.globStatus(path) or []]
    return sorted(int(x) for x in found if x.isdigit())


def checkpoint_folder(df: DataFrame) -> str | None:
    """Where the checkpoint lies that df is read from; None if it isn't."""
    try:
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        return file.get() if file.isDefined() else None
    except Exception:  # not a checkpoint
        return None


def checkpointed(df: DataFrame) -> DataFrame:
    """df cut from its lineage by a reliable checkpoint in the shared folder; keeps its partitioning."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
