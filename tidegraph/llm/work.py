"""Working folders of the operators here: the library's, with short batches, as rows are whole texts."""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..storage import drop_path, open_new, open_read, spread, written
from ..storage import work_folder as _work_folder

__all__ = ["bounded_sample", "drop_path", "open_new", "open_read", "placed", "prepare", "small", "spread", "tidy", "work_folder", "written"]

#: Spark's defaults and what they become here: rows, and bytes, that an Arrow batch to a Python worker may hold, and rows
#: that a reader of Parquet keeps decoded, all columns of each.
BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16777216b"),
    "spark.sql.parquet.columnarReaderBatchSize": ("4096", "512"),
}
#: Rows up to which small() broadcasts a table; callers have a few numbers in each.
SMALL = 250_000


def prepare(spark: SparkSession) -> None:
    """Short Arrow batches bound a worker's memory, by rows and by bytes, short read batches an executor's heap; the package
    goes to the workers.

    A session that sets its own bounds keeps them.
    """
    ship(spark)
    for key, (default, ours) in BATCHES.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)


#: What a worker keeps between tasks: the name of each (bounded) cache, and how to empty it.
CACHES: dict[str, Callable[[], None]] = {}


def tidy(f, cache: str | None = None):
    """f for mapInPandas, as a good neighbour: workers are reused by later stages, and several share an executor's memory.

    Before a task, caches of other operators are emptied (cache: the one that f uses); when it is done, memory that the
    worker has freed goes back to the system.
    """

    @functools.wraps(f)
    def run(batches):
        from tidegraph.llm.work import CACHES as kept  # the worker's own, not a copy from the driver

        for name, empty in kept.items():
            if name != cache:
                empty()
        yield from f(batches)
        import ctypes
        import gc

        import pyarrow

        gc.collect()
        pyarrow.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # a C library without it
            ctypes.CDLL(None).malloc_trim(0)

    return run


def small(df: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, marked for broadcast if it has up to SMALL rows."""
    return F.broadcast(df) if df.count() <= SMALL else df


def work_folder(spark: SparkSession, name: str) -> str:
    prepare(spark)
    return _work_folder(spark, name)


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """About as many rows of df (all, if it has no more): those whose hash of some columns is low; the same every time."""
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(*by, F.lit("sample")), F.lit(1 << 40)) < int(rows / n * (1 << 40)))


def placed(docs: DataFrame, folder: str) -> tuple[DataFrame, list[str]]:
    """docs and two columns that tell its rows apart: file and row of a table on disk, else of a written copy.

    A row's place in its file names it only where every row of the file is read once: through columns and filters.
    """
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    if plan.nodeName().startswith("LogicalRelation") and not docs._jdf.queryExecution().analyzed().metadataOutput().isEmpty() and "_metadata" not in docs.columns:
        return docs.select("*", F.xxhash64("_metadata.file_path").alias("__tg_file"), F.col("_metadata.row_index").alias("__tg_row")), ["__tg_file", "__tg_row"]
    numbered = docs.select("*", F.lit(0).cast("long").alias("__tg_file"), F.monotonically_increasing_id().alias("__tg_row"))
    return written(numbered, f"{folder}/numbered"), ["__tg_file", "__tg_row"]
