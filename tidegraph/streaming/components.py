"""Connected components of an edge stream: every micro-batch merges into the labels kept so far."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.stars import star_components
from ..storage import drop_path, finished_versions, work_folder, written

LABELS = "id long, color long"


class StreamingComponents:
    """Labels (id, color) of all edges seen, advanced by foreachBatch.

    A batch costs its own edges and the labels, not the edges before it: a label is an edge to its color. The labels
    after a batch are a table named by the batch's number, and count once they are completely written. A batch that is
    delivered again therefore changes nothing, and an object on a folder that has tables goes on from the last one: give
    the same folder, next to the same checkpoint, after a restart. The table before the last is kept until the next
    batch, so a reader of the latest is never cut off.
    """

    def __init__(self, spark, folder: str | None = None):
        self.folder = folder or work_folder(spark, "stream")
        done = finished_versions(spark, self.folder)
        self.version = done[-1] if done else -1
        self.labels: DataFrame = spark.read.schema(LABELS).parquet(f"{self.folder}/{self.version}/labels") if done else spark.createDataFrame([], LABELS)

    def merge(self, batch: DataFrame, batch_id: int | None = None) -> None:
        """Take in the edges (src, dst) of a batch; those of a number that isn't over the last one's are known."""
        number = self.version + 1 if batch_id is None else batch_id
        if number <= self.version:
            return
        known = self.labels.select(F.col("id").alias("a"), F.col("color").alias("b"))
        at = f"{self.folder}/{number}"
        stars = star_components(known.unionByName(batch.select(F.col("src").alias("a"), F.col("dst").alias("b"))), f"{at}/rounds")
        self.labels = written(stars.select("id", F.col("component").alias("color")), f"{at}/labels")
        spark = self.labels.sparkSession
        drop_path(spark, f"{at}/rounds")
        for old in finished_versions(spark, self.folder)[:-2]:
            drop_path(spark, f"{self.folder}/{old}")
        self.version = number

    def start(self, edges: DataFrame, checkpoint: str, **trigger):
        """Start on a stream of edges (src, dst); returns the running query."""
        return edges.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
