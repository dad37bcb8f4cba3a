"""A running top-k over points that arrive as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfold.operators import evaluate
from nearfold.sources.points import valid


class RunningNeighbors:
    """add() merges the best of a batch into the list kept at ``path``; value() reads it; reset() empties it.

    A list has at most k rows. Each batch writes its own folder from the latest one before it, so a batch that runs again, also after
    a restart, replaces its own result.
    """

    def __init__(self, spark: SparkSession, query: DataFrame, k: int, path: str):
        self.spark, self.query, self.k, self.path = spark, query, k, path
        self._write(spark.createDataFrame([], "id long, dist double"), -1, "ignore")

    def _write(self, rows: DataFrame, batch_id: int, mode: str) -> None:
        rows.write.mode(mode).parquet(f"{self.path}/batch={batch_id}")

    def add(self, points: DataFrame, batch_id: int) -> None:
        best = evaluate.top_k(evaluate.sum_distances(valid(points), self.query), self.k)
        self._write(evaluate.merge(self.value(before=batch_id), best, self.k), batch_id, "overwrite")

    def value(self, before: int | None = None) -> DataFrame:
        """The list after the latest batch, or after the latest one before a given batch."""
        lists = self.spark.read.schema("id long, dist double, batch int").parquet(self.path)
        folders = {int(name.rpartition("batch=")[2].split("/")[0]) for name in lists.inputFiles()}
        latest = max((b for b in folders if before is None or b < before), default=-1)
        return lists.where(F.col("batch") == latest).select("id", "dist")

    def reset(self) -> None:
        """Begin again with an empty list; batches go on counting from the next number."""
        lists = self.spark.read.schema("id long, dist double, batch int").parquet(self.path)
        latest = max(int(name.rpartition("batch=")[2].split("/")[0]) for name in lists.inputFiles())
        self._write(self.spark.createDataFrame([], "id long, dist double"), latest, "overwrite")

    def start(self, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
        """Run over a stream of (id, x, y)."""
        writer = stream.writeStream.foreachBatch(lambda frame, number: self.add(frame, number)).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if available_now else writer).start()
