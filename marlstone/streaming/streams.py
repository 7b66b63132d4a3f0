"""Streams into a collection, and continuous search of a stream against one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.knn import knn_join
from marlstone.sources.store import Store


def upsert_stream(stream: DataFrame, store: Store, checkpoint: str, order: str, id: str = "id", **trigger) -> StreamingQuery:
    """Each batch of a stream is one change; of several rows with an id the last by `order` counts. A batch that is run
    again after a loss is known by its number and logged once."""
    from pyspark.sql import Window

    def write(batch: DataFrame, n: int) -> None:
        last = F.row_number().over(Window.partitionBy(id).orderBy(F.desc(order)))
        rows = batch.withColumn("__n", last).where("__n = 1").drop("__n")
        if not rows.isEmpty():
            store.upsert(rows, (checkpoint, n))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def search_stream(queries: DataFrame, table: DataFrame, k: int, out: str, checkpoint: str, metric: str = "cosine", **trigger) -> StreamingQuery:
    """The nearest rows of a table for each query (query_id, vector) of a stream, as Parquet below out: a folder for each
    batch, which a batch that is run again replaces."""

    def write(batch: DataFrame, n: int) -> None:
        knn_join(batch, table, k, metric).write.mode("overwrite").parquet(f"{out}/batch={n}")

    return queries.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def counts_by_window(stream: DataFrame, time: str, width: str, late: str, *by: str) -> DataFrame:
    """Counts per window of time and key, with rows accepted up to `late` behind the newest."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
