"""Cells as JSON lines from a stream, appended batch by batch through the store's own loader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from countgrid.store import MatrixStore


def read_json_lines(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder)


def start_ingest(store: MatrixStore, lines: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Adds each micro-batch once. Cells that the store has already, as after a replay, are left out."""

    def add(batch: DataFrame, number: int) -> None:
        name = F.get_json_object("value", "$.metaData.CellName")
        fresh = batch.withColumn("cell_name", name).filter("cell_name IS NOT NULL").dropDuplicates(["cell_name"])
        fresh = fresh.join(store.table("cells"), "cell_name", "left_anti").select("value")
        if not fresh.isEmpty():
            store.add_cells_from_json(fresh)

    return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def event_counts(events: DataFrame, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Counts per user and kind of event in tumbling windows, with late rows dropped after the watermark."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", window), "user_id", "event_type").agg(F.count(F.lit(1)).alias("count"))
