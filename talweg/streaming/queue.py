"""Queued work as a stream: one query owns the queue, and each batch is handled by type.

Tasks arrive as files. ``foreachBatch`` may repeat a batch after a failure, so handlers must give the same result for the same task id,
and results replace those of the same batch.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

TASKS = "id string, task_type string, resource_type string, resource_id string, payload string, created_at timestamp"
Handler = Callable[[DataFrame], DataFrame]


def task_stream(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Tasks from JSON files, oldest files first."""
    return spark.readStream.schema(TASKS).option("maxFilesPerTrigger", files_per_batch).json(path)


def handled(tasks: DataFrame, handlers: Mapping[str, Handler]) -> DataFrame:
    """id, task_type, status, result, error_message of a batch; a repeated id is one task, an unknown type fails."""
    tasks = tasks.dropDuplicates(["id"])
    columns = ["id", "task_type", "status", "result", "error_message"]
    known = list(handlers)
    out = tasks.where(F.col("task_type").isNull() | ~F.col("task_type").isin(*known or [""])).select(
        "id", "task_type", F.lit("failed").alias("status"), F.lit(None).cast("string").alias("result"), F.lit("unknown task type").alias("error_message"))
    for kind, handler in handlers.items():
        mine = tasks.where(F.col("task_type") == kind)
        done = handler(mine).select("id", F.col("result").cast("string").alias("result"))
        joined = mine.select("id", "task_type").join(done, "id", "left")
        status = F.when(F.col("result").isNull(), "failed").otherwise("completed")
        out = out.unionByName(joined.select("id", "task_type", status.alias("status"), "result", F.when(F.col("result").isNull(), "no result").alias("error_message")).select(*columns))
    return out.select(*columns)


def run_queue(tasks: DataFrame, handlers: Mapping[str, Handler], results: str, checkpoint: str, once: bool = False, every: str = "2 seconds") -> StreamingQuery:
    """Starts the query that works the queue off into the table at ``results`` (partitioned by batch)."""
    def work(batch: DataFrame, number: int) -> None:
        done = handled(batch, handlers).withColumn("batch_no", F.lit(number))
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_no").parquet(results)

    writer = tasks.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def changed_entities(changes: DataFrame) -> DataFrame:
    """Index-build tasks for the entities of a change log: one a batch and entity."""
    return changes.select(
        F.concat_ws("-", "entity_type", "entity_id", F.date_format("updated_at", "yyyyMMddHHmmss")).alias("id"), F.concat(F.col("entity_type"), F.lit("_index_build")).alias("task_type"),
        F.col("entity_type").alias("resource_type"), F.col("entity_id").alias("resource_id"), F.lit(None).cast("string").alias("payload"), F.col("updated_at").alias("created_at"))


def usage_windows(log: DataFrame, at: str = "ts", by: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Streaming counts and sums per window and key; rows later than ``late`` are left out."""
    windows = log.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), by)
    return windows.agg(F.count("*").alias("row_count"), F.sum(value).alias(f"sum_{value}")).select(F.col("w.start").alias("bucket"), by, "row_count", f"sum_{value}")
