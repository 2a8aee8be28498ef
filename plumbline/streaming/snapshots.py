"""Snapshots as a stream: each batch of newly appended dependency rows is audited as it arrives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.plans import audit as audits
from plumbline.sources import files
from plumbline.sources.graph import Graph


def audit_stream(spark: SparkSession, store: str, checkpoint: str, on_audit: Callable[[audits.Audit, int], None], available_now: bool = False) -> StreamingQuery:
    """Audit the snapshots that each micro-batch completes, and hand the results to ``on_audit`` with the batch's number.

    A snapshot is written by one append, so its rows arrive in one batch; its
    modules, appended before, are read from the store. Batches are repeated
    after a failure, so ``on_audit`` should overwrite by batch number.
    """
    schema = files.DEPENDENCIES
    arriving = spark.readStream.schema(schema).parquet(f"{store}/dependencies")

    def each(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        ids = batch.select("snapshot_id").distinct()
        modules = spark.read.schema(files.MODULES).parquet(f"{store}/modules").join(ids, "snapshot_id", "left_semi").select("snapshot_id", "id", "path")
        deps = batch.select("snapshot_id", F.col("from_module_id").alias("from_id"), F.col("to_module_id").alias("to_id"), "line_number")
        on_audit(audits.audit(Graph(modules, deps)), number)

    writer = arriving.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
