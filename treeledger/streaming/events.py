"""The event log as a stream: an extension, the batch reports remain the measure."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from treeledger.session import shared_folder
from treeledger.sources.store import TableStore


def _cleaned(events: DataFrame) -> DataFrame:
    kind = F.lower(F.regexp_replace("event_type", r"^\s+|\s+$", ""))
    return events.select("id", kind.alias("event_type"), F.timestamp_millis("timestamp").alias("at"), "tokens_estimated")


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """(hour, event_type, n_events, tokens) of a stream; rows later than ``late`` are left out.

    Repeated ids within that time are one event.
    """
    fresh = _cleaned(events).withWatermark("at", late).dropDuplicatesWithinWatermark(["id"])
    grouped = fresh.groupBy(F.window("at", "1 hour"), "event_type")
    return grouped.agg(F.count("*").alias("n_events"), F.coalesce(F.sum("tokens_estimated"), F.lit(0)).alias("tokens")).select(F.col("window.start").alias("hour"), "event_type", "n_events", "tokens")


def maintain_counts(events: DataFrame, store: TableStore, table: str, checkpoint: str) -> StreamingQuery:
    """Keep (event_type, n_events) of all rows of a stream in a stored table, batch by batch.

    Each batch is counted on its own and merged with the table; a repeated batch number is
    recognised by the number kept in the table, so a restart counts nothing twice.
    """

    def merge(batch: DataFrame, number: int) -> None:
        counts = _cleaned(batch).groupBy("event_type").agg(F.count("*").alias("n_events"))
        if store.exists(table):
            before = store.read(table)
            if (before.agg(F.max("batch")).first()[0] or 0) >= number + 1:
                return
            counts = counts.unionByName(before.select("event_type", "n_events")).groupBy("event_type").agg(F.sum("n_events").alias("n_events"))
        store.commit(table, counts.withColumn("batch", F.lit(number + 1)))

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the telemetry log by type, counted by a stream over its files.

    State and table lie in the shared folder under a name made from application and path, so
    a query that is run again goes on from its checkpoint.
    """
    path = os.path.join(folder, "telemetry.parquet")
    base = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{hashlib.sha256(path.encode()).hexdigest()[:16]}"
    store = TableStore(spark, f"{base}/tables")
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if not os.path.isfile(path) else f"{folder}/telemetry.parque[t]")
    query = maintain_counts(events, store, "type_counts", f"{base}/offsets")
    query.awaitTermination()
    return store.read("type_counts").select("event_type", "n_events")
