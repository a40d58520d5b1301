"""Continuous ingest: a stream of commands into intents and edges, late outcomes, and windowed metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentdeck.operators import knn, metrics
from intentdeck.operators.store import extract


def command_stream(spark, path: str, schema, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest_stream(commands: DataFrame, path: str, checkpoint: str):
    """Append extracted intents; the checkpoint is the write-ahead log, so a restart neither loses nor repeats a batch."""
    return extract(commands).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def edge_stream(vectors: DataFrame, path: str, checkpoint: str, k: int = 5):
    """Per batch of (id, v): edges from each row's k most similar earlier rows, of history or of the same batch.

    A batch writes to its own folders, so that a batch that runs again replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/vectors/batch={number}")
        now = spark.read.parquet(f"{path}/vectors/batch={number}")
        history = spark.read.option("basePath", f"{path}/vectors").parquet(f"{path}/vectors").where(F.col("batch") < number)
        knn.form_edges_incremental(history, now, k).write.mode("overwrite").parquet(f"{path}/edges/batch={number}")

    return vectors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def gauge_stream(intents: DataFrame, path: str, checkpoint: str, value: str, capacity: int, every: str | None = None):
    """Per batch of intents: the gauges over all rows so far, written to a folder of the batch. With ``every`` (as "5 seconds") it goes on, else it runs to the end.

    A batch keeps its count and sum only, so a refresh reads one row for each batch before it.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total")).coalesce(1).write.mode("overwrite").parquet(f"{path}/sums/batch={number}")
        sums = spark.read.option("basePath", f"{path}/sums").parquet(f"{path}/sums").where(F.col("batch") <= number)
        metrics.gauges_of(sums, capacity).coalesce(1).write.mode("overwrite").parquet(f"{path}/gauges/batch={number}")

    w = intents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, width: str, late: str, by: str = "event_type") -> DataFrame:
    """Counts per event-time window; rows later than ``late`` are dropped."""
    ts = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return ts.groupBy(F.window("ts", width), by).agg(F.count("*").alias("events"))


def late_outcomes(intents: DataFrame, outcomes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Stream-stream left join of intents (id, ts) with outcomes (id, outcome_ts, status) that arrive within ``late``."""
    i = intents.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    o = outcomes.withColumn("outcome_ts", F.col("outcome_ts").cast("timestamp")).withWatermark("outcome_ts", late).withColumnRenamed("id", "of")
    return i.join(o, F.expr(f"id = of AND outcome_ts >= ts AND outcome_ts <= ts + interval {late}"), "left").drop("of")


def run_to_end(query) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()
