"""Incremental feedback counts, windowed dedup and story state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators.feedback import normal_rating


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet folder or file as a stream, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def feedback_counts(events: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Ratings per day and source; late rows count until the watermark passes their day."""
    rows = events.withColumn("at", F.col("created_at").cast("timestamp")).withWatermark("at", late)
    return rows.groupBy(F.window("at", window).alias("w"), "source", normal_rating(F.col("rating")).alias("rating")).agg(F.count(F.lit(1)).alias("n"))


def first_seen(rows: DataFrame, key: str = "url_hash", at: str = "published_at", days: int = 7) -> DataFrame:
    """Rows whose key was not seen within some days before."""
    timed = rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, f"{days} days")
    return timed.dropDuplicatesWithinWatermark([key])


def run_once(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Process all that is there and return the result, which is written as Parquet beside the checkpoint.

    Each micro-batch has a folder of its own, so a batch that is run again replaces its rows; in
    complete mode the newest one is the result.
    """
    out, spark = f"{checkpoint.rstrip('/')}-{name}-out", stream.sparkSession
    seen = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        seen.append(number)

    q = stream.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    if not seen:
        return spark.createDataFrame([], stream.schema)
    folders = [f"{out}/batch={n}" for n in ([max(seen)] if mode == "complete" else sorted(set(seen)))]
    return spark.read.schema(stream.schema).parquet(*folders)


def deliver(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch to a delivery channel or a state upsert."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finish(query) -> None:
    """Wait for a query that ends by itself; its error is raised."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
