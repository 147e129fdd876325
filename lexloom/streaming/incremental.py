"""Incremental jobs: new files are read as they land, and state is kept in the checkpoint folder of the query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexloom.operators.spans import GENERIC_RULES, extract


def new_files(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, at most so many a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def windowed_counts(events: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and sums by event type and window; rows later than ``late`` behind the newest are left out."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("started"), "event_type", "n", "total")


def spans_of_new_documents(docs: DataFrame, out: str, checkpoint: str, rules=GENERIC_RULES) -> StreamingQuery:
    """Extract spans of every new document once; a batch that is run again replaces its own output only."""

    def write(batch: DataFrame, number: int) -> None:
        extract(batch, rules).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of a resumable batch whose key isn't among those done."""
    return work.join(done.select(key), key, "left_anti")
