"""Batch forms of the incremental jobs; the streaming forms are in ``lexloom.streaming``."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexloom.plans.catalog import query


@query("SELECT time_bucket(INTERVAL '10 minutes', ts) AS started, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def s01_windowed_counts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("window.start").alias("started"), "event_type", "n", "total")
