"""The event log of runs as a stream of JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillscreen.sources.sinks import redacted

EVENT = "timestamp timestamp, level string, stage string, message string, details map<string,string>"


def read_events(spark: SparkSession, path: str, streaming: bool = True) -> DataFrame:
    """Run events with secret-looking details masked; a stream of new files, or a batch of all."""
    reader = (spark.readStream if streaming else spark.read).schema(EVENT)
    return reader.json(path).withColumn("details", redacted(F.col("details")))
