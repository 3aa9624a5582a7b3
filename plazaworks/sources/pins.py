"""Events as a client keeps them: one JSON file that holds an array."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "id string, emoji string, title string, signedCount int, capacity int, latitude double, longitude double, hostName string, startsAt string"


def read_pins(spark: SparkSession, path: str) -> DataFrame:
    """(id, emoji, title, signed_count, capacity, latitude, longitude, host_name, starts_at), a row for each element; missing fields are null."""
    read = spark.read.schema(SCHEMA).json(path, multiLine=True)
    return read.withColumnsRenamed({"signedCount": "signed_count", "hostName": "host_name", "startsAt": "starts_at"})
