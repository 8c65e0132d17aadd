"""Streams over append-only record files (an addition of this engine)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def appended(spark: SparkSession, paths: list[str], **options: str) -> DataFrame:
    """Records as they are appended; a record still being written waits for the next batch."""
    return spark.readStream.format("cborkv").options(**options).load(paths[0]) if len(paths) == 1 else spark.readStream.format("cborkv").option("paths", _json(paths)).options(**options).load()


def _json(paths: list[str]) -> str:
    import json

    return json.dumps(paths)


def key_counts(stream: DataFrame) -> DataFrame:
    """Running count of rows per key."""
    return stream.groupBy("key").agg(F.count("*").alias("n"))
