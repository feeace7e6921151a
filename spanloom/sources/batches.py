"""Raw JSON batches: one row per delivery, the body kept as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom import model


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Delivered batches stored as JSON lines of the raw-batch columns."""
    return spark.read.schema(model.RAW_BATCHES).json(path)


def stream_batches(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same files as an unbounded source."""
    return (
        spark.readStream.schema(model.RAW_BATCHES)
        .option("maxFilesPerTrigger", files_per_trigger)
        .json(path)
    )
