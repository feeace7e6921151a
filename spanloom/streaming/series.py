"""The score series as a stream.

Scores are summed by day (or another unit) as they come. A bucket's sums are handed on
whenever they change, and dropped from the state once the watermark has passed the bucket;
scores that come later than that are left out of the series, as the state is gone. What is
handed on is stored by epoch, and the newest of a bucket counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from spanloom.sources import tables

KEY = ["project_id", "name", "bucket"]


def start_score_series(
    scores: DataFrame, path: str, checkpoint: str, unit: str = "1 day", lateness: str = "7 days", available_now: bool = False,
) -> StreamingQuery:
    """Count and sum of numeric scores per project, name and bucket, kept for ``lateness`` behind the newest score."""
    sums = (
        scores.filter(F.col("value").isNotNull() & F.col("scored_at").isNotNull())
        .withWatermark("scored_at", lateness)
        .groupBy("project_id", "name", F.window("scored_at", unit).alias("_in"))
        .agg(F.count("*").alias("scores"), F.sum("value").alias("total"))
        .select("project_id", "name", F.col("_in.start").alias("bucket"), "scores", "total")
    )
    writer = sums.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(
        lambda df, epoch: tables.append_rows(df, path, epoch)
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_score_series(spark: SparkSession, path: str) -> DataFrame:
    """Scores and mean of each bucket as last handed on."""
    newest = F.max_by(F.struct("scores", "total"), "epoch")
    return spark.read.parquet(path).groupBy(*KEY).agg(newest.alias("n")).select(
        *KEY, "n.scores", (F.col("n.total").cast("double") / F.col("n.scores")).alias("mean_value")
    )
