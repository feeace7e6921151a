"""Tags of traces turned round: for each tag the traces that bear it.

Lists ask for traces that bear every one of some tags. The side table is filed by a hash
bucket of project and tag, so such a question reads the asked tags' buckets, counts the tags found
per trace and keeps traces with all of them. The traces themselves are not scanned.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources import tables

BUCKETS = 256


def _bucket(project: Column, tag: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(project, tag), F.lit(buckets)).cast("int")


def postings(traces: DataFrame) -> DataFrame:
    """One row per trace and tag; a tag named twice counts once, null and no tags not at all."""
    return traces.select(
        "project_id", F.explode(F.array_distinct("tags")).alias("tag"), "id", "started_at"
    ).filter(F.col("tag").isNotNull())


def write(traces: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A tag that many traces bear is split by size, its rows sorted so that files can be skipped."""
    filed = postings(traces).withColumns(
        {"buckets": F.lit(buckets), "bucket": _bucket(F.col("project_id"), F.col("tag"), buckets)}
    )
    placed = filed.hint("rebalance", "bucket").sortWithinPartitions("bucket", "project_id", "tag")
    tables.replace_partitions(placed, path, ["buckets", "bucket"])


def traces_with(spark: SparkSession, path: str, project_ids: Sequence[str], tags: Sequence[str]) -> DataFrame:
    """Project, id and start of the traces of some tenants that bear every tag."""
    wanted = list(dict.fromkeys(tags))
    if not wanted:
        raise ValueError("name at least one tag")
    stored = spark.read.parquet(path)
    noted = stored.select("buckets").first()
    if noted is None:
        return stored.select("project_id", "id", "started_at")
    pairs = spark.createDataFrame([(p, t) for p in dict.fromkeys(project_ids) for t in wanted], "project_id string, tag string")
    # As many rows as tenants and tags were named.
    read = sorted({r[0] for r in pairs.select(_bucket(F.col("project_id"), F.col("tag"), noted[0])).collect()})
    own = stored.filter(
        F.col("bucket").isin(read) & F.col("project_id").isin(list(project_ids)) & F.col("tag").isin(wanted)
    )
    return (
        own.groupBy("project_id", "id")
        .agg(F.count("*").alias("_n"), F.max("started_at").alias("started_at"))
        .filter(F.col("_n") == len(wanted))
        .drop("_n")
    )
