"""Traces stored in page order, for lists that open few files.

Files are ranges of (project, start newest first, id), so a tenant's newest traces lie in
one or two of them however large the table. A side table holds, for each file and project,
the first and last start and the rows. A page asks it for the newest files, opens those, and
goes on to older ones only while they may still hold rows of the page.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import cursors
from spanloom.operators import listing

ROWS_PER_FILE = 1_000_000
# A task writes at least so many rows, file after file, once there is a range for every core.
ROWS_PER_TASK = 250_000


def _data(path: str) -> str:
    return f"{path.rstrip('/')}/traces"


def _files(path: str) -> str:
    return f"{path.rstrip('/')}/files"


def write(traces: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store traces in page order; ``traces`` is read more than once, so it should be stored.

    The start is part of the range key, so a tenant that holds most rows fills many files.
    """
    spark = traces.sparkSession
    rows = traces.count()
    files = -(-rows // rows_per_file) or 1
    # Small files don't make as many tasks: one writes the files of its range in their order.
    tasks = min(files, max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK)))
    order = [F.col("project_id").asc_nulls_first(), *listing.newest_first()]
    placed = traces.repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    placed.write.option("maxRecordsPerFile", rows_per_file).parquet(_data(path))
    held = spark.read.schema(traces.schema).parquet(_data(path)).groupBy("project_id", F.col("_metadata.file_name").alias("file")).agg(
        F.min("started_at").alias("first_start"), F.max("started_at").alias("last_start"), F.count("*").alias("rows")
    )
    held.hint("rebalance", "project_id").sortWithinPartitions("project_id").write.parquet(_files(path))


def _may_follow(last_start: datetime | None, oldest: datetime | None) -> bool:
    """Whether a file may hold rows that come before the oldest row found; no start comes last."""
    return oldest is None or last_start is not None and last_start >= oldest


def newest(
    spark: SparkSession, path: str, project_id: str, rows: int,
    filters: Mapping[str, Any] | None = None, cursor: str | None = None,
) -> DataFrame:
    """A tenant's traces from the files that hold the newest ``rows`` kept by filters and cursor.

    The files opened double until the rows are complete: where a filter keeps few rows all
    files of the tenant within the filter's range of time are read, as they must be.
    """
    filters = filters or {}
    files = spark.read.parquet(_files(path)).filter(F.col("project_id") == project_id)
    if "from" in filters:
        files = files.filter(F.col("last_start") >= F.lit(str(filters["from"])).cast("timestamp"))
    if "to" in filters:
        files = files.filter(F.col("first_start") < F.lit(str(filters["to"])).cast("timestamp"))
    position = None
    if cursor:
        at, trace_id = cursors.decode(cursor)
        position = F.lit(at.isoformat()).cast("timestamp"), F.lit(trace_id)
        files = files.filter(F.col("first_start") <= position[0])
    ranked = files.orderBy(F.col("last_start").desc_nulls_last(), "file")
    schema = spark.read.parquet(_data(path)).schema
    opened = 1
    while True:
        listed = ranked.limit(opened + 1).collect()
        taken, behind = listed[:opened], listed[opened:]
        found = spark.read.schema(schema).parquet(*[f"{_data(path)}/{f.file}" for f in taken]) if taken else spark.createDataFrame([], schema)
        found = found.filter(F.col("project_id") == project_id)
        if not behind:
            return found
        kept = listing.filter_traces(found, filters)
        if position:
            kept = listing.after(kept, *position)
        starts = kept.select("started_at", "id").orderBy(*listing.newest_first()).limit(rows).collect()
        if len(starts) == rows and not _may_follow(behind[0].last_start, starts[-1].started_at):
            return found
        opened *= 2


def list_page(
    spark: SparkSession, path: str, observations: DataFrame, project_id: str | None,
    filters: Mapping[str, Any] | None = None, limit: int | None = None, cursor: str | None = None,
) -> listing.Page:
    """:func:`listing.list_page` over the stored files; the same rows from a few of them."""
    n = listing.page_size(limit)
    if project_id is None:
        nothing = spark.read.parquet(_data(path)).limit(0)
        return listing.list_page(nothing, observations, None, filters, limit, cursor)
    found = newest(spark, path, project_id, n + 1, filters, cursor)
    return listing.list_page(found, observations, project_id, filters, limit, cursor)
