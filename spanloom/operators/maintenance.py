"""Audits of days, windows and references."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import model
from spanloom.functions import display


def day_series(
    df: DataFrame,
    today: date,
    behind: int = model.PARTITION_DAYS_BEHIND,
    ahead: int = model.PARTITION_DAYS_AHEAD,
) -> DataFrame:
    """The days a table is laid out for, around ``today``."""
    base = F.lit(today.isoformat()).cast("date")
    days = F.sequence(F.date_sub(base, behind), F.date_add(base, ahead))
    return df.sparkSession.range(1).select(F.explode(days).alias("day"))


def partition_plan(
    placed_days: DataFrame,
    unplaced: DataFrame,
    today: date,
    behind: int = model.PARTITION_DAYS_BEHIND,
    ahead: int = model.PARTITION_DAYS_AHEAD,
) -> DataFrame:
    """Which days exist, can be created, or are blocked by rows stored outside them."""
    have = placed_days.select(F.col("day").cast("date").alias("day")).distinct().withColumn("_have", F.lit(True))
    stranded = unplaced.groupBy(F.to_date("started_at").alias("day")).agg(F.count("*").alias("stranded"))
    status = (
        F.when(F.col("_have"), "exists")
        .when(F.col("stranded") > 0, "skipped")
        .otherwise("create")
    )
    return (
        day_series(placed_days, today, behind, ahead)
        .join(have, "day", "left")
        .join(stranded, "day", "left")
        .select(
            "day", display.partition_name(F.col("day")).alias("partition"),
            F.coalesce("stranded", F.lit(0)).alias("stranded"), status.alias("status"),
        )
    )


def created_count(plan: DataFrame) -> DataFrame:
    return plan.agg(F.count_if(F.col("status") == "create").alias("created"))


def stranded_rows(
    observations: DataFrame,
    today: date,
    behind: int = model.PARTITION_DAYS_BEHIND,
    ahead: int = model.PARTITION_DAYS_AHEAD,
) -> DataFrame:
    """Per day, rows outside the laid-out range and rows filed under another day."""
    base = F.lit(today.isoformat()).cast("date")
    day = F.to_date("started_at")
    outside = ~day.between(F.date_sub(base, behind), F.date_add(base, ahead))
    filed = F.col("started_date") if "started_date" in observations.columns else day
    return (
        observations.groupBy(day.alias("day"))
        .agg(
            F.count_if(outside).alias("outside"),
            F.count_if(~filed.eqNullSafe(day)).alias("misfiled"),
        )
        .filter((F.col("outside") > 0) | (F.col("misfiled") > 0))
    )


def check_windows(
    age: int = model.MAX_EVENT_AGE_DAYS,
    future: int = model.MAX_EVENT_FUTURE_DAYS,
    behind: int = model.PARTITION_DAYS_BEHIND,
    ahead: int = model.PARTITION_DAYS_AHEAD,
) -> None:
    """What is accepted must be laid out, with a day to spare behind.

    An event accepted just before midnight is a day older when stored.
    """
    if age + 1 > behind or future + 1 > ahead:
        raise ValueError(
            f"accepted -{age}..+{future} days does not fit into stored -{behind}..+{ahead} days"
        )


def dangling_references(traces: DataFrame, observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Counts of references whose target has not arrived; all are normal states.

    References are counted per target before they are looked up, so a target
    named a billion times is one row of the join.
    """
    def missing(name: str, refs: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
        counted = refs.groupBy(*keys).agg(F.count("*").alias("n"))
        absent = counted.join(targets.select(*keys).distinct(), keys, "left_anti")
        return absent.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("missing")).select(
            F.lit(name).alias("reference"), "missing"
        )

    span_keys = ["project_id", "trace_id", "ref"]
    spans = observations.withColumn("ref", F.col("id"))
    parents = observations.filter(F.col("parent_observation_id").isNotNull()).withColumn(
        "ref", F.col("parent_observation_id")
    )
    keys = ["project_id", "ref"]
    known_traces = traces.withColumn("ref", F.col("id"))
    reports = [
        missing("observation.parent", parents, spans, span_keys),
        missing("observation.trace", observations.withColumn("ref", F.col("trace_id")), known_traces, keys),
        missing(
            "score.trace",
            scores.filter(F.col("trace_id").isNotNull()).withColumn("ref", F.col("trace_id")),
            known_traces, keys,
        ),
        missing(
            "score.observation",
            scores.filter(F.col("observation_id").isNotNull()).withColumn("ref", F.col("observation_id")),
            spans, keys,
        ),
    ]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out
