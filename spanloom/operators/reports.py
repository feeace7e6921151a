"""Reports over stored tables.

``placement`` is a documented check. The others are the questions the stored
columns are there for: scores by prompt version, score series, spend by
attribute, delivery lag, SDK versions and sessions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import model, session
from spanloom.functions import display
from spanloom.operators import listing
from spanloom.operators.ranking import number_rows


def placement(projects: DataFrame, traces: DataFrame, observations: DataFrame) -> DataFrame:
    """Where each observation is filed, with project and trace names; order by start to read."""
    t = traces.select("project_id", F.col("id").alias("trace_id"), F.col("name").alias("trace_name"), F.col("started_at").alias("trace_started_at"))
    o = observations.select(
        "project_id", "trace_id", F.col("id").alias("observation_id"), "started_at",
        display.partition_name(F.to_date("started_at")).alias("partition"),
    )
    p = projects.select("project_id", F.col("name").alias("project_name"))
    key = ["project_id", "trace_id"]
    # Observations lead an inner join, because only there can a crowded trace be split.
    filled = o.join(t, key)
    empty = t.join(o.select(*key).distinct(), key, "left_anti")
    named = filled.unionByName(empty, allowMissingColumns=True)
    return session.lookup_join(named, p, ["project_id"], [F.col("trace_id")], how="inner")


def scores_by_prompt_version(observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Mean score per prompt version; booleans count as one or zero."""
    span = ["project_id", "observation_id"]
    measured = scores.filter(F.col("value").isNotNull() & F.col("observation_id").isNotNull())
    named = observations.filter(F.col("prompt_name").isNotNull()).select(
        "project_id", F.col("id").alias("observation_id"), "prompt_name", "prompt_version"
    )
    prompts = session.narrowed(named, measured, span).distinct()
    return (
        measured.join(prompts, span)
        .groupBy("project_id", "prompt_name", "prompt_version", F.col("name").alias("score_name"))
        .agg(F.count("*").alias("scores"), F.avg(F.col("value").cast("double")).alias("mean_value"))
    )


def score_series(scores: DataFrame, unit: str = "day") -> DataFrame:
    return (
        scores.filter(F.col("value").isNotNull())
        .groupBy("project_id", "name", F.date_trunc(unit, "scored_at").alias("bucket"))
        .agg(F.count("*").alias("scores"), F.avg(F.col("value").cast("double")).alias("mean_value"))
    )


def spend_by(traces_with_rollup: DataFrame, attributes: list[str]) -> DataFrame:
    """Traces, tokens and cost per value of each attribute, in one pass; ``tags`` counts once per tag."""
    def values(a: str) -> Column:
        found = F.when(F.size("tags") > 0, F.col("tags")).otherwise(F.array(F.lit(None).cast("string"))) if a == "tags" else F.array(F.col(a))
        return F.transform(found, lambda v: F.struct(F.lit(a).alias("attribute"), v.alias("value")))

    tagged = traces_with_rollup.select(
        "project_id", F.explode(F.flatten(F.array(*map(values, attributes)))).alias("_of"), "total_tokens", "total_cost_usd"
    ).select("project_id", "_of.*", "total_tokens", "total_cost_usd")
    return tagged.groupBy("attribute", "project_id", "value").agg(
        F.count("*").alias("traces"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost_usd").cast("decimal(38,8)").alias("total_cost_usd"),
    )


def release_comparison(traces_with_rollup: DataFrame, releases: list[str]) -> DataFrame:
    """Traces and cost of chosen releases side by side, per trace name."""
    aggs: list[Column] = []
    for r in releases:
        hit = F.col("release") == r
        aggs.append(F.count_if(hit).alias(f"{r}_traces"))
        aggs.append(
            F.coalesce(F.sum(F.when(hit, F.col("total_cost_usd"))), F.lit(0)).cast("decimal(38,8)").alias(f"{r}_cost_usd")
        )
    return traces_with_rollup.groupBy("project_id", "name").agg(*aggs)


def delivery_lag(rows: DataFrame) -> DataFrame:
    """Seconds from event to receipt, by day of receipt."""
    lag = (F.unix_micros("created_at") - F.unix_micros("started_at")) / F.lit(1000000.0)
    return rows.groupBy(F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("rows"),
        F.min(lag).alias("min_seconds"),
        F.max(lag).alias("max_seconds"),
        F.percentile_approx(lag, 0.5, 10000).alias("median_seconds"),
    )


def sdk_versions(traces: DataFrame) -> DataFrame:
    return traces.groupBy("project_id", "sdk_version").agg(
        F.count("*").alias("traces"), F.max("started_at").alias("last_seen")
    )


def sessions(traces_with_rollup: DataFrame) -> DataFrame:
    """One row per conversation: its span of time, traces and spend."""
    return (
        traces_with_rollup.filter(F.col("session_id").isNotNull())
        .groupBy("project_id", "session_id")
        .agg(
            F.count("*").alias("traces"),
            F.min("started_at").alias("first_started_at"),
            F.max("started_at").alias("last_started_at"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("total_cost_usd").cast("decimal(38,8)").alias("total_cost_usd"),
        )
    )


def session_traces(traces_with_rollup: DataFrame) -> DataFrame:
    """The traces of each conversation with their position, oldest first.

    A session may hold most of the rows, so positions come from range partitions, not from a window over it.
    """
    inside = traces_with_rollup.filter(F.col("session_id").isNotNull())
    order = [F.col("started_at").asc(), F.col("id").asc()]
    return number_rows(inside, ["project_id", "session_id"], order, "position")


def trace_display(traces_with_rollup: DataFrame, as_of: Column) -> DataFrame:
    """The texts a list row shows."""
    return traces_with_rollup.select(
        "project_id", "id",
        display.short_id(F.col("id")).alias("short_id"),
        display.tokens(F.col("total_tokens")).alias("tokens_text"),
        display.cost(F.col("total_cost_usd")).alias("cost_text"),
        display.duration(F.col("total_latency_ms")).alias("model_time_text"),
        display.duration(F.col("duration_ms")).alias("duration_text"),
        display.relative_age(F.col("started_at"), as_of).alias("age_text"),
    )


def score_display(scores: DataFrame) -> DataFrame:
    args = F.col("data_type"), F.col("value")
    return scores.select(
        "project_id", "id", "name",
        display.score(*args, F.col("value_text")).alias("score_text"),
        display.score_is_negative(*args).alias("negative"),
    )
