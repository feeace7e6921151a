"""Trace detail: observations, scores of either target, totals."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import session
from spanloom.functions import display, measures
from spanloom.operators import listing, tenancy


SPAN = ["project_id", "observation_id"]


def _scored(observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Observations that have a score; told in the scan when scored ids are few."""
    ids = scores.filter(F.col("observation_id").isNotNull()).select(*SPAN).distinct()
    if session.within(ids, session.BROADCAST_ROW_BOUND):
        ids = F.broadcast(ids)
    return observations.withColumnRenamed("id", "observation_id").join(ids, SPAN, "left_semi")


def observation_owners(observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Which traces hold a scored observation id; re-sent starts collapse."""
    return _scored(observations.select("project_id", "id", "trace_id"), scores).select(
        *SPAN, F.col("trace_id").alias("owner")
    ).distinct()


def scores_of_traces(traces: DataFrame, observations: DataFrame, scores: DataFrame) -> DataFrame:
    """Each score with every trace it names or whose observation it names, once.

    Two equality joins instead of a disjunction. The second one leaves out the
    trace the score names itself, so nothing repeats and nothing needs a
    distinct over whole scores.
    """
    known = traces.select("project_id", F.col("id").alias("shown_in"))
    direct = scores.filter(F.col("trace_id").isNotNull()).withColumn("shown_in", F.col("trace_id"))
    through = (
        scores.filter(F.col("observation_id").isNotNull())
        .join(observation_owners(observations, scores), SPAN)
        .filter(~F.col("owner").eqNullSafe(F.col("trace_id")))
        .withColumnRenamed("owner", "shown_in")
    )
    return direct.unionByName(through).join(known, ["project_id", "shown_in"], "left_semi")


def detail_totals(observations: DataFrame) -> DataFrame:
    """Rollup per trace with cached and reasoning tokens and the cached share."""
    zero = F.lit(0).cast("bigint")
    keys = ["project_id", "trace_id"]
    extra = observations.groupBy(*keys).agg(
        F.count("*").alias("observation_count"),
        F.sum(F.coalesce("prompt_tokens", zero)).alias("prompt_tokens"),
        F.sum(F.coalesce("completion_tokens", zero)).alias("completion_tokens"),
        F.sum(F.coalesce("cached_tokens", zero)).alias("cached_tokens"),
        F.sum(F.coalesce("reasoning_tokens", zero)).alias("reasoning_tokens"),
    )
    return extra.withColumn(
        "cached_percent", measures.percent(F.col("cached_tokens"), F.col("prompt_tokens"))
    )


def score_targets(scores: DataFrame, observations: DataFrame) -> DataFrame:
    """What each score is shown against: observation name, its short id, or the trace."""
    names = _scored(observations, scores).groupBy(*SPAN).agg(
        F.min_by("name", F.struct("started_at", "trace_id")).alias("_name")
    )
    target = F.when(F.col("observation_id").isNull(), "trace").otherwise(
        F.coalesce("_name", display.short_id(F.col("observation_id")))
    )
    return scores.join(names, SPAN, "left").withColumn(
        "target", target
    ).drop("_name")


def spans_with_scores(observations: DataFrame, scores: DataFrame) -> DataFrame:
    """One row per span and score, and one per span without any.

    Kept flat: a span may hold any number of scores.
    """
    badges = scores.filter(F.col("observation_id").isNotNull()).select(
        "project_id", "observation_id", F.col("id").alias("score_id"),
        F.col("name").alias("score_name"), "source", "scored_at",
        display.score(F.col("data_type"), F.col("value"), F.col("value_text")).alias("score_text"),
        display.score_is_negative(F.col("data_type"), F.col("value")).alias("score_negative"),
    )
    spans = observations.select(
        "project_id", "trace_id", F.col("id").alias("observation_id"), "started_at", "name", "level"
    )
    ids = badges.select(*SPAN).distinct()
    few = session.within(ids, session.BROADCAST_ROW_BOUND)
    # Scores lead an inner join, because only there can a crowded span be split.
    scored = badges.join(session.narrowed(spans, ids, SPAN), SPAN)
    bare = spans.join(F.broadcast(ids) if few else ids, SPAN, "left_anti")
    return scored.unionByName(bare, allowMissingColumns=True)


class Detail(NamedTuple):
    trace: DataFrame
    observations: DataFrame
    scores: DataFrame


def trace_detail(
    traces: DataFrame, observations: DataFrame, scores: DataFrame, project_id: str | None, trace_id: str
) -> Detail | None:
    """One trace of a tenant with its observations and scores in order; None when not found.

    Scores are looked up by the trace and its own span ids, not the other way round.
    """
    spark = traces.sparkSession
    traces, observations, scores = (tenancy.tenant_view(df, project_id) for df in (traces, observations, scores))
    found = traces.filter(F.col("id") == trace_id).select(*listing.LIST_COLUMNS).withColumn(
        "metadata", F.to_json("metadata")
    )
    rows = found.limit(1).collect()
    if not rows:
        return None
    row = rows[0]
    own = observations.filter(F.col("trace_id") == trace_id)
    if row.observations_started_min and row.observations_started_max:
        own = listing.bounded_scan(own, row.observations_started_min, row.observations_started_max)
    else:
        own = own.limit(0)
    trace = spark.createDataFrame(rows, found.schema)
    spans = own.select(F.col("id").alias("_span")).distinct()
    if session.within(spans, session.BROADCAST_ROW_BOUND):
        spans = F.broadcast(spans)
    direct = scores.filter(F.col("trace_id") == trace_id)
    through = scores.filter(~F.col("trace_id").eqNullSafe(trace_id)).join(
        spans, F.col("observation_id") == F.col("_span"), "left_semi"
    )
    shown = direct.unionByName(through)
    return Detail(
        listing.with_rollup(trace, listing.rollup(own)),
        own.orderBy("started_at", "id"),
        shown.orderBy("scored_at", "id"),
    )
