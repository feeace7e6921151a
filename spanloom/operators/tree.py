"""Span trees: parents, orphans, cycles, depth, depth-first order.

A span's place in depth-first order is the sum, over the way from its root down to it,
of one and the sizes of the subtrees of earlier siblings. So two numbers per span are
enough and no paths are carried: first the spans below each, then the places above it.
Both are found by pointer jumping: every round doubles how far a span has looked up,
so the rounds grow with the logarithm of the depth. Only spans that are somebody's
parent take part; leaves join once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom import session
from spanloom.functions import display
from spanloom.operators.ranking import has_group_beyond, running_total

TRACE = ["project_id", "trace_id"]


def first_spans(observations: DataFrame) -> DataFrame:
    """One row per span id of a trace: the first by start, then input order of ids."""
    order = Window.partitionBy(*TRACE, "id").orderBy("started_at", "parent_observation_id")
    return observations.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _spans(observations: DataFrame) -> DataFrame:
    return first_spans(
        observations.select(
            *TRACE, "id", F.nullif("parent_observation_id", F.lit("")).alias("parent_observation_id"),
            "started_at",
        )
    ).select(
        *TRACE, "id", F.col("parent_observation_id").alias("parent"),
        F.unix_millis("started_at").alias("ms"),
    )


def _subtrees(spans: DataFrame) -> DataFrame:
    """Spans named as a parent: how many spans lie below, and whether its way up never ends.

    After round k ``below`` counts the spans less than 2 ** k levels under a span's children and
    ``anc`` is the span 2 ** k levels up. A round in which no span arrives at a root
    proves the rest to hang on a cycle, as a longer finite chain would have to pass
    through that distance.
    """
    children = spans.filter(F.col("parent").isNotNull()).groupBy(*TRACE, F.col("parent").alias("id")).agg(
        F.count("*").alias("below")
    )
    # A parent that is missing counts as one more level: the first round looks above it and finds nothing.
    state = session.cut_lineage(
        spans.select(*TRACE, "id", F.col("parent").alias("anc")).join(children, [*TRACE, "id"])
    )
    climbing = F.col("anc").isNotNull()
    waiting = state.filter(climbing).count()
    while waiting:
        gained = state.filter(climbing).groupBy(*TRACE, F.col("anc").alias("id")).agg(F.sum("below").alias("_gained"))
        up = state.select(*TRACE, F.col("id").alias("anc"), F.col("anc").alias("_anc"))
        state = session.cut_lineage(
            state.join(up, [*TRACE, "anc"], "left").join(gained, [*TRACE, "id"], "left").select(
                *TRACE, "id", F.col("_anc").alias("anc"),
                (F.col("below") + F.coalesce("_gained", F.lit(0))).alias("below"),
            )
        )
        still = state.filter(climbing).count()
        if still == waiting:
            break
        waiting = still
    return state.select(*TRACE, "id", "below", climbing.alias("endless"))


def _kinds(spans: DataFrame) -> DataFrame:
    """Every span with its kind, the parent it stands under and the size of its subtree."""
    inner = _subtrees(spans)
    over = inner.select(*TRACE, F.col("id").alias("parent"), F.col("endless").alias("_over"))
    own = inner.select(*TRACE, "id", "below")
    kind = (
        F.when(F.col("parent").isNull(), "root")
        .when(F.col("_over").isNull(), "missing_parent")
        .when(F.col("_over"), "cycle")
        .otherwise("child")
    )
    return (
        spans.join(over, [*TRACE, "parent"], "left").join(own, [*TRACE, "id"], "left")
        .withColumn("kind", kind)
        .select(
            *TRACE, "id", "parent", "ms", "kind",
            F.when(F.col("kind") == "child", F.col("parent")).alias("under"),
            # Spans of a cycle stand alone.
            (F.col("below").isNotNull() & (F.col("kind") != "cycle")).alias("is_parent"),
            F.when(F.col("kind") == "cycle", F.lit(1)).otherwise(1 + F.coalesce("below", F.lit(0))).cast("bigint").alias("size"),
        )
    )


def _reached(placed: DataFrame) -> DataFrame:
    """Position and depth of the spans that are parents, summed along their way to the root."""
    state = session.cut_lineage(
        placed.filter("is_parent").select(
            *TRACE, "id", F.col("under").alias("anc"), (F.col("earlier") + 1).alias("position"),
            F.when(F.col("under").isNull(), 0).otherwise(1).cast("bigint").alias("depth"),
        )
    )
    done, open_ = state.filter(F.col("anc").isNull()), state.filter(F.col("anc").isNotNull())
    while not open_.isEmpty():
        up = done.unionByName(open_).select(
            *TRACE, F.col("id").alias("anc"), F.col("anc").alias("_anc"),
            F.col("position").alias("_position"), F.col("depth").alias("_depth"),
        )
        moved = session.cut_lineage(
            open_.join(up, [*TRACE, "anc"]).select(
                *TRACE, "id", F.col("_anc").alias("anc"),
                (F.col("position") + F.col("_position")).alias("position"),
                (F.col("depth") + F.col("_depth")).alias("depth"),
            )
        )
        done = done.unionByName(moved.filter(F.col("anc").isNull()))
        open_ = moved.filter(F.col("anc").isNotNull())
    return done.select(*TRACE, "id", "position", "depth")


def span_tree(observations: DataFrame) -> DataFrame:
    """Every span with its kind, depth and position in depth-first order of its trace.

    ``kind`` is root, child, missing_parent or cycle; the last two stand at the
    root, flagged as orphaned. Siblings are ordered by start and id.
    """
    # Narrow and used several times: deduplicated once.
    spans = session.stage(_spans(observations), "spans")
    # Siblings are never more than the spans of their trace.
    crowded = has_group_beyond(spans, TRACE)
    kinds = _kinds(spans)
    if crowded:
        kinds = session.stage(kinds, "kinds")  # placing by range samples its input before it reads it
    siblings = running_total(kinds, [*TRACE, "under"], [F.col("ms").asc(), F.col("id").asc()], "size", "earlier", crowded)
    # Sums are read for parents first and for all spans after.
    placed = session.stage(siblings.drop("size", "ms"), "siblings")
    above = _reached(placed).select(
        *TRACE, F.col("id").alias("under"), F.col("position").alias("_position"), F.col("depth").alias("_depth")
    )
    return placed.join(above, [*TRACE, "under"], "left").select(
        *TRACE, "id", F.col("parent").alias("parent_observation_id"), "kind",
        F.coalesce(F.col("_depth") + 1, F.lit(0)).cast("bigint").alias("depth"),
        F.col("kind").isin("missing_parent", "cycle").alias("orphaned"),
        (F.coalesce("_position", F.lit(0)) + F.col("earlier") + 1).alias("position"),
    )


def span_facts(observations: DataFrame) -> DataFrame:
    """What a span row shows: error, finish reason, payload and details."""
    has_payload = F.col("input").isNotNull() | F.col("output").isNotNull()
    counted = (F.coalesce("cached_tokens", F.lit(0)) != 0) | (F.coalesce("reasoning_tokens", F.lit(0)) != 0)
    described = F.coalesce(F.size("metadata"), F.lit(0)) > 0
    return observations.select(
        *TRACE, "id", "started_at",
        display.is_error(F.col("level")).alias("is_error"),
        display.finish_reason(F.col("metadata")).alias("finish_reason"),
        has_payload.alias("has_payload"),
        (has_payload | counted | described).alias("has_details"),
    )
