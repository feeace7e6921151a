"""Daily summaries that merge over any range of days without the rows behind them.

Counts and sums are exact. Distinct users and quantiles of lag are sketches stored beside
them, of a size that doesn't grow with the rows: a chart over a year reads as many rows as
there are days and groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Registers of a user sketch as a power of two; one standard error is 1.04 / sqrt(2 ** 14) = 0.8 %.
USER_LOG2 = 14
# Size of a lag sketch; a quantile's rank is off by at most 1.33 % at 200 and about half of that
# at 400, with 99 % confidence.
LAG_SIZE = 400
LAG_RANK_ERROR = 0.0133
GROUPS = ["project_id", "environment", "release"]


def daily_spend(traces_with_rollup: DataFrame, groups: Sequence[str] = GROUPS) -> DataFrame:
    """Traces, tokens, cost and a sketch of users per day and combination of groups."""
    return traces_with_rollup.groupBy(F.to_date("started_at").alias("day"), *groups).agg(
        F.count("*").alias("traces"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost_usd").cast("decimal(38,8)").alias("total_cost_usd"),
        F.hll_sketch_agg("user_id", USER_LOG2).alias("users"),
    )


def spend_cube(
    daily: DataFrame, sets: Sequence[Sequence[str]], groups: Sequence[str] = GROUPS, since: Column | None = None, until: Column | None = None
) -> DataFrame:
    """Spend over a closed range of days by several sets of groups, in one pass.

    ``level`` has a bit set for each group, the first the highest, that a row sums over; it tells
    such a row from one whose group is null. ``users`` is an estimate.
    """
    inside = daily
    if since is not None:
        inside = inside.filter(F.col("day") >= since)
    if until is not None:
        inside = inside.filter(F.col("day") <= until)
    wanted = [[F.col(c) for c in s] for s in sets]
    return inside.groupingSets(wanted, *groups).agg(
        F.grouping_id(*groups).cast("int").alias("level"),
        F.sum("traces").alias("traces"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost_usd").cast("decimal(38,8)").alias("total_cost_usd"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("users"),
    )


def lag_ms(rows: DataFrame) -> DataFrame:
    """Milliseconds from event to receipt; rows without either have none."""
    return rows.withColumn("lag_ms", F.unix_millis("created_at") - F.unix_millis("started_at")).filter("lag_ms IS NOT NULL")


def daily_lag(rows: DataFrame) -> DataFrame:
    """Rows, least and greatest lag, and a sketch of lags, per project and day of receipt."""
    return lag_ms(rows).groupBy("project_id", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("rows"), F.min("lag_ms").alias("min_ms"), F.max("lag_ms").alias("max_ms"),
        F.kll_sketch_agg_bigint("lag_ms", F.lit(LAG_SIZE)).alias("lags"),
    )


def lag_over(daily: DataFrame, bucket: Column, quantiles: Sequence[float] = (0.5, 0.95)) -> DataFrame:
    """Lags per project and bucket of days, with the quantiles of the merged sketches as ``q50_ms`` and the like."""
    merged = daily.groupBy("project_id", bucket.alias("bucket")).agg(
        F.sum("rows").alias("rows"), F.min("min_ms").alias("min_ms"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_bigint("lags", F.lit(LAG_SIZE)).alias("_lags"),
    )
    found = {f"q{round(100 * q)}_ms": F.kll_sketch_get_quantile_bigint("_lags", F.lit(float(q))) for q in quantiles}
    return merged.withColumns(found).drop("_lags")
