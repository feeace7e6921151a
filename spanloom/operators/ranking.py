"""Row numbers inside groups of any size.

A window over a group sorts the whole group in one task. Here the rows are
range-partitioned over group and order together, so a group that holds most of
the table is spread over many tasks, and only one count per (task, group)
is added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom import session


# Groups of at most this many rows, each a few columns wide, are summed by a window in one task.
WINDOW_ROWS = 100_000


def _range_placed(df: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows in order of group and ``order`` over all tasks, with their task and position."""
    slots = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_first() for g in group]
    placed = df.repartitionByRange(slots, *keys, *order).sortWithinPartitions(*keys, *order)
    # The bounds come from sampling, so the placement is fixed before it is counted.
    return session.cut_lineage(
        placed.select("*", F.spark_partition_id().alias("_task"), F.monotonically_increasing_id().alias("_pos"))
    )


def _before_task(runs: DataFrame, group: list[str]) -> Column:
    """Sum of ``_size`` over a group's earlier tasks; one row per task a group touches, few."""
    earlier = Window.partitionBy(*group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("_size").over(earlier), F.lit(0))


def _with_shift(fixed: DataFrame, offsets: DataFrame, group: list[str]) -> DataFrame:
    on = F.lit(True)
    o = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in (*group, "_task")], "_shift")
    for c in (*group, "_task"):
        on = on & F.col(c).eqNullSafe(F.col(f"_o_{c}"))
    return fixed.join(o, on)


def number_rows(
    df: DataFrame, group: list[str], order: list[Column], name: str = "row_number"
) -> DataFrame:
    """Adds the 1-based position of each row in its group; ``order`` must be total."""
    fixed = _range_placed(df, group, order)
    runs = fixed.groupBy(*group, "_task").agg(F.count("*").alias("_size"), F.min("_pos").alias("_base"))
    offsets = runs.select(*group, "_task", (_before_task(runs, group) - F.col("_base")).alias("_shift"))
    return (
        _with_shift(fixed, offsets, group)
        .withColumn(name, F.col("_pos") + F.col("_shift") + 1)
        .select(*df.columns, name)
    )


def has_group_beyond(df: DataFrame, group: list[str], rows: int = WINDOW_ROWS) -> bool:
    return not df.groupBy(*group).count().filter(F.col("count") > rows).isEmpty()


def running_total(
    df: DataFrame, group: list[str], order: list[Column], value: str, name: str, crowded: bool = True
) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each in its group; ``order`` must be total.

    Groups that may be ``crowded`` are placed by range and summed within (group, task); where a
    count has proved all of them small, one window will do.
    """
    preceding = Window.unboundedPreceding, -1
    if not crowded:
        inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(*preceding)
        return df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    fixed = _range_placed(df, group, order)
    runs = fixed.groupBy(*group, "_task").agg(F.sum(value).alias("_size"))
    offsets = runs.select(*group, "_task", _before_task(runs, group).alias("_shift"))
    inside = Window.partitionBy(*group, "_task").orderBy("_pos").rowsBetween(*preceding)
    summed = fixed.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        _with_shift(summed, offsets, group)
        .withColumn(name, F.col("_own") + F.col("_shift"))
        .select(*df.columns, name)
    )
