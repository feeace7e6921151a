"""Trace lists: filters, keyset pages, rollups."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import model, session
from spanloom.functions import cursors, measures
from spanloom.operators import tenancy
from spanloom.operators.ranking import number_rows

_EXACT = ["name", "user_id", "session_id", "environment", "release"]
LIST_COLUMNS = [
    "id", "project_id", "name", "user_id", "session_id", "tags", "environment", "release",
    "metadata", "started_at", "ended_at", "created_at", "sdk_version",
    "observations_started_min", "observations_started_max",
]
_SUMS = ["prompt_tokens", "completion_tokens", "total_tokens", "latency_ms"]
MOST_DAYS = 100_000  # calendar days of 270 years
ROLLUP_COLUMNS = [
    "observation_count", "prompt_tokens", "completion_tokens", "total_tokens", "total_cost_usd",
    "total_latency_ms",
]


def read_filters(params: Mapping[str, Any]) -> dict[str, Any]:
    """Known filters from loose parameters: last scalar wins, empty means absent."""
    out: dict[str, Any] = {}
    for key in (*_EXACT, "from", "to"):
        value = params.get(key)
        if isinstance(value, (list, tuple)):
            value = value[-1] if value else None
        if value not in (None, ""):
            out[key] = value
    tags = params.get("tag") or []
    out["tags"] = [t for t in ([tags] if isinstance(tags, str) else tags) if t]
    return out


def split_tags(text: str) -> list[str]:
    """Comma-separated tags, trimmed, without repeats, in order."""
    return list(dict.fromkeys(t for t in (raw.strip() for raw in text.split(",")) if t))


def page_size(limit: int | None, most: int | None = model.MAX_PAGE) -> int:
    """A page's rows; a limit outside 1 to ``most`` is refused, not cut."""
    size = model.DEFAULT_PAGE if limit is None else int(limit)
    if size < 1 or most is not None and size > most:
        raise ValueError(f"limit must be from 1 to {most}" if most else "limit must be at least 1")
    return size


def _bound(value: datetime | str) -> Column:
    """A range bound; without an offset it is UTC."""
    text = value.isoformat() if isinstance(value, datetime) else str(value)
    return F.lit(text).cast("timestamp")


def filter_traces(traces: DataFrame, filters: Mapping[str, Any]) -> DataFrame:
    """Exact matches, every tag, and a half-open range of event time."""
    out = traces
    for name in _EXACT:
        if name in filters:
            out = out.filter(F.col(name) == filters[name])
    for tag in filters.get("tags", []):
        out = out.filter(F.array_contains("tags", tag))
    if "from" in filters:
        out = out.filter(F.col("started_at") >= _bound(filters["from"]))
    if "to" in filters:
        out = out.filter(F.col("started_at") < _bound(filters["to"]))
    return out


def newest_first() -> list[Column]:
    return [F.col("started_at").desc(), F.col("id").desc()]


def after(traces: DataFrame, started_at: Column, trace_id: Column) -> DataFrame:
    """Rows behind a position of the newest-first order.

    The leading comparison alone bounds the scan, so it reaches the files.
    """
    at = F.col("started_at")
    return traces.filter((at <= started_at) & ((at < started_at) | (F.col("id") < trace_id)))


def rollup(observations: DataFrame, keys: Iterable[str] = ("project_id", "trace_id")) -> DataFrame:
    """Counts and sums per trace; a missing value counts zero in its own row."""
    zero = F.lit(0).cast("bigint")
    free = F.lit(0).cast(model.COST)
    sums = {c: F.sum(F.coalesce(F.col(c), zero)) for c in _SUMS}
    return observations.groupBy(*keys).agg(
        F.count("*").alias("observation_count"),
        *[sums[c].alias(c) for c in _SUMS[:3]],
        F.sum(F.coalesce("cost_usd", free)).cast("decimal(28,8)").alias("total_cost_usd"),
        sums["latency_ms"].alias("total_latency_ms"),
    )


def with_rollup(traces: DataFrame, rolled: DataFrame) -> DataFrame:
    """Traces with their rollup; zeros where there are no observations."""
    right = rolled.withColumnRenamed("trace_id", "id")
    joined = traces.join(right, ["project_id", "id"], "left")
    zeros = {c: F.coalesce(F.col(c), F.lit(0).cast("bigint")) for c in ROLLUP_COLUMNS if c != "total_cost_usd"}
    return joined.withColumns(
        {
            **zeros,
            "total_cost_usd": F.coalesce("total_cost_usd", F.lit(0).cast("decimal(28,8)")),
            "duration_ms": measures.duration_ms(F.col("started_at"), F.col("ended_at")),
        }
    )


def list_all(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """The list with rollups for every trace at once."""
    return with_rollup(traces, rollup(observations))


def list_filtered(
    traces: DataFrame, observations: DataFrame, filters: Mapping[str, Any]
) -> DataFrame:
    """The list with rollups for the traces a filter keeps.

    When they are few, only their observations leave the scan.
    """
    found = filter_traces(traces, filters)
    ids = found.select("project_id", F.col("id").alias("trace_id"))
    own = session.narrowed(observations, ids, ["project_id", "trace_id"])
    return with_rollup(found, rollup(own))


def bounded_scan(observations: DataFrame, lo: datetime, hi: datetime) -> DataFrame:
    """Observations that start inside a closed window, pruned to its days."""
    out = observations
    if "started_date" in observations.columns:
        out = out.filter(F.col("started_date").between(_bound(lo).cast("date"), _bound(hi).cast("date")))
    return out.filter(F.col("started_at").between(_bound(lo), _bound(hi)))


def observations_of(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """Observations of many traces, read from the days in which those traces have any.

    The days of all traces are few, one per calendar day at most, and prune the stored
    day folders at run time before a row of them is read; the join by trace follows.
    The two bounds of a window are compared in the scan of the traces, which is also what
    tells the optimiser that pruning pays.
    """
    lo, hi = F.col("observations_started_min"), F.col("observations_started_max")
    windows = traces.filter(lo <= hi).select("project_id", F.col("id").alias("trace_id"), lo.alias("_lo"), hi.alias("_hi"))
    # Only the distinct days leave the tasks; a trace is not repeated for the days of its window.
    each = F.explode(F.sequence(F.col("_lo").cast("date"), F.col("_hi").cast("date")))
    days = windows.select(each.alias("started_date")).distinct()
    if session.within(days, MOST_DAYS):
        observations = observations.join(F.broadcast(days), "started_date", "left_semi")
    return (
        observations.join(windows, ["project_id", "trace_id"])
        .filter(F.col("started_date").between(F.col("_lo").cast("date"), F.col("_hi").cast("date")))
        .filter(F.col("started_at").between(F.col("_lo"), F.col("_hi")))
        .drop("_lo", "_hi")
    )


class Page(NamedTuple):
    rows: DataFrame
    next_cursor: str | None
    has_more: bool


def list_page(
    traces: DataFrame,
    observations: DataFrame,
    project_id: str | None,
    filters: Mapping[str, Any] | None = None,
    limit: int | None = None,
    cursor: str | None = None,
) -> Page:
    """One page of one tenant, newest first, with rollups; without a tenant it is empty."""
    return newest_page(
        tenancy.tenant_view(traces, project_id), tenancy.tenant_view(observations, project_id), filters, limit, cursor
    )


def newest_page(
    traces: DataFrame,
    observations: DataFrame,
    filters: Mapping[str, Any] | None = None,
    limit: int | None = None,
    cursor: str | None = None,
) -> Page:
    """One page of all rows given, for callers that may see them all.

    The page (at most ``MAX_PAGE`` rows) is fetched first; its stored window
    prunes the observation scan and its ids are small enough to broadcast.
    """
    spark = traces.sparkSession
    n = page_size(limit)
    found = filter_traces(traces.select(*LIST_COLUMNS), filters or {})
    if cursor:
        at, trace_id = cursors.decode(cursor)
        found = after(found, _bound(at), F.lit(trace_id))
    shown = found.withColumn("metadata", F.to_json("metadata")).withColumn(
        "_cursor", cursors.encode(F.col("started_at"), F.col("id"))
    )
    top = shown.orderBy(*newest_first()).limit(n + 1)
    fetched = top.collect()
    has_more = len(fetched) > n
    kept = fetched[:n]
    page = spark.createDataFrame(kept, top.schema)
    starts = [r.observations_started_min for r in kept if r.observations_started_min]
    ends = [r.observations_started_max for r in kept if r.observations_started_max]
    if starts and ends:
        scan = bounded_scan(observations, min(starts), max(ends))
    else:
        scan = observations.limit(0)
    ids = F.broadcast(page.select("project_id", F.col("id").alias("trace_id")))
    rolled = rollup(scan.join(ids, ["project_id", "trace_id"], "left_semi"))
    rows = with_rollup(page, rolled).drop("_cursor").orderBy(*newest_first())
    return Page(rows, kept[-1]["_cursor"] if has_more else None, has_more)


def all_pages(traces: DataFrame, limit: int | None = None) -> DataFrame:
    """Every page of every tenant: position and page number of each trace."""
    n = page_size(limit, most=None)
    narrow = traces.select("project_id", "id", "started_at")
    numbered = number_rows(narrow, ["project_id"], newest_first(), "position")
    return numbered.withColumn("page", F.floor((F.col("position") - 1) / F.lit(n)).cast("bigint") + 1)
