"""Merging of repeated and out-of-order deliveries.

All columns of the fold are maxima or minima over the arrival order
``seq = (received_at, batch_id, ordinal)``. State keeps beside each value the
arrival that set it, so folding may be cut in any way: partial and final
aggregation, compaction of old state, replays and epochs that overlap in time
agree, and a hot trace shrinks to one row per map task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom import model

KEY = ["project_id", "id"]
_LAST_WINS = ["name", "user_id", "session_id", "environment", "release", "ended_at", "sdk_version"]


def arrival() -> Column:
    return F.struct("received_at", "batch_id", "ordinal")


def first_arrivals(df: DataFrame, key: list[str]) -> DataFrame:
    """First row per key in arrival order; later ones are repeats.

    The rank limit also runs before the shuffle, so a key sent a billion times
    contributes one row per map task.
    """
    order = Window.partitionBy(*key).orderBy("received_at", "batch_id", "ordinal")
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") == 1).drop("_n")


def dedupe_observations(observations: DataFrame) -> DataFrame:
    """A retry that carries another start is another observation."""
    return first_arrivals(observations, ["project_id", "id", "started_at"])


def dedupe_scores(scores: DataFrame) -> DataFrame:
    return first_arrivals(scores, KEY)


def batch_windows(observations: DataFrame) -> DataFrame:
    """Per batch and trace, the span of starts of the admitted observations."""
    return observations.groupBy("project_id", "batch_id", "received_at", "trace_id").agg(
        F.min("started_at").alias("observations_started_min"),
        F.max("started_at").alias("observations_started_max"),
    )


def window_events(observations: DataFrame) -> DataFrame:
    """The batch windows of a trace as one fold input, which keeps the first and the last of their arrivals.

    Where no real trace ever arrives, the earliest batch's window is the stub. The start of that window
    is the least one of the trace's first arrival, so windows need not be made batch by batch.
    """
    # Starts that are absent come after all others, as in a minimum.
    start = [F.col("started_at").isNull().alias("no_start"), "started_at"]
    spans = observations.groupBy("project_id", F.col("trace_id").alias("id")).agg(
        F.min("started_at").alias("observations_started_min"),
        F.max("started_at").alias("observations_started_max"),
        F.min("received_at").alias("created_at"),
        F.max("received_at").alias("updated_at"),
        F.min(F.struct("received_at", "batch_id", *start)).alias("_first"),
        F.max(F.struct("received_at", "batch_id")).alias("_last"),
    )

    def arrived(end: str) -> Column:
        return F.struct(f"{end}.received_at", f"{end}.batch_id", F.lit(-1).cast("bigint").alias("ordinal"))

    held = {"stub_start": arrived("_first"), "first": arrived("_first"), "last": arrived("_last")}
    absent = {c: F.lit(None).cast(model.TRACES[c].dataType) for c in (*_LAST_WINS, "tags", "metadata")}
    return spans.withColumns(
        {
            **absent,
            **{n: F.col(f"_first.{n}") for n in ("received_at", "batch_id", "started_at")},
            "ordinal": F.lit(-1).cast("bigint"),
            "is_stub": F.lit(True),
            "set_at": F.struct(*[held.get(c, F.lit(None).cast(_SEQ)).alias(c) for c in _SET_AT]).cast(_SET_AT_TYPE),
            "keys_set_at": F.lit(None).cast(_KEYS_SET_AT_TYPE),
        }
    ).select(*_EVENT)


def real_events(traces: DataFrame) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    return traces.withColumns(
        {
            "is_stub": F.lit(False),
            "observations_started_min": none,
            "observations_started_max": none,
            "ordinal": F.col("ordinal").cast("bigint"),
        }
    )


def stub_traces(traces: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows of traces that the same batch does not carry."""
    sent = traces.select("project_id", "batch_id", F.col("id").alias("trace_id")).distinct()
    return windows.join(sent, ["project_id", "batch_id", "trace_id"], "left_anti")


_SEQ = "struct<received_at:timestamp,batch_id:string,ordinal:bigint>"
# Arrivals that state keeps: per column, of the start, and of the first and last event.
_SET_AT = [*_LAST_WINS, "tags", "real_start", "stub_start", "first", "last"]
_SET_AT_TYPE = f"struct<{','.join(f'{c}:{_SEQ}' for c in _SET_AT)}>"
_KEYS_SET_AT_TYPE = f"map<string,{_SEQ}>"

_EVENT = [
    *KEY, "received_at", "batch_id", "ordinal", "is_stub", *_LAST_WINS, "tags", "metadata",
    "started_at", "observations_started_min", "observations_started_max", "created_at",
    "updated_at", "set_at", "keys_set_at",
]

_TRACE = [
    *KEY, *_LAST_WINS, "tags", "started_at", "observations_started_min", "observations_started_max", "created_at",
    "updated_at", "is_stub", "set_at", "received_at", "batch_id", "ordinal", "metadata", "keys_set_at",
]


def _events(df: DataFrame) -> DataFrame:
    touched = {
        "created_at": F.col("received_at"), "updated_at": F.col("received_at"),
        "set_at": F.lit(None).cast(_SET_AT_TYPE), "keys_set_at": F.lit(None).cast(_KEYS_SET_AT_TYPE),
    }
    return df.withColumns(touched).select(*_EVENT)


def fold_inputs(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """Trace events plus the windows of admitted observations, ready to fold.

    There is one row of windows per trace, so what is to be folded in parts is dealt before.
    """
    return _events(real_events(traces)).unionByName(window_events(observations))


def empty_events(spark: SparkSession) -> DataFrame:
    """Fold input without a row."""
    head = T.StructType.fromDDL("received_at timestamp, batch_id string, ordinal bigint")
    own = [f for f in model.TRACES.fields if f.name not in ("created_at", "updated_at")]
    return _events(real_events(spark.createDataFrame([], T.StructType([*head.fields, *own]))))


def state_events(state: DataFrame) -> DataFrame:
    """Folded traces as input of a later fold."""
    return state.select(*_EVENT)


def fold_traces(events: DataFrame) -> DataFrame:
    """One row per trace from trace events, windows and earlier state.

    ``set_at`` and ``keys_set_at`` hold the arrivals that set the columns and the
    metadata keys; with them the result can be folded again with any other events.
    """
    e = events.withColumn("seq", arrival())
    return _as_traces(e.groupBy(*KEY).agg(*_latest()), merge_metadata(e))


def merge_states(*states: DataFrame) -> DataFrame:
    """States of one row per trace each, folded together; equals a fold of all their events.

    States that come from folds meet without another shuffle, as they are dealt by trace.
    """
    e = None
    for n, state in enumerate(states):
        part = state_events(state).withColumn("_state", F.lit(n))
        e = part if e is None else e.unionByName(part)
    return merge_rows(e, len(states), KEY)


def merge_rows(rows: DataFrame, states: int, by: list[str], *kept: Column) -> DataFrame:
    """Rows of some states, each with one row per trace and its number in ``_state``, merged in one aggregate.

    ``by`` holds the key and may name more that follows from it; ``kept`` adds aggregates to the result.
    """
    e = rows.withColumn("seq", arrival())
    dated = F.transform_values(
        "metadata", lambda k, v: F.struct(F.coalesce(F.element_at("keys_set_at", k), F.col("seq")).alias("at"), v.alias("value"))
    )
    maps = [f"_map_{n}" for n in range(states)]  # a trace has one map of each state at most
    held = [F.first(F.when((F.col("_state") == n) & (F.size("metadata") > 0), dated), ignorenulls=True).alias(m) for n, m in enumerate(maps)]

    def later(x: Column, y: Column) -> Column:
        return F.when(y.isNull() | (x["at"] > y["at"]), x).otherwise(y)

    merged = F.col(maps[0])
    for m in maps[1:]:
        both = F.map_zip_with(merged, F.col(m), lambda k, x, y: later(x, y))
        merged = F.coalesce(both, merged, F.col(m))
    return _as_traces(
        e.groupBy(*by).agg(*_latest(), *held, *kept).withColumn("_merged", merged).withColumns(
            {
                "metadata": F.transform_values("_merged", lambda k, v: v["value"]),
                "keys_set_at": F.transform_values("_merged", lambda k, v: v["at"]).cast(_KEYS_SET_AT_TYPE),
            }
        ).drop(*maps, "_merged")
    )


def _latest() -> list[Column]:
    """Per column the latest value with its arrival as one struct, so that an arrival travels once beside its value."""

    def at(c: str) -> Column:
        """Arrival of a value: its own for an event, the kept one for state."""
        return F.coalesce(F.col(f"set_at.{c}"), F.col("seq"))

    def held(c: str, value: str, keep: Column) -> Column:
        return F.when(keep, F.struct(at(c).alias("at"), F.col(value).alias("value")))

    stub = F.col("is_stub")
    return [
        *[F.max(held(c, c, F.col(c).isNotNull())).alias(f"_{c}") for c in _LAST_WINS],
        F.max(held("tags", "tags", F.size("tags") > 0)).alias("_tags"),
        F.max(held("real_start", "started_at", ~stub)).alias("_real_start"),
        F.min(held("stub_start", "started_at", stub)).alias("_stub_start"),
        F.min(at("first")).alias("_first"),
        F.max(at("last")).alias("_last"),
        F.min("observations_started_min").alias("observations_started_min"),
        F.max("observations_started_max").alias("observations_started_max"),
        F.min("created_at").alias("created_at"),
        F.max("updated_at").alias("updated_at"),
        F.min("is_stub").alias("is_stub"),
    ]


def _as_traces(latest: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Columns of a trace from the structs of :func:`_latest`; its metadata may come beside them."""
    stub = F.col("is_stub")
    held = {c: F.col(f"_{c}.at") for c in (*_LAST_WINS, "tags", "real_start")}
    # Once there is a real start, no stub's matters any more.
    held |= {"stub_start": F.when(stub, F.col("_stub_start.at")), "first": F.col("_first"), "last": F.col("_last")}
    # A stub stays at its first position: its start is the earliest batch's.
    position = F.when(stub, F.col("_first")).otherwise(F.col("_last"))
    rows = latest.withColumns(
        {
            **{c: F.col(f"_{c}.value") for c in _LAST_WINS},
            "tags": F.coalesce("_tags.value", F.array().cast("array<string>")),
            "started_at": F.coalesce("_real_start.value", "_stub_start.value"),
            "set_at": F.struct(*[held[c].alias(c) for c in _SET_AT]).cast(_SET_AT_TYPE),
            **{c: position[c] for c in ("received_at", "batch_id", "ordinal")},
        }
    ).drop(*[f"_{c}" for c in _SET_AT])
    if metadata is not None:
        rows = rows.join(metadata, KEY, "left")
    rows = rows.withColumn("metadata", F.coalesce("metadata", F.from_json(F.lit("{}"), model.DOC)))
    return rows.select(*_TRACE, *[c for c in rows.columns if c not in _TRACE])


def merge_metadata(events: DataFrame) -> DataFrame:
    """Top-level keys merged, the later value wins, an explicit null too."""
    entries = events.select(*KEY, "seq", "keys_set_at", F.explode("metadata").alias("key", "value"))
    at = F.coalesce(F.element_at("keys_set_at", F.col("key")), F.col("seq"))
    latest = entries.groupBy(*KEY, "key").agg(F.max_by("value", at).alias("value"), F.max(at).alias("at"))
    return latest.groupBy(*KEY).agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metadata"),
        F.map_from_entries(F.collect_list(F.struct("key", "at"))).cast(_KEYS_SET_AT_TYPE).alias("keys_set_at"),
    )


def rebuild_windows(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """Stored windows replaced by those of the observations, where there are any."""
    return _with_true_window(traces, observations).select(
        *[c for c in traces.columns if not c.startswith("observations_started_")],
        F.coalesce("_lo", "observations_started_min").alias("observations_started_min"),
        F.coalesce("_hi", "observations_started_max").alias("observations_started_max"),
    )


def windows_to_repair(traces: DataFrame, observations: DataFrame) -> DataFrame:
    """Only the traces whose stored window differs from the measured one."""
    stored_differs = ~(
        F.col("_lo").eqNullSafe(F.col("observations_started_min"))
        & F.col("_hi").eqNullSafe(F.col("observations_started_max"))
    )
    return (
        _with_true_window(traces, observations)
        .filter(F.col("_lo").isNotNull() & stored_differs)
        .select(*KEY, F.col("_lo").alias("observations_started_min"), F.col("_hi").alias("observations_started_max"))
    )


def _with_true_window(traces: DataFrame, observations: DataFrame) -> DataFrame:
    measured = observations.groupBy("project_id", F.col("trace_id").alias("id")).agg(
        F.min("started_at").alias("_lo"), F.max("started_at").alias("_hi")
    )
    return traces.join(measured, KEY, "left")
