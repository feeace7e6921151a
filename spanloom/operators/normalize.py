"""Raw JSON batches to typed traces, observations and scores.

Every member of a batch becomes one row of one frame (``channel`` tells what it
is), so a batch is parsed once and typed once by plain projections. A batch is
accepted or refused as a whole: its verdict is a small aggregate over the
narrow ``error`` column and payloads never move for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import model, session
from spanloom.functions import measures, values

ACCEPTED, REFUSED = "accepted", "refused"
MALFORMED, TOO_LARGE_SCHEMA, TOO_LARGE_CONFIG = (
    "malformed", "too_large_schema", "too_large_config",
)
BATCH, TRACE, OBSERVATION, SCORE = "batch", "trace", "observation", "score"

_TEXTS = [
    "name", "user_id", "session_id", "model", "provider", "level", "status_message", "comment",
]
_COUNTS = [
    "prompt_tokens", "completion_tokens", "cached_tokens", "reasoning_tokens", "latency_ms",
]
_IDS = ["id", "trace_id", "observation_id", "parent_observation_id"]
_PLAIN = [
    *_IDS, *_TEXTS, *_COUNTS, "type", "source", "input", "output", "prompt_name",
    "prompt_version", "tags", "environment", "release", "metadata", "observations", "value",
    "ended_at",
]
_STARTS = {
    TRACE: model.ALIASES["trace_started_at"],
    OBSERVATION: model.ALIASES["started_at"],
    SCORE: model.ALIASES["scored_at"],
}
_WIRE_KEYS = sorted(
    {k for f in _PLAIN for k in model.ALIASES.get(f, [f])} | {k for s in _STARTS.values() for k in s}
)
_SLOTS = 64
_UNTYPED = {"input", "output", "metadata", "observations"}


def _start(doc: Column, keys: list[str]) -> Column:
    v = F.coalesce(*[values.member(doc, k) for k in keys])
    return values.instant(v, values.kind(v))


def _id(doc: Column, key: str) -> Column:
    v = values.member(doc, key)
    return values.uuid(v, values.kind(v))


def _made_id(seed: Column) -> Column:
    """Derived from the position in the batch: stable under task retry."""
    return values.canonical_uuid(F.md5(seed))


def _native(doc: Column, key: str, beside_events: Column) -> Column:
    """A native list, or NULL when it holds something that is no list.

    Beside an ``events`` list, empty and null stand-ins count as an empty list.
    """
    v = values.member(doc, key)
    blank = F.coalesce(
        F.is_variant_null(v) | F.to_json(v).isin("{}", '""', "0", "false"), F.lit(False)
    )
    return F.when(v.isNull() | (beside_events & blank), values.no_items()).otherwise(
        values.listed(v)
    )


def unify_envelopes(batches: DataFrame) -> DataFrame:
    """Both envelopes to three document lists: native members first, then routed."""
    d = F.col("doc")
    parsed = batches.withColumn("doc", F.try_parse_json("body")).withColumn(
        "events", values.listed(values.member(d, "events"))
    )
    objects = F.filter(
        "events", lambda e: values.members(e, ["type"]).isNotNull()
    )
    tagged = F.transform(
        objects,
        lambda e: F.struct(
            F.coalesce(F.try_variant_get(e, "$.type", "string"), F.lit("")).alias("type"), e.alias("e")
        ),
    )
    routed = parsed.withColumn("routed", F.coalesce(tagged, F.array().cast("array<struct<type:string,e:variant>>")))

    def sent(wanted) -> Column:
        return F.transform(F.filter("routed", lambda r: wanted(r["type"])), lambda r: r["e"])

    beside = F.col("events").isNotNull()
    keyed = F.lit(False)
    for key in ("events", "traces", "observations", "scores"):
        keyed = keyed | values.member(d, key).isNotNull()
    return routed.select(
        *batches.columns,
        F.coalesce(keyed, F.lit(False)).alias("keyed"),
        values.member(d, "sdk_version").alias("body_sdk_version"),
        F.concat(_native(d, "traces", beside), sent(lambda t: t == TRACE)).alias("trace_docs"),
        F.concat(
            _native(d, "observations", beside), sent(lambda t: ~t.isin(TRACE, SCORE))
        ).alias("observation_docs"),
        F.concat(_native(d, "scores", beside), sent(lambda t: t == SCORE)).alias("score_docs"),
    )


def _size(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0))


def explode_members(
    batches: DataFrame,
    max_traces: int = model.CONFIG_MAX_TRACES,
    max_observations: int = model.CONFIG_MAX_OBSERVATIONS,
) -> DataFrame:
    """One row per member plus one header row per batch.

    Ceilings are checked on list sizes before anything is exploded; a batch
    beyond them keeps only its header row. Members carry the trace id and the
    start they inherit from the trace around or beside them.
    """
    for name in ("project_id", "sdk_version_header"):
        if name not in batches.columns:
            batches = batches.withColumn(name, F.lit(None).cast("string"))
    u = unify_envelopes(batches)
    received_at = F.col("received_at")

    heads = F.transform(
        "trace_docs",
        lambda t, i: F.struct(
            t.alias("doc"),
            F.coalesce(
                _id(t, "id"), _made_id(F.concat_ws("|", F.col("batch_id"), F.lit(TRACE), i.cast("string")))
            ).alias("id"),
            _start(t, _STARTS[TRACE]).alias("own_start"),
            values.listed(values.member(t, "observations")).alias("nested"),
        ),
    )
    timed = F.transform(
        "heads",
        lambda h: F.struct(
            h["doc"].alias("doc"),
            h["id"].alias("id"),
            h["nested"].alias("nested"),
            F.coalesce(
                h["own_start"],
                F.array_min(F.transform(h["nested"], lambda o: _start(o, _STARTS[OBSERVATION]))),
                received_at,
            ).alias("start"),
        ),
    )
    nested_sizes = F.transform("trace_docs", lambda t: _size(values.listed(values.member(t, "observations"))))
    sized = (
        u.withColumn("nested_sizes", nested_sizes)
        .withColumn("n_nested", F.aggregate("nested_sizes", F.lit(0), lambda a, x: a + x))
    )
    too_large = (
        (F.size("trace_docs") > model.MAX_TRACES_PER_BATCH)
        | (F.size("observation_docs") > model.MAX_FLAT_OBSERVATIONS_PER_BATCH)
        | (F.size("score_docs") > model.MAX_SCORES_PER_BATCH)
        | F.exists("nested_sizes", lambda n: n > model.MAX_OBSERVATIONS_PER_TRACE)
    )
    over_config = (F.size("trace_docs") > max_traces) | (
        F.col("n_nested") + F.size("observation_docs") > max_observations
    )
    unlisted = (
        F.col("trace_docs").isNull() | F.col("observation_docs").isNull() | F.col("score_docs").isNull()
    )
    v, k = F.col("body_sdk_version"), values.kind(F.col("body_sdk_version"))
    version = F.coalesce("sdk_version_header", values.text(v, k))
    judged = sized.withColumn("sdk_version", version).withColumn(
        "refusal",
        F.when(~F.col("keyed") | unlisted, MALFORMED)
        .when(too_large, TOO_LARGE_SCHEMA)
        .when(over_config, TOO_LARGE_CONFIG)
        .when(~values.is_null(k) & ~values.is_text(k), "sdk_version: not text")
        .when(F.length(version) > model.WIDTHS["sdk_version"], "sdk_version: too long"),
    )
    ok = F.col("refusal").isNull()
    fits = judged.withColumn("heads", F.when(ok, heads)).withColumn("heads", timed)

    def slot(trace_id: Column) -> Column:
        return F.pmod(F.xxhash64(trace_id), F.lit(_SLOTS)).cast("int")

    unstarted = F.transform(
        "observation_docs",
        lambda o: F.struct(
            o.alias("doc"),
            F.when(
                F.coalesce(*[values.member(o, k) for k in _STARTS[OBSERVATION]]).isNull(), _id(o, "trace_id")
            ).alias("trace"),
        ),
    )
    fits = fits.withColumn("siblings", F.when(ok, unstarted)).withColumns(
        {
            "siblings": F.transform("siblings", lambda o: F.struct(o["doc"], o["trace"], slot(o["trace"]).alias("slot"))),
            "starts": F.transform(
                "heads", lambda h: F.struct(h["id"].alias("id"), h["start"].alias("start"), slot(h["id"]).alias("slot"))
            ),
        }
    )

    # Starts by trace id, dealt to slots by the id's hash; only flat observations
    # without an own start look theirs up, each in one slot.
    slots = F.when(
        F.exists("siblings", lambda o: o["trace"].isNotNull()),
        F.transform(
            F.sequence(F.lit(0), F.lit(_SLOTS - 1)),
            lambda n: F.filter("starts", lambda h: h["slot"] == n),
        ),
    )

    def sibling_start(o: Column) -> Column:
        """Start of the batch's trace of that id; the last one if it repeats."""
        mine = F.filter(F.get(F.col("slots"), o["slot"]), lambda h: h["id"] == o["trace"])
        return F.try_element_at(mine, F.lit(-1))["start"]

    def row(channel: str, doc: Column, trace_id: Column, start: Column) -> Column:
        return F.struct(
            F.lit(channel).alias("channel"), doc.alias("doc"),
            trace_id.cast("string").alias("from_trace"), start.cast("timestamp").alias("from_start"),
        )

    none = F.lit(None)
    row_type = "array<struct<channel:string,doc:variant,from_trace:string,from_start:timestamp>>"
    nested = F.flatten(
        F.transform(
            "heads",
            lambda h: F.transform(
                F.coalesce(h["nested"], values.no_items()),
                lambda o: row(OBSERVATION, o, h["id"], h["start"]),
            ),
        )
    )
    flat = F.transform(
        "siblings",
        lambda o: row(OBSERVATION, o["doc"], none, F.when(o["trace"].isNotNull(), sibling_start(o))),
    )
    channels = [
        F.array(row(BATCH, none.cast("variant"), none, none)).cast(row_type),
        F.transform("heads", lambda h: row(TRACE, h["doc"], h["id"], h["start"])),
        F.concat(nested, flat),
        F.transform("score_docs", lambda s: row(SCORE, s, none, none)),
    ]
    positioned = [
        F.transform(c, lambda r, i: F.struct(i.alias("ordinal"), r.alias("row"))) for c in channels
    ]
    everything = F.when(ok, F.concat(*positioned)).otherwise(positioned[0])
    return fits.withColumn("slots", slots).select(
        "batch_id", "received_at", "project_id", "sdk_version", "refusal",
        F.explode(everything).alias("m"),
    ).select(
        "batch_id", "received_at", "project_id", "sdk_version", "refusal",
        F.col("m.ordinal").cast("bigint").alias("ordinal"), "m.row.*",
    )


def type_members(exploded: DataFrame) -> DataFrame:
    """Aliases resolved, values typed, defaults filled, first error named."""
    channel = F.col("channel")
    head = [
        "batch_id", "received_at", "project_id", "sdk_version", "refusal", "ordinal", "channel",
        "from_trace", "from_start",
    ]
    picked = exploded.withColumn("p", values.members(F.col("doc"), _WIRE_KEYS))
    p = F.col("p")
    start = F.when(channel == TRACE, values.first_present(p, _STARTS[TRACE])).when(
        channel == OBSERVATION, values.first_present(p, _STARTS[OBSERVATION])
    ).otherwise(values.first_present(p, _STARTS[SCORE]))
    raw = picked.select(
        *head,
        p.isNotNull().alias("is_object"),
        *[values.first_present(p, model.ALIASES.get(f, [f])).alias(f"v_{f}") for f in _PLAIN],
        start.alias("v_start"),
    )
    fields = [*_PLAIN, "start"]
    kinds = raw.select(
        "*", *[values.kind(F.col(f"v_{f}")).alias(f"k_{f}") for f in fields if f not in _UNTYPED]
    )

    def vk(f: str) -> tuple[Column, Column]:
        return F.col(f"v_{f}"), F.col(f"k_{f}")

    seed = F.concat_ws("|", "batch_id", "channel", F.col("ordinal").cast("string"))
    own_id = values.uuid(*vk("id"))
    typed = kinds.select(
        *head,
        "is_object",
        *[f"k_{f}" for f in fields if f not in _UNTYPED],
        F.col("v_id").isNotNull().alias("id_sent"),
        F.col("v_observations").isNotNull().alias("nested_sent"),
        values.listed(F.col("v_observations")).isNotNull().alias("nested_listed"),
        F.col("v_metadata").isNotNull().alias("metadata_sent"),
        F.when(channel == TRACE, F.col("from_trace")).otherwise(
            F.when(F.col("v_id").isNull(), _made_id(seed)).otherwise(own_id)
        ).alias("id"),
        own_id.isNotNull().alias("id_read"),
        *[values.uuid(*vk(f)).alias(f) for f in _IDS[1:]],
        *[values.text(*vk(f)).alias(f) for f in _TEXTS],
        *[values.count(*vk(f)).alias(f) for f in _COUNTS],
        F.when(F.col("v_type").isNull(), "span").otherwise(values.text(*vk("type"))).alias("type"),
        F.when(F.col("v_source").isNull(), "human").otherwise(values.text(*vk("source"))).alias("source"),
        values.payload(F.col("v_input")).alias("input"),
        values.payload(F.col("v_output")).alias("output"),
        values.text(*vk("prompt_name"), model.CLIP_PROMPT_NAME).alias("prompt_name"),
        values.version_text(*vk("prompt_version")).alias("prompt_version"),
        values.tags(*vk("tags")).alias("tags"),
        values.text(*vk("environment"), model.CLIP_ENVIRONMENT).alias("environment"),
        values.text(*vk("release"), model.CLIP_RELEASE).alias("release"),
        values.document(F.col("v_metadata")).alias("metadata"),
        values.score_type(F.col("k_value")).alias("data_type"),
        values.score_number(*vk("value")).alias("value"),
        values.score_label(*vk("value")).alias("value_text"),
        values.instant(*vk("start")).alias("start"),
        values.instant(*vk("ended_at")).alias("ended_at"),
    )
    is_observation = channel == OBSERVATION
    latency = measures.derived_latency(F.col("latency_ms"), F.col("start"), F.col("ended_at"))
    trace_id = F.when(
        is_observation, F.coalesce("trace_id", "from_trace", "id")
    ).otherwise(F.col("trace_id"))
    started = F.when(channel == TRACE, F.col("from_start")).otherwise(
        F.coalesce("start", "from_start", "received_at")
    )
    stored = [
        "observation_id", "parent_observation_id", *_TEXTS, *_COUNTS[:-1], "type", "source",
        "input", "output", "prompt_name", "prompt_version", "tags", "environment", "release",
        "metadata", "data_type", "value", "value_text", "ended_at", "id",
    ]
    return typed.select(
        "batch_id", "received_at", "project_id", "sdk_version", "channel", "ordinal", *stored,
        F.when(is_observation, latency).alias("latency_ms"),
        trace_id.alias("trace_id"),
        started.alias("started_at"),
        F.when(is_observation, admits(started, F.col("received_at"))).alias("admitted"),
        F.coalesce("refusal", F.when(channel != BATCH, _member_error())).alias("error"),
    )


def _member_error() -> Column:
    """First reason the member cannot be stored; NULL for a good one."""
    channel = F.col("channel")
    per_channel = {
        TRACE: ["name", "user_id", "session_id"],
        OBSERVATION: ["name", "model", "provider", "level", "status_message"],
        SCORE: ["comment"],
    }

    def kind(f: str) -> Column:
        return F.col(f"k_{f}")

    def unreadable(f: str, value: str | None = None) -> Column:
        """Sent, not null, and nothing came out of typing it."""
        return ~values.is_null(kind(f)) & F.col(value or f).isNull()

    def not_text(f: str) -> Column:
        return ~values.is_null(kind(f)) & ~values.is_text(kind(f))

    def on(c: str, bad: Column, reason: str) -> Column:
        return F.when((channel == c) & bad, F.lit(reason))

    checks = [
        F.when(~F.col("is_object"), "member: not an object"),
        F.when(F.col("id_sent") & ~F.col("id_read"), "id: not a uuid"),
        F.when(F.col("metadata_sent") & F.col("metadata").isNull(), "metadata: not an object"),
        F.when((channel != SCORE) & unreadable("ended_at"), "ended_at: not a time"),
        F.when(unreadable("start"), "started_at: not a time"),
    ]
    for c, names in per_channel.items():
        for f in names:
            checks.append(on(c, not_text(f), f"{f}: not text"))
            if f in model.WIDTHS:
                checks.append(on(c, F.length(f) > model.WIDTHS[f], f"{f}: too long"))
    for f in ("environment", "release"):
        checks.append(on(TRACE, not_text(f), f"{f}: not text"))
    checks.append(
        on(TRACE, F.col("nested_sent") & ~F.col("nested_listed"), "observations: not a list")
    )
    for f in _COUNTS:
        checks.append(on(OBSERVATION, unreadable(f), f"{f}: not a number"))
        checks.append(on(OBSERVATION, F.abs(f) > model.MAX_INT, f"{f}: out of range"))
    for f in ("trace_id", "parent_observation_id"):
        checks.append(on(OBSERVATION, unreadable(f), f"{f}: not a uuid"))
    checks += [
        on(OBSERVATION, F.col("type").isNull(), "type: not text"),
        on(OBSERVATION, F.length("type") > model.WIDTHS["type"], "type: too long"),
        on(OBSERVATION, not_text("prompt_name"), "prompt_name: not text"),
        on(OBSERVATION, unreadable("prompt_version"), "prompt_version: not text"),
        on(SCORE, unreadable("trace_id"), "trace_id: not a uuid"),
        on(SCORE, unreadable("observation_id"), "observation_id: not a uuid"),
        on(SCORE, F.coalesce(F.length("name"), F.lit(0)) == 0, "name: missing"),
        on(SCORE, F.length("name") > model.WIDTHS["name"], "name: too long"),
        on(SCORE, F.col("data_type").isNull(), "value: missing"),
        on(
            SCORE, (F.col("data_type") == "numeric") & F.col("value").isNull(), "value: out of range"
        ),
        on(SCORE, F.col("source").isNull(), "source: not text"),
        on(SCORE, F.length("source") > model.WIDTHS["source"], "source: too long"),
    ]
    return F.coalesce(*checks)


def admits(started_at: Column, received_at: Column) -> Column:
    """Event time within the accepted window around the receive time, inclusive."""
    return started_at.between(
        received_at - F.make_dt_interval(F.lit(model.MAX_EVENT_AGE_DAYS)),
        received_at + F.make_dt_interval(F.lit(model.MAX_EVENT_FUTURE_DAYS)),
    )


def read_members(batches: DataFrame, **limits: int) -> DataFrame:
    """Batches (``batch_id, received_at, body``, optionally ``project_id`` and
    ``sdk_version_header``) to typed member rows."""
    return type_members(explode_members(batches, **limits))


def batch_verdicts(members: DataFrame) -> DataFrame:
    """Status, reason and accepted/rejected counts of each batch.

    The rows of a batch come from one task, so the partial aggregate leaves one
    row per batch to shuffle.
    """
    channel = F.col("channel")
    aimed = F.col("trace_id").isNotNull() | F.col("observation_id").isNotNull()
    counts = {
        "accepted_traces": channel == TRACE,
        "accepted_observations": (channel == OBSERVATION) & F.col("admitted"),
        "accepted_scores": (channel == SCORE) & aimed,
        "rejected_observations": (channel == OBSERVATION) & ~F.col("admitted"),
        "rejected_scores": (channel == SCORE) & ~aimed,
    }
    per_batch = members.groupBy("project_id", "batch_id").agg(
        F.max("received_at").alias("received_at"),
        F.min("error").alias("reason"),
        *[F.count_if(c).alias(n) for n, c in counts.items()],
    )
    ok = F.col("reason").isNull()
    return per_batch.select(
        "batch_id", "received_at", "project_id",
        F.when(ok, ACCEPTED).otherwise(REFUSED).alias("status"),
        "reason",
        *[F.when(ok, F.col(n)).otherwise(F.lit(0)).alias(n) for n in counts],
    )


def accepted_members(members: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Members of accepted batches. A batch is bounded, so it is no hot key.

    Batch ids are unique within a project only.
    """
    refused = verdicts.filter(F.col("status") == REFUSED).select(
        F.col("project_id").alias("_project"), F.col("batch_id").alias("_batch")
    )
    if session.within(refused, session.BROADCAST_ROW_BOUND):
        refused = F.broadcast(refused)
    same = (F.col("batch_id") == F.col("_batch")) & F.col("project_id").eqNullSafe(F.col("_project"))
    return members.join(refused, same, "left_anti")


_HEAD = ["batch_id", "received_at", "ordinal", "project_id"]


def trace_events(members: DataFrame) -> DataFrame:
    return members.filter(F.col("channel") == TRACE).select(
        *_HEAD, "sdk_version", "id", "name", "user_id", "session_id", "tags", "environment",
        "release", "metadata", "started_at", "ended_at",
    )


def observation_events(members: DataFrame) -> DataFrame:
    """Observations sent, admitted or not."""
    return members.filter(F.col("channel") == OBSERVATION).select(
        *_HEAD, "id", "trace_id", "parent_observation_id", "type", "name", "model", "provider",
        "input", "output", *_COUNTS,
        measures.total_tokens(F.col("prompt_tokens"), F.col("completion_tokens")).alias("total_tokens"),
        "prompt_name", "prompt_version", "level", "status_message", "metadata", "started_at",
        "ended_at", "admitted",
    )


def score_events(members: DataFrame) -> DataFrame:
    """Scores sent, with or without a target."""
    return members.filter(F.col("channel") == SCORE).select(
        *_HEAD, "id", "trace_id", "observation_id", "name", "data_type", "value", "value_text",
        "comment", "source", "metadata", F.col("started_at").alias("scored_at"),
    )
