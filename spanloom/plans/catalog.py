"""Registered queries: each runs over whole tables, most with checking SQL.

At the edge of a query decimals, times and lists become text, so both engines
return the same plain types.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom import session
from spanloom.functions import cursors, display, measures, model_ids, values
from spanloom.operators import (
    admit, detail, fold, listing, maintenance, normalize, pricing, reports, sketches, tenancy, tree,
)
from spanloom.plans.fixtures import Fixtures, _sql, with_views
from spanloom.sources import page_files, tables, tag_index, trace_store
from spanloom.streaming import ingest, series

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn: Callable[[Fixtures], DataFrame]):
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(Fixtures(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(_sql(sql))
        return fn

    return register


def ts(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS").alias(c)


def dec(c: str, scale: int = 8) -> Column:
    return F.col(c).cast(f"decimal(38,{scale})").cast("string").alias(c)


def joined(c: str) -> Column:
    return F.array_join(F.col(c), ",").alias(c)


def _ts(c: str) -> str:
    name = c.split(".")[-1]
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S.%f') AS {name}"


def _dec(c: str, scale: int = 8) -> str:
    return f"CAST(CAST({c} AS decimal(38,{scale})) AS varchar) AS {c.split('.')[-1]}"


_ROLLED = "observation_count, prompt_tokens, completion_tokens, total_tokens"


# --- Rollups, lists, pages ----------------------------------------------------
def _list_columns() -> list:
    return [
        "project_id", "id", "name", "environment", "release", joined("tags"), ts("started_at"),
        "observation_count", "prompt_tokens", "completion_tokens", "total_tokens",
        dec("total_cost_usd"), "total_latency_ms", "duration_ms",
    ]


_LIST_SQL = f"""project_id, id, name, environment, release, array_to_string(tags, ',') AS tags,
    {_ts('started_at')}, {_ROLLED}, {_dec('total_cost_usd')}, total_latency_ms, duration_ms"""


@query(f"SELECT project_id, trace_id, {_ROLLED}, {_dec('total_cost_usd')}, total_latency_ms FROM fx_rollup")
def trace_rollup(fx: Fixtures) -> DataFrame:
    return listing.rollup(fx.priced()).withColumn("total_cost_usd", dec("total_cost_usd"))


@query(f"SELECT {_LIST_SQL} FROM fx_listed")
def trace_list_all(fx: Fixtures) -> DataFrame:
    return listing.list_all(fx.traces(), fx.priced()).select(*_list_columns())


@query(f"SELECT {_LIST_SQL} FROM fx_listed ORDER BY fx_listed.started_at DESC, id DESC LIMIT 50")
def trace_list_page(fx: Fixtures) -> DataFrame:
    obs = fx.priced()
    return listing.newest_page(fx.windowed_traces(obs), obs, limit=50).rows.select(*_list_columns())


@query(f"SELECT {_LIST_SQL} FROM fx_listed WHERE project_id = 'p3' ORDER BY fx_listed.started_at DESC, id DESC LIMIT 50")
def tenant_list_page(fx: Fixtures) -> DataFrame:
    obs = fx.priced()
    return listing.list_page(fx.windowed_traces(obs), obs, "p3", limit=50).rows.select(*_list_columns())


@query()
def tenant_page_stored(fx: Fixtures) -> DataFrame:
    """The same page from traces stored in page order."""
    root, obs = session.scratch_path(fx.spark, "pages"), session.stage(fx.priced(), "priced")
    page_files.write(session.stage(fx.windowed_traces(obs), "windowed"), root, rows_per_file=1000)
    return page_files.list_page(fx.spark, root, obs, "p3", limit=50).rows.select(*_list_columns())


ORACLES["tenant_page_stored"] = ORACLES["tenant_list_page"]


@query(f"""SELECT project_id, id, {_ts('started_at')} FROM fx_traces
    WHERE list_contains(tags, '1') AND list_contains(tags, 'O')""")
def traces_by_tags(fx: Fixtures) -> DataFrame:
    """Traces of all tenants that bear both tags, from the tags' side table."""
    path = session.scratch_path(fx.spark, "tags")
    tag_index.write(fx.traces(), path, buckets=16)
    tenants = [r.project_id for r in fx.projects().collect()]  # as many as there are nations
    return tag_index.traces_with(fx.spark, path, tenants, ["1", "O", "1"]).select("project_id", "id", ts("started_at"))


@query("""WITH one AS (SELECT project_id, min(id) AS id FROM fx_traces WHERE project_id = 'p3' GROUP BY project_id),
    own AS (SELECT o.* FROM fx_observations o JOIN one ON o.project_id = one.project_id AND o.trace_id = one.id),
    shown AS (SELECT c.* FROM fx_scores c JOIN one ON c.project_id = one.project_id
              WHERE c.trace_id = one.id OR c.observation_id IN (SELECT id FROM own))
    SELECT 'observation' AS kind, id, row_number() OVER (ORDER BY started_at, id) AS position FROM own
    UNION ALL SELECT 'score', id, row_number() OVER (ORDER BY scored_at, id) FROM shown
    UNION ALL SELECT 'trace', id, 1 FROM one""")
def trace_detail(fx: Fixtures) -> DataFrame:
    """The first trace of a tenant: its observations and scores in their order."""
    obs = fx.priced()
    traces = fx.windowed_traces(obs)
    first = traces.filter("project_id = 'p3'").agg(F.min("id")).first()[0]
    found = detail.trace_detail(traces, obs, fx.scores(), "p3", first)
    parts = [("observation", found.observations, "started_at"), ("score", found.scores, "scored_at"), ("trace", found.trace, "started_at")]
    out = None
    for kind, rows, at in parts:
        place = F.row_number().over(Window.orderBy(at, "id")).cast("bigint")  # of one trace
        part = rows.select(F.lit(kind).alias("kind"), "id", place.alias("position"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""
    SELECT project_id, id, row_number() OVER w AS position,
           CAST(floor((row_number() OVER w - 1) / 50) AS bigint) + 1 AS page
    FROM fx_traces WINDOW w AS (PARTITION BY project_id ORDER BY started_at DESC, id DESC)""")
def trace_pages_all(fx: Fixtures) -> DataFrame:
    return listing.all_pages(fx.traces(), 50).select("project_id", "id", "position", "page")


@query(f"""SELECT {_LIST_SQL} FROM fx_listed
    WHERE environment = 'prod' AND list_contains(tags, '1') AND list_contains(tags, 'O')
      AND fx_listed.started_at >= TIMESTAMP '1996-01-01' AND fx_listed.started_at < TIMESTAMP '1998-01-01'""")
def trace_filter_env_tag_range(fx: Fixtures) -> DataFrame:
    filters = listing.read_filters(
        {"environment": ["dev", "prod"], "tag": ["1", "", "O"], "from": "1996-01-01", "to": "1998-01-01T00:00:00Z", "odd": "x"}
    )
    return listing.list_filtered(fx.traces(), fx.priced(), filters).select(*_list_columns())


_SEEK_AT, _SEEK_ID = "1997-06-15", "00000000-0000-4000-8000-000000000500"


@query(f"""SELECT project_id, id, {_ts('started_at')} FROM fx_traces
    WHERE (fx_traces.started_at, id) < (TIMESTAMP '{_SEEK_AT}', '{_SEEK_ID}')""")
def keyset_seek(fx: Fixtures) -> DataFrame:
    behind = listing.after(fx.traces(), F.lit(_SEEK_AT).cast("timestamp"), F.lit(_SEEK_ID))
    return behind.select("project_id", "id", ts("started_at"))


@query("""
    SELECT project_id, id, replace(replace(rtrim(to_base64(encode(
        'v1|' || strftime(started_at, '%Y-%m-%dT%H:%M:%S') || '+00:00|' || id)), '='), '+', '-'), '/', '_') AS cursor
    FROM fx_traces""")
def cursors_encoded(fx: Fixtures) -> DataFrame:
    return fx.traces().select(
        "project_id", "id", cursors.encode(F.col("started_at"), F.col("id")).alias("cursor")
    )


@query(f"""SELECT project_id, {_ts('lo')}, {_ts('hi')} FROM
    (SELECT project_id, min(started_at) AS lo, max(started_at) AS hi FROM fx_observations GROUP BY project_id)""")
def tenant_windows(fx: Fixtures) -> DataFrame:
    stored = fx.windowed_traces(fx.observations(with_model=False))
    windows = stored.groupBy("project_id").agg(
        F.min("observations_started_min").alias("lo"), F.max("observations_started_max").alias("hi")
    )
    return windows.select("project_id", ts("lo"), ts("hi"))


@query("SELECT project_id, trace_id, id, strftime(started_at, '%Y-%m-%d') AS started_date FROM fx_observations")
def bounded_observations(fx: Fixtures) -> DataFrame:
    """The observations of all traces, from files stored by day."""
    obs = fx.observations(with_model=False)
    stored = session.scratch_path(fx.spark, "days")
    tables.append_days(obs, stored)
    found = listing.observations_of(fx.windowed_traces(obs), fx.spark.read.parquet(stored))
    return found.select("project_id", "trace_id", "id", F.col("started_date").cast("string").alias("started_date"))


# --- Pricing ------------------------------------------------------------------
@query("SELECT model, model_norm, count(*) AS n FROM fx_normalised GROUP BY model, model_norm")
def model_normalise(fx: Fixtures) -> DataFrame:
    return fx.observations().groupBy("model").agg(F.count("*").alias("n")).select(
        "model", model_ids.normalize(F.col("model")).alias("model_norm"), "n"
    )


@query(f"""SELECT m.model_norm, r.model_key, {_dec('r.input_usd_per_mtok', 6)}, {_dec('r.output_usd_per_mtok', 6)},
           {_dec('r.cached_input_usd_per_mtok', 6)}
    FROM (SELECT DISTINCT model_norm FROM fx_normalised) m LEFT JOIN fx_resolved r USING (model_norm)""")
def price_lookup(fx: Fixtures) -> DataFrame:
    models = fx.observations().groupBy("model").agg(F.count("*").alias("n"))
    rates = ["input_usd_per_mtok", "output_usd_per_mtok", "cached_input_usd_per_mtok"]
    return pricing.attach_prices(models, fx.prices()).select(
        "model_norm", "model_key", *[dec(r, 6) for r in rates]
    ).distinct()


@query("SELECT model_norm, model_key FROM fx_resolved")
def price_resolution_distinct(fx: Fixtures) -> DataFrame:
    models = fx.observations().select(model_ids.normalize(F.col("model")).alias("model_norm"))
    return pricing.resolve_models(models, fx.prices()).select("model_norm", "model_key")


_SPAN = f"project_id, trace_id, id, {_ts('started_at')}, latency_ms, ordinal"


@query(f"SELECT {_SPAN}, model, {_dec('cost_usd')} FROM fx_priced")
def observation_cost(fx: Fixtures) -> DataFrame:
    return fx.priced().select(
        "project_id", "trace_id", "id", ts("started_at"), "latency_ms", "ordinal", "model", dec("cost_usd")
    )


@query("""SELECT model_norm, count(*) AS observations FROM fx_priced WHERE model_key IS NULL GROUP BY model_norm""")
def unpriced_models(fx: Fixtures) -> DataFrame:
    return pricing.unpriced_models(fx.observations(), fx.prices())


@query(f"""SELECT model_key, {_dec('cached_input_usd_per_mtok', 6)} FROM (
    SELECT model_key, CAST(coalesce(cached_input_usd_per_mtok, input_usd_per_mtok * CAST(0.1 AS decimal(4,2))) AS decimal(12,6)) AS cached_input_usd_per_mtok
    FROM fx_prices)""")
def cached_rate_factor(fx: Fixtures) -> DataFrame:
    listed = fx.prices().withColumn("vendor", F.lit("house"))
    factors = listed.select("vendor").distinct().withColumn("factor", F.lit("0.1").cast("decimal(4,2)"))
    return pricing.build_prices(listed, factors).select("model_key", dec("cached_input_usd_per_mtok", 6))


@query("""SELECT rule, violations FROM (
    SELECT 'prices_positive' AS rule, count(*) FILTER (NOT (input_usd_per_mtok > 0 AND output_usd_per_mtok > 0)) AS violations FROM fx_prices
    UNION ALL SELECT 'key_normalised', count(*) FILTER (model_key <> lower(trim(model_key))) FROM fx_prices
    UNION ALL SELECT 'cached_below_input', count(*) FILTER (cached_input_usd_per_mtok >= input_usd_per_mtok) FROM fx_prices)""")
def price_hygiene(fx: Fixtures) -> DataFrame:
    return admit.violations(fx.prices(), pricing.price_rules())


# --- Merge and dedupe ---------------------------------------------------------
@query(f"""SELECT {_SPAN} FROM fx_observation_deliveries
    QUALIFY row_number() OVER (PARTITION BY project_id, id, fx_observation_deliveries.started_at
                               ORDER BY received_at, batch_id, ordinal) = 1""")
def observation_dedupe(fx: Fixtures) -> DataFrame:
    return fold.dedupe_observations(fx.observation_deliveries()).select(
        "project_id", "trace_id", "id", ts("started_at"), "latency_ms", "ordinal"
    )


@query(f"SELECT project_id, id, name, {_dec('value', 6)} FROM fx_scores")
def score_dedupe(fx: Fixtures) -> DataFrame:
    sent = fx.scores().withColumns({"batch_id": F.lit("a"), "ordinal": F.lit(0), "received_at": F.col("scored_at")})
    again = sent.withColumns({"batch_id": F.lit("b"), "name": F.lit("repeat")})
    return fold.dedupe_scores(again.unionByName(sent)).select("project_id", "id", "name", dec("value", 6))


_SEQ = "strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') || '|' || batch_id || '|' || lpad(CAST(ordinal AS varchar), 12, '0')"


def _last(c: str) -> str:
    return f"arg_max({c}, seq) FILTER ({c} IS NOT NULL) AS {c}"


@query(f"""WITH sent AS (SELECT *, {_SEQ} AS seq FROM fx_trace_deliveries),
    real AS (
      SELECT project_id, id, {', '.join(_last(c) for c in ('name', 'user_id', 'session_id', 'environment', 'release', 'ended_at', 'sdk_version'))},
             arg_max(tags, seq) FILTER (len(tags) > 0) AS tags, arg_max(started_at, seq) AS started_at,
             min(received_at) AS created_at, max(received_at) AS updated_at,
             'phase="' || arg_max(phase, seq) || '",priority="' || max(priority) || '",status="' || max(status) || '"' AS metadata
      FROM sent GROUP BY project_id, id),
    windows AS (
      SELECT project_id, trace_id AS id, min(lo) AS lo, max(hi) AS hi, min(received_at) AS first_at, max(received_at) AS last_at,
             arg_min(lo, strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') || '|' || batch_id) AS stub_start
      FROM fx_batch_windows GROUP BY project_id, trace_id)
    SELECT project_id, id, r.name, user_id, session_id, environment, release, sdk_version,
           coalesce(array_to_string(tags, ','), '') AS tags, coalesce(metadata, '') AS metadata, {_ts('ended_at')},
           strftime(coalesce(r.started_at, stub_start), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
           strftime(lo, '%Y-%m-%d %H:%M:%S.%f') AS observations_started_min,
           strftime(hi, '%Y-%m-%d %H:%M:%S.%f') AS observations_started_max,
           strftime(least(created_at, first_at), '%Y-%m-%d %H:%M:%S.%f') AS created_at,
           strftime(greatest(updated_at, last_at), '%Y-%m-%d %H:%M:%S.%f') AS updated_at
    FROM real r FULL JOIN windows w USING (project_id, id)""")
def trace_fold(fx: Fixtures) -> DataFrame:
    folded = fold.fold_traces(fold.fold_inputs(fx.trace_deliveries(), fx.observation_deliveries()))
    return _folded_columns(folded)


def _folded_columns(folded: DataFrame) -> DataFrame:
    entries = F.transform(
        F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), F.to_json(e["value"]))
    )
    return folded.select(
        "project_id", "id", "name", "user_id", "session_id", "environment", "release", "sdk_version",
        joined("tags"), F.array_join(F.array_sort(entries), ",").alias("metadata"),
        *[ts(c) for c in ("ended_at", "started_at", "observations_started_min", "observations_started_max", "created_at", "updated_at")],
    )


@query()
def trace_fold_in_two_steps(fx: Fixtures) -> DataFrame:
    """Fold of early events, then of that state with the late ones; equals trace_fold."""
    cut = F.col("received_at") < F.lit("1997-01-01").cast("timestamp")
    state = fold.state_events(fold.fold_traces(_delivered(fx, cut)))
    return _folded_columns(fold.merge_states(state, fold.fold_traces(_delivered(fx, ~cut))))


def _delivered(fx: Fixtures, part: Column) -> DataFrame:
    """Fold input of the deliveries in one part."""
    return fold.fold_inputs(fx.trace_deliveries().filter(part), fx.observation_deliveries().filter(part))


ORACLES["trace_fold_in_two_steps"] = ORACLES["trace_fold"]


@query()
def trace_fold_overlapping(fx: Fixtures) -> DataFrame:
    """Three states of events dealt by batch, so that they overlap in time, folded together; equals trace_fold."""
    part = F.pmod(F.xxhash64("batch_id"), F.lit(3))
    states = [fold.state_events(fold.fold_traces(_delivered(fx, part == n))) for n in (2, 0, 1)]
    two = fold.state_events(fold.merge_states(states[0], states[1]))
    return _folded_columns(fold.merge_states(two, states[2]))


ORACLES["trace_fold_overlapping"] = ORACLES["trace_fold"]


@query(f"""SELECT w.project_id, w.batch_id, w.trace_id, {_ts('lo')}, {_ts('hi')}
    FROM fx_batch_windows w WHERE NOT EXISTS (
      SELECT 1 FROM fx_trace_deliveries d
      WHERE d.project_id = w.project_id AND d.batch_id = w.batch_id AND d.id = w.trace_id)""")
def stub_traces(fx: Fixtures) -> DataFrame:
    stubs = fold.stub_traces(fx.trace_deliveries(), fold.batch_windows(fx.observation_deliveries()))
    return stubs.withColumnsRenamed(
        {"observations_started_min": "lo", "observations_started_max": "hi"}
    ).select("project_id", "batch_id", "trace_id", ts("lo"), ts("hi"))


@query(f"SELECT project_id, batch_id, {_ts('received_at')}, trace_id, {_ts('lo')}, {_ts('hi')} FROM fx_batch_windows")
def batch_windows(fx: Fixtures) -> DataFrame:
    return fold.batch_windows(fx.observation_deliveries()).withColumnsRenamed(
        {"observations_started_min": "lo", "observations_started_max": "hi"}
    ).select("project_id", "batch_id", ts("received_at"), "trace_id", ts("lo"), ts("hi"))


def _stored_windows(fx: Fixtures) -> DataFrame:
    """Stored windows that are right only where the trace started on its first span's day."""
    return fx.traces().withColumns(
        {"observations_started_min": F.col("started_at"), "observations_started_max": F.col("ended_at")}
    )


_TRUE_WINDOWS = "SELECT project_id, trace_id AS id, min(started_at) AS lo, max(started_at) AS hi FROM fx_observations GROUP BY project_id, trace_id"


@query(f"""SELECT t.project_id, t.id, strftime(coalesce(lo, t.started_at), '%Y-%m-%d %H:%M:%S.%f') AS observations_started_min,
           strftime(coalesce(hi, t.ended_at), '%Y-%m-%d %H:%M:%S.%f') AS observations_started_max
    FROM fx_traces t LEFT JOIN ({_TRUE_WINDOWS}) w ON t.project_id = w.project_id AND t.id = w.id""")
def window_rebuild(fx: Fixtures) -> DataFrame:
    rebuilt = fold.rebuild_windows(_stored_windows(fx), fx.observations(with_model=False))
    return rebuilt.select("project_id", "id", ts("observations_started_min"), ts("observations_started_max"))


@query(f"""SELECT t.project_id, t.id, strftime(lo, '%Y-%m-%d %H:%M:%S.%f') AS observations_started_min,
           strftime(hi, '%Y-%m-%d %H:%M:%S.%f') AS observations_started_max
    FROM fx_traces t JOIN ({_TRUE_WINDOWS}) w ON t.project_id = w.project_id AND t.id = w.id
    WHERE lo IS DISTINCT FROM t.started_at OR hi IS DISTINCT FROM t.ended_at""")
def window_repair(fx: Fixtures) -> DataFrame:
    wrong = fold.windows_to_repair(_stored_windows(fx), fx.observations(with_model=False))
    return wrong.select("project_id", "id", ts("observations_started_min"), ts("observations_started_max"))


@query(f"""SELECT project_id, id, strftime(lo, '%Y-%m-%d %H:%M:%S.%f') AS observations_started_min,
           strftime(hi, '%Y-%m-%d %H:%M:%S.%f') AS observations_started_max
    FROM ({_TRUE_WINDOWS}) w WHERE id LIKE '%3' AND EXISTS (SELECT 1 FROM fx_traces t WHERE t.project_id = w.project_id AND t.id = w.id)""")
def window_repair_of_some(fx: Fixtures) -> DataFrame:
    """Most stored windows are right and stay out of the repair."""
    obs = fx.observations(with_model=False)
    late = F.when(F.col("id").endswith("3"), F.col("observations_started_max") + F.expr("INTERVAL 1 DAY"))
    stored = fold.rebuild_windows(_stored_windows(fx), obs).withColumn(
        "observations_started_max", F.coalesce(late, F.col("observations_started_max"))
    )
    wrong = fold.windows_to_repair(stored, obs)
    return wrong.select("project_id", "id", ts("observations_started_min"), ts("observations_started_max"))


# --- Normalisation and gates on raw JSON --------------------------------------
def _accepted(batches: DataFrame) -> DataFrame:
    """Parsed and typed once, then judged and filtered from the staged rows."""
    members = session.stage(normalize.read_members(batches), "members")
    return normalize.accepted_members(members, normalize.batch_verdicts(members))


def _json(c: str) -> Column:
    return F.to_json(c).alias(c)


@query(_sql(f"""SELECT 'e' || event_id AS batch_id, $trace[event_id] AS id, $trace[event_id] AS trace_id, event_type AS type,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS started_at, CAST(greatest(0, round_even(value, 0)) AS bigint) AS latency_ms,
           replace(props, ' ', '') AS metadata, true AS admitted
    FROM events"""))
def ingest_events(fx: Fixtures) -> DataFrame:
    obs = normalize.observation_events(_accepted(fx.event_batches()))
    return obs.select(
        "batch_id", "id", "trace_id", "type", ts("started_at"), "latency_ms", _json("metadata"), "admitted"
    )


@query("""SELECT status, reason, count(*) AS batches, CAST(sum(n) AS bigint) AS accepted_observations FROM (
    SELECT CASE WHEN event_type = 'error' THEN 'refused' ELSE 'accepted' END AS status,
           CASE WHEN event_type = 'error' THEN 'id: not a uuid' END AS reason,
           CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS n FROM events) GROUP BY status, reason""")
def batch_verdicts(fx: Fixtures) -> DataFrame:
    verdicts = normalize.batch_verdicts(normalize.read_members(fx.event_batches(bad_type="error")))
    return verdicts.groupBy("status", "reason").agg(
        F.count("*").alias("batches"), F.sum("accepted_observations").alias("accepted_observations")
    )


@query(_sql("""SELECT 't' || o_orderkey AS batch_id, $trace[o_orderkey] AS id, o_orderpriority AS name, 'u' || o_custkey AS user_id,
           o_orderstatus || ',' || substr(o_orderpriority, 1, 1) AS tags, repeat('e', 64) AS environment,
           strftime(o_orderdate - INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS started_at, '9.9' AS sdk_version
    FROM orders"""))
def ingest_traces(fx: Fixtures) -> DataFrame:
    sent = normalize.trace_events(_accepted(fx.order_batches()))
    return sent.select(
        "batch_id", "id", "name", "user_id", joined("tags"), "environment", ts("started_at"), "sdk_version"
    )


_LINE_SQL = _sql("""
    SELECT $span[l_linenumber;l_orderkey] AS id, $trace[l_orderkey] AS trace_id, 'brand' AS model,
           CAST(round_even(l_quantity + 0.5, 0) AS bigint) AS prompt_tokens, CAST(0 AS bigint) AS completion_tokens,
           CAST(l_linenumber AS bigint) AS cached_tokens, CAST(l_linenumber AS varchar) AS prompt_version,
           CASE WHEN l_linestatus = 'F' THEN 'error' END AS level,
           CAST(trunc((l_partkey % 3000) * 1000 / 1000000.0::double * 1000.0::double) AS bigint) AS latency_ms,
           strftime(l_shipdate, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
           l_partkey % 12 - 3 BETWEEN -1 AND 7 AS admitted
    FROM lineitem""")


@query(_LINE_SQL)
def ingest_observations(fx: Fixtures) -> DataFrame:
    obs = normalize.observation_events(_accepted(fx.line_batches()))
    return obs.select(
        "id", "trace_id", "model", "prompt_tokens", "completion_tokens", "cached_tokens", "prompt_version", "level",
        "latency_ms", ts("started_at"), "admitted",
    )


@query(_sql("""WITH starts AS (SELECT conv_id, min(CASE WHEN turn % 2 = 0 THEN turn END) AS s FROM conversations GROUP BY conv_id)
    SELECT $turn[turn] AS id, $trace[conv_id] AS trace_id, role AS type,
           strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(CASE WHEN turn % 2 = 0 THEN turn % 10 ELSE s END), '%Y-%m-%d %H:%M:%S.%f') AS started_at,
           length(text) AS chars
    FROM conversations JOIN starts USING (conv_id)"""))
def ingest_nested(fx: Fixtures) -> DataFrame:
    obs = normalize.observation_events(_accepted(fx.conversation_batches()))
    content = F.try_variant_get("input", "$.content", "string")
    return obs.select("id", "trace_id", "type", ts("started_at"), F.length(content).cast("bigint").alias("chars"))


@query(_sql(f"""SELECT id, name, data_type, {_dec('value', 6)}, value_text, trace_id IS NOT NULL AS targeted FROM (
    SELECT $score[1;doc_id] AS id, 'quality' AS name, 'numeric' AS data_type, quality * 0.5 AS value, NULL::varchar AS value_text, 'x' AS trace_id FROM labels
    UNION ALL SELECT $score[2;doc_id], 'toxic', 'boolean', toxic, NULL, 'x' FROM labels
    UNION ALL SELECT $score[3;doc_id], 'label', 'categorical', NULL, CAST(toxic AS varchar), NULL FROM labels)"""))
def ingest_scores(fx: Fixtures) -> DataFrame:
    sent = normalize.score_events(_accepted(fx.score_batches()))
    return sent.select(
        "id", "name", "data_type", dec("value", 6), "value_text", admit.has_target().alias("targeted")
    )


@query("""SELECT CAST(count(*) AS bigint) AS batches, CAST(2 * count(*) AS bigint) AS accepted_scores,
           CAST(count(*) AS bigint) AS rejected_scores FROM labels""")
def ingest_report(fx: Fixtures) -> DataFrame:
    verdicts = normalize.batch_verdicts(normalize.read_members(fx.score_batches()))
    return verdicts.agg(
        F.count("*").alias("batches"), F.sum("accepted_scores").alias("accepted_scores"),
        F.sum("rejected_scores").alias("rejected_scores"),
    )


@query("""SELECT l_partkey % 12 - 3 AS days_late, count(*) FILTER (l_partkey % 12 - 3 BETWEEN -1 AND 7) AS accepted,
           count(*) FILTER (NOT (l_partkey % 12 - 3 BETWEEN -1 AND 7)) AS rejected
    FROM lineitem GROUP BY ALL""")
def admission_split(fx: Fixtures) -> DataFrame:
    line = fx.table("lineitem").selectExpr(
        "l_partkey % 12 - 3 AS days_late", "cast(l_shipdate AS timestamp) AS started_at"
    ).withColumn("received_at", F.col("started_at") + F.expr("make_dt_interval(cast(days_late AS int))"))
    inside, outside = admit.split_admitted(line)
    marked = inside.withColumn("ok", F.lit(True)).unionByName(outside.withColumn("ok", F.lit(False)))
    return marked.groupBy("days_late").agg(
        F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected")
    )


@query("""WITH m AS (
      SELECT 'b' || (l_orderkey // 1000) AS batch_id, CASE WHEN l_linenumber % 2 = 0 THEN 'flat' ELSE 'nested' END AS channel, l_orderkey AS k FROM lineitem
      UNION ALL SELECT 'b' || (o_orderkey // 1000), 'trace', o_orderkey FROM orders),
    per AS (SELECT batch_id, channel, k, count(*) AS n FROM m GROUP BY ALL),
    b AS (SELECT batch_id, CAST(coalesce(sum(n) FILTER (channel = 'trace'), 0) AS bigint) AS traces,
                 CAST(coalesce(sum(n) FILTER (channel = 'nested'), 0) AS bigint) AS nested,
                 CAST(coalesce(sum(n) FILTER (channel = 'flat'), 0) AS bigint) AS flat,
                 coalesce(max(n) FILTER (channel = 'nested'), 0) AS largest_trace FROM per GROUP BY batch_id)
    SELECT *, CASE WHEN traces > 1000 OR largest_trace > 2000 OR flat > 10000 THEN 'too_large_schema'
                   WHEN nested + flat > 4000 THEN 'too_large_config' ELSE 'accepted' END AS verdict FROM b""")
def batch_gate_counts(fx: Fixtures) -> DataFrame:
    lines = fx.table("lineitem").selectExpr(
        "'b' || (l_orderkey div 1000) AS batch_id",
        "CASE WHEN l_linenumber % 2 = 0 THEN 'flat' ELSE 'nested' END AS channel", "l_orderkey AS trace_id",
    )
    orders = fx.table("orders").selectExpr(
        "'b' || (o_orderkey div 1000) AS batch_id", "'trace' AS channel", "o_orderkey AS trace_id"
    )
    return admit.gate_counts(lines.unionByName(orders), max_observations=4000).drop("scores")


@query("""SELECT 'keys' AS checked, 'scopes_present' AS rule, 0::bigint AS violations
    UNION ALL SELECT 'keys', 'scopes_known', 0
    UNION ALL SELECT 'members', 'role_known', count(*) FILTER (role NOT IN ('owner', 'member')) FROM fx_members
    UNION ALL SELECT 'scores', 'data_type_known', 0
    UNION ALL SELECT 'scores', 'has_target', count(*) FILTER (trace_id IS NULL AND observation_id IS NULL) FROM fx_scores""")
def domain_checks(fx: Fixtures) -> DataFrame:
    checks = {
        "keys": admit.violations(fx.keys(), admit.key_rules()),
        "members": admit.violations(fx.members(), admit.member_rules()),
        "scores": admit.violations(fx.scores(), admit.score_rules()),
    }
    out = None
    for name, df in checks.items():
        part = df.select(F.lit(name).alias("checked"), "rule", "violations")
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT event_id, CAST(greatest(0, round_even(value, 0)) AS bigint) AS whole,
           CAST(greatest(0, round_even(-value, 0)) AS bigint) AS negated,
           CAST(greatest(0, round_even(floor(value) + 0.5, 0)) AS bigint) AS halves, event_id AS digits, CAST(1 AS bigint) AS truth
    FROM events""")
def count_coercion(fx: Fixtures) -> DataFrame:
    shapes = {
        "whole": F.col("value"), "negated": -F.col("value"), "halves": F.floor("value") + F.lit(0.5),
        "digits": F.col("event_id").cast("string"), "truth": F.lit(True),
    }
    doc = F.to_json(F.struct(*[c.alias(n) for n, c in shapes.items()]))
    parsed = fx.table("events").select("event_id", F.parse_json(doc).alias("doc")).select(
        "event_id", *[values.member(F.col("doc"), n).alias(n) for n in shapes]
    )
    return parsed.select(
        "event_id", *[values.count(F.col(n), values.kind(F.col(n))).alias(n) for n in shapes]
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey,
           CAST(trunc((l_partkey % 3000) * 1000 / 1000000.0::double * 1000.0::double) AS bigint) AS latency_ms FROM lineitem""")
def derived_latency(fx: Fixtures) -> DataFrame:
    line = fx.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "cast(l_shipdate AS timestamp) AS a",
        "timestamp_millis(unix_millis(cast(l_shipdate AS timestamp)) + l_partkey % 3000) AS b",
    )
    none = F.lit(None).cast("bigint")
    return line.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        measures.derived_latency(none, F.col("a"), F.col("b")).alias("latency_ms"),
    )


@query("""SELECT doc_id, array_to_string(list_filter([substr(trim(lang), 1, 64), substr(trim(source), 1, 64)],
           lambda x, i: x <> '' AND (i = 1 OR trim(lang) <> trim(source))), ',') AS tags FROM documents""")
def tags_coerced(fx: Fixtures) -> DataFrame:
    doc = F.to_json(F.struct(F.array(F.concat(F.lit(" "), "lang"), F.col("source"), F.lit("  "), F.col("lang")).alias("tags")))
    v = values.member(F.parse_json(doc), "tags")
    tagged = fx.table("documents").select("doc_id", v.alias("v"))
    return tagged.select("doc_id", F.array_join(values.tags(F.col("v"), values.kind(F.col("v"))), ",").alias("tags"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey,
           CASE WHEN l_returnflag = 'R' THEN NULL WHEN l_linestatus = 'F' THEN 'failed' ELSE 'ok' END AS level FROM lineitem""")
def alias_resolution(fx: Fixtures) -> DataFrame:
    """An explicit null in the first alias hides the second one."""
    doc = F.expr(
        """CASE WHEN l_returnflag = 'R' THEN '{"level":null,"status":"ok"}'
                WHEN l_linestatus = 'F' THEN '{"status":"ok","level":" failed "}' ELSE '{"status":"ok"}' END"""
    )
    picked = fx.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        values.members(F.parse_json(doc), ["level", "status"]).alias("p"),
    ).withColumn("v", values.first_present(F.col("p"), ["level", "status"]))
    return picked.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        values.text(F.col("v"), values.kind(F.col("v"))).alias("level"),
    )


# --- Detail and scores --------------------------------------------------------
@query(f"""WITH owners AS (SELECT DISTINCT project_id, id AS observation_id, trace_id AS owner FROM fx_observations),
    shown AS (
      SELECT s.project_id, s.id, s.trace_id AS shown_in FROM fx_scores s WHERE s.trace_id IS NOT NULL
      UNION
      SELECT s.project_id, s.id, o.owner FROM fx_scores s JOIN owners o USING (project_id, observation_id))
    SELECT s.project_id, s.shown_in, s.id FROM shown s JOIN fx_traces t ON t.project_id = s.project_id AND t.id = s.shown_in""")
def trace_scores(fx: Fixtures) -> DataFrame:
    found = detail.scores_of_traces(fx.traces(), fx.observations(with_model=False), fx.scores())
    return found.select("project_id", "shown_in", "id")


@query("""WITH names AS (SELECT project_id, id, arg_min(name, started_at) AS n FROM fx_observations GROUP BY ALL)
    SELECT s.project_id, s.id, CASE WHEN s.observation_id IS NULL THEN 'trace' ELSE coalesce(n, substr(s.observation_id, 1, 8)) END AS target
    FROM fx_scores s LEFT JOIN names ON names.project_id = s.project_id AND names.id = s.observation_id""")
def score_targets(fx: Fixtures) -> DataFrame:
    return detail.score_targets(fx.scores(), fx.observations(with_model=False)).select("project_id", "id", "target")


_SCORE_TEXT = """CASE s.data_type WHEN 'categorical' THEN coalesce(s.value_text, '—')
    WHEN 'boolean' THEN CASE WHEN s.value >= 1 THEN 'yes' ELSE 'no' END ELSE CAST(CAST(s.value AS double) AS varchar) END"""
_SCORE_NEGATIVE = "coalesce((s.data_type = 'boolean' AND s.value < 1) OR (s.data_type = 'numeric' AND s.value < 0), false)"


@query(f"""SELECT o.project_id, o.trace_id, o.id AS observation_id, {_ts('o.started_at')}, s.id AS score_id, s.name AS score_name,
           CASE WHEN s.id IS NOT NULL THEN {_SCORE_TEXT} END AS score_text, CASE WHEN s.id IS NOT NULL THEN {_SCORE_NEGATIVE} END AS score_negative
    FROM fx_observations o LEFT JOIN fx_scores s ON s.project_id = o.project_id AND s.observation_id = o.id""")
def observation_scores(fx: Fixtures) -> DataFrame:
    found = detail.spans_with_scores(fx.observations(with_model=False), fx.scores())
    return found.select(
        "project_id", "trace_id", "observation_id", ts("started_at"), "score_id", "score_name", "score_text", "score_negative"
    )


@query(f"SELECT s.project_id, s.id, s.name, {_SCORE_TEXT} AS score_text, {_SCORE_NEGATIVE} AS negative FROM fx_scores s")
def score_display(fx: Fixtures) -> DataFrame:
    return reports.score_display(fx.scores())


@query("""SELECT project_id, trace_id, count(*) AS observation_count, CAST(sum(coalesce(prompt_tokens, 0)) AS bigint) AS prompt_tokens,
           CAST(sum(coalesce(completion_tokens, 0)) AS bigint) AS completion_tokens,
           CAST(sum(coalesce(cached_tokens, 0)) AS bigint) AS cached_tokens, CAST(sum(coalesce(reasoning_tokens, 0)) AS bigint) AS reasoning_tokens,
           CAST(CASE WHEN sum(coalesce(prompt_tokens, 0)) > 0 AND sum(cached_tokens) > 0
             THEN floor(CAST(sum(cached_tokens) AS double) / CAST(sum(prompt_tokens) AS double) * 100 + 0.5) ELSE 0 END AS bigint) AS cached_percent
    FROM fx_observations GROUP BY project_id, trace_id""")
def detail_totals(fx: Fixtures) -> DataFrame:
    return detail.detail_totals(fx.observations(with_model=False))


# --- Trees --------------------------------------------------------------------
def _tree_sql(source: str, columns: str, tail: str = "") -> str:
    return f"""WITH RECURSIVE
    n AS (SELECT project_id, trace_id, id, parent_observation_id AS parent, started_at,
                 lpad(CAST(epoch_ms(started_at) AS varchar), 15, '0') || id || '/' AS step
          FROM {source} QUALIFY row_number() OVER (PARTITION BY project_id, trace_id, id ORDER BY started_at) = 1),
    top AS (SELECT n.*, n.parent IS NOT NULL AS dangling FROM n LEFT JOIN n p
            ON p.project_id = n.project_id AND p.trace_id = n.trace_id AND p.id = n.parent WHERE p.id IS NULL),
    down AS (
      SELECT project_id, trace_id, id, parent, step AS path, 0 AS depth, CASE WHEN dangling THEN 'missing_parent' ELSE 'root' END AS kind FROM top
      UNION ALL
      SELECT n.project_id, n.trace_id, n.id, n.parent, d.path || n.step, d.depth + 1, 'child'
      FROM down d JOIN n ON n.project_id = d.project_id AND n.trace_id = d.trace_id AND n.parent = d.id),
    every AS (
      SELECT * FROM down
      UNION ALL
      SELECT project_id, trace_id, id, parent, step, 0, 'cycle' FROM n WHERE (project_id, trace_id, id) NOT IN (SELECT (project_id, trace_id, id) FROM down))
    SELECT {columns} FROM every {tail}"""


_TREE = """project_id, trace_id, id, parent AS parent_observation_id, kind, CAST(depth AS bigint) AS depth,
    kind IN ('missing_parent', 'cycle') AS orphaned,
    row_number() OVER (PARTITION BY project_id, trace_id ORDER BY path) AS position"""


@query(_tree_sql("fx_turns", _TREE))
def span_tree(fx: Fixtures) -> DataFrame:
    return tree.span_tree(fx.turns())


@query(_tree_sql("fx_observations", _TREE))
def span_tree_observations(fx: Fixtures) -> DataFrame:
    return tree.span_tree(fx.observations(with_model=False))


@query(_tree_sql("fx_turns", "kind, count(*) AS spans, CAST(max(depth) AS bigint) AS deepest", "GROUP BY kind"))
def tree_kinds(fx: Fixtures) -> DataFrame:
    return tree.span_tree(fx.turns()).groupBy("kind").agg(
        F.count("*").alias("spans"), F.max("depth").alias("deepest")
    )


@query(f"""SELECT project_id, trace_id, id, {_ts('started_at')}, lower(level) = 'error' AS is_error, name AS finish_reason,
           level <> 'ok' AS has_payload, true AS has_details FROM fx_observations""")
def span_facts(fx: Fixtures) -> DataFrame:
    obs = fx.observations(with_model=False).withColumns(
        {
            "input": F.when(F.col("level") != "ok", F.col("name").cast("variant")),
            "output": F.lit(None).cast("variant"),
            "metadata": F.create_map(F.lit("finish_reason"), F.col("name").cast("variant")),
        }
    )
    return tree.span_facts(obs).withColumn("started_at", ts("started_at"))


# --- Tenancy ------------------------------------------------------------------
@query("""SELECT k.project_id, CASE WHEN k.key_hash IS NULL THEN 'unauthenticated'
             WHEN NOT list_contains(k.scopes, 'ingest') THEN 'out_of_scope' END AS refused, count(*) AS batches
    FROM lineitem LEFT JOIN fx_keys k ON k.key_hash = sha256('key-' || l_suppkey) AND k.revoked_at IS NULL GROUP BY ALL""")
def key_attribution(fx: Fixtures) -> DataFrame:
    sent = fx.table("lineitem").selectExpr(
        "'b' || l_orderkey || '-' || l_linenumber AS batch_id", "'key-' || l_suppkey AS api_key"
    )
    return tenancy.attribute_batches(sent, fx.keys()).groupBy("project_id", "refused").agg(
        F.count("*").alias("batches")
    )


@query(f"""SELECT user_id, project_id, p.name, role, strftime(m.created_at, '%Y-%m-%d %H:%M:%S.%f') AS member_since
    FROM fx_members m JOIN fx_projects p USING (project_id)""")
def visible_projects(fx: Fixtures) -> DataFrame:
    found = tenancy.visible_projects(fx.projects(), fx.members())
    return found.select("user_id", "project_id", "name", "role", ts("member_since"))


@query(f"""SELECT project_id, id FROM fx_traces
    WHERE project_id IN (SELECT project_id FROM fx_members WHERE user_id = 'm7')""")
def membership_scope(fx: Fixtures) -> DataFrame:
    return tenancy.rows_of_member(fx.traces(), fx.members(), "m7").select("project_id", "id")


@query(f"SELECT project_id, trace_id, {_ROLLED}, {_dec('total_cost_usd')}, total_latency_ms FROM fx_rollup WHERE project_id = 'p3'")
def tenant_rollup(fx: Fixtures) -> DataFrame:
    mine = tenancy.checked_write(tenancy.tenant_view(fx.priced(), "p3"), "p3")
    return listing.rollup(mine).withColumn("total_cost_usd", dec("total_cost_usd"))


_CROSSING = """SELECT '{0}' AS subject, CAST(count(*) AS bigint) AS checked, CAST(count(*) FILTER (r.project_id IS NULL) AS bigint) AS without_project,
    CAST(count(*) FILTER (EXISTS (SELECT 1 FROM {2} t WHERE t.id = r.{1}) AND NOT EXISTS (SELECT 1 FROM {2} t WHERE t.id = r.{1} AND t.project_id = r.project_id)) AS bigint) AS foreign
    FROM {3} r WHERE r.{1} IS NOT NULL"""
_UNKNOWN = """SELECT '{0}' AS subject, CAST(count(*) AS bigint) AS checked, CAST(count(*) FILTER (project_id IS NULL) AS bigint) AS without_project,
    CAST(count(*) FILTER (project_id NOT IN (SELECT project_id FROM known)) AS bigint) AS foreign FROM {0}"""


@query(f"""WITH known AS (SELECT project_id FROM fx_projects WHERE project_id <> 'p3'),
    traces AS (SELECT CASE WHEN id LIKE '%7' THEN NULL ELSE project_id END AS project_id, id FROM fx_traces),
    observations AS (SELECT CASE WHEN id LIKE '%1' THEN 'p1' ELSE project_id END AS project_id, trace_id FROM fx_observations),
    scores AS (SELECT project_id, trace_id FROM fx_scores)
    {_UNKNOWN.format('traces')} UNION ALL {_UNKNOWN.format('observations')} UNION ALL {_UNKNOWN.format('scores')}
    UNION ALL {_CROSSING.format('observation.trace', 'trace_id', 'traces', 'observations')}
    UNION ALL {_CROSSING.format('score.trace', 'trace_id', 'traces', 'scores')}""")
def isolation_audit(fx: Fixtures) -> DataFrame:
    """Tables with a project missing, rows without one, and observations filed under another's."""
    traces = fx.traces().withColumn("project_id", F.when(~F.col("id").endswith("7"), F.col("project_id")))
    observations = fx.observations(with_model=False).withColumn(
        "project_id", F.when(F.col("id").endswith("1"), "p1").otherwise(F.col("project_id"))
    )
    return tenancy.isolation_audit(
        {"traces": traces, "observations": observations, "scores": fx.scores()},
        fx.projects().filter("project_id <> 'p3'"),
        {"observation.trace": (observations, "trace_id", traces), "score.trace": (fx.scores(), "trace_id", traces)},
    )


@query("""SELECT project_id, id, key_prefix, label, array_to_string(scopes, ',') AS scopes,
           CASE WHEN revoked_at IS NULL THEN 'active' ELSE 'revoked' END AS status FROM fx_keys""")
def key_listing(fx: Fixtures) -> DataFrame:
    return tenancy.key_listing(fx.keys()).select("project_id", "id", "key_prefix", "label", joined("scopes"), "status")


@query("""SELECT id, strftime(CASE WHEN project_id = 'p3' AND revoked_at IS NULL THEN TIMESTAMP '2025-06-01' ELSE revoked_at END, '%Y-%m-%d %H:%M:%S.%f') AS revoked_at
    FROM fx_keys""")
def key_rotation(fx: Fixtures) -> DataFrame:
    at = F.lit("2025-06-01").cast("timestamp")
    return tenancy.revoke_keys(fx.keys(), at, "p3").select("id", ts("revoked_at"))


@query("""SELECT project_id, id FROM fx_keys WHERE revoked_at IS NULL
    QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY created_at, id) = 1""")
def oldest_key(fx: Fixtures) -> DataFrame:
    return tenancy.oldest_live_keys(fx.keys()).select("project_id", "id")


@query("""WITH single AS (SELECT lower(email) AS email, min(id) AS user_id FROM fx_users GROUP BY ALL HAVING count(*) = 1),
    granted AS (SELECT 'p' || (s_suppkey % 25) AS project_id, user_id, 'owner' AS role FROM supplier JOIN single
                ON email = lower(CASE WHEN s_acctbal < 0 THEN 'Shared-' || s_nationkey ELSE 'User-' || s_suppkey END || '@x.org'))
    SELECT project_id, user_id, coalesce(g.role, m.role) AS role FROM fx_members m FULL JOIN granted g USING (project_id, user_id)""")
def membership_grants(fx: Fixtures) -> DataFrame:
    users = fx.users()
    grants = users.select(
        F.concat(F.lit("p"), F.substring("id", 2, 10).cast("bigint") % 25).alias("project_id"),
        F.upper("email").alias("email"), F.lit("owner").alias("role"),
        F.lit("2025-01-01").cast("timestamp").alias("granted_at"),
    )
    return tenancy.grant_memberships(fx.members(), grants, users).select("project_id", "user_id", "role")


def _sign_ins(fx: Fixtures) -> DataFrame:
    """Orders as sign-ins of their customers; the priority decides what happened."""
    return fx.table("orders").selectExpr(
        "'g' || o_custkey AS subject", "'c' || o_custkey || '-' || o_orderkey || '@x.org' AS email",
        "o_orderpriority <> '3-MEDIUM' AS verified",
        "CASE WHEN o_orderstatus = 'F' THEN 'N' || o_orderkey ELSE '' END AS name",
        "cast(NULL AS string) AS avatar_url",
        "CASE WHEN o_orderpriority = '5-LOW' THEN 'sign_out' ELSE 'sign_in' END AS kind",
        "cast(o_orderdate AS timestamp) + make_dt_interval(0, 0, 0, o_orderkey / 1000000BD) AS at",
    )


@query("""WITH s AS (SELECT 'g' || o_custkey AS subject, 'c' || o_custkey || '-' || o_orderkey || '@x.org' AS email,
        CASE WHEN o_orderstatus = 'F' THEN 'N' || o_orderkey ELSE '' END AS name,
        o_orderdate + to_microseconds(o_orderkey) AS seen, o_orderpriority AS p FROM orders)
    SELECT subject, arg_max(email, seen) FILTER (WHERE ok) AS email, arg_max(name, seen) FILTER (WHERE ok) AS name,
           arg_min(CASE WHEN name = '' THEN email ELSE name END, seen) FILTER (WHERE ok) || '''s project' AS project_name,
           count(*) FILTER (p = '5-LOW') AS session_version
    FROM (SELECT *, p NOT IN ('3-MEDIUM', '5-LOW') AS ok FROM s) GROUP BY subject HAVING count(*) FILTER (WHERE ok) > 0""")
def account_fold(fx: Fixtures) -> DataFrame:
    return tenancy.fold_accounts(_sign_ins(fx)).select("subject", "email", "name", "project_name", "session_version")


@query("""SELECT 'traces' AS table_name, count(*) AS kept FROM fx_traces WHERE project_id NOT IN ('p3', 'p4')
    UNION ALL SELECT 'observations', count(*) FROM fx_observations WHERE project_id NOT IN ('p3', 'p4')
    UNION ALL SELECT 'scores', count(*) FROM fx_scores WHERE project_id NOT IN ('p3', 'p4')""")
def tenant_purge(fx: Fixtures) -> DataFrame:
    gone = fx.projects().filter(F.col("project_id").isin("p3", "p4"))
    kept = tenancy.purge_tenants(
        {"traces": fx.traces(), "observations": fx.observations(with_model=False), "scores": fx.scores()}, gone
    )
    out = None
    for name, df in kept.items():
        n = df.agg(F.count("*").alias("kept")).select(F.lit(name).alias("table_name"), "kept")
        out = n if out is None else out.unionByName(n)
    return out


# --- Maintenance --------------------------------------------------------------
_TODAY = date(2024, 4, 5)


@query("""WITH days AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-03-28', TIMESTAMP '2024-05-05', INTERVAL 1 DAY)) AS date) AS day),
    have AS (SELECT DISTINCT CAST(created_at AS date) AS day FROM fx_members),
    lost AS (SELECT CAST(ts + INTERVAL 97 DAY AS date) AS day, count(*) AS stranded FROM events GROUP BY ALL)
    SELECT CAST(d.day AS varchar) AS day, 'p' || strftime(d.day, '%Y%m%d') AS partition, coalesce(stranded, 0) AS stranded,
           CASE WHEN have.day IS NOT NULL THEN 'exists' WHEN stranded > 0 THEN 'skipped' ELSE 'create' END AS status
    FROM days d LEFT JOIN have USING (day) LEFT JOIN lost USING (day)""")
def partition_plan(fx: Fixtures) -> DataFrame:
    placed = fx.members().select(F.to_date("created_at").alias("day"))
    unplaced = fx.table("events").select((F.col("ts").cast("timestamp") + F.expr("INTERVAL 97 DAY")).alias("started_at"))
    plan = maintenance.partition_plan(placed, unplaced, _TODAY)
    return plan.withColumn("day", F.col("day").cast("string"))


@query("""SELECT CAST(CAST(started_at AS date) AS varchar) AS day, count(*) FILTER (CAST(started_at AS date) NOT BETWEEN DATE '1998-06-07' AND DATE '1998-07-15') AS outside,
           count(*) FILTER (level = 'Error') AS misfiled
    FROM fx_observations GROUP BY CAST(started_at AS date) HAVING outside > 0 OR misfiled > 0""")
def stranded_rows(fx: Fixtures) -> DataFrame:
    obs = fx.observations(with_model=False)
    filed = F.when(F.col("level") == "Error", F.date_add(F.to_date("started_at"), 1)).otherwise(F.to_date("started_at"))
    found = maintenance.stranded_rows(obs.withColumn("started_date", filed), date(1998, 6, 15))
    return found.withColumn("day", F.col("day").cast("string"))


@query("""WITH spans AS (SELECT DISTINCT project_id, trace_id, id FROM fx_observations)
    SELECT 'observation.parent' AS reference, count(*) AS missing FROM fx_observations o
    WHERE parent_observation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.project_id = o.project_id AND s.trace_id = o.trace_id AND s.id = o.parent_observation_id)
    UNION ALL SELECT 'observation.trace', count(*) FROM fx_observations o WHERE NOT EXISTS (SELECT 1 FROM fx_traces t WHERE t.project_id = o.project_id AND t.id = o.trace_id)
    UNION ALL SELECT 'score.trace', count(*) FROM fx_scores c WHERE trace_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM fx_traces t WHERE t.project_id = c.project_id AND t.id = c.trace_id)
    UNION ALL SELECT 'score.observation', count(*) FROM fx_scores c WHERE observation_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spans s WHERE s.project_id = c.project_id AND s.id = c.observation_id)""")
def dangling_refs(fx: Fixtures) -> DataFrame:
    return maintenance.dangling_references(fx.traces(), fx.observations(with_model=False), fx.scores())


# --- Flat members beside their traces ------------------------------------------
_KEY = "'00000000-0000-4000-8000-' || lpad(cast({0} AS string), 12, '0')"


def _sibling_batches(fx: Fixtures) -> DataFrame:
    """One batch per customer: its orders as traces, some sent again with a later start, and their items flat."""
    stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    def sent(shift: int) -> Column:
        at = F.date_format(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=F.lit(shift)), stamp)
        return F.struct(F.expr(_KEY.format("o_orderkey")).alias("id"), at.alias("start_time"))

    traces = fx.table("orders").groupBy("o_custkey").agg(
        F.concat(F.collect_list(sent(0)), F.collect_list(F.when(F.col("o_orderkey") % 3 == 0, sent(1)))).alias("traces")
    )
    item = F.struct(
        F.expr(_KEY.format("l_orderkey * 8 + l_linenumber")).alias("id"),
        F.expr(_KEY.format("if(l_linenumber = 7, 999999999999, l_orderkey)")).alias("trace_id"),
        F.when(F.col("l_linenumber") % 2 == 0, F.date_format(F.col("l_shipdate").cast("timestamp"), stamp)).alias("start_time"),
    )
    items = (
        fx.table("lineitem").join(fx.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy("o_custkey").agg(F.collect_list(item).alias("observations"))
    )
    return traces.join(items, "o_custkey").select(
        F.concat(F.lit("c"), "o_custkey").alias("batch_id"), F.lit("2000-01-01").cast("timestamp").alias("received_at"),
        F.lit("p0").alias("project_id"), F.to_json(F.struct("traces", "observations")).alias("body"),
    )


@query(_sql("""SELECT $trace[l_orderkey * 8 + l_linenumber] AS id, strftime(CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS timestamp)
        WHEN l_linenumber = 7 THEN TIMESTAMP '2000-01-01'
        ELSE CAST(o_orderdate AS timestamp) + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END END, '%Y-%m-%d %H:%M:%S.%f') AS started_at
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""))
def ingest_siblings(fx: Fixtures) -> DataFrame:
    """Flat observations without a start take it from the batch's last trace of their id, else from the receipt."""
    members = normalize.read_members(_sibling_batches(fx))
    return normalize.observation_events(members).select("id", ts("started_at"))


_SIBLING_WINDOWS = """SELECT 'c' || o_custkey AS batch_id, CASE WHEN l_linenumber = 7 THEN '00000000-0000-4000-8000-999999999999' ELSE $trace[l_orderkey] END AS trace_id,
    min(began) AS lo, max(began) AS hi FROM (SELECT o_custkey, l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_shipdate AS timestamp)
        WHEN l_linenumber = 7 THEN TIMESTAMP '2000-01-01'
        ELSE CAST(o_orderdate AS timestamp) + CASE WHEN o_orderkey % 3 = 0 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END END AS began
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL"""


@query(_sql(f"""SELECT batch_id, trace_id, {_ts('lo')}, {_ts('hi')} FROM ({_SIBLING_WINDOWS})"""))
def sibling_windows(fx: Fixtures) -> DataFrame:
    """Per batch and trace the span of starts of several observations."""
    members = normalize.read_members(_sibling_batches(fx))
    return _windows(fold.batch_windows(normalize.observation_events(members)))


@query(_sql(f"""SELECT batch_id, trace_id, {_ts('lo')}, {_ts('hi')} FROM ({_SIBLING_WINDOWS}) WHERE trace_id LIKE '%999999999999'"""))
def sibling_stubs(fx: Fixtures) -> DataFrame:
    """Only the trace that the batches don't carry is a stub; all others have a real send beside them."""
    members = session.stage(normalize.read_members(_sibling_batches(fx)), "siblings")
    windows = fold.batch_windows(normalize.observation_events(members))
    return _windows(fold.stub_traces(normalize.trace_events(members), windows))


def _windows(df: DataFrame) -> DataFrame:
    named = df.withColumnsRenamed({"observations_started_min": "lo", "observations_started_max": "hi"})
    return named.select("batch_id", "trace_id", ts("lo"), ts("hi"))


@query("""WITH n AS (SELECT o_custkey, count(*) + count(*) FILTER (o_orderkey % 3 = 0) AS traces FROM orders GROUP BY o_custkey),
    i AS (SELECT o_custkey, count(*) AS items FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey)
    SELECT 'c' || o_custkey AS batch_id, CASE WHEN traces > 14 OR items > 45 THEN 'refused' ELSE 'accepted' END AS status,
           CASE WHEN traces > 14 OR items > 45 THEN 'too_large_config' END AS reason,
           CAST(CASE WHEN traces > 14 OR items > 45 THEN 0 ELSE traces END AS bigint) AS accepted_traces
    FROM n JOIN i USING (o_custkey)""")
def batch_ceilings(fx: Fixtures) -> DataFrame:
    """Batches beyond the configured ceilings are refused whole."""
    members = normalize.read_members(_sibling_batches(fx), max_traces=14, max_observations=45)
    return normalize.batch_verdicts(members).select("batch_id", "status", "reason", "accepted_traces")


# --- Streaming ----------------------------------------------------------------
def _event_stream(fx: Fixtures) -> DataFrame:
    # A pattern matches a file and a folder of files alike.
    return fx.spark.readStream.schema(fx.table("events").schema).parquet(f"{fx.sf_dir.rstrip('/')}/events.parque[t]")


@query(_sql(f"""SELECT $trace[event_id] AS id, {_ts('ts')}, event_type AS type FROM events"""))
def stream_dedupe(fx: Fixtures) -> DataFrame:
    """Each event arrives twice, in several micro-batches, the newest first, and is kept once."""
    sent = fx.table("events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).selectExpr(
        "'p' || (user_id % 25) AS project_id", TRACE_ID_OF_EVENT, "cast(ts AS timestamp) AS started_at", "event_type AS type",
        "cast(ts AS timestamp) + make_dt_interval(copy) AS received_at", "'b' || copy AS batch_id", "event_id AS ordinal", "copy",
    )
    inbox, out = session.scratch_path(fx.spark, "dedupe-in"), session.scratch_path(fx.spark, "dedupe")
    sent.repartitionByRange(4, F.col("started_at").desc(), "copy").write.parquet(inbox)
    arriving = fx.spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(inbox).drop("copy")
    ingest.start_dedupe(arriving, out, f"{out}-state", available_now=True).awaitTermination()
    return fx.spark.read.parquet(out).select("id", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"), "type")


TRACE_ID_OF_EVENT = "'00000000-0000-4000-8000-' || lpad(cast(event_id AS string), 12, '0') AS id"


@query(_sql("""SELECT $trace[event_id] AS id, 1::bigint AS observations, CAST(greatest(0, round_even(value, 0)) AS bigint) AS total_latency_ms,
           strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS started_at
    FROM events"""))
def stream_ingest(fx: Fixtures) -> DataFrame:
    """Raw bodies from a stream through normalise, gates, prices, dedupe and fold."""
    root = session.scratch_path(fx.spark, "ingest")
    layout = ingest.Layout.under(root)
    ingest.start_ingest(_raw_events(_event_stream(fx)), layout, f"{root}/state", fx.prices(), available_now=True).awaitTermination()
    return _ingested(fx, layout)


def _raw_events(events: DataFrame, *more: str) -> DataFrame:
    doc = F.struct(
        F.expr(TRACE_ID_OF_EVENT).alias("id"), F.col("event_type").alias("type"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start_time"), F.col("value").alias("latency_ms"),
    )
    return events.select(
        F.concat(F.lit("e"), "event_id").alias("batch_id"),
        (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("received_at"),
        F.lit("p0").alias("project_id"),
        F.to_json(F.struct(F.array(doc, doc).alias("events"))).alias("body"), *more,
    )


def _ingested(fx: Fixtures, layout: ingest.Layout) -> DataFrame:
    stored = fx.spark.read.parquet(layout.observations)
    traces = tables.read_traces(fx.spark, layout.trace_log)
    rolled = listing.rollup(stored.withColumn("total_tokens", F.lit(0)))
    return listing.with_rollup(traces, rolled).select(
        "id", F.col("observation_count").alias("observations"), "total_latency_ms", ts("started_at")
    )


@query()
def stream_restart(fx: Fixtures) -> DataFrame:
    """Two streams with fresh checkpoints into one layout, a third of the events in both; equals stream_ingest."""
    root = session.scratch_path(fx.spark, "restart")
    layout = ingest.Layout.under(root)
    for name, own in (("first", F.col("event_id") % 3 < 2), ("second", F.col("event_id") % 3 > 0)):
        raw = _raw_events(_event_stream(fx).filter(own))
        ingest.start_ingest(raw, layout, f"{root}/{name}", fx.prices(), available_now=True, stream=name).awaitTermination()
    return _ingested(fx, layout)


ORACLES["stream_restart"] = ORACLES["stream_ingest"]


@query(_sql("""SELECT 'late' AS kind, $trace[event_id] AS id, '2024-06' AS version FROM events WHERE event_id % 4 = 0
    UNION ALL SELECT 'untargeted', 'e' || event_id, '2024-06' FROM events WHERE event_id % 4 = 1
    UNION ALL SELECT 'refused', '{"n":' || event_id || '}', '2024-06' FROM events WHERE event_id % 4 = 2
    UNION ALL SELECT 'stored', $trace[event_id], '2024-06' FROM events WHERE event_id % 4 = 3"""))
def stream_rejects(fx: Fixtures) -> DataFrame:
    """What a stream sets aside: late observations, scores without a target, refused bodies; and what it stores."""
    start = F.when(F.col("event_id") % 4 == 0, F.expr("ts - INTERVAL 40 DAYS")).otherwise(F.col("ts"))
    span = F.struct(F.expr(TRACE_ID_OF_EVENT).alias("id"), F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start_time"))
    score = F.struct(F.lit("s").alias("name"), F.lit(1).alias("value"))
    body = (
        F.when(F.col("event_id") % 4 == 1, F.to_json(F.struct(F.array(score).alias("scores"))))
        .when(F.col("event_id") % 4 == 2, F.concat(F.lit('{"n":'), "event_id", F.lit("}")))
        .otherwise(F.to_json(F.struct(F.array(span).alias("observations"))))
    )
    raw = _event_stream(fx).select(
        F.concat(F.lit("e"), "event_id").alias("batch_id"), F.col("ts").cast("timestamp").alias("received_at"),
        F.lit("p0").alias("project_id"), body.alias("body"),
    )
    root = session.scratch_path(fx.spark, "rejects")
    layout = ingest.Layout.under(root)
    ingest.start_ingest(raw, layout, f"{root}/state", fx.prices(), available_now=True, price_version="2024-06").awaitTermination()
    read = fx.spark.read.parquet
    given = F.lit("2024-06").alias("version")
    return (
        read(layout.late_observations).select(F.lit("late").alias("kind"), "id", given)
        .unionByName(read(layout.untargeted_scores).select(F.lit("untargeted").alias("kind"), F.col("batch_id").alias("id"), given))
        .unionByName(read(layout.refusals).select(F.lit("refused").alias("kind"), F.col("body").alias("id"), given))
        .unionByName(read(layout.observations).select(F.lit("stored").alias("kind"), "id", F.col("pricebook_version").alias("version")))
    )


@query()
def stream_merge(fx: Fixtures) -> DataFrame:
    """Deliveries in four epochs that overlap in time, merged into stored buckets; equals trace_fold and folds nothing when read."""
    root = session.scratch_path(fx.spark, "merge")
    part = F.pmod(F.xxhash64("batch_id"), F.lit(4))
    for n in range(4):
        events = _delivered(fx, part == n)
        events.write.mode("append").parquet(f"{root}/in")
        # The stream goes on where it stopped; all files that are new make one epoch, however many tasks wrote them.
        arriving = fx.spark.readStream.schema(events.schema).parquet(f"{root}/in")
        ingest.start_merge(arriving, f"{root}/traces", f"{root}/state", available_now=True, buckets=16).awaitTermination()
        trace_store.drop_old_versions(fx.spark, f"{root}/traces")  # nothing reads them here
    return _folded_columns(trace_store.read_traces(fx.spark, f"{root}/traces"))


ORACLES["stream_merge"] = ORACLES["trace_fold"]


@query(_sql("""SELECT $trace[event_id] AS id, 'stored' AS kind FROM events WHERE event_id % 2 = 0
    UNION ALL SELECT 'e' || event_id, 'denied' FROM events WHERE event_id % 2 = 1"""))
def stream_replay(fx: Fixtures) -> DataFrame:
    """An epoch written twice, with a key revoked in between: nothing of the first attempt stays."""
    layout = ingest.Layout.under(session.scratch_path(fx.spark, "replay"))
    key = F.when(F.col("event_id") % 2 == 0, "key-2").otherwise("key-3")
    events = fx.table("events").withColumn("api_key", key)
    raw = _raw_events(events, "api_key").drop("project_id")
    keys = fx.keys().withColumn("revoked_at", F.lit(None).cast("timestamp"))
    ingest.write_epoch(raw, 0, layout, fx.prices(), keys)
    revoked = F.when(F.col("key_prefix") == "key-3", F.lit("1990-01-01").cast("timestamp"))
    ingest.write_epoch(raw, 0, layout, fx.prices(), keys.withColumn("revoked_at", revoked))
    read = fx.spark.read.parquet
    return read(layout.observations).select("id", F.lit("stored").alias("kind")).unionByName(
        read(layout.refusals).select(F.col("batch_id").alias("id"), F.lit("denied").alias("kind"))
    )


@query(_sql(f"""WITH sent AS (SELECT *, {_SEQ} AS seq FROM fx_trace_deliveries),
    real AS (SELECT project_id, id, arg_max(started_at, seq) AS started_at FROM sent GROUP BY project_id, id),
    windows AS (SELECT project_id, trace_id AS id,
        arg_min(lo, strftime(received_at, '%Y-%m-%d %H:%M:%S.%f') || '|' || batch_id) AS stub_start
      FROM fx_batch_windows GROUP BY project_id, trace_id)
    SELECT project_id, id, 'created' AS change, CAST(NULL AS varchar) AS started_before,
        strftime(stub_start, '%Y-%m-%d %H:%M:%S.%f') AS started_after FROM windows
    UNION ALL SELECT project_id, id, CASE WHEN w.id IS NULL THEN 'created' ELSE 'arrived' END,
        strftime(stub_start, '%Y-%m-%d %H:%M:%S.%f'), strftime(started_at, '%Y-%m-%d %H:%M:%S.%f')
    FROM real r LEFT JOIN windows w USING (project_id, id)"""))
def stream_late_traces(fx: Fixtures) -> DataFrame:
    """Spans two epochs before their traces: the stubs that appear, and the traces that take their place."""
    path = session.scratch_path(fx.spark, "late")
    traces = fold.fold_inputs(fx.trace_deliveries(), fx.observation_deliveries().limit(0))

    def merge(events: DataFrame, epoch: int) -> None:
        trace_store.merge_epoch(events, path, epoch, buckets=16)
        trace_store.drop_old_versions(fx.spark, path)  # nothing reads them here

    with session.staged(fold.fold_inputs(fx.trace_deliveries().limit(0), fx.observation_deliveries()), "late-spans") as spans:
        merge(spans, 0)
        merge(spans, 1)
    merge(traces, 2)
    return trace_store.read_changes(fx.spark, path).select(
        "project_id", "id", "change", ts("started_before"), ts("started_after")
    )


@query("""SELECT project_id, session_id, id, strftime(started_at, '%Y-%m-%d %H:%M:%S.%f') AS started_at,
        row_number() OVER (PARTITION BY project_id, session_id ORDER BY fx_listed.started_at, id) AS position, total_tokens
    FROM fx_listed WHERE session_id IS NOT NULL""")
def session_traces(fx: Fixtures) -> DataFrame:
    found = reports.session_traces(listing.list_all(fx.traces(), fx.priced()))
    return found.select("project_id", "session_id", "id", ts("started_at"), "position", "total_tokens")


# --- Reports ------------------------------------------------------------------
@query(f"""SELECT p.name AS project_name, t.name AS trace_name, t.id AS trace_id, o.id AS observation_id, {_ts('o.started_at')},
           'p' || strftime(o.started_at, '%Y%m%d') AS partition
    FROM fx_projects p JOIN fx_traces t USING (project_id) LEFT JOIN fx_observations o ON o.project_id = t.project_id AND o.trace_id = t.id""")
def placement(fx: Fixtures) -> DataFrame:
    return reports.placement(fx.projects(), fx.traces(), fx.observations(with_model=False)).select(
        "project_name", "trace_name", "trace_id", "observation_id", ts("started_at"), "partition"
    )


_DURATION = """CASE WHEN {c} IS NULL THEN '—' WHEN {c} < 1000 THEN format('{{:,}}ms', {c})
    WHEN {c} < 60000 THEN CASE WHEN {c} % 250 = 125 THEN printf('%.2f', ({c} + 5) / 1000.0) ELSE printf('%.2f', {c} / 1000.0) END || 's'
    ELSE ({c} // 60000) || 'm ' || CAST(floor(({c} % 60000) / 1000.0 + 0.5) AS bigint) || 's' END"""
_AS_OF = "TIMESTAMP '1999-01-01 00:00:00'"
_AGE = f"""CASE WHEN started_at > {_AS_OF} + INTERVAL 500 MILLISECOND THEN 'just now'
    WHEN started_at = {_AS_OF} THEN '0s ago'
    ELSE floor((epoch({_AS_OF}) - epoch(started_at)) / 86400 + 0.5)::bigint || 'd ago' END"""
_COST = """CASE WHEN total_cost_usd = 0 THEN '$0'
    WHEN total_cost_usd < 0.000001 THEN '$' || CASE WHEN total_cost_usd >= 0.0000001 THEN CAST(CAST(total_cost_usd * 10000000 AS decimal(10,3)) AS varchar) || 'e-7'
         ELSE CAST(CAST(total_cost_usd * 100000000 AS decimal(10,3)) AS varchar) || 'e-8' END
    WHEN total_cost_usd < 0.01 THEN '$' || rtrim(rtrim(CAST(CASE WHEN total_cost_usd >= 0.001 THEN round(total_cost_usd, 6)
         WHEN total_cost_usd >= 0.0001 THEN round(total_cost_usd, 7) ELSE total_cost_usd END AS varchar), '0'), '.')
    WHEN total_cost_usd < 1 THEN '$' || CAST(CAST(round(total_cost_usd, 4) AS decimal(28,4)) AS varchar)
    ELSE '$' || CAST(CAST(round(total_cost_usd, 2) AS decimal(28,2)) AS varchar) END"""


@query(f"""SELECT project_id, id, substr(id, 1, 8) AS short_id, format('{{:,}}', total_tokens) AS tokens_text, {_COST} AS cost_text,
           {_DURATION.format(c='total_latency_ms')} AS model_time_text, {_DURATION.format(c='duration_ms')} AS duration_text,
           {_AGE} AS age_text FROM fx_listed""")
def trace_display(fx: Fixtures) -> DataFrame:
    listed = listing.list_all(fx.traces(), fx.priced())
    return reports.trace_display(listed, F.lit("1999-01-01 00:00:00").cast("timestamp"))


@query("""SELECT event_id, 'finish_reason:stop|http_status:' || (event_id % 500) || '|a_ms:' ||
           CASE WHEN event_id < 1000 THEN event_id || 'ms' WHEN event_id < 60000
                THEN (CASE WHEN event_id % 250 = 125 THEN printf('%.2f', (event_id + 5) / 1000.0) ELSE printf('%.2f', event_id / 1000.0) END) || 's'
                ELSE (event_id // 60000) || 'm ' || CAST(floor((event_id % 60000) / 1000.0 + 0.5) AS bigint) || 's' END
           || '|b:' || event_type || ', x|c:—|d:' || replace(props, ' ', '') AS shown FROM events""")
def metadata_display(fx: Fixtures) -> DataFrame:
    doc = F.struct(
        F.parse_json("props").alias("d"), F.lit(None).cast("string").alias("c"), F.array("event_type", F.lit("x")).alias("b"),
        F.col("event_id").alias("a_ms"), (F.col("event_id") % 500).alias("http_status"), F.lit("stop").alias("finish_reason"),
    )
    body = F.to_json(doc, {"ignoreNullFields": "false"})
    shown = fx.table("events").select("event_id", F.from_json(body, "map<string,variant>").alias("metadata"))
    entries = F.transform(
        display.ordered_metadata(F.col("metadata")), lambda e: F.concat(e["key"], F.lit(":"), e["value"])
    )
    return shown.select("event_id", F.array_join(entries, "|").alias("shown"))


@query("""WITH o AS (SELECT DISTINCT project_id, id, prompt_name, prompt_version FROM fx_observations)
    SELECT project_id, prompt_name, prompt_version, s.name AS score_name, count(*) AS scores,
           CAST(round(avg(CAST(value AS double)), 6) AS decimal(18,6))::varchar AS mean_value
    FROM fx_scores s JOIN o USING (project_id) WHERE s.observation_id = o.id AND value IS NOT NULL GROUP BY ALL""")
def score_by_prompt_version(fx: Fixtures) -> DataFrame:
    found = reports.scores_by_prompt_version(fx.observations(with_model=False), fx.scores())
    return found.withColumn("mean_value", F.round("mean_value", 6).cast("decimal(18,6)").cast("string"))


@query("""SELECT project_id, name, strftime(date_trunc('day', scored_at), '%Y-%m-%d') AS bucket, count(*) AS scores,
           CAST(round(avg(CAST(value AS double)), 6) AS decimal(18,6))::varchar AS mean_value
    FROM fx_scores WHERE value IS NOT NULL GROUP BY ALL""")
def score_series(fx: Fixtures) -> DataFrame:
    return reports.score_series(fx.scores()).select(
        "project_id", "name", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "scores",
        F.round("mean_value", 6).cast("decimal(18,6)").cast("string").alias("mean_value"),
    )


def _spend_sql(attribute: str) -> str:
    value = "unnest(tags)" if attribute == "tags" else attribute
    return f"""SELECT '{attribute}' AS attribute, project_id, value, count(*) AS traces, CAST(sum(total_tokens) AS bigint) AS total_tokens,
        CAST(CAST(sum(total_cost_usd) AS decimal(38,8)) AS varchar) AS total_cost_usd
        FROM (SELECT project_id, {value} AS value, total_tokens, total_cost_usd FROM fx_listed) GROUP BY ALL"""


_ATTRIBUTES = ["environment", "release", "tags", "user_id"]


@query(" UNION ALL ".join(_spend_sql(a) for a in _ATTRIBUTES))
def spend_by_attribute(fx: Fixtures) -> DataFrame:
    found = reports.spend_by(listing.list_all(fx.traces(), fx.priced()), _ATTRIBUTES)
    return found.withColumn("total_cost_usd", dec("total_cost_usd"))


@query("""SELECT project_id, name, count(*) FILTER (release = 'r1996') AS r1996_traces,
           CAST(CAST(coalesce(sum(total_cost_usd) FILTER (release = 'r1996'), 0) AS decimal(38,8)) AS varchar) AS r1996_cost_usd,
           count(*) FILTER (release = 'r1997') AS r1997_traces,
           CAST(CAST(coalesce(sum(total_cost_usd) FILTER (release = 'r1997'), 0) AS decimal(38,8)) AS varchar) AS r1997_cost_usd
    FROM fx_listed GROUP BY project_id, name""")
def release_comparison(fx: Fixtures) -> DataFrame:
    found = reports.release_comparison(listing.list_all(fx.traces(), fx.priced()), ["r1996", "r1997"])
    return found.withColumns({c: dec(c) for c in ("r1996_cost_usd", "r1997_cost_usd")})


@query("""SELECT CAST(CAST(created_at AS date) AS varchar) AS day, count(*) AS rows,
           CAST(min(epoch_us(created_at) - epoch_us(started_at)) // 1000000 AS bigint) AS min_seconds,
           CAST(max(epoch_us(created_at) - epoch_us(started_at)) // 1000000 AS bigint) AS max_seconds,
           CAST(3600 AS bigint) AS median_seconds FROM fx_traces GROUP BY CAST(created_at AS date)""")
def delivery_lag(fx: Fixtures) -> DataFrame:
    lag = reports.delivery_lag(fx.traces())
    seconds = [F.col(c).cast("bigint").alias(c) for c in ("min_seconds", "max_seconds", "median_seconds")]
    return lag.select(F.col("day").cast("string").alias("day"), "rows", *seconds)


@query("""SELECT project_id, sdk_version, count(*) AS traces, strftime(max(started_at), '%Y-%m-%d %H:%M:%S.%f') AS last_seen
    FROM fx_traces GROUP BY project_id, sdk_version""")
def sdk_usage(fx: Fixtures) -> DataFrame:
    return reports.sdk_versions(fx.traces()).withColumn("last_seen", ts("last_seen"))


@query("""SELECT project_id, session_id, count(*) AS traces, strftime(min(started_at), '%Y-%m-%d %H:%M:%S.%f') AS first_started_at,
           strftime(max(started_at), '%Y-%m-%d %H:%M:%S.%f') AS last_started_at, CAST(sum(total_tokens) AS bigint) AS total_tokens,
           CAST(CAST(sum(total_cost_usd) AS decimal(38,8)) AS varchar) AS total_cost_usd
    FROM fx_listed GROUP BY project_id, session_id""")
def session_view(fx: Fixtures) -> DataFrame:
    found = reports.sessions(listing.list_all(fx.traces(), fx.priced()))
    return found.withColumns(
        {"first_started_at": ts("first_started_at"), "last_started_at": ts("last_started_at"), "total_cost_usd": dec("total_cost_usd")}
    )


_CUBE_SETS = [[], ["project_id"], ["environment"], ["project_id", "environment"], ["project_id", "release"], ["project_id", "environment", "release"]]


@query("""SELECT project_id, environment, release, CAST(grouping(project_id) * 4 + grouping(environment) * 2 + grouping(release) AS integer) AS level,
        count(*) AS traces, CAST(sum(total_tokens) AS bigint) AS total_tokens,
        CAST(CAST(sum(total_cost_usd) AS decimal(38,8)) AS varchar) AS total_cost_usd, count(DISTINCT user_id) AS users, true AS users_close
    FROM fx_listed GROUP BY GROUPING SETS ((), (project_id), (environment), (project_id, environment), (project_id, release),
        (project_id, environment, release))""")
def spend_cube(fx: Fixtures) -> DataFrame:
    """Spend by six sets of groups from stored days; users estimated by sketches, held against an exact count."""
    listed = session.stage(
        listing.list_all(fx.traces(), fx.priced()).select(*sketches.GROUPS, "started_at", "user_id", "total_tokens", "total_cost_usd"), "listed"
    )
    cube = sketches.spend_cube(session.stage(sketches.daily_spend(listed), "daily-spend"), _CUBE_SETS)
    sets = [[F.col(c) for c in s] for s in _CUBE_SETS]
    exact = listed.groupingSets(sets, *sketches.GROUPS).agg(
        F.grouping_id(*sketches.GROUPS).cast("int").alias("level"), F.count_distinct("user_id").alias("_exact")
    )
    same = F.lit(True)
    for c in (*sketches.GROUPS, "level"):
        same = same & F.col(f"c.{c}").eqNullSafe(F.col(f"e.{c}"))
    # Four standard errors.
    close = F.abs(F.col("c.users") - F.col("_exact")) <= F.greatest(F.lit(1.0), 0.0325 * F.col("_exact"))
    return cube.alias("c").join(exact.alias("e"), same).select(
        *[f"c.{c}" for c in (*sketches.GROUPS, "level", "traces", "total_tokens")],
        F.col("c.total_cost_usd").cast("string").alias("total_cost_usd"), F.col("_exact").alias("users"), close.alias("users_close"),
    )


@query("""SELECT project_id, strftime(date_trunc('month', started_at + to_milliseconds(latency_ms)), '%Y-%m-%d') AS bucket, count(*) AS rows,
        min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, true AS median_close, true AS q95_close
    FROM fx_observations GROUP BY ALL""")
def delivery_lag_months(fx: Fixtures) -> DataFrame:
    """Lags per month from stored days; the median and the 95 % quantile hold against the ranks of all rows."""
    rows = fx.observations(with_model=False).withColumn("created_at", F.timestamp_millis(F.unix_millis("started_at") + F.col("latency_ms")))
    month = F.date_trunc("month", "day")
    found = sketches.lag_over(session.stage(sketches.daily_lag(rows), "daily-lag"), month)
    lags = sketches.lag_ms(rows).select("project_id", F.date_trunc("month", "created_at").alias("bucket"), "lag_ms")
    ranks = session.lookup_join(lags, found, ["project_id", "bucket"], [F.col("lag_ms")], how="inner")

    def close(q: float, c: str) -> Column:
        # The share of rows below, and up to, the value must hold the quantile, but for the sketch's error and one row.
        slack = sketches.LAG_RANK_ERROR * F.count("*") + 1
        below, upto = F.count_if(F.col("lag_ms") < F.col(c)), F.count_if(F.col("lag_ms") <= F.col(c))
        return (below <= q * F.count("*") + slack) & (upto >= q * F.count("*") - slack)

    return ranks.groupBy("project_id", "bucket", "rows", "min_ms", "max_ms").agg(
        close(0.5, "q50_ms").alias("median_close"), close(0.95, "q95_ms").alias("q95_close")
    ).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd"))


@query()
def score_series_stream(fx: Fixtures) -> DataFrame:
    """Scores that come in four micro-batches, summed by day in a stream; equals score_series."""
    root = session.scratch_path(fx.spark, "series")
    scores = fx.scores().select("project_id", "name", "value", "scored_at")
    scores.repartitionByRange(4, "scored_at").write.parquet(f"{root}/in")
    arriving = fx.spark.readStream.schema(scores.schema).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")
    series.start_score_series(arriving, f"{root}/out", f"{root}/state", lateness="3650 days", available_now=True).awaitTermination()
    return series.read_score_series(fx.spark, f"{root}/out").select(
        "project_id", "name", F.date_format("bucket", "yyyy-MM-dd").alias("bucket"), "scores",
        F.round("mean_value", 6).cast("decimal(18,6)").cast("string").alias("mean_value"),
    )


ORACLES["score_series_stream"] = ORACLES["score_series"]
