"""Telemetry views over the test tables, for Spark and as SQL for the checker.

Every view keeps all rows of its tables. Ids are UUID text built from the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import model, session


class Fixtures:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = session.prepare(spark)
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    # -- dimensions ----------------------------------------------------------
    def projects(self) -> DataFrame:
        return self.table("nation").selectExpr("'p' || n_nationkey AS project_id", "n_name AS name")

    def members(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "'p' || s_nationkey AS project_id", "'m' || s_suppkey AS user_id",
            "CASE WHEN s_acctbal >= 0 THEN 'owner' ELSE 'member' END AS role",
            "TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(cast(s_suppkey AS int)) AS created_at",
        )

    def users(self) -> DataFrame:
        """Every user has an address; those of one bank balance sign share spelling only."""
        return self.table("supplier").selectExpr(
            "'m' || s_suppkey AS id",
            "CASE WHEN s_acctbal < 0 THEN 'Shared-' || s_nationkey ELSE 'User-' || s_suppkey END || '@x.org' AS email",
        )

    def keys(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "'k' || s_suppkey AS id", "'p' || s_nationkey AS project_id",
            "sha2('key-' || s_suppkey, 256) AS key_hash",
            "substring('key-' || s_suppkey, 1, 6) AS key_prefix", "s_name AS label",
            """CASE s_suppkey % 3 WHEN 0 THEN array('ingest') WHEN 1 THEN array('read')
               ELSE array('ingest', 'read') END AS scopes""",
            "TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(cast(s_suppkey AS int)) AS created_at",
            "CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP'2025-01-01 00:00:00' END AS revoked_at",
        )

    def prices(self) -> DataFrame:
        brands = self.table("part").selectExpr("cast(substring(p_brand, 7) AS int) AS n").distinct()
        return brands.selectExpr(
            "'brand-' || n AS model_key",
            "cast(n * 0.05BD AS decimal(12,6)) AS input_usd_per_mtok",
            "cast(n * 0.2BD AS decimal(12,6)) AS output_usd_per_mtok",
            "cast(CASE WHEN n % 3 <> 0 THEN n * 0.005BD END AS decimal(12,6)) AS cached_input_usd_per_mtok",
        )

    # -- facts ---------------------------------------------------------------
    def traces(self) -> DataFrame:
        """Stored traces, without an observation window yet."""
        df = session.spread(self.table("orders")).selectExpr(
            f"{TRACE_ID.format('o_orderkey')} AS id", "'p' || (o_orderkey % 25) AS project_id",
            "o_orderpriority AS name", "'u' || o_custkey AS user_id",
            "'s' || o_custkey || '-' || year(o_orderdate) AS session_id",
            "array(substring(o_orderpriority, 1, 1), o_orderstatus) AS tags",
            "CASE o_orderstatus WHEN 'O' THEN 'prod' WHEN 'F' THEN 'staging' ELSE 'dev' END AS environment",
            "'r' || year(o_orderdate) AS release",
            "cast(o_orderdate AS timestamp) AS started_at",
            """CASE WHEN o_orderstatus <> 'O' THEN timestamp_millis(
               unix_millis(cast(o_orderdate AS timestamp)) + o_custkey % 3000) END AS ended_at""",
            "cast(o_orderdate AS timestamp) + INTERVAL 1 HOUR AS created_at",
            "'1.' || (o_custkey % 4) AS sdk_version",
        )
        return df.withColumn("metadata", F.create_map(F.lit("priority"), F.col("name").cast("variant")))

    def windowed_traces(self, observations: DataFrame) -> DataFrame:
        from spanloom.operators import fold

        none = F.lit(None).cast("timestamp")
        bare = self.traces().withColumns(
            {"observations_started_min": none, "observations_started_max": none}
        )
        return fold.rebuild_windows(bare, observations)

    def observations(self, with_model: bool = True) -> DataFrame:
        line = session.spread(self.table("lineitem"))
        brand = "'Brand-0'"
        if with_model:
            part = self.table("part").selectExpr("p_partkey AS l_partkey", "p_brand")
            line = line.join(part, "l_partkey", "left")
            brand = "replace(p_brand, '#', '-')"
        return line.selectExpr(
            f"{SPAN_ID.format('l_linenumber', 'l_orderkey')} AS id",
            "'p' || (l_orderkey % 25) AS project_id",
            f"{TRACE_ID.format('l_orderkey')} AS trace_id",
            f"CASE WHEN l_linenumber > 1 THEN {SPAN_ID.format('(l_linenumber - 1)', 'l_orderkey')} END AS parent_observation_id",
            "CASE l_returnflag WHEN 'A' THEN 'generation' WHEN 'R' THEN 'span' ELSE 'event' END AS type",
            "'step-' || l_linenumber AS name",
            f"""CASE WHEN l_linestatus = 'F' THEN 'Azure/' ELSE '' END || {brand}
                || CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'x' ELSE '' END
                || CASE WHEN l_returnflag = 'A' THEN '-20240101' ELSE '' END AS model""",
            "CASE WHEN l_linenumber < 7 THEN cast(l_quantity * 20 AS bigint) END AS prompt_tokens",
            "CASE WHEN l_linenumber < 6 THEN cast(floor(l_extendedprice / 100) AS bigint) END AS completion_tokens",
            "cast(floor(l_quantity * 20 * l_discount) AS bigint) AS cached_tokens",
            "cast(l_partkey % 50 AS bigint) AS reasoning_tokens",
            "l_partkey % 3000 AS latency_ms",
            "'prompt-' || l_returnflag AS prompt_name", "'v' || l_linenumber AS prompt_version",
            "CASE WHEN l_linestatus = 'F' THEN 'Error' ELSE 'ok' END AS level",
            "cast(l_shipdate AS timestamp) AS started_at",
            "timestamp_millis(unix_millis(cast(l_shipdate AS timestamp)) + l_partkey % 3000) AS ended_at",
            "l_partkey AS ordinal",
            "'b' || (l_orderkey % 97) AS batch_id",
            "cast(l_shipdate AS timestamp) + INTERVAL 1 DAY AS received_at",
        ).withColumn(
            "total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))
        )

    def priced(self) -> DataFrame:
        from spanloom.operators import pricing

        return pricing.price_observations(self.observations(), self.prices(), version="fixture")

    def scores(self) -> DataFrame:
        labels, docs = self.table("labels"), self.table("documents").select("doc_id", "lang")
        head = "'p' || (doc_id % 25) AS project_id"
        at = "TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id AS int)) AS scored_at"
        none = "cast(NULL AS string)"
        quality = labels.selectExpr(
            f"{SCORE_ID.format('1', 'doc_id')} AS id", head, f"{TRACE_ID.format('doc_id')} AS trace_id",
            f"{none} AS observation_id", "'quality' AS name", "'numeric' AS data_type",
            "cast(quality * 0.875BD - 0.25BD AS decimal(18,6)) AS value", f"{none} AS value_text", at,
        )
        toxic = labels.selectExpr(
            f"{SCORE_ID.format('2', 'doc_id')} AS id", head, f"{none} AS trace_id",
            f"{SPAN_ID.format('1', 'doc_id')} AS observation_id", "'toxic' AS name", "'boolean' AS data_type",
            "cast(toxic AS decimal(18,6)) AS value", f"{none} AS value_text", at,
        )
        lang = docs.selectExpr(
            f"{SCORE_ID.format('3', 'doc_id')} AS id", head, f"{TRACE_ID.format('doc_id')} AS trace_id",
            f"{SPAN_ID.format('2', 'doc_id')} AS observation_id", "'lang' AS name", "'categorical' AS data_type",
            "cast(NULL AS decimal(18,6)) AS value", "lang AS value_text", at,
        )
        return quality.unionByName(toxic).unionByName(lang).withColumn("source", F.lit("human"))

    def turns(self) -> DataFrame:
        """Conversations as span chains with branches, cycles and missing parents."""
        return self.table("conversations").selectExpr(
            f"{TURN_ID.format('turn')} AS id", "'p' || (conv_id % 25) AS project_id",
            f"{TRACE_ID.format('conv_id')} AS trace_id",
            f"""CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN {TURN_ID.format('1')}
                     WHEN conv_id % 10 = 5 AND turn = 2 THEN {TURN_ID.format('999')}
                     WHEN conv_id % 10 = 7 AND turn >= 2 THEN {TURN_ID.format('0')}
                     WHEN turn > 0 THEN {TURN_ID.format('(turn - 1)')} END AS parent_observation_id""",
            "role AS type",
            "TIMESTAMP'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, turn % 3) AS started_at",
        )

    # -- deliveries ----------------------------------------------------------
    def trace_deliveries(self) -> DataFrame:
        """Each trace is sent when it opens and when it closes; pending ones close first."""
        t = session.spread(self.table("orders")).selectExpr(
            "*", "cast(o_orderdate AS timestamp) AS at", f"{TRACE_ID.format('o_orderkey')} AS id",
            "'p' || (o_orderkey % 25) AS project_id",
        )
        # Both are made in one pass, so that a trace's two sends lie in one task.
        sent = t.withColumn("closes", F.explode(F.array(F.lit(False), F.lit(True))))
        return sent.selectExpr(
            "id", "project_id", "CASE WHEN closes THEN 'c' ELSE 'o' END || (o_orderkey % 89) AS batch_id",
            """at + CASE WHEN NOT closes THEN INTERVAL 1 HOUR WHEN o_orderstatus = 'P' THEN INTERVAL 30 MINUTE
               ELSE INTERVAL 2 HOUR END AS received_at""",
            "o_orderkey AS ordinal", "CASE WHEN NOT closes THEN o_orderpriority END AS name",
            "CASE WHEN NOT closes THEN 'u' || o_custkey END AS user_id",
            "CASE WHEN closes THEN 's' || o_custkey END AS session_id",
            """CASE WHEN closes THEN array(substring(o_orderpriority, 1, 1), o_orderstatus)
               ELSE cast(array() AS array<string>) END AS tags""",
            "CASE WHEN closes THEN NULL WHEN o_orderstatus = 'O' THEN 'prod' ELSE 'staging' END AS environment",
            "CASE WHEN closes THEN 'r' || year(at) END AS release",
            "CASE WHEN closes AND o_orderstatus = 'F' THEN at + INTERVAL 2 HOUR ELSE at END AS started_at",
            "CASE WHEN closes THEN timestamp_millis(unix_millis(at) + o_custkey % 3000) END AS ended_at",
            "CASE WHEN NOT closes THEN '1.0' END AS sdk_version",
            """CASE WHEN closes THEN map('phase', cast('close' AS variant), 'priority', cast(o_orderpriority AS variant))
               ELSE map('phase', cast('open' AS variant), 'status', cast(o_orderstatus AS variant)) END AS metadata""",
        )

    def observation_deliveries(self) -> DataFrame:
        """Every observation sent twice, the repeat a day later with another latency.

        Last lines name no trace, so they become traces of their own.
        """
        first = self.observations(with_model=False).withColumn(
            "trace_id", F.when(F.col("name") == "step-7", F.col("id")).otherwise(F.col("trace_id"))
        )
        # Both are made in one pass, so that the two sends lie in one task.
        repeat = F.col("repeat")
        return first.withColumn("repeat", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns(
            {
                "received_at": F.when(repeat == 1, F.col("received_at") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("received_at")),
                "batch_id": F.when(repeat == 1, F.concat(F.lit("r"), F.col("batch_id"))).otherwise(F.col("batch_id")),
                "latency_ms": F.col("latency_ms") + repeat,
            }
        ).drop("repeat")

    # -- raw JSON ------------------------------------------------------------
    def event_batches(self, bad_type: str | None = None) -> DataFrame:
        """One JSON body per event; events of ``bad_type`` carry an unusable id."""
        bad = F.lit(False) if bad_type is None else F.col("event_type") == bad_type
        event_id = F.when(bad, F.lit("not-an-id")).otherwise(F.expr(TRACE_ID.format("event_id")))
        doc = F.struct(
            event_id.alias("id"), F.col("event_type").alias("type"),
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start_time"),
            F.col("value").alias("latency_ms"), F.parse_json("props").alias("metadata"),
        )
        return session.spread(self.table("events")).select(
            F.concat(F.lit("e"), "event_id").alias("batch_id"),
            (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("received_at"),
            F.to_json(F.struct(F.array(doc).alias("events"))).alias("body"),
        )

    def order_batches(self) -> DataFrame:
        """One flat-envelope body per order: the trace with aliased and untidy fields."""
        doc = F.struct(
            F.lit("trace").alias("type"),
            F.expr(f"upper({TRACE_ID.format('o_orderkey')})").alias("id"),
            F.concat(F.lit("  "), F.col("o_orderpriority"), F.lit(" ")).alias("name"),
            F.concat(F.lit("u"), "o_custkey").alias("userId"),
            F.expr(
                "array(o_orderstatus, ' ' || substring(o_orderpriority, 1, 1) || ' ', o_orderstatus, '')"
            ).alias("tags"),
            F.concat(F.repeat(F.lit("e"), 70), "o_orderstatus").alias("environment"),
            F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+02:00'").alias("timestamp"),
            F.struct(F.col("o_totalprice").alias("total")).alias("metadata"),
        )
        return session.spread(self.table("orders")).select(
            F.concat(F.lit("t"), "o_orderkey").alias("batch_id"),
            F.col("o_orderdate").cast("timestamp").alias("received_at"),
            F.to_json(F.struct(F.array(doc).alias("events"), F.lit("9.9").alias("sdk_version"))).alias("body"),
        )

    def line_batches(self) -> DataFrame:
        """One native-list body per line: aliased counts, versions and spans of time."""
        doc = F.struct(
            F.expr(SPAN_ID.format("l_linenumber", "l_orderkey")).alias("id"),
            F.expr(TRACE_ID.format("l_orderkey")).alias("trace_id"),
            F.lit("generation").alias("type"),
            F.lit("brand").alias("gen_ai.request.model"),
            (F.col("l_quantity") + 0.5).alias("gen_ai.usage.input_tokens"),
            (-F.col("l_quantity")).alias("output_tokens"),
            F.col("l_linenumber").cast("string").alias("cache_read_input_tokens"),
            F.col("l_linenumber").alias("prompt_version"),
            F.when(F.col("l_linestatus") == "F", "error").alias("status"),
            F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("startTime"),
            F.date_format(
                F.expr("timestamp_millis(unix_millis(cast(l_shipdate AS timestamp)) + l_partkey % 3000)"),
                "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'",
            ).alias("endTime"),
        )
        return session.spread(self.table("lineitem")).select(
            F.expr("'l' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey").alias("batch_id"),
            # Admitted or not by how long the delivery took.
            (F.col("l_shipdate").cast("timestamp") + F.expr("make_dt_interval(cast(l_partkey % 12 - 3 AS int))")).alias("received_at"),
            F.to_json(F.struct(F.array(doc).alias("observations"))).alias("body"),
        )

    def conversation_batches(self) -> DataFrame:
        """One nested body per conversation; the trace's start comes from its turns."""
        turn = F.struct(
            F.col("turn"),
            F.struct(
                F.expr(TURN_ID.format("turn")).alias("id"),
                F.col("role").alias("type"),
                F.expr("CASE WHEN turn % 2 = 0 THEN '2024-01-01T00:00:0' || (turn % 10) || 'Z' END").alias("started_at"),
                F.struct(F.col("text").alias("content")).alias("input"),
            ).alias("doc"),
        )
        # A conversation has at most eight turns, so its list is a small row.
        listed = self.table("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
        trace = F.struct(
            F.expr(TRACE_ID.format("conv_id")).alias("id"), F.col("turns.doc").alias("observations")
        )
        return listed.select(
            F.concat(F.lit("v"), "conv_id").alias("batch_id"),
            F.expr("TIMESTAMP'2024-01-02 00:00:00'").alias("received_at"),
            F.to_json(F.struct(F.array(trace).alias("traces"))).alias("body"),
        )

    def score_batches(self) -> DataFrame:
        """Three scores per labelled document; the last one names no target."""
        at = F.expr(f"{TRACE_ID.format('doc_id')}")

        def score(n: int, name: str, value, *target):
            score_id = F.expr(SCORE_ID.format(n, "doc_id")).alias("id")
            return F.to_json(F.struct(score_id, F.lit(name).alias("name"), value.alias("value"), *target))

        bodies = F.concat(
            F.lit('{"scores":['),
            F.concat_ws(
                ",",
                score(1, "quality", F.col("quality") * 0.5, at.alias("trace_id")),
                score(2, "toxic", F.col("toxic") == 1, at.alias("trace_id")),
                score(3, "label", F.concat(F.lit(" "), F.col("toxic").cast("string"))),
            ),
            F.lit("]}"),
        )
        return session.spread(self.table("labels")).select(
            F.concat(F.lit("s"), "doc_id").alias("batch_id"),
            F.expr("TIMESTAMP'2024-02-01 00:00:00'").alias("received_at"),
            bodies.alias("body"),
        )


TRACE_ID = "'00000000-0000-4000-8000-' || lpad(cast({} AS string), 12, '0')"
SPAN_ID = "'0000000' || {} || '-0000-4000-8000-' || lpad(cast({} AS string), 12, '0')"
SCORE_ID = "'a000000{}-0000-4000-8000-' || lpad(cast({} AS string), 12, '0')"
TURN_ID = "lpad(cast({} AS string), 8, '0') || '-0000-4000-8000-' || lpad(cast(conv_id AS string), 12, '0')"


def _sql(template: str) -> str:
    """Fill the id patterns into a view's SQL."""
    import re

    def fill(m: re.Match) -> str:
        pattern = {"trace": TRACE_ID, "span": SPAN_ID, "score": SCORE_ID, "turn": TURN_ID}[m.group(1)]
        return "(" + pattern.format(*[a.strip() for a in m.group(2).split(";")]).replace("AS string", "AS varchar") + ")"

    return re.sub(r"\$(trace|span|score|turn)\[([^\]]*)\]", fill, template)


# SQL of the same views. A view may use the ones above it.
VIEWS: dict[str, str] = {
    "fx_projects": "SELECT 'p' || n_nationkey AS project_id, n_name AS name FROM nation",
    "fx_members": """
        SELECT 'p' || s_nationkey AS project_id, 'm' || s_suppkey AS user_id,
               CASE WHEN s_acctbal >= 0 THEN 'owner' ELSE 'member' END AS role,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(s_suppkey::int) AS created_at
        FROM supplier""",
    "fx_users": """
        SELECT 'm' || s_suppkey AS id,
               CASE WHEN s_acctbal < 0 THEN 'Shared-' || s_nationkey ELSE 'User-' || s_suppkey END || '@x.org' AS email
        FROM supplier""",
    "fx_keys": """
        SELECT 'k' || s_suppkey AS id, 'p' || s_nationkey AS project_id,
               sha256('key-' || s_suppkey) AS key_hash, substr('key-' || s_suppkey, 1, 6) AS key_prefix,
               s_name AS label,
               CASE s_suppkey % 3 WHEN 0 THEN ['ingest'] WHEN 1 THEN ['read'] ELSE ['ingest', 'read'] END AS scopes,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(s_suppkey::int) AS created_at,
               CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2025-01-01 00:00:00' END AS revoked_at
        FROM supplier""",
    "fx_prices": """
        SELECT 'brand-' || n AS model_key,
               CAST(n * CAST(0.05 AS decimal(5,3)) AS decimal(12,6)) AS input_usd_per_mtok,
               CAST(n * CAST(0.2 AS decimal(5,3)) AS decimal(12,6)) AS output_usd_per_mtok,
               CAST(CASE WHEN n % 3 <> 0 THEN n * CAST(0.005 AS decimal(5,3)) END AS decimal(12,6)) AS cached_input_usd_per_mtok
        FROM (SELECT DISTINCT CAST(substr(p_brand, 7) AS int) AS n FROM part)""",
    "fx_traces": _sql("""
        SELECT $trace[o_orderkey] AS id, 'p' || (o_orderkey % 25) AS project_id,
               o_orderpriority AS name, 'u' || o_custkey AS user_id,
               's' || o_custkey || '-' || year(o_orderdate) AS session_id,
               [substr(o_orderpriority, 1, 1), o_orderstatus] AS tags,
               CASE o_orderstatus WHEN 'O' THEN 'prod' WHEN 'F' THEN 'staging' ELSE 'dev' END AS environment,
               'r' || year(o_orderdate) AS release, o_orderdate AS started_at,
               CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + to_milliseconds(o_custkey % 3000) END AS ended_at,
               o_orderdate + INTERVAL 1 HOUR AS created_at, '1.' || (o_custkey % 4) AS sdk_version
        FROM orders"""),
    "fx_observations": _sql("""
        SELECT $span[l_linenumber;l_orderkey] AS id, 'p' || (l_orderkey % 25) AS project_id,
               $trace[l_orderkey] AS trace_id,
               CASE WHEN l_linenumber > 1 THEN $span[(l_linenumber - 1);l_orderkey] END AS parent_observation_id,
               CASE l_returnflag WHEN 'A' THEN 'generation' WHEN 'R' THEN 'span' ELSE 'event' END AS type,
               'step-' || l_linenumber AS name,
               CASE WHEN l_linestatus = 'F' THEN 'Azure/' ELSE '' END || replace(p_brand, '#', '-')
                 || CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'x' ELSE '' END
                 || CASE WHEN l_returnflag = 'A' THEN '-20240101' ELSE '' END AS model,
               CASE WHEN l_linenumber < 7 THEN CAST(l_quantity * 20 AS bigint) END AS prompt_tokens,
               CASE WHEN l_linenumber < 6 THEN CAST(floor(l_extendedprice / 100) AS bigint) END AS completion_tokens,
               CAST(floor(l_quantity * 20 * l_discount) AS bigint) AS cached_tokens,
               CAST(l_partkey % 50 AS bigint) AS reasoning_tokens, l_partkey % 3000 AS latency_ms,
               'prompt-' || l_returnflag AS prompt_name, 'v' || l_linenumber AS prompt_version,
               CASE WHEN l_linestatus = 'F' THEN 'Error' ELSE 'ok' END AS level,
               l_shipdate AS started_at, l_shipdate + to_milliseconds(l_partkey % 3000) AS ended_at,
               l_partkey AS ordinal, 'b' || (l_orderkey % 97) AS batch_id,
               l_shipdate + INTERVAL 1 DAY AS received_at,
               coalesce(CASE WHEN l_linenumber < 7 THEN CAST(l_quantity * 20 AS bigint) END, 0)
                 + coalesce(CASE WHEN l_linenumber < 6 THEN CAST(floor(l_extendedprice / 100) AS bigint) END, 0) AS total_tokens
        FROM lineitem LEFT JOIN part ON l_partkey = p_partkey"""),
    "fx_normalised": """
        SELECT *, regexp_replace(lower(model), '^azure/', '') AS model_norm FROM fx_observations""",
    "fx_resolved": """
        SELECT m.model_norm, p.*
        FROM (SELECT DISTINCT model_norm FROM fx_normalised) m JOIN fx_prices p
          ON m.model_norm = p.model_key OR starts_with(m.model_norm, p.model_key || '-')
        QUALIFY row_number() OVER (PARTITION BY m.model_norm ORDER BY length(p.model_key) DESC) = 1""",
    "fx_priced": """
        SELECT o.*, r.model_key,
               CASE WHEN r.model_key IS NOT NULL AND (o.prompt_tokens IS NOT NULL OR o.completion_tokens IS NOT NULL) THEN
                 CAST(round(CAST(
                   CAST(coalesce(o.prompt_tokens, 0) - least(coalesce(o.cached_tokens, 0), coalesce(o.prompt_tokens, 0)) AS decimal(10,0)) * r.input_usd_per_mtok
                   + CAST(least(coalesce(o.cached_tokens, 0), coalesce(o.prompt_tokens, 0)) AS decimal(10,0)) * coalesce(r.cached_input_usd_per_mtok, r.input_usd_per_mtok)
                   + CAST(coalesce(o.completion_tokens, 0) AS decimal(10,0)) * r.output_usd_per_mtok AS decimal(26,6))
                   * CAST(0.000001 AS decimal(7,6)), 8) AS decimal(18,8)) END AS cost_usd
        FROM fx_normalised o LEFT JOIN fx_resolved r USING (model_norm)""",
    "fx_rollup": """
        SELECT project_id, trace_id, count(*) AS observation_count,
               CAST(sum(coalesce(prompt_tokens, 0)) AS bigint) AS prompt_tokens,
               CAST(sum(coalesce(completion_tokens, 0)) AS bigint) AS completion_tokens,
               CAST(sum(total_tokens) AS bigint) AS total_tokens,
               CAST(sum(coalesce(cost_usd, 0)) AS decimal(28,8)) AS total_cost_usd,
               CAST(sum(coalesce(latency_ms, 0)) AS bigint) AS total_latency_ms
        FROM fx_priced GROUP BY project_id, trace_id""",
    "fx_listed": """
        SELECT t.*, coalesce(r.observation_count, 0) AS observation_count,
               coalesce(r.prompt_tokens, 0) AS prompt_tokens, coalesce(r.completion_tokens, 0) AS completion_tokens,
               coalesce(r.total_tokens, 0) AS total_tokens,
               coalesce(r.total_cost_usd, CAST(0 AS decimal(28,8))) AS total_cost_usd,
               coalesce(r.total_latency_ms, 0) AS total_latency_ms,
               CASE WHEN ended_at IS NOT NULL THEN greatest(0, CAST(trunc((epoch_us(ended_at) - epoch_us(started_at)) / 1000000.0::double * 1000.0::double) AS bigint)) END AS duration_ms
        FROM fx_traces t LEFT JOIN fx_rollup r ON t.project_id = r.project_id AND t.id = r.trace_id""",
    "fx_scores": _sql("""
        SELECT $score[1;doc_id] AS id, 'p' || (doc_id % 25) AS project_id, $trace[doc_id] AS trace_id,
               NULL::varchar AS observation_id, 'quality' AS name, 'numeric' AS data_type,
               CAST(quality * CAST(0.875 AS decimal(4,3)) - CAST(0.25 AS decimal(4,3)) AS decimal(18,6)) AS value,
               NULL::varchar AS value_text, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id::int) AS scored_at FROM labels
        UNION ALL
        SELECT $score[2;doc_id], 'p' || (doc_id % 25), NULL, $span[1;doc_id], 'toxic', 'boolean',
               CAST(toxic AS decimal(18,6)), NULL, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id::int) FROM labels
        UNION ALL
        SELECT $score[3;doc_id], 'p' || (doc_id % 25), $trace[doc_id], $span[2;doc_id], 'lang', 'categorical',
               NULL, lang, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id::int) FROM documents"""),
    "fx_turns": _sql("""
        SELECT $turn[turn] AS id, 'p' || (conv_id % 25) AS project_id, $trace[conv_id] AS trace_id,
               CASE WHEN conv_id % 10 = 3 AND turn = 0 THEN $turn[1]
                    WHEN conv_id % 10 = 5 AND turn = 2 THEN $turn[999]
                    WHEN conv_id % 10 = 7 AND turn >= 2 THEN $turn[0]
                    WHEN turn > 0 THEN $turn[(turn - 1)] END AS parent_observation_id,
               role AS type, TIMESTAMP '2024-01-01 00:00:00' + to_seconds(turn % 3) AS started_at
        FROM conversations"""),
    "fx_trace_deliveries": _sql("""
        SELECT $trace[o_orderkey] AS id, 'p' || (o_orderkey % 25) AS project_id, 'o' || (o_orderkey % 89) AS batch_id,
               o_orderdate + INTERVAL 1 HOUR AS received_at, o_orderkey AS ordinal, o_orderpriority AS name,
               'u' || o_custkey AS user_id, NULL::varchar AS session_id, []::varchar[] AS tags,
               CASE WHEN o_orderstatus = 'O' THEN 'prod' ELSE 'staging' END AS environment, NULL::varchar AS release,
               o_orderdate AS started_at, NULL::timestamp AS ended_at, '1.0' AS sdk_version,
               'open' AS phase, o_orderstatus AS status, NULL::varchar AS priority
        FROM orders
        UNION ALL
        SELECT $trace[o_orderkey], 'p' || (o_orderkey % 25), 'c' || (o_orderkey % 89),
               o_orderdate + CASE WHEN o_orderstatus = 'P' THEN INTERVAL 30 MINUTE ELSE INTERVAL 2 HOUR END,
               o_orderkey, NULL, NULL, 's' || o_custkey, [substr(o_orderpriority, 1, 1), o_orderstatus], NULL,
               'r' || year(o_orderdate),
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 2 HOUR ELSE o_orderdate END,
               o_orderdate + to_milliseconds(o_custkey % 3000), NULL, 'close', NULL, o_orderpriority
        FROM orders"""),
    "fx_observation_deliveries": """
        SELECT id, project_id, CASE WHEN name = 'step-7' THEN id ELSE trace_id END AS trace_id, started_at,
               batch_id, received_at, ordinal, latency_ms FROM fx_observations
        UNION ALL
        SELECT id, project_id, CASE WHEN name = 'step-7' THEN id ELSE trace_id END, started_at,
               'r' || batch_id, received_at + INTERVAL 1 DAY, ordinal, latency_ms + 1 FROM fx_observations""",
    "fx_batch_windows": """
        SELECT project_id, batch_id, received_at, trace_id, min(started_at) AS lo, max(started_at) AS hi
        FROM fx_observation_deliveries GROUP BY ALL""",
}


def with_views(sql: str) -> str:
    """Prefix the views a query uses, directly or through each other."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name in text.replace("\n", " ").replace("(", " ").replace(",", " ").replace(")", " ").split():
                if name not in needed:
                    visit(body)
                    needed.append(name)

    visit(sql)
    body = sql.strip()
    recursive = body.upper().startswith("WITH RECURSIVE")
    for head in ("WITH RECURSIVE", "WITH"):
        if body.upper().startswith(head):
            body = body[len(head):].strip()
            break
    else:
        body = None
    views = ",\n".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    if body is not None:
        return f"{keyword} {views},\n{body}" if needed else sql
    return f"{keyword} {views}\n{sql}" if needed else sql
