import base64
from datetime import datetime, timedelta, timezone
from decimal import Decimal as D

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from spanloom.functions import cursors
from spanloom.operators import detail, fold, listing
from spanloom.operators.ranking import number_rows
from tests.helpers import uid

T0 = datetime(2024, 1, 1)


def make_traces(spark, rows):
    """(id, project, start, end, tags, environment)"""
    df = spark.createDataFrame(rows, "id string, project_id string, started_at timestamp, ended_at timestamp, tags array<string>, environment string")
    none = F.lit(None)
    return df.withColumns(
        {**{c: none.cast("string") for c in ("name", "user_id", "session_id", "release", "sdk_version")},
         "created_at": F.col("started_at"), "metadata": F.from_json(F.lit('{"a":1}'), "map<string,variant>"),
         "observations_started_min": none.cast("timestamp"), "observations_started_max": none.cast("timestamp")}
    )


def make_spans(spark, rows):
    """(id, trace, project, start, prompt, completion, latency, cost)"""
    df = spark.createDataFrame(
        rows, "id string, trace_id string, project_id string, started_at timestamp, prompt_tokens bigint, completion_tokens bigint, latency_ms bigint, cost_usd decimal(18,8)"
    )
    return df.withColumn("total_tokens", F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0)))


def test_rollup_zeros_and_duration(spark):
    spans = make_spans(spark, [(uid(10 + i), uid(1), "p", T0 + timedelta(seconds=i), 10, 5, 100, D("0.00012500")) for i in range(3)])
    traces = make_traces(spark, [(uid(1), "p", T0, T0 + timedelta(seconds=2), [], None), (uid(2), "p", T0, None, [], None),
                                 (uid(3), "p", T0, T0 - timedelta(seconds=1), [], None)])
    page = listing.newest_page(fold.rebuild_windows(traces, spans), spans)
    got = {r.id: r for r in page.rows.collect()}
    a = got[uid(1)]
    assert (a.observation_count, a.prompt_tokens, a.completion_tokens, a.total_tokens, a.total_latency_ms, a.duration_ms) == (3, 30, 15, 45, 300, 2000)
    assert a.total_cost_usd == D("0.00037500")
    b = got[uid(2)]
    assert (b.observation_count, b.total_cost_usd, b.duration_ms) == (0, 0, None)
    assert got[uid(3)].duration_ms == 0
    # The list and the detail of a trace agree.
    one = detail.trace_detail(fold.rebuild_windows(traces, spans), spans, make_scores(spark), "p", uid(1))
    row = one.trace.first()
    assert [row[c] for c in listing.ROLLUP_COLUMNS] == [a[c] for c in listing.ROLLUP_COLUMNS]
    assert [o.id for o in one.observations.collect()] == [uid(10), uid(11), uid(12)]


def make_scores(spark, rows=()):
    return spark.createDataFrame(list(rows), "id string, project_id string, trace_id string, observation_id string, name string, data_type string, value decimal(18,6), value_text string, source string, scored_at timestamp")


def test_paging_covers_ties_once(spark):
    traces = make_traces(spark, [(uid(i), "p", T0, None, [], None) for i in range(10)])
    spans = make_spans(spark, [])
    seen, cursor = [], None
    while True:
        page = listing.newest_page(traces, spans, limit=3, cursor=cursor)
        seen.append([r.id for r in page.rows.collect()])
        cursor = page.next_cursor
        if not page.has_more:
            break
    assert cursor is None and [len(p) for p in seen] == [3, 3, 3, 1]
    assert sum(seen, []) == [uid(i) for i in reversed(range(10))]
    pages = {r.id: r.page for r in listing.all_pages(traces, 3).collect()}
    assert pages == {i: n + 1 for n, p in enumerate(seen) for i in p}


def test_filters(spark):
    rows = [(uid(i), "p", T0 + timedelta(hours=i), None, ["a", "b"] if i % 2 else ["a"], "prod" if i < 3 else "dev") for i in range(6)]
    traces = make_traces(spark, rows)
    ids = lambda f: sorted(int(r.id[-2:]) for r in listing.filter_traces(traces, f).collect())
    assert ids({"tags": ["a", "b"]}) == [1, 3, 5]
    assert ids({"environment": "prod", "tags": ["b"]}) == [1]
    assert ids({"from": T0 + timedelta(hours=1), "to": "2024-01-01T04:00:00Z"}) == [1, 2, 3]
    assert listing.read_filters({"name": ["a", "b"], "tag": ["x", ""], "user_id": "", "zzz": 1}) == {"name": "b", "tags": ["x"]}
    assert listing.split_tags(" a, b ,,a") == ["a", "b"]
    assert [listing.page_size(x) for x in (None, 1, 7, 200)] == [50, 1, 7, 200]
    for refused in (0, 201, -1):
        with pytest.raises(ValueError, match="limit"):
            listing.page_size(refused)
    assert listing.page_size(5000, most=None) == 5000


def test_one_trace_id_in_two_projects(spark):
    traces = make_traces(spark, [(uid(1), "p", T0, None, [], None), (uid(1), "q", T0 + timedelta(1), None, [], None), (uid(2), "q", T0, None, [], None)])
    spans = make_spans(spark, [(uid(11), uid(1), "p", T0, 1, 1, 1, D(1)), (uid(12), uid(1), "q", T0, 2, 2, 2, D(2)), (uid(13), uid(1), "q", T0, 4, 4, 4, D(4))])
    stored = fold.rebuild_windows(traces, spans)
    rows = {p: [(r.id, r.project_id, r.observation_count) for r in listing.list_page(stored, spans, p).rows.collect()] for p in ("p", "q", "r", None)}
    assert rows == {"p": [(uid(1), "p", 1)], "q": [(uid(1), "q", 2), (uid(2), "q", 0)], "r": [], None: []}
    scores = make_scores(spark, [(i, p, t, o, "n", "numeric", D(1), None, "human", T0 + timedelta(n)) for n, (i, p, t, o) in enumerate(
        [("s1", "p", uid(1), None), ("s2", "q", None, uid(13)), ("s3", "q", uid(1), uid(12)), ("s4", "q", uid(2), uid(12)), ("s5", "q", uid(2), None)])])
    one = detail.trace_detail(stored, spans, scores, "q", uid(1))
    assert [o.id for o in one.observations.collect()] == [uid(12), uid(13)]
    assert [s.id for s in one.scores.collect()] == ["s2", "s3", "s4"]
    assert detail.trace_detail(stored, spans, scores, None, uid(1)) is None


def test_cursor_round_trip_and_refusals(spark):
    df = spark.createDataFrame([(T0.replace(microsecond=5), uid(1))], "a timestamp, i string")
    text = df.select(cursors.encode(F.col("a"), F.col("i"))).first()[0]
    assert "=" not in text
    assert cursors.decode(text) == (T0.replace(microsecond=5, tzinfo=timezone.utc), uid(1))
    raw = lambda s: base64.urlsafe_b64encode(s.encode()).decode().rstrip("=")
    assert cursors.decode(raw(f"v1|2024-01-01T00:00:00|{uid(1)}"))[0].tzinfo is timezone.utc
    for bad in ("é", "a", raw("v1|2024-01-01"), raw(f"v2|2024-01-01T00:00:00|{uid(1)}"), raw(f"v1|soon|{uid(1)}"), raw("v1|2024-01-01T00:00:00|x")):
        with pytest.raises(cursors.BadCursor):
            cursors.decode(bad)


def test_page_reads_only_its_days(spark, tmp_path):
    spans = make_spans(spark, [(uid(100 + i), uid(i), "p", T0 + timedelta(days=i), 1, 1, 1, D(1)) for i in range(20)])
    spans.withColumn("started_date", F.to_date("started_at")).write.partitionBy("started_date").parquet(str(tmp_path / "o"))
    stored = spark.read.parquet(str(tmp_path / "o"))
    scan = listing.bounded_scan(stored, T0 + timedelta(days=3), T0 + timedelta(days=4))
    assert "PartitionFilters: [isnotnull(started_date" in scan._jdf.queryExecution().executedPlan().toString()
    assert len(scan.inputFiles()) >= 2 and scan.count() == 2
    traces = fold.rebuild_windows(make_traces(spark, [(uid(i), "p", T0, None, [], None) for i in (5, 6)]), spans)
    many = listing.observations_of(traces.filter("project_id = 'p'"), stored)
    assert "dynamicpruning" in many._jdf.queryExecution().executedPlan().toString()
    assert many.count() == 2


def test_list_never_reads_payloads(spark, tmp_path):
    wide = make_spans(spark, [(uid(1), uid(2), "p", T0, 1, 1, 1, D(1))]).withColumn("input", F.lit("big")).withColumn("output", F.lit("big"))
    wide.write.parquet(str(tmp_path / "w"))
    plan = listing.rollup(spark.read.parquet(str(tmp_path / "w")))._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "input" not in schema and "output" not in schema


def test_numbering_equals_a_window_under_skew(spark):
    df = spark.range(30_000).selectExpr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE 'g' || (id % 50) END AS g", "(id * 7919) % 30011 AS o", "id")
    got = number_rows(df, ["g"], [F.col("o").desc(), F.col("id").asc()], "n")
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.col("o").desc(), "id")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == 30_000


def test_scores_of_either_target(spark):
    traces = make_traces(spark, [(uid(1), "p", T0, None, [], None), (uid(2), "p", T0, None, [], None), (uid(1), "q", T0, None, [], None)])
    spans = make_spans(spark, [(uid(11), uid(1), "p", T0, 1, 1, 1, D(1)), (uid(11), uid(1), "p", T0 + timedelta(1), 1, 1, 1, D(1)),
                               (uid(12), uid(2), "p", T0, 1, 1, 1, D(1))])
    rows = [("trace", "p", uid(1), None), ("span", "p", None, uid(11)), ("both", "p", uid(1), uid(11)), ("across", "p", uid(1), uid(12)),
            ("dangling", "p", uid(9), uid(99)), ("other", "q", uid(1), uid(11)), ("foreign", "r", uid(1), None)]
    scores = make_scores(spark, [(i, p, t, o, "n", "numeric", D(1), None, "human", T0) for i, p, t, o in rows])
    got = sorted((r.project_id, r.shown_in[-1], r.id) for r in detail.scores_of_traces(traces, spans, scores).collect())
    assert got == [("p", "1", "across"), ("p", "1", "both"), ("p", "1", "span"), ("p", "1", "trace"), ("p", "2", "across"), ("q", "1", "other")]
    plan = detail.scores_of_traces(traces, spans, scores)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_detail_of_unknown_trace(spark):
    assert detail.trace_detail(make_traces(spark, []), make_spans(spark, []), make_scores(spark), "p", uid(1)) is None


def test_traces_are_not_repeated_for_the_days_of_their_windows(spark):
    traces = spark.sql("""SELECT 'p' project_id, id, lo observations_started_min, hi observations_started_max FROM VALUES
        ('a', timestamp'2024-01-01 10:00:00', timestamp'2024-12-31 10:00:00'), ('a', timestamp'2024-02-01', timestamp'2024-02-02'),
        ('b', timestamp'2024-03-01', NULL) t(id, lo, hi)""")
    observations = spark.sql("""SELECT 'p' project_id, trace_id, s started_at, to_date(s) started_date FROM VALUES
        ('a', timestamp'2024-01-01 09:59:59'), ('a', timestamp'2024-02-01 12:00:00'), ('a', timestamp'2024-12-31 10:00:00'),
        ('b', timestamp'2024-03-01'), ('a', NULL) t(trace_id, s)""")
    found = listing.observations_of(traces, observations)
    # The days are exploded where they are made distinct, and nowhere else.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1
    assert sorted(r.started_at.month for r in found.collect()) == [2, 2, 12]
