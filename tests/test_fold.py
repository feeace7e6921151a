import itertools
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spanloom.operators import fold
from tests.helpers import NOW, Ingested, at, uid


def _rows(df):
    df = df.withColumn("keys_set_at", F.array_sort(F.map_entries("keys_set_at")))
    return sorted(
        map(tuple, df.withColumn("metadata", F.to_json(F.map_from_entries(F.array_sort(F.map_entries(
            F.transform_values("metadata", lambda k, v: F.to_json(v))))))).collect()), key=str)


def _fold(run):
    return fold.fold_traces(fold.fold_inputs(run.trace_df, run.observation_df.filter("admitted").drop("admitted")))


def _by_id(run):
    df = _fold(run).withColumn("metadata", F.to_json("metadata"))
    return {r.id: r for r in df.collect()}


def test_close_later_keeps_and_merges(spark):
    run = Ingested(
        spark,
        {"traces": [{"id": uid(1), "name": "n", "user_id": "u", "tags": ["a"], "started_at": at(), "metadata": {"a": 1, "b": {"x": 1}}}]},
        {"traces": [{"id": uid(1), "ended_at": at(seconds=2), "tags": [], "metadata": {"b": None, "c": "z"}}]},
    )
    t = _by_id(run)[uid(1)]
    assert (t.name, t.user_id, t.tags) == ("n", "u", ["a"])
    assert t.ended_at is not None and t.metadata in ('{"a":1,"b":null,"c":"z"}',) or sorted(t.metadata) == sorted('{"a":1,"b":null,"c":"z"}')
    # Sent without a start, the close is stamped with its receive time.
    assert t.started_at == (NOW + timedelta(minutes=1)).replace(tzinfo=None)
    assert (t.created_at, t.updated_at) == (NOW.replace(tzinfo=None), (NOW + timedelta(minutes=1)).replace(tzinfo=None))


def test_replay_converges(spark):
    body = {"traces": [{"id": uid(1), "started_at": at(), "observations": [{"id": uid(2), "started_at": at()}]}]}
    run = Ingested(spark, body, body, body)
    assert _fold(run).count() == 1
    assert fold.dedupe_observations(run.observation_df).count() == 1


def test_regenerated_start_is_another_observation(spark):
    run = Ingested(spark, *[{"observations": [{"id": uid(2), "trace_id": uid(1)}]}] * 2)
    assert fold.dedupe_observations(run.observation_df).count() == 2
    assert _fold(run).count() == 1


REAL = [{"traces": [{"id": uid(1), "name": f"r{i}", "started_at": at(minutes=i)}]} for i in range(2)]
STUB = [{"observations": [{"id": uid(10 + i), "trace_id": uid(1), "started_at": at(hours=-1 - i)}]} for i in range(2)]


def test_all_orders_of_two_sends_and_two_stubs(spark):
    orders = list(itertools.permutations(range(4)))
    events = None
    for n, order in enumerate(orders):
        bodies = [(REAL + STUB)[i] for i in order]
        swap = {uid(1): uid(1000 + n)}
        text = [__import__("json").dumps(b).replace(uid(1), swap[uid(1)]) for b in bodies]
        events = (events or []) + text
    run = Ingested(spark, *events)
    got = _by_id(run)
    for n, order in enumerate(orders):
        t = got[uid(1000 + n)]
        last_real = max((i for i in range(4) if order[i] < 2))
        assert t.name == f"r{order[last_real]}"
        assert t.started_at == (NOW + timedelta(minutes=order[last_real])).replace(tzinfo=None)
        assert t.observations_started_min == (NOW - timedelta(hours=2)).replace(tzinfo=None)
        assert t.observations_started_max == (NOW - timedelta(hours=1)).replace(tzinfo=None)


def test_stub_start_is_the_earliest_batch_not_the_earliest_start(spark):
    t = _by_id(Ingested(spark, *STUB))[uid(1)]
    assert t.name is None and t.started_at == (NOW - timedelta(hours=1)).replace(tzinfo=None)
    assert t.observations_started_min == (NOW - timedelta(hours=2)).replace(tzinfo=None)


def test_rejected_observation_makes_no_stub(spark):
    run = Ingested(spark, {"observations": [{"id": uid(1), "started_at": at(days=-30)}]})
    assert _fold(run).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_folding_in_steps_equals_folding_at_once(spark, seed):
    rnd = random.Random(seed)
    bodies = []
    for _ in range(60):
        ids = [uid(rnd.randrange(12)) for _ in range(3)]
        traces = [
            {"id": i, "name": rnd.choice([None, "a", "b"]), "tags": rnd.choice([[], ["x"], ["y", "z"]]),
             "metadata": {rnd.choice("abc"): rnd.randrange(9)}, "started_at": at(minutes=rnd.randrange(60))}
            for i in set(ids[:2])
        ]
        spans = [{"id": uid(rnd.randrange(10**6)), "trace_id": ids[2], "started_at": at(seconds=rnd.randrange(9999))}]
        bodies.append({"traces": rnd.choice([traces, []]), "observations": rnd.choice([spans, []])})
    run = Ingested(spark, *bodies)
    events = fold.fold_inputs(run.trace_df, run.observation_df.drop("admitted"))
    whole = fold.fold_traces(events)
    for cut in ("b010", "b030"):
        early = fold.state_events(fold.fold_traces(events.filter(F.col("batch_id") <= cut)))
        stepped = fold.fold_traces(early.unionByName(events.filter(F.col("batch_id") > cut)))
        assert _rows(stepped) == _rows(whole)
    # Parts that overlap in time, in any order.
    part = F.pmod(F.xxhash64("batch_id"), F.lit(3))
    parts = [fold.state_events(fold.fold_traces(events.filter(part == n))) for n in (1, 2, 0)]
    both = fold.state_events(fold.fold_traces(parts[0].unionByName(parts[1])))
    assert _rows(fold.fold_traces(both.unionByName(parts[2]))) == _rows(whole)
    # Against a row-by-row replay of the same events.
    state = {}
    for e in sorted(events.withColumn("metadata", F.to_json("metadata")).collect(), key=lambda r: (r.received_at, r.batch_id, r.ordinal)):
        s = state.setdefault(e.id, {"name": None, "tags": [], "start": None, "real": False})
        if e.is_stub:
            if s["start"] is None:
                s["start"] = e.started_at
        else:
            s["name"] = e.name or s["name"]
            s["tags"] = e.tags or s["tags"]
            s["start"], s["real"] = e.started_at, True
    # Windows carry ordinal -1; where a batch has both, the real send decides anyway.
    got = {r.id: r for r in whole.drop("metadata").collect()}
    assert {i: (r.name, r.tags) for i, r in got.items()} == {i: (s["name"], s["tags"]) for i, s in state.items()}
    assert {i: r.started_at for i, r in got.items()} == {i: s["start"] for i, s in state.items()}


def test_hot_key_is_limited_before_the_shuffle(spark):
    df = spark.range(50_000).selectExpr(
        "'p' AS project_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || id END AS id", "current_timestamp() AS started_at",
        "timestamp_seconds(id) AS received_at", "'b' AS batch_id", "id AS ordinal",
    ).withColumn("started_at", F.lit("2024-01-01").cast("timestamp"))
    out = fold.dedupe_observations(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning")
    assert "WindowGroupLimit" in plan[exchange:]
    assert out.filter("id = 'hot'").first().ordinal == 0


def test_window_repair_touches_only_wrong_rows(spark):
    traces = spark.sql("""SELECT 'p' project_id, id, timestamp'2024-01-01' observations_started_min, hi observations_started_max
        FROM VALUES ('a', timestamp'2024-01-02'), ('b', timestamp'2024-01-03'), ('c', NULL), ('d', NULL) t(id, hi)""")
    obs = spark.sql("""SELECT 'p' project_id, trace_id, s started_at FROM VALUES ('a', timestamp'2024-01-01'), ('a', timestamp'2024-01-02'),
        ('b', timestamp'2024-01-01'), ('c', timestamp'2024-01-01') t(trace_id, s)""")
    assert {r.id for r in fold.windows_to_repair(traces, obs).collect()} == {"b", "c"}
    assert fold.rebuild_windows(traces, obs).count() == 4


def test_windows_of_a_trace_are_one_fold_input(spark):
    """Its batches' windows fold to the same trace, in one row instead of one per batch."""
    head = "project_id string, batch_id string, received_at timestamp, trace_id string, started_at timestamp"
    minute = lambda n: NOW.replace(tzinfo=None) + timedelta(minutes=n)
    # The earliest batch starts at 5, a later one at 2; its third span and all of b's have no start.
    sent = [("p", "x", minute(1), "a", minute(9)), ("p", "x", minute(1), "a", minute(5)), ("p", "x", minute(1), "a", None),
            ("p", "w", minute(3), "a", minute(2)), ("p", "x", minute(2), "b", None), (None, None, None, None, minute(4))]
    windows = fold.window_events(spark.createDataFrame(sent, head))
    assert windows.count() == 3
    got = {r.id: r for r in fold.fold_traces(windows).collect()}
    a = got["a"]
    assert (a.started_at, a.observations_started_min, a.observations_started_max) == (minute(5), minute(2), minute(9))
    assert (a.created_at, a.updated_at, a.batch_id, a.is_stub) == (minute(1), minute(3), "x", True)
    assert (a.set_at.last.batch_id, a.set_at.first.batch_id, a.set_at.stub_start.ordinal) == ("w", "x", -1)
    assert (got["b"].started_at, got["b"].observations_started_min) == (None, None)
    assert got[None].started_at == minute(4)


def test_states_merge_as_their_events_do_and_without_another_shuffle(spark):
    """Values, arrivals and metadata of two and of three states; a trace without a project, one in a single state."""
    bodies = [
        {"traces": [{"id": uid(1), "name": "n", "tags": ["a"], "started_at": at(), "metadata": {"a": 1, "b": {"x": 1}}}]},
        {"observations": [{"id": uid(10), "trace_id": uid(1), "started_at": at(hours=-1)}, {"id": uid(11), "trace_id": uid(2), "started_at": at()}]},
        {"traces": [{"id": uid(1), "user_id": "u", "started_at": at(minutes=2), "metadata": {"b": None, "c": "z"}}]},
        {"observations": [{"id": uid(12), "trace_id": uid(2), "started_at": at(hours=-2)}]},
        {"traces": [{"id": uid(1), "started_at": at(minutes=4), "metadata": {"a": 2}}, {"id": uid(3), "started_at": at(), "metadata": {"q": 1}}]},
    ]
    run = Ingested(spark, *bodies)
    sent = run.trace_df, run.observation_df.drop("admitted")
    sent = [df.withColumn("project_id", F.when(F.col("batch_id") != "b003", F.col("project_id"))) for df in sent]

    def state(*batches):
        return fold.state_events(fold.fold_traces(fold.fold_inputs(*[df.filter(F.col("batch_id").isin(*batches)) for df in sent])))

    whole = _rows(fold.fold_traces(fold.fold_inputs(*sent)))
    assert len(whole) == 4
    # The later state first, and states that overlap in time.
    assert _rows(fold.merge_states(state("b002", "b003", "b004"), state("b000", "b001"))) == whole
    three = [state("b001", "b004"), state("b000", "b003"), state("b002")]
    assert _rows(fold.merge_states(*three)) == whole
    two = fold.merge_states(*three[:2])
    assert _rows(fold.merge_states(fold.state_events(two), three[2])) == whole

    def shuffles(df):
        return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")

    assert shuffles(two) == sum(shuffles(s) for s in three[:2])
    assert shuffles(fold.merge_states(two, three[2])) == sum(shuffles(s) for s in three)
