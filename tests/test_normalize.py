import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.helpers import NOW, Ingested, at, uid


@pytest.fixture(scope="module")
def mixed(spark):
    return Ingested(
        spark,
        {"traces": [{"id": uid(1), "name": "a", "observations": [{"id": uid(11)}]}, {"id": uid(2)}]},
        {"events": [
            {"id": uid(3).upper(), "type": "trace", "userId": " u1 ", "sessionId": "s", "timestamp": at(hours=-1),
             "tags": ["qa", " beta ", "qa", 42], "environment": "   abcdefgh" + "x" * 100, "novel": {"x": 1},
             "metadata": {"env": "prod", "n": 1, "t": "1"}},
            {"id": uid(31), "type": "generation", "trace_id": uid(3), "gen_ai.request.model": "m1",
             "gen_ai.system": "acme", "level": None, "status": "ok", "input": {"messages": ["hi"]}, "output": None,
             "gen_ai.usage.input_tokens": 1000, "gen_ai.usage.output_tokens": 500.0, "cost_usd": 99,
             "start_time": at(), "end_time": at(milliseconds=1234), "prompt_version": 3},
            {"id": uid(32), "type": "embedding-v2", "trace_id": uid(3), "status": "error", "latency_ms": 50.4779,
             "prompt_version": 3.0, "prompt_tokens": "12", "completion_tokens": True, "cached_tokens": 2.5,
             "reasoning_tokens": -1.2},
            {"id": uid(33), "type": "score", "observation_id": uid(31), "name": "ok", "value": True},
            "noise", 7,
        ], "sdk_version": "1.2.3"},
        {"events": []},
        {"records": []},
        "not json",
        {"observations": [{"id": uid(41), "started_at": at()}, {"id": uid(42), "startTime": at(days=-30)},
                          {"id": uid(43), "startTime": at(days=10)}]},
        {"observations": [{"id": uid(51), "trace_id": uid(52), "started_at": at(days=-7)},
                          {"id": uid(53), "started_at": at(days=1)}]},
    )


def test_verdicts_and_counts(mixed):
    got = [(v.status, v.reason, v.accepted_traces, v.accepted_observations, v.accepted_scores, v.rejected_observations)
           for v in mixed.verdicts]
    assert got == [
        ("accepted", None, 2, 1, 0, 0), ("accepted", None, 1, 2, 1, 0), ("accepted", None, 0, 0, 0, 0),
        ("refused", "malformed", 0, 0, 0, 0), ("refused", "malformed", 0, 0, 0, 0),
        ("accepted", None, 0, 1, 0, 2),
        # The edges are judged against the receive time, here six minutes after NOW.
        ("accepted", None, 0, 1, 0, 1),
    ]


def test_trace_fields(mixed):
    t = mixed.traces[2]
    assert (t.id, t.user_id, t.session_id, t.tags, t.sdk_version) == (uid(3), "u1", "s", ["qa", "beta"], "1.2.3")
    assert t.environment == "abcdefgh" + "x" * 53
    assert t.metadata == '{"env":"prod","n":1,"t":"1"}'
    assert t.started_at == dt.datetime(2024, 5, 1, 11)


def test_observation_fields(mixed):
    o = {r.id: r for r in mixed.observations}
    g = o[uid(31)]
    assert (g.model, g.provider, g.level, g.prompt_version) == ("m1", "acme", None, "3")
    assert (g.prompt_tokens, g.completion_tokens, g.total_tokens, g.latency_ms) == (1000, 500, 1500, 1234)
    assert g.input == '{"messages":["hi"]}' and g.output is None
    e = o[uid(32)]
    assert (e.type, e.level, e.latency_ms, e.prompt_version) == ("embedding-v2", "error", 50, "3.0")
    assert (e.prompt_tokens, e.completion_tokens, e.cached_tokens, e.reasoning_tokens) == (12, 1, 2, 0)
    # No start of its own: the sibling trace's start, and no latency from it.
    assert e.started_at == dt.datetime(2024, 5, 1, 11)
    nested = o[uid(11)]
    assert nested.trace_id == uid(1) and nested.started_at == NOW.replace(tzinfo=None)
    assert o[uid(41)].trace_id == uid(41)


def test_score_fields(mixed):
    (s,) = mixed.scores
    assert (s.data_type, int(s.value), s.value_text, s.source) == ("boolean", 1, None, "human")
    assert s.scored_at == NOW.replace(tzinfo=None) + dt.timedelta(minutes=1)


BAD = {
    "bad uuid": {"traces": [{"id": "zzz"}]},
    "null id": {"traces": [{"id": None}]},
    "bad parent": {"observations": [{"parent": "x"}]},
    "name is number": {"observations": [{"name": 5}]},
    "type is null": {"observations": [{"type": None}]},
    "count is text": {"observations": [{"prompt_tokens": "many"}]},
    "count too large": {"observations": [{"prompt_tokens": 3_000_000_000}]},
    "metadata is list": {"traces": [{"metadata": []}]},
    "metadata is null": {"observations": [{"metadata": None}]},
    "time is text": {"traces": [{"started_at": "yesterday"}]},
    "time of day only": {"traces": [{"started_at": "12:30"}]},
    "nested is not a list": {"traces": [{"observations": {}}]},
    "nested member is bad": {"traces": [{"observations": [{"id": "x"}]}]},
    "member is text": {"traces": ["x"]},
    "score without name": {"scores": [{"value": 1}]},
    "score with blank name": {"scores": [{"name": "  ", "value": 1}]},
    "score without value": {"scores": [{"name": "a", "value": None}]},
    "score name too long": {"scores": [{"name": "n" * 256, "value": 1}]},
    "source too long": {"scores": [{"name": "a", "value": 1, "source": "s" * 33}]},
    "name too long": {"traces": [{"name": "n" * 256}]},
    "level too long": {"observations": [{"level": "l" * 17}]},
    "boolean version": {"observations": [{"prompt_version": True}]},
    "native list is null": {"traces": None},
    "sdk version is number": {"events": [], "sdk_version": 3},
    "list of lists beside events": {"events": [], "traces": {"a": 1}},
}
GOOD = {
    "null native list beside events": {"events": [], "traces": None},
    "events that are no list": {"events": "x"},
    "null texts": {"traces": [{"name": None, "tags": None, "started_at": None}]},
    "packed uuid": {"traces": [{"id": uid(9).replace("-", "")}]},
    "unix time": {"traces": [{"started_at": 1714564800}, {"started_at": 1714564800000}]},
    "minutes and short offset": {"traces": [{"started_at": "2024-05-01T12:00Z"}, {"started_at": "2024-05-01 14:00+02"}]},
    "empty body parts": {"scores": []},
}


def test_one_bad_member_refuses_its_batch_only(spark):
    run = Ingested(spark, *BAD.values(), *GOOD.values())
    got = dict(zip([*BAD, *GOOD], run.verdicts))
    assert [n for n in BAD if got[n].status != "refused"] == []
    assert [(n, got[n].reason) for n in GOOD if got[n].status != "accepted"] == []
    starts = {t.started_at for t in run.traces if t.batch_id >= f"b{len(BAD) + 4:03d}"}
    assert starts == {dt.datetime(2024, 5, 1, 12)}
    assert uid(9) in {t.id for t in run.traces}


def test_ceilings(spark):
    run = Ingested(
        spark,
        {"traces": [{} for _ in range(1001)]},
        {"traces": [{"observations": [{} for _ in range(2000)]} for _ in range(3)]},
        {"traces": [{"observations": [{} for _ in range(2001)]}]},
        {"scores": [{"name": "a", "value": 1}] * 10_001},
        {"observations": [{} for _ in range(5000)]},
    )
    assert [v.reason for v in run.verdicts] == [
        "too_large_schema", "too_large_config", "too_large_schema", "too_large_schema", None,
    ]


def test_tags_latency_and_clip(spark):
    run = Ingested(
        spark,
        {"traces": [{"tags": [f"t{i}" for i in range(40)]}, {"tags": "solo"}, {"tags": {"a": 1}}, {"tags": ["x" * 70]}]},
        {"observations": [
            {"started_at": at(), "ended_at": at(milliseconds=ms), "prompt_name": "   " + "n" * 300} for ms in (1001, 1003, 2002, -5)
        ]},
        {"scores": [{"name": "a", "value": v, "trace_id": uid(1)} for v in (True, 0.875, "billing", 1, "5", " " + "z" * 300)]
         + [{"name": "none", "value": 1}]},
    )
    tags = [t.tags for t in run.traces]
    assert [len(t) for t in tags] == [32, 1, 0, 1] and len(tags[3][0]) == 64
    assert [o.latency_ms for o in run.observations] == [1000, 1002, 2001, None]
    assert {len(o.prompt_name) for o in run.observations} == {252}
    assert [(s.data_type, None if s.value is None else float(s.value), s.value_text and len(s.value_text)) for s in run.scores[:6]] == [
        ("boolean", 1.0, None), ("numeric", 0.875, None), ("categorical", None, 7), ("numeric", 1.0, None),
        ("categorical", None, 1), ("categorical", None, 255),
    ]
    assert (run.verdicts[2].accepted_scores, run.verdicts[2].rejected_scores) == (6, 1)


def test_generated_ids_are_stable_and_distinct(spark):
    body = {"traces": [{"observations": [{}, {}]}], "observations": [{}], "scores": [{"name": "a", "value": 1}]}
    first, second = Ingested(spark, body), Ingested(spark, body)
    ids = lambda r: [x.id for x in (*r.traces, *r.observations, *r.scores)]
    assert ids(first) == ids(second) and len(set(ids(first))) == 5


def test_trace_start_comes_from_nested_observations(spark):
    run = Ingested(spark, {"traces": [{"observations": [{"startTime": at(hours=2)}, {"started_at": at(hours=1)}, {}]}]})
    assert run.traces[0].started_at == dt.datetime(2024, 5, 1, 13)
    assert run.observations[2].started_at == dt.datetime(2024, 5, 1, 13)


def test_ids_in_canonical_form_take_one_pattern(spark):
    from spanloom.functions import values

    want = "0a000000-0000-4000-8000-00000000000f"
    shapes = [want, want.upper(), want + "\n", "{" + want + "}", "urn:uuid:" + want, want.replace("-", ""), want + "0", " " + want]
    rows = spark.createDataFrame([(s,) for s in shapes], "s string").select("s", F.expr("parse_json(to_json(named_struct('v', s)))").alias("d"))
    v = values.member(F.col("d"), "v")
    got = {r.s: r.id for r in rows.select("s", values.uuid(v, values.kind(v)).alias("id")).collect()}
    assert [got[s] for s in shapes] == [want] * 6 + [None] * 2


def test_methods_beyond_what_the_machine_compiles_are_split(spark):
    from spanloom import session

    assert session.prepare(spark).conf.get("spark.sql.codegen.hugeMethodLimit") == "8000"
