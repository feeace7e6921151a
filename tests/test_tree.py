import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import tree
from spanloom.operators.ranking import has_group_beyond, running_total

T0 = datetime(2024, 1, 1)


def frame(spark, spans):
    rows = [("p", t, i, p, T0 + timedelta(microseconds=us)) for t, i, p, us in spans]
    return spark.createDataFrame(rows, "project_id string, trace_id string, id string, parent_observation_id string, started_at timestamp")


def walk(spans):
    """Row-by-row tree of one trace, as a check."""
    first = {}
    for t, i, p, us in sorted(spans, key=lambda s: s[3]):
        first.setdefault(i, (p or None, us // 1000))
    kind, children = {}, {}
    for i, (p, _) in first.items():
        if not p:
            kind[i] = "root"
        elif p not in first:
            kind[i] = "missing_parent"
        else:
            seen, cur = {i}, p
            while cur in first and cur not in seen:
                seen.add(cur)
                cur = first[cur][0]
            kind[i] = "cycle" if cur in seen else "child"
    for i, k in kind.items():
        children.setdefault(first[i][0] if k == "child" else None, []).append(i)
    out, stack = {}, [(i, 0) for i in sorted(children.get(None, []), key=lambda x: (first[x][1], x), reverse=True)]
    while stack:
        i, d = stack.pop()
        out[i] = (kind[i], d, len(out) + 1)
        stack += [(c, d + 1) for c in sorted(children.get(i, []), key=lambda x: (first[x][1], x), reverse=True)]
    return out


def check(spark, spans):
    got = {}
    for r in tree.span_tree(frame(spark, spans)).collect():
        got.setdefault(r.trace_id, {})[r.id] = (r.kind, r.depth, r.position)
        assert r.orphaned == (r.kind in ("cycle", "missing_parent"))
    for t in {s[0] for s in spans}:
        assert got[t] == walk([s for s in spans if s[0] == t])


def test_shapes(spark):
    spans = [
        ("self", "a", "a", 0), ("self", "b", "a", 1000),
        ("loop", "a", "b", 0), ("loop", "b", "a", 1000), ("loop", "c", "b", 2000), ("loop", "d", "c", 3000), ("loop", "e", "d", 4000),
        ("gone", "a", "zz", 5000), ("gone", "b", "a", 0), ("gone", "c", "b", 0), ("gone", "r", None, 9000), ("gone", "q", "", 9000),
        ("twice", "a", None, 2000), ("twice", "a", "b", 1000), ("twice", "b", None, 500),
        # Same millisecond, other microseconds: the id decides.
        ("ties", "r", None, 0), ("ties", "b", "r", 1001), ("ties", "a", "r", 1900), ("ties", "c", "r", 900),
    ]
    check(spark, spans)


def test_long_chain_and_cycle_beside_it(spark):
    chain = [("deep", f"{i:05d}", f"{i - 1:05d}" if i else None, i) for i in range(1000)]
    ring = [("ring", f"{i:05d}", f"{(i + 1) % 40:05d}", i) for i in range(40)]
    check(spark, chain + ring)


def test_crowded_trace(spark, monkeypatch):
    monkeypatch.setattr(tree, "has_group_beyond", lambda spans, group: True)
    test_random_forests(spark)


def test_random_forests(spark):
    rnd = random.Random(5)
    spans = []
    for t in range(30):
        n = rnd.randrange(1, 60)
        for i in range(n):
            parent = rnd.choice([None, f"{rnd.randrange(n + 3):03d}", f"{max(0, i - 1):03d}"])
            spans.append((f"t{t}", f"{i:03d}", parent, rnd.randrange(5000)))
    check(spark, spans)


def test_hot_parent(spark):
    spans = [("t", "00000", None, 0)] + [("t", f"{i:05d}", "00000", i * 1000) for i in range(1, 20000)]
    check(spark, spans)


def test_span_facts(spark):
    df = spark.sql("""SELECT 'p' project_id, 't' trace_id, id, timestamp'2024-01-01' started_at, level, cached_tokens, 0L reasoning_tokens,
        from_json(m, 'map<string,variant>') metadata, try_parse_json(i) input, try_parse_json(NULL) output
        FROM VALUES ('a', 'FATAL', 0L, '{"finish_reason":"stop"}', NULL), ('b', 'ok', 3L, '{}', NULL), ('c', NULL, 0L, '{}', '1'),
                    ('d', 'critical', 0L, '{"finish_reason":5}', NULL), ('e', 'warn', NULL, '{}', NULL) t(id, level, cached_tokens, m, i)""")
    got = {r.id: (r.is_error, r.finish_reason, r.has_payload, r.has_details) for r in tree.span_facts(df).collect()}
    assert got == {"a": (True, "stop", False, True), "b": (False, None, False, True), "c": (False, None, True, True),
                   "d": (True, None, False, True), "e": (False, None, False, False)}


def test_deep_chain_beside_cycles(spark):
    chain = [("deep", f"s{i:03d}", f"s{i - 1:03d}" if i else None, i) for i in range(300)]
    # Cycles, tails below them, and a cycle in the chain's own trace.
    rings = [("rings", f"{k}-{i}", f"{k}-{(i + 1) % 3}", i) for k in range(20) for i in range(3)]
    tails = [("rings", f"t{i:02d}", f"t{i - 1:02d}" if i else "0-1", i) for i in range(40)]
    own = [("deep", "x", "y", 0), ("deep", "y", "x", 1), ("deep", "z", "y", 2)]
    check(spark, chain + rings + tails + own)


def test_deep_chain_beside_many_cycles_in_time(spark):
    chain = [("deep", f"s{i:05d}", f"s{i - 1:05d}" if i else None, i) for i in range(5000)]
    rings = [("rings", f"{k:04d}-{i}", f"{k:04d}-{(i + 1) % 4}", i) for k in range(2500) for i in range(4)]
    df = session.stage(frame(spark, chain + rings), "deep")
    begun = time.perf_counter()
    got = {(r.trace_id, r.id): (r.kind, r.depth, r.position) for r in tree.span_tree(df).collect()}
    assert time.perf_counter() - begun < 30  # 13 rounds up and 14 down; about 8 s on eight free cores
    for n, (t, i, _, _) in enumerate(chain):
        assert got[t, i] == ("child" if n else "root", n, n + 1)
    by_start = sorted(rings, key=lambda s: (s[3] // 1000, s[1]))
    assert [got[t, i] for t, i, _, _ in by_start] == [("cycle", 0, n + 1) for n in range(len(rings))]


def test_no_arrays_travel(spark, monkeypatch):
    seen = []

    def noting(do):
        def noted(df, *args):
            seen.append(df.schema)
            return do(df, *args)
        return noted

    monkeypatch.setattr(session, "cut_lineage", noting(session.cut_lineage))
    monkeypatch.setattr(session, "stage", noting(session.stage))
    seen.append(tree.span_tree(frame(spark, [("t", f"{i}", f"{i - 1}" if i else None, i) for i in range(6)])).schema)
    assert len(seen) > 6
    assert {f.dataType.typeName() for schema in seen for f in schema} <= {"string", "long", "boolean"}


def test_running_total_of_crowded_groups(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice(["a", "a", "b", None]), i, rnd.randrange(9)) for i in range(5000)]
    df = spark.createDataFrame(rows, "g string, o int, v bigint")
    sums, want = {}, {}
    for g, o, v in rows:
        want[g, o] = sums.get(g, 0)
        sums[g] = want[g, o] + v
    assert has_group_beyond(df, ["g"], 2000) and not has_group_beyond(df, ["g"], 5000)
    for crowded in (True, False):  # range partitions, and one window
        got = running_total(df, ["g"], [F.col("o").asc()], "v", "before", crowded)
        assert {(r.g, r.o): r.before for r in got.collect()} == want
