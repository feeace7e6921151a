"""Pages and tag questions answered from few files."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.functions import cursors
from spanloom.operators import listing
from spanloom.sources import page_files, tag_index

T0 = datetime(2024, 1, 1)
SCHEMA = """id string, project_id string, name string, user_id string, session_id string, tags array<string>, environment string,
    release string, metadata map<string,variant>, started_at timestamp, ended_at timestamp, created_at timestamp, sdk_version string,
    observations_started_min timestamp, observations_started_max timestamp"""


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    # p0 holds most rows; starts repeat, so that ids decide across files.
    return [
        (f"00000000-0000-4000-8000-{i:012d}", rnd.choice(["p0"] * 8 + ["p1", "p2"]), T0 + timedelta(hours=rnd.randrange(700)),
         rnd.sample(["a", "b", "c", "d"], rnd.randrange(4)), rnd.choice(["prod"] * 30 + ["dev"]))
        for i in range(6000)
    ]


@pytest.fixture(scope="module")
def traces(spark, rows):
    none = None
    full = [(i, p, none, none, none, tags, env, none, none, at, none, none, none, none, none) for i, p, at, tags, env in rows]
    return session.stage(spark.createDataFrame(full, SCHEMA), "page-traces")


@pytest.fixture(scope="module")
def stored(spark, traces, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "t")
    page_files.write(traces, path, rows_per_file=200)
    return path


@pytest.fixture(scope="module")
def observations(spark):
    return spark.sql("""SELECT 'p0' project_id, 't' trace_id, timestamp'2024-01-01' started_at, 0L prompt_tokens, 0L completion_tokens,
        0L total_tokens, 0L latency_ms, cast(0 AS decimal(18,8)) cost_usd""")


def expected(rows, project, env=None, lo=None, hi=None):
    own = [r for r in rows if r[1] == project and (env is None or r[4] == env) and (lo is None or r[2] >= lo) and (hi is None or r[2] < hi)]
    return [r[0] for r in sorted(own, key=lambda r: (r[2], r[0]), reverse=True)]


def test_pages_follow_each_other(spark, rows, stored, observations):
    for project in ("p0", "p1"):
        want, cursor = expected(rows, project), None
        for n in range(4):
            page = page_files.list_page(spark, stored, observations, project, limit=130, cursor=cursor)
            assert [r.id for r in page.rows.collect()] == want[n * 130 : (n + 1) * 130]
            cursor = page.next_cursor
            if cursor is None:
                break


def test_few_files_are_opened(spark, rows, stored):
    every = spark.read.parquet(f"{stored}/traces").inputFiles()
    assert len(every) >= 25
    assert len(page_files.newest(spark, stored, "p0", 51).inputFiles()) <= 2
    # From the middle of the list, and within a range of time.
    at, trace_id = sorted([(r[2], r[0]) for r in rows if r[1] == "p0"], reverse=True)[2500]
    cursor = spark.range(1).select(cursors.encode(F.lit(at.isoformat()).cast("timestamp"), F.lit(trace_id)).alias("c")).first().c
    assert len(page_files.newest(spark, stored, "p0", 51, cursor=cursor).inputFiles()) <= 2
    assert len(page_files.newest(spark, stored, "p0", 51, {"to": "2024-01-10T00:00:00Z"}).inputFiles()) <= 2
    assert page_files.newest(spark, stored, "nobody", 51).count() == 0


def test_rare_filter_reads_on_until_the_page_is_whole(spark, rows, stored, observations):
    for filters, args in (
        ({"environment": "dev"}, {"env": "dev"}),
        ({"environment": "dev", "from": "2024-01-08T00:00:00Z", "to": "2024-01-20"}, {"env": "dev", "lo": datetime(2024, 1, 8), "hi": datetime(2024, 1, 20)}),
        ({"environment": "none"}, {"env": "none"}),
    ):
        page = page_files.list_page(spark, stored, observations, "p0", filters, limit=40)
        want = expected(rows, "p0", **args)
        assert [r.id for r in page.rows.collect()] == want[:40]
        assert page.has_more == (len(want) > 40)


def test_no_tenant_and_no_rows(spark, traces, stored, observations, tmp_path):
    assert page_files.list_page(spark, stored, observations, None).rows.count() == 0
    page_files.write(traces.limit(0), str(tmp_path / "none"))
    assert page_files.list_page(spark, str(tmp_path / "none"), observations, "p0").rows.count() == 0


def test_tags(spark, rows, traces, tmp_path):
    path = str(tmp_path / "tags")
    tag_index.write(traces, path, buckets=32)
    for tags in (["a"], ["a", "b"], ["c", "a", "d"], ["a", "nothing"]):
        got = {(r.project_id, r.id, r.started_at) for r in tag_index.traces_with(spark, path, ["p0", "p2"], tags).collect()}
        assert got == {(r[1], r[0], r[2]) for r in rows if r[1] in ("p0", "p2") and set(tags) <= set(r[3])}
        by_array = listing.filter_traces(traces, {"tags": tags}).filter("project_id IN ('p0', 'p2')")
        assert {(r.project_id, r.id) for r in by_array.collect()} == {g[:2] for g in got}
    one = tag_index.traces_with(spark, path, ["p1"], ["a", "b"])
    assert 1 <= sum(n.metrics().apply("numFiles").value() for n in _scans(one)) <= 2
    with pytest.raises(ValueError):
        tag_index.traces_with(spark, path, ["p1"], [])


def _scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, out = [plan], []
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name == "FileSourceScanExec":
            out.append(node)
        else:
            children = node.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


def test_repeated_and_missing_tags(spark, traces, tmp_path):
    odd = spark.createDataFrame([("x", "p", ["a", "a", None, ""], T0), ("y", "p", None, T0), ("z", "p", [], None)],
                                "id string, project_id string, tags array<string>, started_at timestamp")
    tag_index.write(odd, str(tmp_path / "odd"))
    assert [r.id for r in tag_index.traces_with(spark, str(tmp_path / "odd"), ["p"], ["a", ""]).collect()] == ["x"]


def test_small_files_do_not_make_as_many_tasks(spark, tmp_path):
    traces = spark.range(3000).selectExpr(
        "'p' || (id % 3) AS project_id", "cast(id AS string) AS id", "timestamp_seconds(id % 700) AS started_at"
    )
    path = str(tmp_path / "many")
    page_files.write(traces, path, rows_per_file=20)
    files = spark.read.parquet(f"{path}/files").groupBy("file").agg({"rows": "sum"}).collect()
    assert len(files) >= 150 and max(r[1] for r in files) <= 20 and sum(r[1] for r in files) == 3000
    assert len({r.file.split("-")[1] for r in files}) <= spark.sparkContext.defaultParallelism
