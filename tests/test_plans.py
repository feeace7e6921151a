"""Shapes of the physical plans that matter at scale."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import detail, fold, listing
from spanloom.plans.fixtures import Fixtures


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    fx = Fixtures(spark, "/root/testdata/sf0.001")
    root = str(tmp_path_factory.mktemp("stored"))
    frames = {"traces": fx.traces(), "observations": fx.priced(), "scores": fx.scores()}
    for name, df in frames.items():
        df.write.parquet(f"{root}/{name}")
    return {n: spark.read.parquet(f"{root}/{n}") for n in frames}


@pytest.fixture()
def no_broadcast(spark):
    """Sizes as on a large cluster: nothing is small unless a count proves it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_rollup_is_one_hash_aggregate(stored):
    p = plan(listing.rollup(stored["observations"]))
    assert p.count("Exchange hashpartitioning") == 1 and "SortAggregate" not in p
    assert "partial_sum" in p


def test_set_list_shuffles_each_side_once(stored, no_broadcast):
    p = plan(listing.list_all(stored["traces"], stored["observations"]))
    assert p.count("Exchange hashpartitioning") == 2


def test_seek_reaches_the_files(stored):
    p = plan(listing.after(stored["traces"].select("id", "started_at"), F.lit("1997-01-01").cast("timestamp"), F.lit("x")))
    assert "LessThanOrEqual(started_at" in p[p.index("PushedFilters"):]


def test_filters_reach_the_files(stored):
    p = plan(listing.filter_traces(stored["traces"], {"environment": "prod", "from": "1997-01-01"}).select("id"))
    assert "EqualTo(environment,prod)" in p


def test_newest_page_is_a_top_k(stored):
    p = plan(stored["traces"].orderBy(*listing.newest_first()).limit(51))
    assert "TakeOrderedAndProject" in p and "Exchange range" not in p


def test_few_scores_do_not_shuffle_observations(stored, no_broadcast):
    p = plan(detail.observation_owners(stored["observations"], stored["scores"]))
    scan = p.index("ReadSchema: struct<id:string,project_id:string,trace_id")
    between = p[: scan].rsplit("BroadcastHashJoin", 1)[1]
    assert "Exchange hashpartitioning" not in between.split("FileScan")[0]


def test_fold_aggregates_before_it_shuffles(stored):
    events = stored["observations"]
    p = plan(fold.batch_windows(events))
    assert "partial_min" in p and p.count("Exchange hashpartitioning") == 1


def test_narrowing_beyond_the_bound_changes_nothing(stored, monkeypatch):
    want = sorted(map(tuple, detail.observation_owners(stored["observations"], stored["scores"]).collect()))
    monkeypatch.setattr(session, "BROADCAST_ROW_BOUND", 3)
    full = detail.observation_owners(stored["observations"], stored["scores"])
    assert want == sorted(map(tuple, full.collect()))
    targets = detail.score_targets(stored["scores"], stored["observations"])
    monkeypatch.undo()
    again = detail.score_targets(stored["scores"], stored["observations"])
    assert targets.select("id", "target").exceptAll(again.select("id", "target")).count() == 0


def test_both_sends_of_a_delivery_come_from_one_scan(spark, sf_tables):
    """A trace's open and close, and an observation's repeat, lie in one task; repeats and nulls stay."""
    fx = sf_tables
    for df, table in ((fx.trace_deliveries(), "orders"), (fx.observation_deliveries(), "lineitem")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Union" not in plan and plan.count("Scan parquet") == 1
        assert df.count() == 2 * fx.table(table).count()
    sent = {(r.batch_id[0], r.id[-1]): r for r in fx.trace_deliveries().collect()}
    opened, closed = sent["o", "1"], sent["c", "1"]
    assert (opened.name, opened.user_id, opened.session_id, opened.tags, opened.environment, opened.sdk_version) == ("1-URGENT", "u7", None, [], "staging", "1.0")
    assert (closed.name, closed.session_id, closed.tags, closed.environment, closed.release) == (None, "s7", ["1", "F"], None, "r1996")
    assert (closed.started_at - opened.started_at, closed.received_at - opened.received_at) == (timedelta(hours=2), timedelta(hours=1))
    assert sent["c", "2"].received_at < sent["o", "2"].received_at and sent["o", "3"].started_at is None
    lines = sorted((r.batch_id, r.latency_ms) for r in fx.observation_deliveries().collect() if r.id and r.id[-1] == "1")
    assert lines == [("b1", 5), ("b1", 5), ("rb1", 6), ("rb1", 6)]


@pytest.fixture
def sf_tables(spark, tmp_path):
    spark.sql("""SELECT * FROM VALUES (1L, 7L, 'F', timestamp'1996-01-02', '1-URGENT'), (2L, 8L, 'P', timestamp'1996-01-03', '2-HIGH'),
        (3L, NULL, NULL, NULL, NULL) t(o_orderkey, o_custkey, o_orderstatus, o_orderdate, o_orderpriority)""").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    line = "1L, 5L, 1L, 1, 2.0D, 3.0D, 0.1D, 0.0D, 'A', 'F', timestamp'1996-01-04'"
    spark.sql(f"""SELECT * FROM VALUES ({line}), ({line}), (2L, 5L, 1L, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL)
        t(l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)""").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return Fixtures(spark, str(tmp_path))
