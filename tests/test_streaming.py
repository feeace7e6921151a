import hashlib
import json
from datetime import timedelta
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import listing
from spanloom.sources import batches as raw_batches
from spanloom.sources import tables
from spanloom.streaming import ingest
from tests.helpers import NOW, at, batches, uid


@pytest.fixture()
def dims(spark):
    sha = hashlib.sha256(b"key").hexdigest()
    keys = spark.createDataFrame([(sha, "p1", ["ingest"], None)], "key_hash string, project_id string, scopes array<string>, revoked_at timestamp")
    prices = spark.createDataFrame([("m", D(1), D(2), None)], "model_key string, input_usd_per_mtok decimal(12,6), output_usd_per_mtok decimal(12,6), cached_input_usd_per_mtok decimal(12,6)")
    return keys, prices


def deliver(folder, name, n, body, key="key"):
    row = {"batch_id": name, "received_at": (NOW + timedelta(minutes=n)).isoformat(), "api_key": key, "body": json.dumps(body)}
    (folder / f"{name}.json").write_text(json.dumps(row) + "\n")


def test_stream_over_several_epochs(spark, tmp_path, dims):
    keys, prices = dims
    inbox = tmp_path / "in"
    inbox.mkdir()
    span = {"id": uid(2), "trace_id": uid(1), "started_at": at(), "model": "m-1", "prompt_tokens": 1_000_000}
    deliver(inbox, "a", 0, {"observations": [span, span, {"id": uid(3), "started_at": at(days=-40)}]})
    layout = ingest.Layout.under(str(tmp_path / "store"))

    def run():
        raw = raw_batches.stream_batches(spark, str(inbox))
        ingest.start_ingest(raw, layout, str(tmp_path / "ck"), prices, keys, available_now=True).awaitTermination()

    run()
    deliver(inbox, "b", 1, {"traces": [{"id": uid(1), "name": "real", "started_at": at(seconds=1)}], "observations": [span],
                            "scores": [{"id": uid(7), "trace_id": uid(1), "name": "s", "value": 1}, {"name": "lost", "value": 1}]})
    deliver(inbox, "d", 3, {"traces": [{"id": "bad"}]})
    deliver(inbox, "e", 4, {"traces": []}, key="wrong")
    run()

    # Compaction, then later deliveries on top of the base.
    base = str(tmp_path / "base")
    tables.compact_traces(spark, layout.trace_log, base)
    deliver(inbox, "c", 4, {"observations": [dict(span, name="late repeat")], "scores": [{"id": uid(7), "trace_id": uid(1), "name": "again", "value": 1}]})
    deliver(inbox, "f", 5, {"traces": [{"id": uid(1), "user_id": "u", "started_at": at(seconds=1)}]})
    run()

    (o,) = spark.read.parquet(layout.observations).collect()
    assert (o.id, o.cost_usd, o.name, o.project_id) == (uid(2), D("1.00000000"), None, "p1")
    (s,) = spark.read.parquet(layout.scores).collect()
    assert s.name == "s"
    (t,) = tables.read_traces(spark, layout.trace_log).collect()
    assert (t.name, t.observations_started_min) == ("real", NOW.replace(tzinfo=None))
    assert {(r.batch_id, r.reason) for r in spark.read.parquet(layout.refusals).collect()} == {("d", "id: not a uuid"), ("e", "unauthenticated")}
    report = {r.batch_id: (r.accepted_observations, r.rejected_observations, r.accepted_scores, r.rejected_scores) for r in spark.read.parquet(layout.reports).collect()}
    assert report == {"a": (2, 1, 0, 0), "b": (1, 0, 1, 1), "c": (1, 0, 1, 0), "d": (0, 0, 0, 0), "f": (0, 0, 0, 0)}

    whole = tables.read_traces(spark, layout.trace_log).drop("metadata").collect()
    stepped = tables.read_traces(spark, layout.trace_log, base).drop("metadata").collect()
    assert whole == stepped and whole[0].user_id == "u" and whole[0].name == "real"
    page = listing.list_page(tables.read_traces(spark, layout.trace_log), spark.read.parquet(layout.observations), "p1")
    assert page.rows.first().total_cost_usd == D("1.00000000")


def test_replayed_epoch_overwrites_itself(spark, tmp_path, dims):
    _, prices = dims
    layout = ingest.Layout.under(str(tmp_path / "store"))
    rows = [("a", NOW.replace(tzinfo=None), "p1", json.dumps({"traces": [{"id": uid(1), "started_at": at(), "observations": [{"id": uid(2), "started_at": at()}]}]}))]
    df = spark.createDataFrame(rows, "batch_id string, received_at timestamp_ntz, project_id string, body string").withColumn("received_at", F.col("received_at").cast("timestamp"))
    for _ in range(2):
        ingest.write_epoch(df, 0, layout, prices)
    ingest.write_epoch(df, 1, layout, prices)
    other = df.withColumn("batch_id", F.lit("b"))
    with pytest.raises(ValueError, match="other input"):
        ingest.write_epoch(other, 0, layout, prices)
    ingest.write_epoch(other, 0, layout, lambda: prices, stream="restarted")
    assert spark.read.parquet(layout.observations).count() == 1
    assert tables.read_traces(spark, layout.trace_log).count() == 1


def test_dedupe_stream_keeps_one(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.sql("SELECT 'p' project_id, 'i' || (id % 10) id, timestamp'2024-01-01' started_at, timestamp'2024-01-01' received_at, 'b' batch_id, id ordinal FROM range(100)").write.parquet(src)
    for day in (20, 2, 25):  # far apart and out of order
        spark.sql(f"SELECT 'p' project_id, 'j' || (id % 10) id, timestamp'2024-01-{day}' started_at, timestamp'2024-01-01' received_at, 'b' batch_id, id ordinal FROM range(100)").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    ingest.start_dedupe(stream, out, str(tmp_path / "ck"), available_now=True).awaitTermination()
    assert spark.read.parquet(out).count() == 40


def test_an_epoch_written_again_leaves_nothing_behind(spark, tmp_path):
    """The second attempt has rows on fewer days, then none at all; another epoch and stream stay."""
    path = str(tmp_path / "obs")
    schema = "project_id string, id string, started_at timestamp, received_at timestamp, batch_id string, ordinal bigint"
    when = NOW.replace(tzinfo=None)
    two = spark.createDataFrame([("p", str(i), when + timedelta(days=i), when, "b", i) for i in range(2)], schema)
    other = spark.createDataFrame([("p", "9", when, when, "b", 0)], schema)
    for n, (df, epoch, stream) in enumerate(((two, 0, "a=b/*"), (other, 1, "a=b/*"), (two.filter("id = '1'"), 0, "a=b/*"))):
        tables.append_observations(df, path, epoch, stream)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["1", "9"]
    tables.append_observations(two.limit(0), path, 0, "a=b/*")
    assert [r.id for r in spark.read.parquet(path).collect()] == ["9"]
    tables.append_rows(two, str(tmp_path / "rows"), 0)
    tables.append_rows(two.filter("id = '1'"), str(tmp_path / "rows"), 0)
    assert [r.id for r in spark.read.parquet(str(tmp_path / "rows")).collect()] == ["1"]


def test_members_of_an_epoch_lie_in_files_that_go(spark, tmp_path, dims, monkeypatch):
    """Nothing is kept in executors' memory while an epoch is written, and no scratch files stay."""
    _, prices = dims
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    seen, write = [], tables.append_scores
    kept = lambda: (spark.sparkContext._jsc.getPersistentRDDs().size(), len(list(tmp_path.glob("spanloom-members-*"))))
    before = kept()

    def noted(*args):
        seen.append(kept())
        write(*args)

    monkeypatch.setattr(tables, "append_scores", noted)
    df = batches(spark, {"traces": [{"id": uid(1), "observations": [{"id": uid(2), "started_at": at()}]}], "scores": [{"id": uid(3), "trace_id": uid(1), "name": "s", "value": 1}]})
    layout = ingest.Layout.under(str(tmp_path / "store"))
    ingest.write_epoch(df, 0, layout, prices)
    assert seen == [(before[0], before[1] + 1)] and kept() == before
    assert spark.read.parquet(layout.observations).count() == spark.read.parquet(layout.scores).count() == 1


def test_many_stored_keys_are_not_broadcast(spark, tmp_path, monkeypatch):
    """An epoch beyond the bound is compared with what is stored by sorting, whatever the files' sizes."""
    path = str(tmp_path / "obs")
    sent = spark.range(60).selectExpr(
        "'p' AS project_id", "'i' || id AS id", "timestamp'2024-05-01' AS started_at", "timestamp'2024-05-01' AS received_at", "'b' AS batch_id", "id AS ordinal"
    )
    tables.append_observations(sent.filter("ordinal < 40"), path, 0)
    monkeypatch.setattr(session, "BROADCAST_ROW_BOUND", 5)
    later = sent.filter("ordinal >= 20").withColumn("started_date", F.to_date("started_at"))
    fresh = tables._without_stored(later, path, 1, "started_date", ["project_id", "id", "started_at"], True, tables.MAIN)
    assert sorted(r.ordinal for r in fresh.collect()) == list(range(40, 60))
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and plan.count("SortMergeJoin") >= 2
