import hashlib
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import tenancy

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def keys(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = [("k1", "a", sha("one"), "one", "x", ["ingest"], T0, None), ("k2", "a", sha("two"), "two", "y", ["read"], T0 + timedelta(1), None),
            ("k3", "b", sha("three"), "thr", "x", ["ingest", "read"], T0, T0), ("k4", "b", sha("four"), "fou", "z", ["ingest", "read"], T0 + timedelta(2), None)]
    return spark.createDataFrame(rows, "id string, project_id string, key_hash string, key_prefix string, label string, scopes array<string>, created_at timestamp, revoked_at timestamp")


def test_attribution(spark, keys):
    sent = spark.createDataFrame([(i, k) for i, k in enumerate(["one", "two", "three", "four", "none", None])], "batch_id int, api_key string")
    got = [(r.project_id, r.refused) for r in tenancy.attribute_batches(sent, keys).orderBy("batch_id").collect()]
    assert got == [("a", None), ("a", "out_of_scope"), (None, "unauthenticated"), ("b", None), (None, "unauthenticated"), (None, "unauthenticated")]


def test_lookup_beyond_the_bound_is_salted_and_equal(spark):
    facts = spark.range(9000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE 'k' || (id % 100) END AS k")
    dim = spark.range(101).selectExpr("CASE WHEN id = 100 THEN 'hot' ELSE 'k' || id END AS k", "id AS v")
    small = session.lookup_join(facts, dim, ["k"], [F.col("id")])
    large = session.lookup_join(facts, dim, ["k"], [F.col("id")], bound=5)
    assert small.select("id", "k", "v").exceptAll(large.select("id", "k", "v")).count() == 0
    assert large.count() == 9000
    plan = large._jdf.queryExecution().analyzed().toString()
    assert "_salt" in plan


def test_tenant_filter_fails_closed(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "project_id string, v int")
    assert [r.v for r in tenancy.tenant_view(df, "a").collect()] == [1]
    assert tenancy.tenant_view(df, None).count() == tenancy.tenant_view(df, "").count() == 0
    assert tenancy.foreign_rows(df, "a").count() == 1
    assert tenancy.checked_write(df.filter("v = 1"), "a").count() == 1
    with pytest.raises(Exception, match="another tenant"):
        tenancy.checked_write(df, "a").collect()
    with pytest.raises(Exception, match="another tenant"):
        tenancy.checked_write(df, "a").select("v").collect()


def test_isolation_audit(spark):
    projects = spark.createDataFrame([("a",), ("b",)], "project_id string")
    traces = spark.createDataFrame([("a", "t1"), ("b", "t2"), ("x", "t3"), (None, "t4")], "project_id string, id string")
    spans = spark.createDataFrame([("a", "t1"), ("a", "t2"), ("b", "t9"), ("a", None), (None, "t1")], "project_id string, trace_id string")
    found = {r.subject: tuple(r)[1:] for r in tenancy.isolation_audit({"traces": traces, "spans": spans}, projects, {"span.trace": (spans, "trace_id", traces)}).collect()}
    assert found == {"traces": (4, 1, 1), "spans": (5, 1, 0), "span.trace": (4, 1, 2)}


def test_keys(spark, keys):
    assert "key_hash" not in tenancy.key_listing(keys).columns
    at = F.lit("2024-06-01").cast("timestamp")
    revoked = lambda df: {r.id for r in df.filter("revoked_at = timestamp'2024-06-01'").collect()}
    assert revoked(tenancy.revoke_keys(keys, at, "a", label="x")) == {"k1"}
    assert revoked(tenancy.revoke_keys(keys, at, "a")) == {"k1", "k2"}
    assert revoked(tenancy.revoke_keys(keys, at, "b")) == {"k4"}
    members = spark.createDataFrame([("a", "u")], "project_id string, user_id string")
    assert revoked(tenancy.revoke_keys(keys, at, "a", by_user="u", members=members)) == {"k1", "k2"}
    assert revoked(tenancy.revoke_keys(keys, at, "b", by_user="u", members=members)) == set()
    assert {r.id for r in tenancy.oldest_live_keys(keys).collect()} == {"k1", "k4"}


def test_memberships(spark):
    members = spark.createDataFrame([("a", "u1", "member", T0), ("b", "u1", "owner", T0 - timedelta(1))], "project_id string, user_id string, role string, created_at timestamp")
    users = spark.createDataFrame([("u1", "One@x"), ("u2", "two@x"), ("u3", "TWO@x")], "id string, email string")
    grants = spark.createDataFrame([("a", "one@X", "owner", T0 + timedelta(5)), ("c", "one@x", "member", T0), ("a", "two@x", "owner", T0)],
                                   "project_id string, email string, role string, granted_at timestamp")
    got = {(r.project_id, r.user_id): (r.role, r.created_at) for r in tenancy.grant_memberships(members, grants, users).collect()}
    assert got == {("a", "u1"): ("owner", T0), ("b", "u1"): ("owner", T0 - timedelta(1)), ("c", "u1"): ("member", T0)}
    assert [r.email for r in tenancy.ambiguous_emails(users).collect()] == ["two@x"]
    projects = spark.createDataFrame([("a", "A"), ("b", "B")], "project_id string, name string")
    assert [r.project_id for r in tenancy.visible_projects(projects, members, "u1").collect()] == ["b", "a"]
    facts = spark.createDataFrame([("a", 1), ("z", 2)], "project_id string, v int")
    assert [r.v for r in tenancy.rows_of_member(facts, members, "u1").collect()] == [1]


def test_accounts(spark):
    rows = [("s1", "a@x", True, "", None, "sign_in", T0), ("s1", "b@x", True, "Bo", None, "sign_in", T0 + timedelta(1)), ("s1", None, True, None, None, "sign_out", T0 + timedelta(2)),
            ("s2", "c@x", False, "C", None, "sign_in", T0), ("s3", "d@x", True, "D", None, "sign_in", T0)]
    log = spark.createDataFrame(rows, "subject string, email string, verified boolean, name string, avatar_url string, kind string, at timestamp")
    got = {r.subject: r for r in tenancy.fold_accounts(log).collect()}
    assert set(got) == {"s1", "s3"}
    assert (got["s1"].email, got["s1"].name, got["s1"].project_name, got["s1"].session_version) == ("b@x", "Bo", "a@x's project", 1)
    allowed = spark.createDataFrame([("B@x",)], "email string")
    gated = {r.subject: r for r in tenancy.fold_accounts(log, allowed).collect()}
    assert set(gated) == {"s1"} and gated["s1"].created_at == T0 + timedelta(1)
    known = spark.createDataFrame([("s3",)], "subject string")
    assert {r.subject for r in tenancy.fold_accounts(log, allowed, known).collect()} == {"s1", "s3"}
    projects, members = tenancy.personal_projects(tenancy.fold_accounts(log))
    assert projects.count() == members.count() == 2 and {r.role for r in members.collect()} == {"owner"}


def test_purge(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "project_id string, v int")
    kept = tenancy.purge_tenants({"t": df}, df.filter("v = 1"))
    assert [r.v for r in kept["t"].collect()] == [2]
