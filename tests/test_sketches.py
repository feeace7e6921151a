"""Stored daily summaries merged over ranges, and the score series as a stream."""

import random
from datetime import datetime, timedelta
from decimal import Decimal as D

from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import sketches
from spanloom.streaming import series

T0 = datetime(2024, 1, 1)
LISTED = "project_id string, environment string, release string, user_id string, started_at timestamp, total_tokens bigint, total_cost_usd decimal(28,8)"


def test_cube_over_a_range(spark):
    rnd = random.Random(1)
    rows = [
        (rnd.choice(["p0", "p0", "p1"]), rnd.choice(["prod", None]), rnd.choice(["r1", "r2"]), rnd.choice([None, *[f"u{i}" for i in range(3000)]]),
         T0 + timedelta(hours=rnd.randrange(480)), rnd.randrange(100), D(rnd.randrange(100)) / 8)
        for _ in range(12_000)
    ]
    daily = session.stage(sketches.daily_spend(spark.createDataFrame(rows, LISTED)), "daily")
    sets = [[], ["project_id"], ["project_id", "environment"]]
    since, until = T0 + timedelta(days=3), T0 + timedelta(days=9)
    got = sketches.spend_cube(daily, sets, since=F.lit(since.date()), until=F.lit(until.date())).collect()
    inside = [r for r in rows if since <= r[4] < until + timedelta(days=1)]
    want = {}
    for r in inside:
        for level, key in ((7, (None, None)), (3, (r[0], None)), (1, (r[0], r[1]))):
            want.setdefault((level, *key), []).append(r)
    assert {(g.level, g.project_id, g.environment) for g in got} == set(want) and len(got) == len(want)
    for g in got:
        own = want[g.level, g.project_id, g.environment]
        assert (g.traces, g.total_tokens, g.total_cost_usd) == (len(own), sum(r[5] for r in own), sum(r[6] for r in own))
        users = len({r[3] for r in own} - {None})
        assert abs(g.users - users) <= max(1, 0.0325 * users)


def test_cube_without_rows_or_users(spark):
    none = sketches.daily_spend(spark.createDataFrame([], LISTED))
    assert sketches.spend_cube(none, [["project_id"]]).count() == 0
    one = sketches.daily_spend(spark.createDataFrame([("p", None, None, None, None, None, None)], LISTED))
    (g,) = sketches.spend_cube(one, [["project_id"]]).collect()
    assert (g.traces, g.total_tokens, g.users, g.level) == (1, None, 0, 3)


def test_lag_quantiles_of_any_range(spark):
    rnd = random.Random(4)
    # Skewed lags, one busy project, receipts on many days; no start or receipt counts not at all.
    rows = [(rnd.choice(["p0"] * 9 + ["p1"]), T0 + timedelta(hours=rnd.randrange(900)), int(rnd.paretovariate(1.2) * 100)) for _ in range(20_000)]
    df = spark.createDataFrame([(p, at, at + timedelta(milliseconds=ms)) for p, at, ms in rows] + [("p0", None, T0), ("p0", T0, None)],
                               "project_id string, started_at timestamp, created_at timestamp")
    daily = session.stage(sketches.daily_lag(df), "lags")
    got = {r.project_id: r for r in sketches.lag_over(daily, F.lit("all")).collect()}
    for p, r in got.items():
        own = sorted(ms for q, _, ms in rows if q == p)
        assert (r.rows, r.min_ms, r.max_ms) == (len(own), own[0], own[-1])
        for q, value in ((0.5, r.q50_ms), (0.95, r.q95_ms)):
            slack = sketches.LAG_RANK_ERROR * len(own) + 1
            assert sum(v < value for v in own) <= q * len(own) + slack and sum(v <= value for v in own) >= q * len(own) - slack


def test_series_is_updated_and_leaves_out_what_comes_too_late(spark, tmp_path):
    def send(n, *scores):
        rows = [("p", "s", D(v), T0 + timedelta(days=d)) for d, v in scores]
        spark.createDataFrame(rows, "project_id string, name string, value decimal(18,6), scored_at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in/n={n}")
        arriving = spark.readStream.schema("project_id string, name string, value decimal(18,6), scored_at timestamp").parquet(f"{tmp_path}/in/*")
        series.start_score_series(arriving, f"{tmp_path}/out", f"{tmp_path}/state", lateness="3 days", available_now=True).awaitTermination()
        return {(r.bucket - T0).days: (r.scores, r.mean_value) for r in series.read_score_series(spark, f"{tmp_path}/out").collect()}

    assert send(0, (0, 1), (0, 3), (1, 5)) == {0: (2, 2.0), 1: (1, 5.0)}
    # A day that was handed on is handed on again when it changes.
    assert send(1, (1, 7), (2, 1)) == {0: (2, 2.0), 1: (2, 6.0), 2: (1, 1.0)}
    assert send(2, (20, 4))[20] == (1, 4.0)
    assert send(3, (1, 100), (19, 2)) == {0: (2, 2.0), 1: (2, 6.0), 2: (1, 1.0), 19: (1, 2.0), 20: (1, 4.0)}
