from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from spanloom.functions import display, measures
from spanloom.operators import maintenance


def test_duration_text(spark):
    want = {None: "—", 0: "0ms", 999: "999ms", 1000: "1.00s", 1005: "1.00s", 1015: "1.01s", 1125: "1.13s", 2675: "2.67s", 1234: "1.23s",
            59999: "60.00s", 60000: "1m 0s", 119600: "1m 60s", 125000: "2m 5s"}
    df = spark.createDataFrame([(k,) for k in want], "ms bigint")
    assert {r[0]: r[1] for r in df.select("ms", display.duration(F.col("ms"))).collect()} == want


def test_two_places_follow_the_binary_quotient(spark):
    df = spark.range(1000, 60000).select("id", display.duration(F.col("id")).alias("t"))
    wrong = [
        r.id for r in df.collect()
        # Exact ties go up; Python would round them to even.
        if r.t != (f"{(r.id + 5) / 1000:.2f}s" if r.id % 250 == 125 else f"{r.id / 1000:.2f}s")
    ]
    assert wrong == []


def test_cost_text(spark):
    want = {"0": "$0", "0.00000001": "$1.000e-8", "0.00000096": "$9.600e-7", "0.00000123": "$0.00000123", "0.00012340": "$0.0001234",
            "0.00987654": "$0.009877", "0.01": "$0.0100", "0.12345678": "$0.1235", "1.005": "$1.01", "1234.5": "$1234.50", "0.00999999": "$0.01"}
    df = spark.createDataFrame([(D(k),) for k in want], "c decimal(18,8)")
    assert [r[0] for r in df.select(display.cost(F.col("c"))).collect()] == list(want.values())
    assert spark.sql("SELECT cast(0.00000096 AS decimal(18,8)) c").select(display.plain_decimal(F.col("c"))).first()[0] == "0.00000096"


def test_ages_tokens_ids_percent(spark):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    ages = [display.relative_age(at(-s), at(0)) for s in (-5, 0, 59, 60, 3599, 3600, 86399, 90000)]
    assert list(spark.range(1).select(*ages).first()) == ["just now", "0s ago", "59s ago", "1m ago", "1h ago", "1h ago", "1d ago", "1d ago"]
    row = spark.range(1).select(display.tokens(F.lit(1234567)), display.short_id(F.lit("abcdefghij")),
                                *[measures.percent(F.lit(p), F.lit(w)) for p, w in ((1, 8), (1, 200), (0, 5), (3, 0))], display.percent(F.lit(9), F.lit(10))).first()
    assert list(row) == ["1,234,567", "abcdefgh", 13, 1, 0, 0, "90%"]


def test_scores(spark):
    df = spark.createDataFrame([("numeric", D("0.875"), None), ("numeric", D("-1"), None), ("numeric", D("100"), None), ("numeric", D("0"), None), ("boolean", D(1), None), ("boolean", D(0), None),
                                ("categorical", None, "x"), ("categorical", None, None), ("numeric", None, None)], "d string, v decimal(18,6), t string")
    got = df.select(display.score(F.col("d"), F.col("v"), F.col("t")), display.score_is_negative(F.col("d"), F.col("v"))).collect()
    assert [tuple(r) for r in got] == [("0.875", False), ("-1", True), ("100", False), ("0", False), ("yes", False), ("no", True), ("x", False), ("—", False), ("—", False)]


def test_metadata(spark):
    doc = '{"zeta":[1,"a"],"alpha":null,"tools":["x","y"],"finish_reason":"stop","wait_ms":1500,"n":2.5,"flag":true,"o":{"k":1}}'
    df = spark.createDataFrame([(doc,)], "j string").select(F.from_json("j", "map<string,variant>").alias("m"))
    got = [(e.key, e.value) for e in df.select(display.ordered_metadata(F.col("m"))).first()[0]]
    assert got == [("finish_reason", "stop"), ("tools", "x, y"), ("alpha", "—"), ("flag", "true"), ("n", "2.5"), ("o", '{"k":1}'), ("wait_ms", "1.50s"), ("zeta", '[1,"a"]')]
    v = spark.createDataFrame([('"t"',), ('{"a":1}',), ("null",)], "j string").select(F.parse_json("j").alias("v"))
    assert [r[0] for r in v.select(display.payload(F.col("v"))).collect()] == ["t", '{"a":1}', None]


def test_partition_plan(spark):
    days = spark.createDataFrame([(date(2024, 1, 1),)], "day date")
    lost = spark.createDataFrame([(datetime(2024, 1, 2, 5),)] * 2, "started_at timestamp")
    plan = maintenance.partition_plan(days, lost, date(2024, 1, 2), behind=1, ahead=1).orderBy("day")
    assert [(r.partition, r.status, r.stranded) for r in plan.collect()] == [("p20240101", "exists", 0), ("p20240102", "skipped", 2), ("p20240103", "create", 0)]
    assert maintenance.created_count(plan).first()[0] == 1
    assert maintenance.partition_plan(days, lost, date(2024, 1, 2)).count() == 39


def test_window_invariant():
    maintenance.check_windows()
    with pytest.raises(ValueError):
        maintenance.check_windows(age=8)
    with pytest.raises(ValueError):
        maintenance.check_windows(future=30)
