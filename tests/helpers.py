from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from spanloom import session
from spanloom.operators import normalize

NOW = datetime(2024, 5, 1, 12, tzinfo=timezone.utc)


def uid(n: int) -> str:
    return f"00000000-0000-4000-8000-{n:012d}"


def at(**offset) -> str:
    return (NOW + timedelta(**offset)).isoformat()


def batches(spark, *bodies, every: timedelta = timedelta(minutes=1)):
    """Bodies as deliveries, one minute apart from NOW on."""
    rows = [
        (f"b{i:03d}", (NOW + every * i).replace(tzinfo=None), "p1", b if isinstance(b, str) else json.dumps(b))
        for i, b in enumerate(bodies)
    ]
    df = spark.createDataFrame(rows, "batch_id string, received_at timestamp_ntz, project_id string, body string")
    return df.withColumn("received_at", F.col("received_at").cast("timestamp"))


class Ingested:
    """Everything one normalisation run produces, fetched."""

    def __init__(self, spark, *bodies):
        members = session.stage(normalize.read_members(batches(spark, *bodies)), "t")
        verdicts = normalize.batch_verdicts(members)
        self.verdicts = verdicts.orderBy("batch_id").collect()
        good = normalize.accepted_members(members, verdicts)
        self.trace_df = normalize.trace_events(good)
        self.observation_df = normalize.observation_events(good)
        self.score_df = normalize.score_events(good)

    @staticmethod
    def _plain(df):
        for c in ("metadata", "input", "output"):
            if c in df.columns:
                df = df.withColumn(c, F.to_json(c))
        return df.orderBy("batch_id", "ordinal").collect()

    @property
    def traces(self):
        return self._plain(self.trace_df)

    @property
    def observations(self):
        return self._plain(self.observation_df)

    @property
    def scores(self):
        return self._plain(self.score_df)
