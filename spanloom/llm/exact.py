"""Exact dedup as a stream with keyed state that never expires.

A stream over the files of documents groups texts by digest. Its state lies in
the disk-backed store of the stream's checkpoint and keeps, per digest, the
number of rows, the row that stays and the file that row is in. A later run over
the same state folder reads only new files. The state is then read as a table.

A digest alone does not decide: the texts of the rows that stay are fetched by
their locator and every other row of their group is compared with them in full.
Rows that differ although their digests agree are grouped again by the text.

Built-in functions only; no text passes through Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import session
from spanloom.llm.common import SPACE, pin

# State on disk. Stores are many and may be small, so none reserves space ahead,
# and a commit writes what changed.
_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextmanager
def _store_settings(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in _STORE}
    for k, v in _STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def normalised(text: Column) -> Column:
    """The text without any ASCII white space; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACE, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _keyed(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        normalised(F.col("text")).alias("norm"),
        F.length(F.coalesce("text", F.lit(""))).alias("points"),
        F.col("_metadata.file_path").alias("file"),
    ).withColumn("digest", digest(F.col("norm")))


def _best() -> Column:
    """Greatest for the row that stays: most code points, then smallest doc_id, then no doc_id."""
    return F.max(F.struct("points", F.bitwise_not("doc_id").alias("turned"), "file"))


def remember(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256) -> None:
    """Feed the files under ``path`` that ``state`` has not seen into its keyed state."""
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    # As a pattern, so that the table may be one file or a folder of files.
    path = path.rstrip("/")
    with _store_settings(spark):
        arriving = spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")
        groups = _keyed(arriving, digest).groupBy("digest").agg(F.count("*").alias("group_size"), _best().alias("best"))
        query = (
            groups.writeStream.outputMode("update").format("noop")
            .option("checkpointLocation", state).trigger(availableNow=True).start()
        )
        query.awaitTermination()


def remembered(spark: SparkSession, state: str) -> DataFrame:
    """(digest, group_size, keep_id, points, file) per digest of the state."""
    stored = spark.read.format("statestore").load(state)
    count, best = stored.schema["value"].dataType.fieldNames()
    return stored.select(
        F.col("key").getField(stored.schema["key"].dataType.fieldNames()[0]).alias("digest"),
        F.col("value").getField(count).alias("group_size"),
        F.bitwise_not(F.col("value").getField(best)["turned"]).alias("keep_id"),
        F.col("value").getField(best)["points"].alias("keep_points"),
        F.col("value").getField(best)["file"].alias("file"),
    )


def _keepers(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per group with the text of the row that stays, found by its file and doc_id."""
    found = rows.join(groups, ["digest", "file"]).filter(
        F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))
    )
    return found.groupBy("digest", "keep_id", "keep_points", "group_size").agg(F.min("norm").alias("keep_norm"))


def _decided(rows: DataFrame) -> DataFrame:
    return rows.select(
        "doc_id", "digest", "keep_id", "group_size", "same", F.sha2("norm", 256).alias("norm_sha256"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points"))).alias("kept"),
    )


def exact_duplicates(
    spark: SparkSession, path: str, state: str | None = None, digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row per row of the documents under ``path``: doc_id, keep_id, group_size, kept, norm_sha256.

    Texts are equal when they agree after deleting all ASCII white space; null
    counts as empty. Of equal texts the row with the most code points stays, then
    the one with the smallest doc_id; a null doc_id comes last. Rows that agree
    in doc_id and length with the row that stays can't be told apart from it and
    stay too. An empty table gives an empty result. ``state`` is a folder that all
    executors share; a new one under spark.checkpoint.dir when not given.
    """
    state = state or session.scratch_path(spark, "exact-state")
    remember(spark, path, state, digest)
    rows = _keyed(spark.read.parquet(path), digest)
    with _store_settings(spark):
        groups = pin(remembered(spark, state).filter(F.col("group_size") > 1))
    few = session.within(groups, session.BROADCAST_ROW_BOUND)
    keepers = session.stage(_keepers(rows, F.broadcast(groups) if few else groups), "exact-keepers")
    own = {"keep_id": F.coalesce("keep_id", "doc_id"), "keep_points": F.coalesce("keep_points", "points"),
           "group_size": F.coalesce("group_size", F.lit(1)), "same": F.coalesce(F.col("norm") == F.col("keep_norm"), F.lit(True))}
    if few:  # rows without an equal need no exchange
        marks = F.broadcast(groups.select("digest"))
        alone = rows.join(marks, "digest", "left_anti").withColumns(
            {"keep_id": F.col("doc_id"), "keep_points": F.col("points"), "group_size": F.lit(1).cast("bigint"), "same": F.lit(True)}
        )
        grouped = rows.join(marks, "digest", "left_semi").join(keepers, "digest").withColumns(own)
        checked = _decided(alone).unionByName(_decided(grouped))
    else:
        checked = _decided(rows.join(keepers, "digest", "left").withColumns(own))
    checked = session.stage(checked, "exact-checked")
    clash = pin(checked.filter(~F.col("same")).select("digest").distinct())
    if clash.limit(1).count():
        again = rows.join(clash, "digest", "left_semi")
        exact = again.groupBy("digest", "norm").agg(F.count("*").alias("group_size"), _best().alias("best"))
        exact = pin(exact.select(
            "digest", "norm", "group_size", F.bitwise_not("best.turned").alias("keep_id"),
            F.col("best.points").alias("keep_points"), F.lit(True).alias("same"),
        ))
        regrouped = _decided(again.join(exact, ["digest", "norm"]))
        checked = checked.join(clash, "digest", "left_anti").unionByName(regrouped.select(*checked.columns))
    return checked.select("doc_id", "keep_id", "group_size", "kept", "norm_sha256")
