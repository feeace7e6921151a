"""Session settings, shared scratch space and size-checked lookups."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only when a count proves it holds at most this many rows.
BROADCAST_ROW_BOUND = 200_000
# Beyond the bound the lookup side is repeated this often so that a hot key is
# spread over as many tasks.
SALT_FANOUT = 16


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("spanloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the runtime settings the operators rely on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # The virtual machine never compiles a method beyond this size; such a stage runs as split projections instead.
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by spark.checkpoint.dir."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context = spark.sparkContext  # the setting can't change at run time, so the context keeps the folder
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint, so a lost executor costs a re-read and not a re-run."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/spanloom-{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write once to columnar files and read back, for plans that fan out.

    Each reader then prunes to the columns it needs instead of repeating the
    whole upstream plan.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def staged(df: DataFrame, label: str) -> Iterator[DataFrame]:
    """As :func:`stage`, for rows that nothing reads later: the files go at the end."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    try:
        df.write.parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """Give heavy row-wise work all cores when the input has too few splits for them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def within(df: DataFrame, bound: int) -> bool:
    """True when the frame has at most ``bound`` rows; reads no more than that."""
    return df.limit(bound + 1).count() <= bound


def narrowed(facts: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """Facts reduced to wanted keys in the scan, when those keys are few.

    Many keys would need a shuffle of the facts just to drop some of them, so
    then the facts stay as they are and the join that follows does the work.
    """
    ids = wanted.select(*keys).distinct()
    if within(ids, BROADCAST_ROW_BOUND):
        return facts.join(F.broadcast(ids), keys, "left_semi")
    return facts


def lookup_join(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    spread_by: list[Column],
    how: str = "left",
    bound: int = BROADCAST_ROW_BOUND,
) -> DataFrame:
    """Join facts to a dimension that has one row per key.

    A dimension of proven size is broadcast. A larger one is repeated
    ``SALT_FANOUT`` times and the facts are salted by ``spread_by``, so a key
    that holds a third of the facts still lands in many tasks.
    """
    if within(dim, bound):
        return facts.join(F.broadcast(dim), keys, how)
    salted_facts = facts.withColumn(
        "_salt", F.pmod(F.xxhash64(*spread_by), F.lit(SALT_FANOUT)).cast("int")
    )
    salted_dim = dim.withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT_FANOUT - 1)))
    )
    return salted_facts.join(salted_dim, [*keys, "_salt"], how).drop("_salt")
