"""What the operators of this folder share."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom import session

# White space in texts is ASCII white space everywhere: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
ROWS_PER_FILE = 1 << 14
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder.

    Besides cutting lineage it forgets how the rows are laid out, so a join
    that follows exchanges both sides and adaptive execution can split a hot key.
    """
    return session.cut_lineage(df)


def settle(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Written table in the shared folder, for loops.

    A checkpoint keeps the constraints of its plan, and each step of a loop over
    joins multiplies them until planning takes minutes; a written table has none.
    Where the rows are known to be at most ``rows``, tasks and files are as many
    as they need, not as many as shuffles are set to.
    """
    if rows is not None:
        df = df.coalesce(min(df.rdd.getNumPartitions(), 1 + rows // ROWS_PER_FILE))
    return session.stage(df, "step")


def small_or_not(df: DataFrame, rows: int = session.BROADCAST_ROW_BOUND) -> DataFrame:
    """The frame, marked for broadcast only when a count proves it has few rows."""
    return F.broadcast(df) if session.within(df, rows) else df


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def slices(batches: Iterable[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches in short runs, so that few texts are Python objects at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_of_bytes(batches: Iterable[pa.RecordBatch], name: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut so that their texts hold about ``most`` bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(name)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, upto - at)
            at = upto


def raw(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """A text column as UTF-8; null reads as empty."""
    return [b or b"" for b in batch.column(name).cast(pa.binary()).to_pylist()]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column; null reads as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def extended(schema: T.StructType, added: dict[str, str]) -> T.StructType:
    """A new schema with further columns, given by name and type."""
    more = T.StructType()
    for name, kind in added.items():
        more.add(name, kind)
    return T.StructType([*schema.fields, *more.fields])


def unused(name: str, columns: Iterable[str]) -> str:
    """The name, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
