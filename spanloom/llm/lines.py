"""Line dedup through a sharded minimal perfect hash.

1. Every text is split at line ends; the key of a line is hashed to 128 bits.
   A key counts only when it is long enough and more than one document holds it.
2. The recurring keys are dealt to shards by hash. Each shard builds a minimal
   perfect hash over its keys (level bitmaps as in Limasset et al., "Fast and
   scalable minimal perfect hashing for massive key sets", 2017), which indexes
   three flat arrays: a second hash as fingerprint, the number of lines, and the
   smallest doc_id. Keys that one document holds alone can't decide anything and
   are not indexed; the fingerprint tells them apart from indexed ones.
3. Documents probe the arrays with the hashes of their lines, 16 bytes each,
   packed per document and shard. Only the hashes a document must drop return.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from spanloom import session
from spanloom.llm.common import SPACE, extended, raw, slices

MIN_CHARS = 10  # code points of a key below which a line always stays
SHARD_KEYS = 100_000  # keys a shard is meant to index
GROUP_PROBES = 500_000  # probes one task is meant to answer
LISTED_SHARDS = 65_536  # busy shards that tasks are told of one by one
NO_ID = (1 << 63) - 1  # a missing doc_id sorts after all others
_BLANK = SPACE.encode()
_ENTRY = np.dtype([("h", "<u8"), ("f", "<u8")])


# -- keys -------------------------------------------------------------------------

def line_hashes(text: bytes, min_chars: int = MIN_CHARS) -> tuple[list[bytes], np.ndarray]:
    """The lines of a text, and for each a pair of 64-bit hashes of its key; (0, 0) where it always stays."""
    lines = text.split(b"\n")
    marks = np.zeros(len(lines), _ENTRY)
    for i, line in enumerate(lines):
        key = line.strip(_BLANK).lower()
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            h = xxhash.xxh3_128_intdigest(key)
            marks[i] = h >> 64, h & 0xFFFF_FFFF_FFFF_FFFF
    return lines, marks


# -- minimal perfect hash -------------------------------------------------------------

def _mix(h: np.ndarray, level: int) -> np.ndarray:
    """A fresh 64-bit hash for each level (the finaliser of splitmix64)."""
    z = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFF_FFFF_FFFF_FFFF)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


class PerfectHash:
    """Maps n distinct 64-bit keys one to one to 0 .. n - 1; other keys map anywhere or to -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        ones = np.bitwise_count(bits)
        self.before = np.concatenate([[0], np.cumsum(ones)]).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        sizes, levels, left = [], [], keys
        while len(left):
            size = max(64, (2 * len(left) + 63) // 64 * 64)
            at = (_mix(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, size in enumerate(self.sizes):
            at = self.starts[level] + (_mix(keys[open_], level) % np.uint64(size)).astype(np.int64)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (self.bits[word] >> bit) & np.uint64(1) == 1
            lower = self.bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            rank = self.before[word] + np.bitwise_count(lower)
            out[open_[hit]] = rank[hit]
            open_ = open_[~hit]
        return out


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    """One row: the hash of a shard and the arrays it indexes."""
    keys = pdf.h.to_numpy(np.int64).view(np.uint64)
    # Two keys may share the first hash at 100 TB; they then share an entry chain by the second.
    unique, first = np.unique(keys, return_index=True)
    perfect = PerfectHash.build(unique)
    place = perfect.index(keys)
    order = np.argsort(place, kind="stable")
    starts = np.searchsorted(place[order], np.arange(len(unique) + 1))
    return pd.DataFrame({
        "shard": [pdf.shard.iloc[0]],
        "sizes": [np.array(perfect.sizes, np.int64).tobytes()],
        "bits": [perfect.bits.tobytes()],
        "starts": [starts.astype(np.int64).tobytes()],
        "marks": [pdf.f.to_numpy(np.int64)[order].tobytes()],
        "counts": [pdf.n.to_numpy(np.int64)[order].tobytes()],
        "owners": [pdf.owner.to_numpy(np.int64)[order].tobytes()],
    })


SHARD = "shard int, sizes binary, bits binary, starts binary, marks binary, counts binary, owners binary"


def probe_shard(probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """For each document the hashes of the lines that another, smaller doc_id owns."""
    ids, drops = [], []
    if len(shard) and len(probes):
        row = shard.iloc[0]
        perfect = PerfectHash(list(np.frombuffer(row.sizes, np.int64)), np.frombuffer(row.bits, np.uint64))
        starts, marks, owners = (np.frombuffer(row[c], np.int64) for c in ("starts", "marks", "owners"))
        packed = probes.hashes.tolist()
        asked = np.frombuffer(b"".join(packed), _ENTRY)
        of = np.repeat(np.arange(len(packed)), [len(b) // _ENTRY.itemsize for b in packed])
        who = probes.owner.to_numpy(np.int64)
        place = perfect.index(asked["h"].copy())
        drop = np.zeros(len(asked), bool)
        f = asked["f"].copy().view(np.int64)
        live = np.flatnonzero(place >= 0)
        at, end = starts[place[live]], starts[place[live] + 1]
        while len(live):
            hit = (marks[at] == f[live]) & (owners[at] < who[of[live]])
            drop[live[hit]] = True
            at = at + 1
            more = at < end
            live, at, end = live[more], at[more], end[more]
        kept, owner_of = asked[drop], of[drop]
        if len(kept):
            start = np.flatnonzero(np.concatenate([[True], owner_of[1:] != owner_of[:-1]]))
            ids = who[owner_of[start]]
            drops = [part.tobytes() for part in np.split(kept, start[1:])]
    return pd.DataFrame({"owner": pd.Series(ids, dtype="int64"), "drops": pd.Series(drops, dtype="object")})


# -- the operator -----------------------------------------------------------------------

def _pre_counted(batches, min_chars):
    """Per run of texts each key once, with its lines, and its smallest and largest doc_id."""
    for batch in slices(batches, 2048):
        marks, ids = [], []
        for owner, text in zip(batch.column("owner").to_pylist(), raw(batch, "text")):
            m = line_hashes(text, min_chars)[1]
            m = m[m["h"] | m["f"] != 0]
            marks.append(m)
            ids.append(np.full(len(m), owner, np.int64))
        m, owner = np.concatenate(marks), np.concatenate(ids)
        if not len(m):
            continue
        order = np.lexsort((owner, m["f"], m["h"]))
        m, owner = m[order], owner[order]
        new = np.concatenate([[True], m[1:] != m[:-1]])
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(m))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(m["h"][start].copy().view(np.int64)), pa.array(m["f"][start].copy().view(np.int64)),
                pa.array(end - start), pa.array(owner[start]), pa.array(owner[end - 1]),
            ],
            ["h", "f", "n", "lo", "hi"],
        )


def recurring_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, int]:
    """(h, f, n, owner) for keys in two documents or more, and the number of keyed lines in all."""
    seen = docs.mapInArrow(
        lambda b: _pre_counted(b, min_chars), "h bigint, f bigint, n bigint, lo bigint, hi bigint"
    )
    total = Observation()
    counted = (
        seen.groupBy("h", "f")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("owner"), F.max("hi").alias("last"))
        .observe(total, F.sum("n").alias("lines"))
        .filter(F.col("owner") < F.col("last"))
        .drop("last")
    )
    kept = session.stage(counted, "line-keys")
    return kept, total.get["lines"] or 0


def groups_of_shards(keys: DataFrame, lines: int, shards: int, tasks: int) -> tuple[int, dict[int, int]]:
    """In how many groups a shard's documents are dealt: for most shards, and for busy ones.

    A line that every document holds is probed once per document, all in one shard. The
    counts of the keys tell each shard's load; no group is meant to get more than twice the
    load of a usual one, nor than ``GROUP_PROBES``. At most ``LISTED_SHARDS`` are named: where more are
    busy, all shards get as many groups as the least busy of the others need.
    """
    own = session.stage(keys.groupBy(F.pmod("h", F.lit(shards)).cast("int").alias("shard")).agg(F.sum("n").alias("n")), "line-loads")
    indexed, median = own.agg(F.sum("n"), F.percentile_approx("n", 0.5)).first()
    # Keys that are not indexed fall on all shards alike.
    rest = (lines - (indexed or 0)) / shards
    middle = max(1, (median or 0) + rest)
    usual = max(math.ceil(middle / GROUP_PROBES), math.ceil(2 * tasks / shards))
    need = own.withColumn("groups", F.ceil((F.col("n") + rest) / min(GROUP_PROBES, 1.5 * middle / usual)))
    power = F.ceil(F.log2("groups")).cast("int")
    # One row per power of two.
    sizes = need.filter(F.col("groups") > usual).groupBy(power.alias("power")).count().orderBy(F.col("power").desc()).collect()
    named, least = 0, usual
    for r in sizes:
        named += r["count"]
        if named > LISTED_SHARDS:
            least = 1 << r.power
            break
    busy = need.filter(F.col("groups") > least).select("shard", "groups").collect()
    return least, {r.shard: r.groups for r in busy}


def dropped_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(owner, drops): per doc_id the packed hashes of the lines it loses."""
    spark = docs.sparkSession
    keys, lines = recurring_keys(docs, min_chars)
    shards = max(1, math.ceil(keys.count() / SHARD_KEYS))
    usual, busy = groups_of_shards(keys, lines, shards, spark.sparkContext.defaultParallelism)
    arrays = session.stage(
        keys.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build_shard, SHARD),
        "line-arrays",
    )

    def ask(batches):
        for batch in slices(batches):
            rows = []
            owners = batch.column("owner").to_pylist()
            # Ids may share a factor with the number of groups, so they are mixed first.
            dealt = (_mix(np.array(owners, np.int64).view(np.uint64), 0) >> np.uint64(1)).tolist()
            for owner, deal, text in zip(owners, dealt, raw(batch, "text")):
                m = np.unique(line_hashes(text, min_chars)[1])
                m = m[m["h"] | m["f"] != 0]
                if len(m):
                    shard = np.mod(m["h"].copy().view(np.int64), shards)
                    for s in np.unique(shard):
                        rows.append((int(s), deal % busy.get(int(s), usual), owner, m[shard == s].tobytes()))
            if rows:
                s, c, o, h = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s, pa.int32()), pa.array(c, pa.int32()), pa.array(o, pa.int64()), pa.array(h, pa.binary())],
                    ["shard", "copy", "owner", "hashes"],
                )

    probes = docs.mapInArrow(ask, "shard int, copy int, owner bigint, hashes binary")
    named = F.broadcast(spark.createDataFrame(list(busy.items()), "shard int, _groups bigint"))  # LISTED_SHARDS rows at most
    groups = F.coalesce("_groups", F.lit(usual)).cast("int")
    served = arrays.join(named, "shard", "left").withColumn("copy", F.explode(F.sequence(F.lit(0), groups - 1))).drop("_groups")
    return (
        probes.groupBy("shard", "copy")
        .cogroup(served.groupBy("shard", "copy"))
        .applyInPandas(probe_shard, "owner bigint, drops binary")
    )


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("owner"), "text")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """All rows and columns of ``docs`` with n_lines, n_dropped and kept_text added.

    doc_id is an integer. A line whose key, stripped of white space at both ends
    and with A-Z in lower case, has at least ``min_chars`` code points and is
    found in two documents or more stays only in the document with the smallest
    doc_id, there as often as it occurs. Null and empty texts are one empty line.
    A null doc_id counts as one document after all others. Rows that share a
    doc_id are one document. An empty table gives an empty result. Columns of
    ``docs`` that have the added names are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_text", "_owner", "_drops")
    drops = dropped_hashes(_prepared(docs), min_chars).groupBy("owner").agg(F.collect_set("drops").alias("_drops"))
    tagged = (
        docs.withColumn("_owner", F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)))
        .join(drops.withColumnRenamed("owner", "_owner"), "_owner", "left")
        .drop("_owner")
    )
    shown = [c for c in tagged.columns if c != "_drops"]

    def rebuild(batches):
        for batch in slices(batches):
            n, gone, kept = [], [], []
            for text, packed in zip(raw(batch, "text"), batch.column("_drops").to_pylist()):
                if packed:
                    parts, marks = line_hashes(text, min_chars)
                    owned = set(np.frombuffer(b"".join(packed), _ENTRY).tolist())
                    stay = [p for p, m in zip(parts, marks.tolist()) if m not in owned]
                    kept.append(b"\n".join(stay).decode())
                    n.append(len(parts))
                    gone.append(len(parts) - len(stay))
                else:
                    kept.append(text.decode())
                    n.append(text.count(b"\n") + 1)
                    gone.append(0)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in shown), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())],
                [*shown, "n_lines", "n_dropped", "kept_text"],
            )

    added = {"n_lines": "long", "n_dropped": "long", "kept_text": "string"}
    return tagged.mapInArrow(rebuild, extended(tagged.drop("_drops").schema, added))
