"""Near duplicates by SetSketch registers (Ertl, "SetSketch: Filling the Gap between MinHash and HyperLogLog", 2021).

1. A text's set of word shingles fills ``BANDS * ROWS`` registers. Register i is the
   minimum of exponential variables of its elements, truncated to a step of the
   scale ``BASE ** -k``. Registers of a union are the greater of those of its parts.
2. Texts of equal sets are one point. Registers are banded: a pair of similarity s
   agrees in a band of ``ROWS`` with probability s ** ROWS and a bit more.
3. First round: each point meets the least and the greatest point it shares a band
   with, so k copies of one text give less than 2 k pairs.
   The counts of greater, smaller and equal registers and the known set sizes give the
   likelihood of each similarity; where its maximum may reach the threshold the pair's
   whole sets are compared, shingle by shingle.
4. Second round: points that share a band but are not connected yet are compared by
   their whole sets, as 64-bit hashes, in blocks of bounded size, where products of
   matrices count what all pairs of two blocks have in common. Only links leave the
   task, never the pairs that fail.

A pair at 0.8 shares no band with probability 5e-6; only then can it be missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import graph
from spanloom.llm.common import extended, raw, settle, slices_of_bytes, small_or_not, unused

BASE = 1.001
RATE = 20.0
TOP = (1 << 16) - 2
ROWS, BANDS = 6, 40
REGISTERS = ROWS * BANDS
SLACK = 0.11  # over four standard deviations of the estimate at 0.8
BLOCK = 512  # points of a band compared in one piece
COLUMNS = 4096  # elements counted by one product of matrices
BLOCK_BYTES = 1 << 24  # set elements of a band compared in one piece
PIECE = 256  # set elements hashed at once


# -- sets and registers ------------------------------------------------------------------

def shingles(text: bytes, width: int) -> set[bytes]:
    """Different shingles of lower-cased words; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if len(words) < width:
        return {b" ".join(words)} if words else set()
    return set(map(b" ".join, zip(*(words[i:] for i in range(width)))))


def _steps(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(1)
    return rng.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, np.uint32)


def minima(hashes: np.ndarray, factor: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Least permuted hash per register."""
    least = np.full(len(factor), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(hashes), PIECE):
        np.minimum(least, (hashes[at : at + PIECE, None] * factor + offset).min(axis=0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Exponential minima on the scale, truncated to 0 .. TOP + 1.

    -log(1 - u) / RATE of the least uniform u is the least exponential variable.
    """
    x = -np.log1p(-(least + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP + 1).astype(np.uint16)


def band_keys(regs: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of each row of registers."""
    values = regs.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), values.shape[:2]).copy()
    for r in range(ROWS):
        key ^= values[:, :, r]
        key *= np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


# -- joint estimate ------------------------------------------------------------------------

_C = (BASE - 1) / BASE


def slope(greater: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray, j: float) -> np.ndarray:
    """Slope at ``j`` of the joint log-likelihood of the similarity of sets with n and m elements.

    ``greater`` counts registers of the first above the second, ``smaller`` those below.
    The likelihood is concave, so the estimate lies at ``j`` or beyond exactly where the slope is not negative.
    """
    u = n / (n + m)
    v = 1 - u
    up, down = np.maximum(u - v * j, 1e-12), np.maximum(v - u * j, 1e-12)
    # Probabilities of a greater and a smaller register, times log(BASE), and their derivatives.
    p, q = -np.log1p(-_C * up), -np.log1p(-_C * down)
    dp, dq = _C * v / (1 - _C * up), _C * u / (1 - _C * down)
    equal = REGISTERS - greater - smaller
    return equal * (dp + dq) / np.maximum(np.log(BASE) - p - q, 1e-12) - greater * dp / p - smaller * dq / q


def estimate(greater: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Most likely similarity, by halving the range where the slope changes sign."""
    lo, hi = np.zeros(len(n)), np.minimum(n / m, m / n)
    for _ in range(20):
        mid = (lo + hi) / 2
        beyond = slope(greater, smaller, n, m, mid) >= 0
        lo, hi = np.where(beyond, mid, lo), np.where(beyond, hi, mid)
    return (lo + hi) / 2


def equal_registers(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Equal registers of row-wise pairs; -1 where sizes or the estimate exclude the threshold."""
    greater, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    n, m = n.astype(float), m.astype(float)
    likely = slope(greater, smaller, n, m, least - SLACK) >= 0
    likely &= np.minimum(n, m) >= least * np.maximum(n, m)
    return np.where(likely, REGISTERS - greater - smaller, -1)


# -- sketches ---------------------------------------------------------------------------------

def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def _hashes(found: set[bytes]) -> np.ndarray:
    """128-bit hashes of a set as rows of two words, in any order."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, found)), np.uint64).reshape(-1, 2)


def _mark(hashes: np.ndarray) -> bytes:
    """Equal for equal sets: the sums of both words, in which order plays no part."""
    return hashes.sum(axis=0, dtype=np.uint64).tobytes()


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (size of the set), mark (16 bytes that equal sets share) and regs (null without a word)."""
    factor, offset = _steps(REGISTERS)

    def run(batches):
        for batch in slices_of_bytes(batches, "text"):
            sets = [_hashes(shingles(t, width)) for t in raw(batch, "text")]
            regs = [registers(minima(s[:, 0].astype(np.uint32), factor, offset)).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_mark(s) for s in sets], pa.binary()), pa.array(regs, pa.binary())],
                ["doc_id", "n", "mark", "regs"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n bigint, mark binary, regs binary")


def marked(docs: DataFrame, width: int, mark: str = "mark") -> DataFrame:
    """All columns and the mark of each text's set."""
    names = docs.columns

    def run(batches):
        for batch in slices_of_bytes(batches, "text"):
            marks = [_mark(_hashes(shingles(t, width))) for t in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.binary())], [*names, mark])

    return docs.mapInArrow(run, extended(docs.schema, {mark: "binary"}))


def _posted(points: DataFrame) -> DataFrame:
    """(key, node, n) of every band."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_unpacked(batch.column("regs")))
                nodes, sizes = (np.repeat(batch.column(c).to_numpy(), BANDS) for c in ("node", "n"))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes), pa.array(sizes)], ["key", "node", "n"])

    return points.select("node", "n", "regs").mapInArrow(run, "key bigint, node bigint, n bigint")


# -- pairs ---------------------------------------------------------------------------------------

def _likely(pairs: DataFrame, points: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) whose registers do not exclude the threshold."""
    one = points.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    two = points.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = equal_registers(
                    _unpacked(batch.column("ra")), batch.column("na").to_numpy(), _unpacked(batch.column("rb")),
                    batch.column("nb").to_numpy(), least,
                )
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(found >= 0))

    return pairs.join(one, "a").join(two, "b").mapInArrow(run, "a bigint, b bigint")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, least: float) -> DataFrame:
    """Pairs whose whole sets reach the threshold. Pairs of one text come together, so its set is made once."""
    one = texts.withColumnsRenamed({"node": "a", "text": "ta"})
    two = texts.withColumnsRenamed({"node": "b", "text": "tb"})

    def run(batches):
        known, first = None, set()
        for batch in slices_of_bytes(batches, "tb"):
            keep = []
            for a, ta, tb in zip(batch.column("a").to_pylist(), raw(batch, "ta"), raw(batch, "tb")):
                if a != known:
                    known, first = a, shingles(ta, width)
                second = shingles(tb, width)
                both = len(first & second)
                keep.append(100 * both >= round(100 * least) * (len(first) + len(second) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    read = pairs.join(two, "b").join(one, "a").sortWithinPartitions("a")
    return read.select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


def _ends(posted: DataFrame) -> DataFrame:
    """Bands of more than one point, with the least and greatest of them."""
    return posted.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")


def _star_pairs(posted: DataFrame, ends: DataFrame) -> DataFrame:
    met = posted.join(ends, "key").groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = met.select("node", F.explode(F.array("low", "high")).alias("other")).filter("node != other")
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def _cross_links(shared: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between different components of points that share a band.

    Bands with the same points are looked at once. Points of the component that holds
    most of a band are connected already, so they meet only the band's other points: s
    others among k points take s * k comparisons at most, not k * k. A band of more than ``BLOCK``
    points, or of more bytes than ``BLOCK_BYTES``, is cut by hash; a task compares two
    blocks, and holds no more than those.
    """
    labelled = shared.join(small_or_not(roots), "node", "left").select(
        "key", "node", "n", F.coalesce("root", "node").alias("root")
    )
    total = F.sum(F.xxhash64("node").cast("decimal(20,0)"))
    held = labelled.groupBy("key", "root").agg(F.count("*").alias("k"), F.sum("n").alias("n"), total.alias("sum"))
    bands = (
        held.groupBy("key")
        .agg(
            F.sum("k").alias("k"), F.sum("n").alias("n"), F.sum("sum").alias("sum"), F.count("*").alias("parts"),
            F.max(F.struct("k", "n", "root")).alias("main"),
        )
        .filter("parts > 1").groupBy("k", "n", "sum").agg(F.min_by(F.struct("key", "main"), "key").alias("of"))
        .select("of.key", "of.main", "k", F.col("n").alias("elements"))
    )

    def cut(points, elements):
        return F.ceil(F.greatest(points / BLOCK, elements * 8 / BLOCK_BYTES)).cast("int")

    whole = cut(F.col("k"), F.col("elements")) <= 1
    bands = bands.select(
        "key",
        F.col("main.root").alias("main"),
        F.when(whole, 0).otherwise(cut(F.col("main.k"), F.col("main.n"))).alias("main_blocks"),
        F.when(whole, 1).otherwise(cut(F.col("k") - F.col("main.k"), F.col("elements") - F.col("main.n"))).alias("blocks"),
    )
    mixed = F.xxhash64("node")
    inside = (F.col("root") == F.col("main")) & (F.col("main_blocks") > 0)
    members = labelled.join(small_or_not(settle(bands)), "key").withColumn(
        "block", F.when(inside, F.col("blocks") + F.pmod(mixed, F.col("main_blocks"))).otherwise(F.pmod(mixed, F.col("blocks"))).cast("int")
    )
    others = F.sequence(F.lit(0), F.when(inside, F.col("blocks")).otherwise(F.col("blocks") + F.col("main_blocks")) - 1)
    dealt = members.withColumn("other", F.explode(others)).select(
        "key", "node", "root", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")
    )

    def run(batches):
        held = None
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("key", "i", "j")]
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if batch.num_rows else []
            found = []
            for at, upto in zip([0, *cuts], [*cuts, batch.num_rows]):
                now = tuple(int(k[at]) for k in keys) if upto else held
                if now != held:
                    found += links(parts, held, least)
                    held, parts = now, []
                parts.append(batch.slice(at, upto - at))
            yield _edges(found)
        yield _edges(links(parts, held, least))

    filled = dealt.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return filled.mapInArrow(run, "a bigint, b bigint").distinct()


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*found) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(parts: list[pa.RecordBatch], group: tuple[int, int, int] | None, least: float) -> list[tuple[int, int]]:
    """Pairs of one group, of blocks i and j, whose sets reach the threshold; none between components joined by an earlier pair."""
    if sum(p.num_rows for p in parts) < 2:
        return []
    rows = pa.Table.from_batches(parts).combine_chunks()
    node, root, block = (rows.column(c).to_numpy() for c in ("node", "root", "block"))
    _, i, j = group
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(left) or not len(right) or root.min() == root.max():
        return []
    sets = [elements(s) for s in rows.column("set")]
    n = np.array([len(s) for s in sets])
    both = in_common([sets[p] for p in left], [sets[q] for q in right])
    near = 100 * both >= round(100 * least) * (n[left][:, None] + n[right] - both)
    near &= root[left][:, None] != root[right]
    joined: dict[int, int] = {}
    out = []
    for p, hits in zip(left[near.any(axis=1)], near[near.any(axis=1)]):
        hit = right[hits]
        for q in hit[np.unique(root[hit], return_index=True)[1]]:
            x, y = top_of(joined, int(root[p])), top_of(joined, int(root[q]))
            if x != y:
                joined[max(x, y)] = min(x, y)
                out.append((int(min(node[p], node[q])), int(max(node[p], node[q]))))
    return out


def in_common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of the first list has in common with each of the second.

    Elements are numbered; of each ``COLUMNS`` numbers that both sides hold, a product of two 0-1 matrices counts all pairs at once.
    """
    sides = [np.concatenate(s) for s in (left, right)]
    shared = np.intersect1d(*sides)
    count = np.zeros((len(left), len(right)))
    entries = []
    for sets, flat in zip((left, right), sides):
        row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(shared, flat)
        own = at < len(shared)
        own[own] = shared[at[own]] == flat[own]
        order = np.argsort(at[own], kind="stable")
        entries.append((row[own][order], at[own][order]))
    for begin in range(0, len(shared), COLUMNS):
        ones = []
        for sets, (row, at) in zip((left, right), entries):
            lo, hi = np.searchsorted(at, [begin, begin + COLUMNS])
            matrix = np.zeros((len(sets), min(COLUMNS, len(shared) - begin)), np.float32)
            matrix[row[lo:hi], at[lo:hi] - begin] = 1
            ones.append(matrix)
        count += ones[0] @ ones[1].T
    return count


def elements(column: pa.Scalar) -> np.ndarray:
    return np.frombuffer(column.as_py(), np.uint64)


def top_of(joined: dict[int, int], root: int) -> int:
    """The component that a root has become part of."""
    while root in joined:
        root = joined[root]
    return root


def _hashed_sets(texts: DataFrame, width: int) -> DataFrame:
    """node and set, the 64-bit hashes of its elements."""

    def run(batches):
        for batch in slices_of_bytes(batches, "text"):
            sets = [np.unique(_hashes(shingles(t, width))[:, 0]).tobytes() for t in raw(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], ["node", "set"])

    return texts.select("node", "text").mapInArrow(run, "node bigint, set binary")


def _connected(rows: DataFrame, made: DataFrame, width: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Points (node, mark, n, doc_id, regs) and the roots (node, root) of those that a link connects."""
    sets = made.filter("n > 0 AND doc_id IS NOT NULL")
    points = settle(
        sets.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("regs").alias("regs"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    posted = _posted(points)
    ends = settle(_ends(posted))
    shared = settle(posted.join(ends, "key", "left_semi"))
    tested = settle(_likely(settle(_star_pairs(shared, ends)), points, least))
    # Whole texts of the points that take part; of rows with one doc_id the one with the point's set.
    busy = settle(points.select("node", "doc_id", "mark").join(shared.select("node").distinct(), "node", "left_semi"))
    named = rows.select("doc_id", "text").join(small_or_not(busy.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = settle(marked(named, width).join(busy, ["doc_id", "mark"]).select("node", "text").dropDuplicates(["node"]))
    edges = settle(_verified(tested, texts, width, least))
    roots = settle(graph.components(edges))
    linked = settle(_cross_links(shared, roots, settle(_hashed_sets(texts, width)), least))
    if not linked.isEmpty():
        # What is connected already weighs no more than its roots.
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(linked)
        roots = settle(graph.components(edges))
    return points, roots


def _classes(rows: DataFrame, made: DataFrame, width: int, least: float) -> DataFrame:
    """mark and component_id of every set."""
    points, roots = _connected(rows, made, width, least)
    rooted = settle(points.select("node", "mark", "doc_id").join(roots, "node", "left").select(
        "mark", "doc_id", F.coalesce("root", "node").alias("root")
    ))
    named = settle(rooted.groupBy("root").agg(F.min("doc_id").alias("component_id")))
    return settle(rooted.join(named, "root").select("mark", "component_id"))


def near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable), kept.

    Documents link when the sets of their word shingles have ``least`` or more in
    common, of their union. A text of fewer words than ``width`` is one shingle; one
    without a word, or null, links with nothing. A row without doc_id links with
    nothing and has no component; it is kept. Repeated rows each get a row. An empty
    table gives an empty result. Columns other than doc_id and text are not read.
    """
    made = settle(sketches(docs, width))
    classes = _classes(docs, made, width, least)
    # A set that many documents share leads the join, where adaptive execution can split it.
    linked = made.filter("n > 0 AND doc_id IS NOT NULL").join(classes, "mark")
    alone = made.filter("n = 0 OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")]
    return linked.select(*columns).unionByName(alone.select(*columns))


def drop_near_duplicates(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The documents that stay: of each component the rows whose doc_id names it.

    Columns are those of ``docs``, whatever their names. Rows without a doc_id or
    without a word stay. A doc_id that occurs with different texts is judged by text.
    """
    mark = unused("mark", docs.columns)
    made = settle(sketches(docs, width))
    moved = made.filter("n > 0").join(_classes(docs, made, width, least), "mark").filter("doc_id != component_id")
    gone = settle(moved.select("doc_id", F.col("mark").alias(mark)).distinct())
    ids = small_or_not(gone.select("doc_id").distinct())
    stay = marked(docs.join(ids, "doc_id", "left_semi").select(*docs.columns), width, mark).join(gone, ["doc_id", mark], "left_anti")
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns).unionByName(stay.select(*docs.columns))
