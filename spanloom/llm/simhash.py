"""SimHash near-duplicates by vantage-point trees.

1. Fingerprint every text (Charikar 2002): bit i is set when it is set in over
   half of the XXH64 hashes of the text's word shingles.
2. Equal fingerprints collapse to one point. A routing tree over a bounded share
   of the points cuts Hamming space into shards: at a vantage point v with radius
   mu, points within mu go left, the others right.
3. By the triangle inequality a point right of the cut can have a partner on the
   left only when its distance to v is at most mu + r. Such a point also visits
   the left side as a query. Each pair is thus met in exactly the shards it must.
4. Each shard builds its own vantage-point tree and finds all pairs at distance
   r or less exactly. It hands on a spanning forest of them, not the pairs: k
   points all close to each other give k - 1 rows.
5. The forests are joined by connected components over all shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm import graph
from spanloom.llm.common import extended, pin, raw, slices, small_or_not, unused

SHARD_POINTS = 16_384  # points a shard should hold before more tasks than cores would be busy
FULL_SHARD = 1 << 20  # points a shard may hold then; each further cut sends more points twice
SAMPLE_POINTS = 64  # points per shard that the routing tree is built from
TASKS_PER_CORE = 4
MAX_SHARDS = 16_384
LEAF_CELLS = 1 << 18  # comparisons done at once at a leaf of a shard's tree
PAIR_BUFFER = 1 << 21  # pairs held before they are reduced to a forest


# -- fingerprints ---------------------------------------------------------------

def shingle_hashes(text: bytes, width: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of all word shingles, repeats included, in blocks."""
    words = text.lower().split()
    n = max(1, len(words) - width + 1) if words else 0
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, 65_536):
        upto = min(n, at + 65_536)
        yield np.fromiter(
            (digest(b" ".join(words[i : i + width]), seed) for i in range(at, upto)), np.uint64, upto - at
        )


def fingerprint(text: bytes, width: int) -> int:
    """64-bit SimHash; zero when there is no word."""
    ones, n = np.zeros(64, np.int64), 0
    for h in shingle_hashes(text, width):
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprints(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number; null text counts as empty."""

    def run(batches):
        for batch in slices(batches):
            marks = np.fromiter((fingerprint(t, width) for t in raw(batch, "text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp bigint")


# -- vantage-point trees in one task -----------------------------------------------

def distance(points: np.ndarray, to: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ to).astype(np.int16)


def choose_cut(points: np.ndarray, radius: int) -> tuple[np.uint64, int] | None:
    """A vantage point and radius that cut the points near the middle with few of them in the overlap.

    Candidates are spread evenly over the points. None when no cut separates anything.
    """
    best = None
    for v in points[:: max(1, len(points) // 8)][:8]:
        counts = np.bincount(distance(points, v), minlength=65)
        upto = counts.cumsum() / len(points)
        for mu in np.flatnonzero((upto >= 0.3) & (upto <= 0.7)):
            overlap = counts[max(0, mu + 1 - radius) : mu + 1 + radius].sum() / len(points)
            score = overlap + abs(upto[mu] - 0.5)
            if best is None or score < best[0]:
                best = score, v, int(mu)
    if best is None:
        d = distance(points, points[0])
        if d.min() == d.max():
            return None
        mu = int(np.median(d))
        best = 0.0, points[0], mu if mu < d.max() else mu - 1
    return best[1], best[2]


class Pairs:
    """Close pairs as they are found, reduced to a spanning forest whenever many have gathered."""

    def __init__(self, n: int):
        self.n, self.a, self.b, self.held = n, [], [], 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.a.append(a)
            self.b.append(b)
            self.held += len(a)
            if self.held > PAIR_BUFFER:
                self._reduce()

    def _reduce(self) -> None:
        roots = component_roots(self.n, np.concatenate(self.a), np.concatenate(self.b))
        inner = np.flatnonzero(roots != np.arange(self.n))
        self.a, self.b, self.held = [inner], [roots[inner]], 0

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        """Each point that is not the root of its component, and that root."""
        if not self.a:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._reduce()
        return self.a[0], self.b[0]


def component_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index of each point's component, by hooking roots and pointer jumping."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if np.array_equal(ra, rb):
            return root
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(root, up := root[root]):
            root = up


def _compare(points: np.ndarray, p: np.ndarray, q: np.ndarray, radius: int, found: Pairs) -> None:
    step = max(1, LEAF_CELLS // max(1, len(p)))
    for at in range(0, len(q), step):
        part = q[at : at + step]
        i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[p][None, :]) <= radius)
        found.add(part[i], p[j])


def _between(points: np.ndarray, p: np.ndarray, q: np.ndarray, radius: int, found: Pairs) -> None:
    """All close pairs of a query q and a tree point p."""
    work = [(p, q)]
    while work:
        p, q = work.pop()
        if not len(p) or not len(q):
            continue
        cut = choose_cut(points[p], radius) if len(p) > 64 and len(p) * len(q) > LEAF_CELLS // 4 else None
        if cut is None:
            _compare(points, p, q, radius, found)
            continue
        dp, dq = distance(points[p], cut[0]), distance(points[q], cut[0])
        work.append((p[dp <= cut[1]], q[dq <= cut[1] + radius]))
        work.append((p[dp > cut[1]], q[dq > cut[1] - radius]))


def close_forest(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the close pairs among home points and between them and visitors."""
    points = np.concatenate([home, visitors])
    found = Pairs(len(points))
    _between(points, np.arange(len(home)), np.arange(len(home), len(points)), radius, found)
    work = [np.arange(len(home))]
    while work:
        p = work.pop()
        cut = choose_cut(points[p], radius) if len(p) > 256 else None
        if cut is None:
            _compare(points, p, p, radius, found)
            continue
        d = distance(points[p], cut[0])
        inside, outside = p[d <= cut[1]], p[d > cut[1]]
        _between(points, inside, outside[d[d > cut[1]] <= cut[1] + radius], radius, found)
        work += [inside, outside]
    child, root = found.forest()
    return points[child], points[root]


# -- routing over shards ----------------------------------------------------------------

def routing_tree(sample: np.ndarray, shards: int, radius: int, first: int = 0):
    """Nested (vantage point, mu, inside, outside); a leaf is its shard number."""
    cut = choose_cut(sample, radius) if shards > 1 and len(sample) > 1 else None
    if cut is None:
        return first
    d = distance(sample, cut[0])
    inside, outside = sample[d <= cut[1]], sample[d > cut[1]]
    left = shards // 2
    return (*cut, routing_tree(inside, left, radius, first), routing_tree(outside, shards - left, radius, first + left))


def route(points: np.ndarray, tree, radius: int) -> Iterator[tuple[int, np.ndarray, bool]]:
    """(shard, indices, home) for every shard a point lives in or visits."""
    work = [(tree, np.arange(len(points)), True)]
    while work:
        node, idx, home = work.pop()
        if not len(idx):
            continue
        if not isinstance(node, tuple):
            yield node, idx, home
            continue
        v, mu, inside, outside = node
        d = distance(points[idx], v)
        near = idx[d <= mu]
        work.append((outside, idx[d > mu] if home else idx[d > mu - radius], home))
        if home:
            work.append((inside, near, True))
            work.append((inside, idx[(d > mu) & (d <= mu + radius)], False))
        else:
            work.append((inside, idx[d <= mu + radius], False))


def links(points: DataFrame, max_distance: int = 3) -> DataFrame:
    """Edges (a, b) that connect exactly what pairs of ``points.fp`` at ``max_distance`` or less connect.

    ``points`` holds each fp once. The routing tree is built on the driver from
    ``SAMPLE_POINTS`` points per shard, picked by hash: 0.4 % of the points.
    """
    total = points.count()
    busy = TASKS_PER_CORE * points.sparkSession.sparkContext.defaultParallelism
    wanted = max(1, min(total / SHARD_POINTS, max(busy, total / FULL_SHARD)))
    shards = min(MAX_SHARDS, 1 << math.ceil(math.log2(wanted)))
    tree = 0
    if shards > 1:
        share = F.pmod(F.xxhash64("fp", F.lit("route")), F.lit(1 << 30)) < int((1 << 30) * shards * SAMPLE_POINTS / total)
        sample = np.sort(np.array([r.fp for r in points.filter(share).collect()], np.int64)).view(np.uint64)
        tree = routing_tree(sample, shards, max_distance)

    def deal(frames):
        for pdf in frames:
            p = pdf.fp.to_numpy(np.int64).view(np.uint64)
            for shard, idx, home in route(p, tree, max_distance):
                yield pd.DataFrame({"shard": np.int32(shard), "fp": p[idx].view(np.int64), "home": home})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        p, home = pdf.fp.to_numpy(np.int64).view(np.uint64), pdf.home.to_numpy(bool)
        a, b = close_forest(np.sort(p[home]), np.sort(p[~home]), max_distance)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = points.select("fp").mapInPandas(deal, "shard int, fp bigint, home boolean")
    return dealt.groupBy("shard").applyInPandas(search, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, width: int = 5, max_distance: int = 3) -> DataFrame:
    """One row per document: doc_id, fp, component_id, the smallest doc_id reachable.

    Documents link when their fingerprints differ in at most ``max_distance``
    bits; three bits stand for a similarity of about 0.95. A text without words
    has fingerprint zero and links like any other. A text of fewer words than
    ``width`` is one shingle. Rows with a repeated doc_id are each fingerprinted.
    A null doc_id is never the smallest; a component of nothing else has the id
    null. An empty table gives an empty result.
    """
    marks = pin(fingerprints(docs, width))
    points = pin(marks.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = graph.components(links(points, max_distance))
    rooted = pin(
        points.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        )
    )
    named = pin(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    classes = pin(rooted.join(named, "root").select("fp", "component_id"))
    return marks.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, width: int = 5, max_distance: int = 3) -> DataFrame:
    """The documents that stay: of each component the rows whose doc_id names it.

    Columns are those of ``docs``, whatever their names. Rows without a doc_id can't
    be named and stay. A doc_id that occurs with different texts is judged by fingerprint.
    """
    key = unused("fp", docs.columns)
    names = docs.columns

    def run(batches):
        for batch in slices(batches):
            marks = np.fromiter((fingerprint(t, width) for t in raw(batch, "text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks.view(np.int64))], [*names, key])

    found = near_duplicates(docs, width, max_distance)
    gone = pin(found.filter(F.col("doc_id") != F.col("component_id")).select("doc_id", F.col("fp").alias(key)).distinct())
    # Most fingerprints have no other of their own; only rows of an id that goes are read again.
    ids = small_or_not(gone.select("doc_id").distinct())
    marked = docs.join(ids, "doc_id", "left_semi").select(*names).mapInArrow(run, extended(docs.schema, {key: "long"}))
    stay = marked.join(gone, ["doc_id", key], "left_anti").select(*names)
    return docs.join(ids, "doc_id", "left_anti").select(*names).unionByName(stay)
