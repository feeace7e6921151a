"""Merkle manifest of a table, kept in trees of SHA-256 midstates.

Leaves are ordered within their group; every 16 consecutive nodes become the hash
of their digests until one remains, the group's subroot. Subroots become the root
in the same way.

A parent is hashed child by child and keeps a copy of the hash state before each
slot. To fold a changed child, the state before its slot is resumed with the
replacement and the siblings to its right; what lies to the left is never read again.

The work is cut into bundles of ``16 ** BUNDLE_LEVELS`` consecutive nodes, which are
lifted by that many levels in one task. Only the bundles' tops go on, so the table
shrinks 256-fold a round. On the way back a bundle receives one row: the path from
its top to the root. All of its leaves are then folded in one task, which resumes
the midstates of that path too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from spanloom import session
from spanloom.llm.common import pin
from spanloom.operators.ranking import number_rows

ARITY = 16
BUNDLE_LEVELS = 2
BUNDLE = ARITY**BUNDLE_LEVELS


# -- hashing in one task -------------------------------------------------------------

class Parent:
    """A node over up to ``ARITY`` child digests, with the state before each slot."""

    def __init__(self, children: list[str]):
        self.children, self.states = children, []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child.encode())
        self.digest = state.hexdigest()

    def folded(self, slot: int, replacement: str) -> str:
        state = self.states[slot].copy()
        state.update(replacement.encode())
        state.update("".join(self.children[slot + 1 :]).encode())
        return state.hexdigest()

    def siblings(self, slot: int) -> str:
        return "".join(self.children[:slot] + self.children[slot + 1 :])


class Bundle:
    """Consecutive nodes and the parents over them, level by level."""

    def __init__(self, nodes: list[str], levels: int):
        self.levels: list[list[Parent]] = []
        for _ in range(levels):
            parents = [Parent(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
            self.levels.append(parents)
            nodes = [p.digest for p in parents]
        self.tops = nodes

    def way(self, at: int) -> Iterator[tuple[Parent, int]]:
        """Parents above a node with the slot the way up passes through."""
        for parents in self.levels:
            yield parents[at // ARITY], at % ARITY
            at //= ARITY


class Path:
    """The parents from a bundle's top to the root, of which only one slot each is folded."""

    def __init__(self, steps):
        self.parents = [(Parent(list(children)), int(slot)) for children, slot in steps]
        self.siblings = "".join(p.siblings(s) for p, s in self.parents)

    def folded(self, digest: str) -> str:
        for parent, slot in self.parents:
            digest = parent.folded(slot, digest)
        return digest


def levels_of(n: int) -> int:
    """Levels over n nodes until one remains."""
    levels = 0
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


# -- lifting ---------------------------------------------------------------------------

def _bundled(nodes: DataFrame) -> DataFrame:
    """Adds the bundle of a node, and its place in there."""
    return nodes.withColumns({
        "bundle": F.floor(F.col("position") / BUNDLE).cast("bigint"),
        "place": (F.col("position") % BUNDLE).cast("int"),
    })


def _levels(n: int) -> int:
    return min(BUNDLE_LEVELS, levels_of(n))


def _lift(nodes: DataFrame) -> DataFrame:
    """Tops of bundles: grp, position, total, digest."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = int(pdf.total.iloc[0])
        made = Bundle(pdf.sort_values("place").digest.tolist(), _levels(total))
        return pd.DataFrame({
            "grp": pdf.grp.iloc[:1], "position": pdf.bundle.iloc[:1],
            "total": [-(-total // ARITY**len(made.levels))], "digest": made.tops,
        })

    # A group of one node is its own top already.
    many = _bundled(nodes.filter("total > 1"))
    up = many.groupBy("grp", "bundle").applyInPandas(run, "grp bigint, position bigint, total bigint, digest string")
    return up.unionByName(nodes.filter("total = 1").select("grp", "position", "total", "digest"))


_STEPS = "array<struct<children:array<string>,slot:int>>"


def _descend(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Paths of nodes (grp, position, steps) from the paths of their bundles' tops."""

    def run(pdf: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:  # the path of a group that is one node
            return pd.DataFrame(columns=["grp", "position", "steps"], dtype=object)
        pdf = pdf.sort_values("place")
        made = Bundle(pdf.digest.tolist(), _levels(int(pdf.total.iloc[0])))
        rest = [{"children": list(s["children"]), "slot": s["slot"]} for s in above.steps.iloc[0]]
        return pd.DataFrame({
            "grp": pdf.grp, "position": pdf.position,
            "steps": [[{"children": p.children, "slot": s} for p, s in made.way(i)] + rest for i in pdf.place],
        })

    many = _bundled(nodes.filter("total > 1"))
    down = _beside(many, paths).applyInPandas(run, f"grp bigint, position bigint, steps {_STEPS}")
    return down.unionByName(nodes.filter("total = 1").select("grp", "position").join(paths, ["grp", "position"]))


def _beside(bundled: DataFrame, paths: DataFrame) -> PandasCogroupedOps:
    """Bundles, each with the one row of its top."""
    tops = paths.withColumnRenamed("position", "bundle")
    return bundled.groupBy("grp", "bundle").cogroup(tops.groupBy("grp", "bundle"))


def _tree(leaves: DataFrame) -> list[DataFrame]:
    """The nodes of each round, up to one for each group."""
    rounds = [leaves]
    while (rounds[-1].agg(F.max("total")).first()[0] or 0) > 1:
        rounds.append(pin(_lift(rounds[-1])))
    return rounds


def _paths(rounds: list[DataFrame], tops: DataFrame, upto: int) -> DataFrame:
    """Paths of the nodes of round ``upto`` from those of the last round."""
    for nodes in reversed(rounds[upto:-1]):
        tops = pin(_descend(nodes, tops))
    return tops


def _positions(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Adds position, from 0, within the group."""
    return number_rows(rows, group, order, "position").withColumn("position", F.col("position") - 1)


# -- leaves -------------------------------------------------------------------------------

def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 in hex of values, each as byte count, colon and value; null as a dash."""
    texts = [c.cast("string") for c in columns]
    parts = [F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]
    return F.sha2(F.concat(*parts), 256)


_RESULT = "subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(leaves: DataFrame, group: str, order: str) -> DataFrame:
    """Digests of a table, the root they are committed to, and what folding each leaf gives.

    ``leaves`` has an ``order`` column, a nullable string column ``group``, ``leaf`` (hex
    digest) and ``presented`` (the digest to be checked). Within a group leaves ascend by
    ``order``, nulls first, equal ones by ``leaf``; groups ascend bytewise, null first.
    Returns those columns with subroot, root, proof_sha256 (hash of the siblings from
    leaf to root), folded_root (from ``presented`` and the committed siblings) and
    verified. A table of one leaf has that leaf as its root and the hash of nothing as
    proof. An empty table gives an empty result. Other columns are dropped.
    """
    kinds = {c: leaves.schema[c].dataType.simpleString() for c in (group, order)}
    rows = leaves.select(F.col(group).alias("name"), F.col(order).alias("rank"), "leaf", "presented")
    sizes = rows.groupBy("name").agg(F.count("*").alias("total"))
    groups = pin(_positions(sizes, [], [F.col("name").asc_nulls_first()]).withColumnRenamed("position", "grp"))
    placed = _positions(rows, ["name"], [F.col("rank").asc_nulls_first(), F.col("leaf"), F.col("presented")])
    # Null and empty names differ; both parts of the key are without nulls.
    key = {"key": F.coalesce("name", F.lit("")), "unnamed": F.col("name").isNull()}
    numbered = session.lookup_join(placed.withColumns(key), groups.withColumns(key).drop("name"), list(key), [F.col("position")], "inner")
    nodes = pin(numbered.drop(*key).withColumnRenamed("leaf", "digest"))

    below = _tree(nodes.select("grp", "position", "total", "digest"))
    subroots = below[-1].select(F.lit(0).cast("bigint").alias("grp"), F.col("grp").alias("position"), "digest")
    count = groups.count()
    above = _tree(pin(subroots.withColumn("total", F.lit(count).cast("bigint"))))
    root = above[-1].select("digest").first()
    root = root.digest if root else None
    nothing = above[-1].select("grp", "position", F.array().cast(_STEPS).alias("steps"))
    tops = _paths(above, nothing, 0).select(F.col("position").alias("grp"), F.lit(0).cast("bigint").alias("position"), "steps")

    def fold(pdf: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        made = Bundle(pdf.digest.tolist(), _levels(int(pdf.total.iloc[0])))
        path = Path([(s["children"], s["slot"]) for s in top.steps.iloc[0]])
        proofs, folded = [], []
        for at, presented in zip(pdf.place, pdf.presented):
            proof, digest = hashlib.sha256(), presented
            for parent, slot in made.way(at):
                proof.update(parent.siblings(slot).encode())
                digest = parent.folded(slot, digest)
            proof.update(path.siblings.encode())
            proofs.append(proof.hexdigest())
            folded.append(path.folded(digest))
        out = pdf[["name", "rank", "digest", "presented"]].copy()
        out["subroot"], out["root"], out["proof_sha256"], out["folded_root"] = top.subroot.iloc[0], root, proofs, folded
        out["verified"] = out.folded_root == out.root
        return out

    known = below[-1].select("grp", F.col("digest").alias("subroot"))
    first = _paths(below, tops, 1) if len(below) > 1 else tops  # else every group is one leaf
    done = _beside(_bundled(nodes), first.join(known, "grp")).applyInPandas(
        fold, f"name {kinds[group]}, rank {kinds[order]}, digest string, presented string, {_RESULT}"
    )
    return done.withColumnsRenamed({"name": group, "rank": order, "digest": "leaf"})


def tampered(doc_id: Column) -> Column:
    """The documents that are altered before they are checked."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def check_documents(docs: DataFrame) -> DataFrame:
    """Manifest of documents and the check of a table in which some texts were lower-cased.

    A null doc_id counts as empty in the choice of what is altered. Equal rows are
    separate leaves. Columns other than doc_id, source, lang, n_chars and text are not read.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate("text", upper, upper.lower())
    parts = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = leaf_digest([*parts, F.col("text")])
    presented = F.when(tampered(F.col("doc_id")), leaf_digest([*parts, lowered])).otherwise(leaf)
    return manifest(docs.select("doc_id", "source", leaf.alias("leaf"), presented.alias("presented")), "source", "doc_id")
