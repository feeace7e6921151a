"""The manifest against a plain Merkle tree, folds included."""

import hashlib
import zlib
from collections import Counter

import pytest

from spanloom.llm import merkle
from tests.llm import odd

COLUMNS = "doc_id source leaf presented subroot root proof_sha256 folded_root verified".split()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return digest(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def ways(nodes):
    """The top of a tree, and for each node its runs of siblings and its slot in them."""
    way, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, a in enumerate(at):
            way[k].append((nodes[a // 16 * 16 : a // 16 * 16 + 16], a % 16))
            at[k] = a // 16
        nodes = [digest(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], way


def plain_version(rows):
    by = {}
    for i, t, lang, source, n in rows:
        own = given = leaf(i, source, lang, n, t)
        if zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0:
            given = leaf(i, source, lang, n, None if t is None else t.translate(LOWER))
        by.setdefault(source, []).append(((i is not None, i or 0), own, given, i))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in sources:
        by[s].sort(key=lambda x: x[:3])
        below[s] = ways([x[1] for x in by[s]])
    root, above = ways([below[s][0] for s in sources])
    out = []
    for s, up in zip(sources, above):
        for (_, own, given, i), way in zip(by[s], below[s][1]):
            folded, siblings = given, []
            for run, a in way + up:
                siblings += run[:a] + run[a + 1 :]
                folded = digest(*run[:a], folded, *run[a + 1 :])
            out.append((i, s, own, given, below[s][0], root, digest(*siblings), folded, folded == root))
    return Counter(out)


def found(docs):
    return Counter(tuple(r) for r in merkle.check_documents(docs).select(COLUMNS).collect())


def test_manifest_of_odd_rows(spark):
    assert found(odd.table(spark)) == plain_version(odd.rows())


def test_nothing_and_one_leaf(spark):
    assert merkle.check_documents(odd.empty(spark)).collect() == []
    one = odd.rows()[:1]
    assert found(odd.table(spark, one)) == plain_version(one)


@pytest.mark.parametrize("n,sources", [(256, 1), (257, 1), (4500, 40)])
def test_levels(spark, n, sources):
    """Whole runs, a run of one, a third of the rows in one source, more sources than a run holds."""
    data = [(i, f"T{i}", "en", f"s{i % sources}" if i % 3 else "hot", 3) for i in range(n)]
    got = found(odd.table(spark, data))
    assert got == plain_version(data)
    assert {k[-1] for k in got} == {True, False}


def test_folding_resumes_the_state_before_a_slot():
    children = [digest(str(i)) for i in range(13)]
    parent = merkle.Parent(children)
    for slot in (0, 5, 12):
        changed = children[:slot] + ["f" * 64] + children[slot + 1 :]
        assert parent.folded(slot, "f" * 64) == digest(*changed)
        assert parent.folded(slot, children[slot]) == parent.digest
