"""Near duplicates by set similarity against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from spanloom.llm import setsketch
from tests.llm import odd


def word_sets(text, width):
    words = (text or "").encode().lower().split()
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def components(rows, width):
    """(doc_id, size, component) of (doc_id, text) by comparing all pairs."""
    sets = [word_sets(t, width) for _, t in rows]
    of = list(range(len(rows)))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i if rows[i][0] is not None else 0):
            b = sets[j]
            if rows[j][0] is None or not a or not b or top(i) == top(j):
                continue
            both = len(a & b)
            if 100 * both >= 80 * (len(a) + len(b) - both):
                of[top(i)] = top(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return [(rows[k][0], len(sets[k]), least.get(top(k))) for k in range(len(rows))]


def families(seed, n, size, words=120, low=4, high=14):
    """Groups of texts with one changed stretch each; many pairs of a group lie near the threshold."""
    rng, out = random.Random(seed), []
    for f in range(n):
        base = [f"f{f}w{rng.randrange(5000)}" for _ in range(words)]
        for _ in range(size):
            t, length = list(base), rng.randrange(low, high + 1)
            at = rng.randrange(0, words - length)
            t[at : at + length] = [f"n{rng.randrange(10**6)}" for _ in range(length)]
            out.append((len(out), " ".join(t)))
    return out


def expected(rows, width):
    return Counter((i, n, c, i == c) for i, n, c in components(rows, width))


@pytest.mark.parametrize("width", [2, 5])
def test_odd_rows(spark, width):
    found = setsketch.near_duplicates(odd.table(spark), width).collect()
    assert Counter(tuple(r) for r in found) == expected([(r[0], r[1]) for r in odd.rows()], width)


@pytest.mark.parametrize("n,size,width", [(6, 40, 5), (8, 60, 2), (1, 600, 5)])
def test_crowded_families_lose_no_link(spark, n, size, width):
    rows = families(n, n, size)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    found = setsketch.near_duplicates(docs, width).collect()
    assert Counter(tuple(r) for r in found) == expected(rows, width)


def test_nothing(spark):
    assert setsketch.near_duplicates(odd.empty(spark)).collect() == []
    assert setsketch.drop_near_duplicates(odd.empty(spark)).collect() == []


def test_drop_judges_an_id_by_its_text(spark):
    x, y = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = odd.table(spark, [(0, x, "en", "s", 1), (1, x, "en", "s", 1), (1, y, "en", "s", 1), (None, x, "en", "s", 1), (7, "", "en", "s", 1), (8, None, "en", "s", 1)])
    stayed = setsketch.drop_near_duplicates(docs)
    assert stayed.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in stayed.collect()) == Counter([(0, x), (1, y), (None, x), (7, ""), (8, None)])


def sketch(hashes):
    return setsketch.registers(setsketch.minima(hashes, *setsketch._steps(setsketch.REGISTERS)))


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(5)
    errors = []
    for _ in range(60):
        n, k = int(rng.integers(50, 600)), int(rng.integers(2, 40))
        a = rng.integers(0, 1 << 32, n, np.uint32)
        b = np.concatenate([a[k:], rng.integers(0, 1 << 32, k, np.uint32)])
        ra, rb = sketch(a), sketch(b)
        assert np.array_equal(sketch(np.concatenate([a, b])), np.maximum(ra, rb))
        counts = np.array([(ra > rb).sum()]), np.array([(ra < rb).sum()])
        sizes = np.array([float(n)]), np.array([float(n)])
        errors.append(setsketch.estimate(*counts, *sizes)[0] - (n - k) / (n + k))
        if (n - k) / (n + k) >= 0.8:
            assert setsketch.slope(*counts, *sizes, 0.8 - setsketch.SLACK)[0] >= 0
            assert (setsketch.band_keys(ra[None]) == setsketch.band_keys(rb[None])).any()
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.12
