"""Near, exact, line and span duplicates against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spanloom.llm import exact, graph, lines, simhash, spans
from tests.llm import odd

BLANK = " \t\n\x0b\x0c\r"


def last(i):
    return (1 << 63) - 1 if i is None else i


# -- SimHash ----------------------------------------------------------------------

def brute_fingerprint(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, fps, radius):
    n, of = len(ids), list(range(len(ids)))
    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and of[i] != of[j]:
                old, new = max(of[i], of[j]), min(of[i], of[j])
                of = [new if o == old else o for o in of]
    least = defaultdict(list)
    for i, o in zip(ids, of):
        least[o].append(i)
    return [min((x for x in least[o] if x is not None), default=None) for o in of]


@pytest.mark.parametrize("width", [3, 5])
def test_near_duplicates(spark, width):
    data = odd.rows()
    fps = [brute_fingerprint(r[1], width) for r in data]
    wanted = Counter(zip([r[0] for r in data], fps, brute_components([r[0] for r in data], fps, 3)))
    found = simhash.near_duplicates(odd.table(spark), width, 3).collect()
    assert Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in found) == wanted


def test_fingerprint_is_that_of_the_sql_hash(spark):
    text = "Äpfel und birnen"
    hashed = spark.sql(f"SELECT xxhash64('{text.replace('A', 'a')}') AS h").first().h % 2**64
    assert simhash.fingerprint("Äpfel UND Birnen".encode(), 3) == hashed


def test_near_duplicates_of_nothing(spark):
    assert simhash.near_duplicates(odd.empty(spark)).collect() == []
    assert simhash.drop_near_duplicates(odd.empty(spark)).collect() == []


def test_drop_near_duplicates_keeps_one_of_each_group(spark):
    docs = odd.table(spark)
    found = simhash.drop_near_duplicates(docs, 3)
    assert found.columns == docs.columns
    ids = [r.doc_id for r in found.collect()]
    assert 0 in ids and 24 not in ids and 25 not in ids and 20 in ids and 21 not in ids
    assert ids.count(None) == 3


def clustered(n, seed):
    rng = random.Random(seed)
    out = {rng.getrandbits(64) for _ in range(n)}
    for c in list(out)[: n // 10]:
        for _ in range(8):
            c ^= 1 << rng.randrange(64)  # chains of near points
            out.add(c)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("radius", [0, 1, 3])
def test_shard_finds_all_pairs(radius):
    points = clustered(1500, radius)
    a, b = simhash.close_forest(points, np.zeros(0, np.uint64), radius)
    at = {int(p): i for i, p in enumerate(points)}
    got = simhash.component_roots(len(points), np.array([at[int(x)] for x in a], int), np.array([at[int(x)] for x in b], int))
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= radius
    i, j = np.nonzero(close)
    assert np.array_equal(got, simhash.component_roots(len(points), i, j))


def test_routing_loses_no_pair():
    points = clustered(3000, 5)
    tree = simhash.routing_tree(points[::7], 8, 3)
    home, seen = {}, defaultdict(set)
    for shard, idx, own in simhash.route(points, tree, 3):
        for i in idx:
            seen[shard].add(int(i))
            if own:
                assert int(i) not in home
                home[int(i)] = shard
    assert len(home) == len(points) and len(set(home.values())) > 4
    close = np.bitwise_count(points[:, None] ^ points[None, :]) <= 3
    for i, j in zip(*np.nonzero(np.triu(close, 1))):
        assert int(j) in seen[home[int(i)]] or int(i) in seen[home[int(j)]]


def test_links_over_shards(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_POINTS", 500)
    points = clustered(2000, 9)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp bigint")
    roots = {r.node: r.root for r in graph.components(simhash.links(df, 3)).collect()}
    i, j = np.nonzero(np.bitwise_count(points[:, None] ^ points[None, :]) <= 3)
    wanted = simhash.component_roots(len(points), i, j)
    signed = points.view(np.int64)
    groups, ours = defaultdict(set), defaultdict(set)
    for k, w in enumerate(wanted):
        groups[w].add(int(signed[k]))
        ours[roots.get(int(signed[k]), int(signed[k]))].add(int(signed[k]))
    assert set(map(frozenset, groups.values())) == set(map(frozenset, ours.values()))


def test_components_of_chains_rings_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + i, 100 + (i + 1) % 9) for i in range(9)] + [(200, 201 + i) for i in range(50)]
    edges += [(300, 300), (5, 4), (5, 4)]
    found = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(9)}, **{200 + i: 200 for i in range(51)}}


# -- lines ---------------------------------------------------------------------------

def brute_lines(data, least=10):
    held = defaultdict(set)
    for i, text, *_ in data:
        for line in odd.text_of(text).split("\n"):
            held[line.strip(BLANK).translate({c: c + 32 for c in range(65, 91)})].add(last(i))
    out = []
    for i, text, *_ in data:
        parts = odd.text_of(text).split("\n")
        keys = [p.strip(BLANK).translate({c: c + 32 for c in range(65, 91)}) for p in parts]
        stay = [p for p, k in zip(parts, keys) if len(k) < least or len(held[k]) < 2 or min(held[k]) == last(i)]
        out.append((i, len(parts), len(parts) - len(stay), "\n".join(stay)))
    return out


@pytest.mark.parametrize("shard_keys, group_probes", [(100_000, 500_000), (3, 5)])
def test_lines(spark, monkeypatch, shard_keys, group_probes):
    monkeypatch.setattr(lines, "SHARD_KEYS", shard_keys)
    monkeypatch.setattr(lines, "GROUP_PROBES", group_probes)
    data = odd.rows() + [(50 + i, f"unique {i}\nthe very busy line\n  THE very busy line\t\nnine char", "en", "s", 1) for i in range(40)]
    found = lines.dedup_lines(odd.table(spark, data)).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found) == Counter(brute_lines(data))
    assert found[0].component_id == "clash"


def test_a_line_in_every_document_is_dealt_evenly(spark, monkeypatch):
    """20,000 documents with one common line, and lines that two documents share; ids share factors with any number of groups."""
    monkeypatch.setattr(lines, "SHARD_KEYS", 1000)
    monkeypatch.setattr(lines, "GROUP_PROBES", 2000)
    n = 20_000
    data = [(i * 60, "the line of all\n" + "\n".join(f"shared line {(i + k * n // 2) // 2 % n}-{k}" for k in range(2)), "en", "s", 1) for i in range(n)]
    keys, total = lines.recurring_keys(lines._prepared(odd.table(spark, data)))
    shards = -(-keys.count() // 1000)
    usual, busy = lines.groups_of_shards(keys, total, shards, 1)
    load = {r.shard: r.n for r in keys.groupBy((F.pmod("h", F.lit(shards))).alias("shard")).agg(F.sum("n").alias("n")).collect()}
    groups = [v / busy.get(s, usual) for s, v in load.items()]
    assert len(busy) >= 1 and max(groups) <= 2 * sorted(groups)[len(groups) // 2] and max(groups) <= 2000
    # More busy shards than may be named: all get enough groups.
    monkeypatch.setattr(lines, "LISTED_SHARDS", 0)
    least, none = lines.groups_of_shards(keys, total, shards, 1)
    assert not none and max(v / least for v in load.values()) <= 2000

    monkeypatch.setattr(lines, "LISTED_SHARDS", 65_536)
    found = lines.dedup_lines(odd.table(spark, data))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in found.collect()) == Counter(brute_lines(data))


def test_lines_of_nothing(spark):
    assert lines.dedup_lines(odd.empty(spark)).collect() == []


def test_perfect_hash_is_minimal_and_perfect():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64))
    perfect = lines.PerfectHash.build(keys)
    assert sorted(perfect.index(keys)) == list(range(len(keys)))
    assert len(lines.PerfectHash.build(keys[:0]).index(keys[:3])) == 3


# -- exact ----------------------------------------------------------------------------

def brute_exact(data):
    norm = [odd.text_of(r[1]).translate({ord(c): None for c in BLANK}) for r in data]
    groups = defaultdict(list)
    for k, r in enumerate(data):
        groups[norm[k]].append((-len(odd.text_of(r[1])), last(r[0]), r[0]))
    out = []
    for k, r in enumerate(data):
        points, _, keep = min(groups[norm[k]], key=lambda g: g[:2])
        kept = r[0] == keep and len(odd.text_of(r[1])) == -points
        out.append((r[0], keep, len(groups[norm[k]]), kept, hashlib.sha256(norm[k].encode()).hexdigest()))
    return Counter(out)


WEAK = {"sha256": exact.sha256, "weak": lambda norm: F.substring(F.sha2(norm, 256), 1, 1)}


@pytest.mark.parametrize("digest", list(WEAK))
@pytest.mark.parametrize("bound", [200_000, 2])
def test_exact(spark, tmp_path, monkeypatch, digest, bound):
    monkeypatch.setattr(exact.session, "BROADCAST_ROW_BOUND", bound)
    odd.table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    found = exact.exact_duplicates(spark, str(tmp_path / "documents.parquet"), digest=WEAK[digest]).collect()
    assert Counter(map(tuple, found)) == brute_exact(odd.rows())


def test_exact_goes_on_from_its_state(spark, tmp_path):
    path, state, data = str(tmp_path / "documents.parquet"), str(tmp_path / "state"), odd.rows()
    odd.table(spark, data[:10]).write.parquet(path)
    exact.exact_duplicates(spark, path, state).collect()
    odd.table(spark, data[10:]).write.mode("append").parquet(path)
    assert Counter(map(tuple, exact.exact_duplicates(spark, path, state).collect())) == brute_exact(data)


def test_exact_of_nothing(spark, tmp_path):
    odd.empty(spark).write.parquet(str(tmp_path / "documents.parquet"))
    assert exact.exact_duplicates(spark, str(tmp_path / "documents.parquet")).collect() == []


# -- spans ------------------------------------------------------------------------------

def passage(rng):
    return ". ".join(" ".join(f"p{rng.randrange(9999)}" for _ in range(rng.choice([1, 4, 30]))) for _ in range(5)) + " " + " ".join(f"q{rng.randrange(9999)}" for _ in range(52)) + "."


def test_spans_remove_later_passages_only(spark):
    rng = random.Random(4)
    own = [odd.prose(rng, 60, 10**6) for _ in range(6)]
    shared = passage(rng)
    data = [(i, f"{t}.\n{shared}\n{t[::-1]}" if i % 2 else t, "en", "s", 1) for i, t in enumerate(own)]
    data += [(None, f"Null. {shared}", "en", "s", 1), (9, None, None, None, None), (10, "", "en", "s", 1), (11, "Ti. Ti. Ti. Ti.", "en", "s", 1), (12, "Ti. Ti. Ti. Ti.", "en", "s", 1)]
    found = {r.doc_id: r for r in spans.dedup_spans(odd.table(spark, data)).collect()}
    assert shared in found[1].kept_text
    for i in (3, 5, None):
        text = next(r[1] for r in data if r[0] == i)
        left = found[i].kept_text
        assert not any(w in left for w in shared.replace(".", " ").split())
        cut = [tuple(map(int, s.split(":"))) for s in found[i].removed.split(",")]
        assert "".join(text[a:b] for a, b in cut).split() == shared.split()
        assert left.split() == text.replace(shared, "").split()
    for i in (0, 2, 4, 11, 12):
        assert found[i].n_removed == 0 and found[i].kept_text == next(r[1] for r in data if r[0] == i)
    assert found[9].kept_text == found[10].kept_text == "" and found[9].n_sentences == 0


def test_spans_of_odd_rows(spark):
    data = odd.rows()
    found = spans.dedup_spans(odd.table(spark)).collect()
    assert len(found) == len(data)
    owners = defaultdict(set)
    for i, text in {(r[0], odd.text_of(r[1])) for r in data}:
        f = spans.sentences(text)
        for a, b in spans.runs(f, 3, 24):
            owners[tuple(s.key for s in f[a : b + 1])].add((last(i), text, a, b))
    texts = {(last(r.doc_id), odd.text_of(r.text)): r for r in found}
    first_of = {k: min(v, key=lambda o: (o[0], o[2])) for k, v in owners.items()}
    gone = defaultdict(set)
    for k, v in owners.items():
        if len({o[0] for o in v}) == len({(o[0], o[1]) for o in v}):  # ties of one id are by text hash
            for o in v - {first_of[k]}:
                gone[o[:2]] |= set(range(o[2], o[3] + 1))
    for key, r in texts.items():
        assert r.n_removed == len(gone[key])
    assert spans.dedup_spans(odd.empty(spark)).collect() == []


def test_runs_cover_a_passage():
    rng = random.Random(2)
    for _ in range(300):
        text = ". ".join(" ".join("w" for _ in range(rng.choice([1, 2, 5, 20, 60]))) for _ in range(rng.randrange(1, 12))) + "."
        found = spans.sentences(text)
        if sum(s.words for s in found) >= 51:
            covered = set()
            for a, b in spans.runs(found, 3, 24):
                covered |= set(range(a, b + 1))
            assert covered == set(range(len(found))), text


def removed_words(texts):
    """Which words of each text go, by looking at every run of every text; texts are in order of their ids."""
    first_of, gone = {}, []
    for text in texts:
        found = spans.sentences(text)
        flags = [False] * len(found)
        for a, b in sorted(spans.runs(found, 3, 24)):
            key = tuple(s.key for s in found[a : b + 1])
            if first_of.setdefault(key, (len(gone), a)) != (len(gone), a):
                flags[a : b + 1] = [True] * (b + 1 - a)
        gone.append([f for f, s in zip(flags, found) for _ in range(s.words)])
    return gone


@pytest.mark.parametrize("length,least", [(60, 0.75), (90, 0.85), (300, 0.93)])
def test_passages_inside_running_sentences(spark, length, least):
    rng = random.Random(length)
    own = lambda: [f"y{rng.randrange(10**7)}" for _ in range(rng.randrange(5, 60))]
    rows, held = [], 0
    for i in range(60):
        shared = [f"x{i}n{rng.randrange(10**6)}" for _ in range(length)]
        rows += [(2 * i + k, " ".join(own() + shared + own()), "en", "s", 1) for k in (0, 1)]
    found = {r.doc_id: r for r in spans.dedup_spans(odd.table(spark, rows)).collect()}
    expected = removed_words([r[1] for r in rows])
    for i, text, *_ in rows:
        left = iter(found[i].kept_text.split())
        assert list(left) == [w for w, gone in zip(text.split(), expected[i]) if not gone]
        assert i % 2 or found[i].n_removed == 0
        held += sum(w.startswith("x") for w in found[i].kept_text.split()) if i % 2 else 0
    assert 1 - held / (60 * length) >= least


def test_passages_of_scripts_without_blanks(spark):
    rng = random.Random(8)
    letters = lambda n: "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(n))
    shared = "\u3002".join(letters(rng.randrange(3, 40)) for _ in range(20)) + "\u3002"
    rows = [(i, letters(33) + "\u3002" + shared + letters(25), "zh", "s", 1) for i in range(3)]
    found = {r.doc_id: r for r in spans.dedup_spans(odd.table(spark, rows)).collect()}
    assert found[0].kept_text == rows[0][1]
    for i in (1, 2):
        a, b = map(int, found[i].removed.split(":"))
        assert abs(a - 34) <= spans.LONGEST and b - a >= 0.95 * len(shared) and found[i].kept_text == rows[i][1][:a] + rows[i][1][b:]
