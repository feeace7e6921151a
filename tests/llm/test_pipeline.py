"""Each stage on its own input against brute force, and the whole on the small table."""

import random
from collections import Counter

import corpus_pipeline as pipeline
from spanloom.llm import mixing, packing, quality, setsketch, simhash
from tests.llm import odd
from tests.llm.test_duplicates import brute_components, brute_fingerprint, brute_lines


def test_stages_are_the_five():
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "line dedup", "simhash near-dedup", "mixing sources", "packing"]


def test_quality_stage(spark):
    docs = odd.table(spark)
    kept = pipeline.quality_rules(spark, docs, "")
    assert kept.columns == docs.columns
    wanted = Counter(r.doc_id for r in quality.judge(docs).filter("kept").collect())
    assert Counter(r.doc_id for r in kept.collect()) == wanted


def test_line_stage(spark):
    docs = odd.table(spark)
    kept = pipeline.line_dedup(spark, docs, "")
    assert set(kept.columns) == set(docs.columns) - {"n_lines", "n_dropped", "kept_text"} or kept.columns == docs.columns
    wanted = Counter((i, t) for i, _, dropped, t in brute_lines(odd.rows()) if not dropped or t.split())
    assert Counter((r.doc_id, odd.text_of(r.text)) for r in kept.collect()) == wanted


def test_near_stage(spark):
    docs, data = odd.table(spark), odd.rows()
    of = brute_components([r[0] for r in data], [brute_fingerprint(r[1], 3) for r in data], 3)
    wanted = Counter(r[0] for r, c in zip(data, of) if r[0] is None or r[0] == c)
    assert Counter(r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()) == wanted


def test_near_stage_leaves_no_two_similar_texts(spark):
    """The stage as registered; ``near_dedup`` is the part of it that the test before this one compares."""
    rng = random.Random(2)
    data = odd.rows()
    for i, words in enumerate((49, 60, 120, 400, 1500)):
        base = [f"v{rng.randrange(5000)}" for _ in range(words)]
        for k in range(4):
            copy = list(base)
            for at in rng.sample(range(words), k * words // 120):
                copy[at] = f"new{rng.randrange(10**6)}"
            data.append((100 + 10 * i + k, " ".join(copy), "en", "s1", 1))
    sets = {(r[0], r[1]): setsketch.shingles(odd.text_of(r[1]).encode(), 5) for r in data}
    first = [(r.doc_id, r.text) for r in pipeline.near_dedup(spark, odd.table(spark, data), "").collect()]
    kept = [(r.doc_id, r.text) for r in dict(pipeline.STAGES)["simhash near-dedup"](spark, odd.table(spark, data), "").collect()]

    def close(rows):
        rows = sorted({r for r in rows if r[0] is not None}, key=str)
        return [(a, b) for n, a in enumerate(rows) for b in rows[:n] if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0]

    assert len(close(first)) >= 5 and close(kept) == []
    ids = brute_components(list(range(len(first))), [0] * len(first), -1)
    for a, b in close([r for r in first if r[0] is not None]):
        x, y = ids[first.index(a)], ids[first.index(b)]
        ids = [min(x, y) if c in (x, y) else c for c in ids]
    groups = {}
    for row, c in zip(first, ids):
        groups.setdefault(c, set()).add(row)
    for rows in groups.values():
        assert len(rows & set(kept)) == 1 and (min(rows)[0] if len(rows) > 1 else None) in (None, next(iter(rows & set(kept)))[0])


def test_an_id_of_two_texts_is_judged_by_text(spark):
    rng = random.Random(4)
    x, y = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(40)) for c in "xy")
    docs = odd.table(spark, [(0, x, "en", "s", 1), (1, x, "en", "s", 1), (1, y, "en", "s", 1)])
    for stage in (pipeline.near_dedup, pipeline.near_copies):
        assert Counter((r.doc_id, r.text) for r in stage(spark, docs, "").collect()) == Counter([(0, x), (1, y)])


def test_stages_take_nothing(spark):
    for _, stage in pipeline.STAGES:
        assert stage(spark, odd.empty(spark), "").collect() == []


def test_the_whole(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, "").collect(), docs.schema)
    wanted = Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packing.pack(docs).collect())
    found = pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == wanted
    assert simhash and mixing
