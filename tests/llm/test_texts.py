"""Pages, secrets, mixing, languages, quality and packing against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import catalog, html, language, mixing, packing, quality, secrets
from tests.llm import odd

SF = "/root/testdata/sf0.001"


# -- pages ------------------------------------------------------------------------------

PROSE = "The house on the hill was old and it had been there for as long as any of the people in the town could say. " * 3


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain text", "plain text"), ("a < b &amp; c <!-- x --> d", "a < b & c d"),
    ("<nav><a href=/>Home</a></nav><article><h1>T</h1><p>One<b>two</b> three<br>four<p>five</article><footer>f</footer>", "T Onetwo three four five"),
    ("<article><header><h1>Head</h1></header><p>Body &eacute;&#8212;&nbsp;x</p><form><input><p>mail</p></form></article>", "Head Body é— x"),
    ("<div class='cookie-notice'>" + PROSE + "</div><main><p>Short.</p></main><div id=sidebar>" + PROSE + "</div>", "Short."),
    ("<article><p>Text</p><section class='post-comments'><article><p>" + PROSE + "</p></article></section></article>", "Text"),
    ("<article><p>Text <a href=x>link</a> end</p><ul><li><a href=a>More one</a></li><li><a href=b>More two</a></li></ul></article>", "Text link end"),
    ("<article><p>a</p><div class=advert>buy</div><p>b <span class='sponsored'>buy</span> c</p></article>", "a b c"),
    ("<article>x<script>if (a<b) '</p>'</script>y<style>p{}</style></article>", "xy"),
    ("<article><div class='article-header'>kept</div><div class='page-header'>kept too</div></article>", "kept kept too"),
    ("<body class='has-sidebar'><div hidden>no</div><p>yes</p></body>", "yes"),
    ("<div><p>" + PROSE + "</p><p>Tiny.</p></div><div><a href=1>all links</a></div><p>(c) x</p>", PROSE.strip() + " Tiny."),
    ("<article>" + "word " * 200_000 + "</article>", ("word " * 200_000).strip()),
    ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"), ("<article><p title=\"a>b\">q</p>", "q"),
])
def test_main_text(page, text):
    assert html.main_text(page or "") == text


RUSSIAN = "Мы долго шли по узкой дороге, которая вела к старому дому на краю леса. Вечером стало холодно, и дождь не прекращался. " * 2
CHINESE = "人类社会的发展离不开语言和文字。语言是人们交流思想的工具，文字则记录了历史。古代的学者在竹简上写下他们的见解，后来纸张的发明使知识得以广泛传播。"
CODE = "for (int i = 0; i < n; i++) { total += rows[i].size(); if (total > limit) throw new Error(total); } " * 3


@pytest.mark.parametrize("text", [RUSSIAN, CHINESE, CODE])
def test_pages_without_known_stop_words_are_judged_by_length_and_links(text):
    from html import escape

    links = "<ul>" + "".join(f"<li><a href=/{i}>{text[:12]}</a></li>" for i in range(5)) + "</ul>"
    page = f"<div>{links}</div><div><p>{escape(text)}</p><p>{escape(text)}</p></div><div>{links}</div>"
    assert html.main_text(page) == f"{text.strip()} {text.strip()}"


def test_open_blocks_follow_their_neighbours():
    g, b, n, o = html.GOOD, html.BAD, html.NEAR, html.OPEN
    assert html.second_pass([g, o, o, b, o, b, n, g], False) == [True, True, False, False, False, False, True, True]
    assert html.second_pass([o, n], False) == [True, True]
    assert html.second_pass([o, b, o], True) == [True, False, True]


@pytest.mark.parametrize("page", ["<a \"" * 9000 + ">", "<" * 99_999, "<div class=\"" * 9000, "<div>" * 9000 + "</x>" * 9000, "<!--" * 9000, "<a<" * 9000 + ">"])
def test_hostile_pages_take_linear_time(page):
    html.main_text(page)


def test_pages_query_is_the_article(spark):
    from html import unescape

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in catalog.QUERIES["op1_html_text"](spark, SF).collect():
        inner = re.sub(r"<(?:/?(?:p|h1)|br)>", " ", re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1])
        assert r.text == " ".join(unescape(re.sub(r"<[^>]+>", "", inner)).split()) and r.n_chars == len(r.text)


def test_extract_of_odd_rows(spark):
    ddl = "page_id bigint, url string, html string, main_text int, inside string"
    df = spark.createDataFrame([(1, "u", None, 1, "x"), (1, "u", None, 1, "x"), (None, None, "<p>t</p>", None, None)], ddl)
    assert Counter((r.page_id, r.main_text) for r in html.extract(df).collect()) == Counter({(1, ""): 2, (None, "t"): 1})
    assert html.extract(df.limit(0)).collect() == []


# -- secrets ------------------------------------------------------------------------------

BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def brute_secrets(text):
    found = [
        (m.start(), k, m.end()) for k, (_, p, enough) in enumerate(BASE) for m in p.finditer(odd.text_of(text)) if enough(m)
    ]
    return sorted(found)


def secret_rows():
    rng = random.Random(3)
    bits = ["password", "passwd", "Secret", "TOKEN", "api_key", "apikey", "'", '"', " ", "  ", ":", "=", "abc", "token:", "AKIA", "Z" * 16, "0f" * 12, "é", "漢", "\n", "x=y"]
    data = odd.rows()
    data += [(100 + i, "".join(rng.choice(bits) for _ in range(rng.randrange(40))), None, None, None) for i in range(300)]
    return data + [(500, "secret=token: abcdefgh", None, None, None), (501, "ghp_" + "a" * 36 + " password=hunter22", None, None, None)]


@pytest.mark.parametrize("bound", [200_000, 3])
def test_secrets(spark, monkeypatch, bound):
    monkeypatch.setattr(secrets.session, "BROADCAST_ROW_BOUND", bound)
    data = secret_rows()
    found = secrets.scan_secrets(odd.table(spark, data)).collect()
    base = [n for n, r in enumerate(secrets.RULES) if r.base]
    got = Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.spans if s.kind in base)) for r in found)
    assert got == Counter((r[0], tuple(brute_secrets(r[1]))) for r in data)
    extra = next(r for r in found if r.doc_id == 501)
    assert [secrets.RULES[s.kind].kind for s in extra.spans] == ["github", "hex", "assign"]
    assert secrets.scan_secrets(odd.empty(spark)).collect() == []


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{24,}") == [] and secrets.trigram_query("ab|cde") == []
    assert secrets.trigram_query("AKIA[A-Z]+") == [["aki", "kia"]]
    assert secrets.trigram_query("(abc|bcd)x?y+") == [["abc"], ["bcd"]]
    rng = random.Random(1)
    for rule in secrets.RULES[:2]:
        asked = secrets.trigram_query(rule.pattern)
        for text in ["my PASSWD = 'abcdef'", "Api_Key:xyz123", "apikey=1", "x AKIA" + "B" * 16]:
            if re.search(rule.pattern, text):
                assert any(all(t in text.lower() for t in c) for c in asked), rng


def test_secret_query_columns(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in catalog.QUERIES["op6_secret_scan"](spark, SF).collect():
        spans = brute_secrets(texts[r.doc_id])
        joined = ",".join(f"{BASE[k][0]}:{a}:{b}" for a, k, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in spans) for n in range(3))


# -- mixing ---------------------------------------------------------------------------------

def brute_seats(weights, seats):
    out = [0] * len(weights)
    for _ in range(seats):
        best = max(range(len(weights)), key=lambda i: (weights[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def test_sainte_lague():
    rng = random.Random(1)
    for _ in range(200):
        w = [rng.choice([0, 1, 2, 5, 7.5, 100]) for _ in range(rng.randrange(1, 9))]
        seats = rng.randrange(0, 60)
        if sum(w):
            assert list(mixing.sainte_lague(np.array(w, float), seats)) == brute_seats(w, seats), (w, seats)
    assert list(mixing.sainte_lague(np.zeros(3), 5)) == [0, 0, 0]


def test_capped_targets():
    got = mixing.capped_targets(np.array([10.0, 1000, 0, 500]), np.array([5.0, 2, 1, 5]), 1510, 3)
    assert got[0] == 30 and got[2] == 0 and abs(got.sum() - 1510) < 1e-6
    assert abs(got[1] / got[3] - 2 / 5) < 1e-9


@pytest.mark.parametrize("shard_docs, block", [(2048, 16), (3, 4)])
def test_mix(spark, shard_docs, block):
    data = odd.rows()
    found = mixing.mix(odd.table(spark), shard_docs=shard_docs, block=block).collect()
    assert Counter((r.doc_id, r.size) for r in found) == Counter((r[0], len(odd.text_of(r[1]).encode().split())) for r in data)
    for r in found:
        assert 0 <= r.taken <= 3 * r.size
        assert r.taken == r.passes * r.size + sum(p.end - p.start for p in r.pieces)
        assert all(0 <= p.start < p.end <= r.size for p in r.pieces)
    sources = defaultdict(int)
    for r in data:
        sources[r[3]] += len(odd.text_of(r[1]).encode().split())
    targets = {r.target for r in found}
    order = sorted(sources, key=lambda s: (s is None, s or ""))
    wanted = mixing.capped_targets(
        np.array([sources[s] for s in order], float), np.array([(5, 2, 1)[i % 3] for i in range(len(order))], float), sum(sources.values()), 3
    )
    assert targets == set(wanted)
    again = mixing.mix(odd.table(spark, partitions=2), shard_docs=shard_docs, block=block).collect()
    assert Counter(map(str, again)) == Counter(map(str, found))
    assert mixing.mix(odd.empty(spark)).collect() == []


def test_mix_comes_near_its_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = mixing.mix(docs, keep=("doc_id", "source"), shard_docs=4)
    for r in found.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("w")).collect():
        assert abs(r.t - r.w) <= 0.01 * r.w + 2 * mixing.BLOCK


def test_mixed_documents_hold_what_is_taken(spark):
    docs = odd.table(spark)
    mixed = mixing.mixed_documents(docs)
    words = sum(len(odd.text_of(r.text).encode().split()) for r in mixed.select("text").collect())
    assert words == mixing.mix(docs).agg(F.sum("taken")).first()[0]
    assert mixing.mixed_documents(odd.empty(spark)).collect() == []


# -- languages -----------------------------------------------------------------------------------

def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    n = language.HIDDEN
    shapes = [(2, 257, 3 * n), (2, n, 3 * n), (2 * n, 3), (3,)]
    params = [rng.normal(0, 0.5, s).astype(np.float64) for s in shapes]
    net = language.Network(list("abc"), *params)
    windows = rng.integers(97, 105, (4, 7)).astype(np.int16)
    windows[0, 5:] = language.PAD
    truth = np.array([0, 1, 2, 1])
    _, grads = language.gradients(net, windows, truth)
    for k, at in ((0, (0, int(windows[1, 2]), 3)), (0, (1, int(windows[2, 3]), 20)), (1, (0, 2, 5)), (1, (1, 3, 17)), (2, (5, 1)), (3, (2,))):
        was = params[k][at]
        params[k][at] = was + 1e-2
        up = language.gradients(net, windows, truth)[0]
        params[k][at] = was - 1e-2
        down = language.gradients(net, windows, truth)[0]
        params[k][at] = was
        assert abs((up - down) / 2e-2 - grads[k][at]) < 2e-4 + 0.02 * abs(grads[k][at])


def test_language_query_on_held_out_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    found = catalog.QUERIES["op8_language"](spark, "/root/testdata/sf0.01").collect()
    assert len(found) == len(truth)
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(r.held_out == (r in held) for r in found[:50])
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in found)


def test_languages_of_odd_rows(spark):
    docs = odd.table(spark)
    net = language.fit(docs, docs_per_label=5, steps=5)
    assert net.labels == sorted({r[2] for r in odd.rows() if r[2] and r[1] is not None})
    found = language.identify(docs, net).collect()
    assert len(found) == len(odd.rows())
    for r in found:
        letters = any(c.isalpha() for c in odd.text_of(r.text))
        assert (r.lang_pred == "und") == (not letters) and (r.lang_pred in net.labels or not letters)
    assert language.fit(odd.empty(spark)) is None
    assert {r.lang_pred for r in language.identify(docs, None).collect()} == {"und"}
    assert language.identify(odd.empty(spark), net).collect() == []


def test_pooling_reads_every_byte_once():
    rng = np.random.default_rng(1)
    shapes = [(2, 257, 3 * language.HIDDEN), (2, language.HIDDEN, 3 * language.HIDDEN), (2 * language.HIDDEN, 2), (2,)]
    net = language.Network(["a", "b"], *[rng.normal(0, 0.5, s).astype(np.float32) for s in shapes])
    sizes = [0, 1, 127, 128, 129, 700_000]
    pool = language.Pool(net, len(sizes))
    for i, n in enumerate(sizes):
        pool.add(i, rng.integers(0, 256, n).astype(np.uint8))
    pool.flush()
    assert np.allclose(pool.sums.sum(1), sizes, rtol=1e-4)


# -- quality -----------------------------------------------------------------------------------

def brute_repeats(words, window=8):
    grams = Counter(tuple(words[i : i + window]) for i in range(len(words) - window + 1))
    out = set()
    for i in range(len(words) - window + 1):
        if grams[tuple(words[i : i + window])] > 1:
            out |= set(range(i, i + window))
    return len(out)


def test_repeated_words():
    rng = random.Random(5)
    for _ in range(500):
        words = [str(rng.randrange(rng.choice([1, 2, 50]))).encode() for _ in range(rng.randrange(60))]
        words = words + words[3:20] + words if rng.random() < 0.5 else words
        assert quality.repeated_words(words) == brute_repeats(words)


def test_quality_counts(spark):
    data = odd.rows() + [(60, "a#b $x\n \na#b $x\na#b $x\n\n" + "|<>&%* " * 9, None, None, None)]
    found = quality.judge(odd.table(spark, data)).collect()
    wanted = Counter()
    for i, text, *_ in data:
        text = odd.text_of(text)
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        repeats = brute_repeats(words)
        wanted[(i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeats, len(words) < 20 or 100 * repeats > 30 * len(words))] += 1
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in found) == wanted
    assert not any(r.kept and r.base_failed for r in found)
    assert quality.judge(odd.empty(spark)).collect() == []


def test_bands():
    fertility = quality.Fertility(quality.default_vocabulary())
    plain = "The committee will meet again on Tuesday to discuss what remains of the plan for the old harbour and its two piers."
    noise = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(30))
    assert quality.within_band("latin", *fertility.measure(plain)[1:])
    assert not quality.within_band("latin", *fertility.measure(noise)[1:])
    assert not quality.within_band("latin", *fertility.measure("ab cd " * 400)[1:])
    assert [quality.script(t) for t in ("abc é", "где", "漢字かな漢", "123 !", "")] == ["latin", "cyrillic", "han", "other", "other"]


def test_quality_keeps_labelled_clean_documents(spark):
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").collect()}
    found = quality.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert all(r.kept or r.base_failed for r in found if r.doc_id in good)


def test_quality_rejects_labelled_junk(spark):
    """Bands are fitted to odd documents of sf0.1; the even ones and sf0.01 are held out."""
    for sf in ("sf0.01", "sf0.1"):
        labels = {r.doc_id: r.quality for r in spark.read.parquet(f"/root/testdata/{sf}/labels.parquet").collect()}
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").filter(F.col("doc_id") % 2 == 0)
        found = [r for r in quality.judge(docs).drop("text").collect() if r.doc_id in labels]
        junk, good = ([r for r in found if labels[r.doc_id] == k] for k in (0, 1))
        assert sum(not r.kept for r in junk) >= 0.95 * len(junk)
        assert sum(r.kept for r in good) >= 0.999 * sum(not r.base_failed for r in good)


def test_bands_are_those_of_clean_labelled_text(spark):
    sf = "/root/testdata/sf0.1"
    clean = spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 AND doc_id % 2 = 1").select("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(F.broadcast(clean), "doc_id", "left_semi")
    of = defaultdict(list)
    for r in quality.judge(docs).filter("NOT base_failed").select("lang", "text").collect():
        of[r.lang].append(r.text)
    fertility = quality.Fertility(quality.default_vocabulary())
    assert {f"latin/{k}" for k in of} == {k for k in quality.BANDS if "/" in k}
    for lang, group in of.items():
        assert quality.fit_band(group, fertility) == quality.BANDS[f"latin/{lang}"]


def test_texts_without_a_letter_have_a_strict_band(spark):
    rng = random.Random(1)
    data = [(1, " ".join(str(rng.randrange(10**6)) for _ in range(300)), None, None, None), (2, "?! -- " * 30, "en", None, None)]
    assert not any(r.kept for r in quality.judge(odd.table(spark, data)).collect())


def test_one_table_in_a_long_text_does_no_harm(spark):
    text = (
        "The committee will meet again on Tuesday to discuss what remains of the plan for the old harbour and its two piers. "
        "Most people in the town remember how the ships used to come in at night, when the lamps along the wall were lit. "
        "Nobody could say whether the money would last until spring, though several members had asked for a longer report. "
        "A second letter arrived from the capital last week and said that the work must wait until the river has been measured."
    )
    table = "\n" + "a | b | c | d |\n" * 2
    rows = quality.judge(odd.table(spark, [(1, text + table, "en", None, None), (2, table * 20, "en", None, None)])).collect()
    assert {r.doc_id: r.kept for r in rows} == {1: True, 2: False}


# -- packing ----------------------------------------------------------------------------------

@pytest.mark.parametrize("bucket", [8192, 2])
def test_pack(spark, monkeypatch, bucket):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BUCKET", bucket)
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    data = odd.rows()
    found = packing.pack(odd.table(spark)).collect()
    wanted = Counter()
    for i, text, *_ in data:
        ids = np.array([*tokenizer.encode(odd.text_of(text), add_special_tokens=False).ids, 1], "<u4")
        for at in range(0, len(ids), 2048):
            part = ids[at : at + 2048]
            wanted[(i, at, len(part), zlib.crc32(part.tobytes()), len(ids))] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(odd.empty(spark)).collect() == []


def test_tokens_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, tokens = Tokenizer.from_file(packing.default_vocabulary()), packing.Tokens(packing.default_vocabulary())
    for text in ["", "Don't STOP 123 !!?? it's", "Éa é ﬁ İ ẞ Σας", "a b c\x1cd\x85e", "x<|endoftext|>y <|startoftext|>", "漢字かな \U0001f600\U0001f601", "ĿŀǅǇ ×÷", "́a", "a\tb\nc\x0bd\x0ce\rf", "'s 'LL we'RE"]:
        assert list(np.frombuffer(tokens.text(text.encode()), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_tokens_of_random_texts():
    from tokenizers import Tokenizer

    tokenizer, tokens = Tokenizer.from_file(packing.default_vocabulary()), packing.Tokens(packing.default_vocabulary())
    rng = random.Random(11)
    bits = [*"abcXYZ019", *"!?.,;:'\"#<=>|_-", " ", " ", "\n", "\t", "é", "É", "ß", "e\u0301", "\u0338", "\u00a0", "\u200d", "漢", "И", "\x1d", "'S", "'ve", "the", "Word"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert list(np.frombuffer(tokens.text(text.encode()), "<u4")) == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_histogram_packing():
    rng = random.Random(7)
    for size in (1, 10, 300, 5000):
        hist = Counter(rng.randrange(1, 2049) for _ in range(size))
        patterns = packing.pack_histogram(dict(hist))
        back = Counter()
        for p in patterns:
            assert sum(n * r for n, r in p.parts) <= 2048
            for n, r in p.parts:
                back[n] += r * p.count
        assert back == hist
        total = sum(p.count for p in patterns)
        if size == 5000:
            assert sum(n * c for n, c in hist.items()) >= 0.99 * 2048 * total
    assert packing.pack_histogram({}) == [] and packing.pack_histogram({5: 1000})[0].parts == ((5, 409),)


PROSE = "The house that we saw was on the hill and it had been there for as long as they could remember, with all of its rooms."


@pytest.mark.parametrize("wrapper", [
    "<form>{}</form>", "<div class='layout-sidebar-right'>{}</div>", "<div class='page search-results'>{}</div>",
    "<div class='content-ad-free'>{}</div>", "<div id='main-menu-open'>{}</div>", "<form><div class='has-widget share'>{}</div></form>",
])
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div>{}</div>"])
def test_doubtful_wrappers_keep_the_article(wrapper, inner):
    text = " ".join([PROSE] * 3)
    page = f"<body><nav><a href=x>Home</a></nav>{wrapper.format(inner.format(f'<p>{text}</p>'))}<footer>Imprint</footer></body>"
    assert html.main_text(page) == text


def test_wrapped_cards_beside_the_article_stay_out():
    text = " ".join([PROSE] * 3)
    card = "<article><h3>Another story</h3><p>Read what they wrote about it.</p></article>"
    for name in ("article", "div"):
        assert html.main_text(f"<{name}><p>{text}</p></{name}><div class='related'>{card}{card}</div>") == text
    remark = f"<div class='comments'><article><p>{text}</p></article></div>"
    assert html.main_text(f"<article><p>{PROSE}</p></article>{remark}") == PROSE
    assert html.main_text(remark) == ""


def test_paragraphs_of_another_script_are_judged_by_length():
    chinese = "这是一个关于天气的长段落我们今天去公园看花然后回家吃饭大家都很高兴因为天气很好" * 4
    page = f"<body><p>{PROSE}</p><p>{chinese}</p><p>{PROSE}</p><p>{PROSE}</p></body>"
    assert html.main_text(page) == " ".join([PROSE, chinese, PROSE, PROSE])
