"""Fill-in-middle against a plain version, and the text back from its output."""

import hashlib
import re
from collections import Counter

from pyspark.sql import functions as F

from spanloom.llm import fim
from tests.llm import odd


def plain_version(doc_id, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(units)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_fill_in_middle(spark):
    texts = ["<", "<<P", "a<S>b", "<P>", "S><M", "Äß中 x\x00y\x7f<", "\U0001f600" * 9, "\n", "<<<S", "P>P>S>"]
    data = odd.rows() + [(100 + i, texts[i % len(texts)], "en", "s", 1) for i in range(300)]
    found = Counter(tuple(r) for r in fim.fill_in_middle(odd.table(spark, data)).collect())
    assert found == Counter(plain_version(r[0], r[1]) for r in data)
    assert {"plain", "psm", "spm"} == {k[2] for k in found}


def test_text_comes_back_from_output_and_form(spark):
    data = odd.rows() + [(100 + i, "<" * (i % 4) + "P>S<" + "a<b" * i, "en", "s", 1) for i in range(200)]
    docs = odd.table(spark, data)
    made = fim.fill_in_middle(docs)
    back = Counter(r[0] for r in made.select(fim.restored(F.col("output"), F.col("form"))).collect())
    assert back == Counter(r[1] or "" for r in data)


def test_nothing(spark):
    assert fim.fill_in_middle(odd.empty(spark)).collect() == []


def test_shares_are_parameters(spark):
    docs = odd.table(spark, [(i, "some words here", "en", "s", 1) for i in range(50)])
    assert {r.form for r in fim.fill_in_middle(docs, plain_percent=0, spm_percent=100).collect()} == {"spm"}
    assert {r.form for r in fim.fill_in_middle(docs, plain_percent=100).collect()} == {"plain"}
