"""Substring dedup by sliding sentence spans.

A text is a row of sentences. One ends at a line break, after a word that ends with a
sentence mark, and after a word whose hash says so (one of ``EACH`` on average); beyond
``LONGEST`` words it is cut in any case. As words decide, the cuts of a passage fall
into step again wherever it begins. In scripts without blanks between words each code
point is a word. From each sentence on, and up to each, the shortest run of at least
``least_sentences`` sentences and ``least_words`` words is hashed. So of a passage of twice
``least_words`` words every sentence lies in a run that does not leave the passage,
but for those at its two ends that run on into other text.

Runs are joined globally by hash. The first occurrence of a run, by document and
position, stays; the sentences of every later one are removed.

1. 64-bit hashes are counted, with partial sums, to find the few that recur.
2. Only runs of those hashes are kept, with a second hash and their place.
3. Each recurring run's first place is a minimum, again with partial results; the
   other places are an equality join, whose busy keys adaptive execution splits.

Sentences of many texts are found and hashed at once, by numpy over their bytes; it needs
some 60 bytes for each byte of ``BATCH_BYTES`` or of the longest text.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom import session
from spanloom.llm.common import extended, raw, slices_of_bytes, small_or_not

LONGEST = 16
EACH = 6
LEAST_SENTENCES = 3
LEAST_WORDS = 24
BATCH_BYTES = 1 << 20
NO_ID = (1 << 63) - 1  # a missing doc_id sorts after all others

_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_BYTE = np.random.default_rng(3).integers(0, 1 << 64, 256, np.uint64)[_LOWER]
# Sentence marks by their UTF-8 bytes: one, two and three of them.
_MARKS = [np.array([int.from_bytes(c.encode()) for c in marks]) for marks in (".!?", "\u061f\u06d4", "\u0964\u0965\u3002\uff01\uff0e\uff1f")]
_PAD = b"\n" * 4


class Sentences(NamedTuple):
    """Sentences of several texts, one entry each."""

    text: np.ndarray  # number of its text
    start: np.ndarray  # bytes before it in its text; it reaches to the start of the next
    end: np.ndarray  # end of its last word
    words: np.ndarray
    hash: np.ndarray


class Sentence(NamedTuple):
    start: int  # code points; it reaches to the start of the next
    words: int
    key: bytes


def _folded(values: np.ndarray, first: np.ndarray, upto: np.ndarray, base: int) -> np.ndarray:
    """A hash of values[first:upto], their order included, for each pair of bounds."""
    powers = np.full(len(values) + 1, base, np.uint64)
    powers[0] = 1
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[:-1], out=sums[1:])
    powers[1:] = pow(base, -1, 1 << 64)
    np.multiply.accumulate(powers, out=powers)
    return (sums[upto] - sums[first]) * powers[first]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words: what white space parts, and each code point of a script without it."""
    solid = ~_SPACE[data]
    following = np.append(data[1:], np.uint8(10))
    alone = (data >= 0xE3) & (data <= 0xE9)
    alone |= (data == 0xE0) & (following >= 0xB8) & (following <= 0xBB)
    alone |= (data == 0xEF) & ((following >= 0xA4) & (following <= 0xAB) | (following >= 0xBC) & (following <= 0xBD))
    alone |= (data == 0xF0) & (following >= 0xA0) & (following <= 0xB3)
    begin = solid.copy()
    begin[1:] &= ~solid[:-1]
    at = np.flatnonzero(alone)
    begin[at] = True
    after = at + np.where(data[at] == 0xF0, 4, 3)
    begin[after] |= solid[after]
    ends = solid[:-1] & (~solid[1:] | begin[1:])
    return np.flatnonzero(begin), np.flatnonzero(ends) + 1


def segmented(found: list[bytes]) -> Sentences:
    """The sentences of texts in UTF-8; A-Z and the kind of white space make no difference to their hashes."""
    data = np.frombuffer(_PAD + b"\n".join(found) + _PAD, np.uint8)
    begins = len(_PAD) + np.cumsum([0, *(len(t) + 1 for t in found[:-1])])
    start, end = _words(data)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Sentences(none, none, none, none, none.astype(np.uint64))
    word = _mixed(_folded(_BYTE[data], start, end, 0x9E3779B97F4A7C15))
    last = data.astype(np.int64)
    ends = np.isin(last[end - 1], _MARKS[0])
    for n, marks in enumerate(_MARKS[1:], 2):
        ends |= np.isin(sum(last[end - 1 - k] << 8 * k for k in range(n)), marks)
    ends |= (word >> np.uint64(40)) % np.uint64(EACH) == 0
    lines = np.cumsum(data == 10)
    ends[:-1] |= lines[start[1:]] > lines[end[:-1] - 1]
    ends[-1] = True
    number = np.arange(len(start))
    since = number - np.maximum.accumulate(np.where(np.append(True, ends[:-1]), number, 0))
    ends |= since % LONGEST == LONGEST - 1
    upto = np.flatnonzero(ends) + 1
    first = np.append(0, upto[:-1])
    text = np.searchsorted(begins, start[first], "right") - 1
    return Sentences(
        text, start[first] - begins[text], end[upto - 1] - begins[text], upto - first,
        _mixed(_folded(word, first, upto, 0xC2B2AE3D27D4EB4F)),
    )


def sentences(text: str) -> list[Sentence]:
    """The sentences of a text, in lower case and without the kind of white space in their keys."""
    data = text.encode("utf-8", "surrogatepass")
    found = segmented([data])
    return [
        Sentence(len(data[:a].decode("utf-8", "surrogatepass")), w, b" ".join(data[a:b].lower().split()))
        for a, b, w in zip(found.start.tolist(), found.end.tolist(), found.words.tolist())
    ]


def _runs(text: np.ndarray, words: np.ndarray, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last sentence of the shortest sufficient run from each sentence on and up to each, each once."""
    n = len(text)
    number = np.arange(n)
    upto = np.cumsum(words)
    before = upto - words
    last = np.maximum(number + least_sentences - 1, np.searchsorted(upto, before + least_words))
    first = np.minimum(number - least_sentences + 1, np.searchsorted(before, upto - least_words, "right") - 1)
    on = (last < n) & (text[np.minimum(last, n - 1)] == text)
    to = (first >= 0) & (text[np.maximum(first, 0)] == text)
    pairs = np.unique(np.concatenate([number[on] << 32 | last[on], first[to] << 32 | number[to]]))
    return pairs >> 32, pairs & ((1 << 32) - 1)


def runs(found: list[Sentence], least_sentences: int, least_words: int) -> list[tuple[int, int]]:
    """(first, last) of the runs of one text."""
    first, last = _runs(np.zeros(len(found), np.int64), np.array([s.words for s in found], np.int64), least_sentences, least_words)
    return list(zip(first.tolist(), last.tolist()))


def hashed_runs(found: Sentences, least_sentences: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last sentence and two 64-bit hashes of each run."""
    first, last = _runs(found.text, found.words, least_sentences, least_words)
    h, g = (_mixed(_folded(found.hash, first, last + 1, base)).view(np.int64) for base in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
    return first, last, h, g


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("owner"), F.xxhash64("text").alias("mark"), "text"
    )


def repeated_spans(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """(owner, mark, first, last): every occurrence of a recurring run but its first.

    ``owner`` is the doc_id and ``mark`` a hash of the text, so that rows that share
    a doc_id don't mix.
    """
    rows = _prepared(docs)

    def count(batches):
        for batch in slices_of_bytes(batches, "text", BATCH_BYTES):
            h, n = np.unique(hashed_runs(segmented(raw(batch, "text")), least_sentences, least_words)[2], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    counted = rows.mapInArrow(count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    recurring = session.stage(counted.filter("n > 1").select("h"), "span-hashes")

    def place(batches):
        for batch in slices_of_bytes(batches, "text", BATCH_BYTES):
            found = segmented(raw(batch, "text"))
            first, last, h, g = hashed_runs(found, least_sentences, least_words)
            of = found.text[first]
            ahead = np.searchsorted(found.text, of)  # sentences of the texts before
            yield pa.RecordBatch.from_arrays(
                [batch.column("owner").take(pa.array(of)), batch.column("mark").take(pa.array(of)), pa.array(h), pa.array(g),
                 pa.array((first - ahead).astype(np.int32)), pa.array((last - ahead).astype(np.int32))],
                ["owner", "mark", "h", "g", "first", "last"],
            )

    placed = rows.mapInArrow(place, "owner bigint, mark bigint, h bigint, g bigint, first int, last int")
    candidates = session.stage(placed.join(small_or_not(recurring), "h", "left_semi"), "span-candidates")
    origin = session.stage(
        candidates.groupBy("h", "g").agg(F.min(F.struct("owner", "mark", "first")).alias("origin"), F.count("*").alias("n"))
        .filter("n > 1").drop("n"),
        "span-origins",
    )
    return (
        candidates.join(origin, ["h", "g"])
        .filter(F.struct("owner", "mark", "first") != F.col("origin"))
        .select("owner", "mark", "first", "last")
    )


ADDED = {"n_sentences": "long", "n_removed": "long", "n_words": "long", "n_words_removed": "long", "removed": "string", "kept_text": "string"}


def dedup_spans(docs: DataFrame, least_sentences: int = LEAST_SENTENCES, least_words: int = LEAST_WORDS) -> DataFrame:
    """All rows and columns of ``docs`` with the columns of ``ADDED``.

    doc_id is an integer. ``removed`` lists the code-point ranges taken out as
    start:end, joined by commas; ``kept_text`` is the rest of the text as it was.
    The first occurrence of a run is the one with the smallest doc_id, then the
    earliest in its text; a null doc_id comes last. Rows that agree in doc_id and
    text count as one. Null and empty texts have no sentence and an empty
    ``kept_text``. Columns that bear an added name are replaced.
    """
    docs = docs.drop(*ADDED, "_owner", "_mark", "_runs")
    covered = repeated_spans(docs, least_sentences, least_words)
    per_doc = covered.groupBy("owner", "mark").agg(F.collect_set(F.struct("first", "last")).alias("_runs"))
    marked = docs.withColumns(
        {"_owner": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)), "_mark": F.xxhash64("text")}
    )
    tagged = marked.join(per_doc.withColumnsRenamed({"owner": "_owner", "mark": "_mark"}), ["_owner", "_mark"], "left")
    shown = docs.columns
    tagged = tagged.select(*shown, F.transform("_runs", lambda r: F.array(r["first"], r["last"])).alias("_runs"))

    def rebuild(batches):
        for batch in slices_of_bytes(batches, "text", BATCH_BYTES):
            read = raw(batch, "text")
            found = segmented(read)
            bounds = np.searchsorted(found.text, np.arange(len(read) + 1))
            out = [
                _without(text, found.start[a:b], found.words[a:b], cut or [])
                for text, a, b, cut in zip(read, bounds[:-1], bounds[1:], batch.column("_runs").to_pylist())
            ]
            added = [pa.array(c, pa.int64() if kind == "long" else pa.string()) for c, kind in zip(zip(*out), ADDED.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in shown), *added], [*shown, *ADDED])

    return tagged.mapInArrow(rebuild, extended(docs.schema, ADDED))


def _without(text: bytes, start: np.ndarray, words: np.ndarray, cut: list[list[int]]) -> tuple[int, int, int, int, str, str]:
    n, total = len(start), int(words.sum())
    if not cut:
        return n, 0, total, 0, "", text.decode("utf-8", "surrogatepass")
    change = np.zeros(n + 1, np.int64)
    runs = np.array(cut)
    np.add.at(change, runs[:, 0], 1)
    np.add.at(change, runs[:, 1] + 1, -1)
    gone = change.cumsum()[:-1] > 0
    reach = np.append(start, len(text))
    reach[0] = 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
    places = reach[turns].tolist()
    points = np.append(0, np.cumsum(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))[places].tolist()
    kept = b"".join(text[a:b] for a, b in zip([0, *places[1::2]], [*places[::2], len(text)]))
    return (
        n, int(gone.sum()), total, int(words[gone].sum()),
        ",".join(f"{a}:{b}" for a, b in zip(points[::2], points[1::2])), kept.decode("utf-8", "surrogatepass"),
    )
