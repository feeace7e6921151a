"""Packing documents into training sequences, shortest pack first over the length histogram.

1. Each text becomes token ids and is cut at every full sequence; what remains is
   one shorter piece. Only lengths and checksums leave this step.
2. The driver sees the histogram of piece lengths: at most one row per length, at
   any size of the corpus. Lengths are placed longest first, each into the pack
   that is shortest so far (Krell et al., "Efficient Sequence Packing without
   Cross-contamination", 2021). Packs of one make are a pattern with a count.
3. A pattern's places for a length are a range of ranks. Pieces are ranked within
   their length and find their sequence and offset by that range. Ranks are counted
   in buckets, so a length that a third of all pieces share is split over tasks.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom import session
from spanloom.llm.common import raw, slices

SEQUENCE = 2048  # tokens
END_ID = 1  # closes each document
BUCKET = 1024  # pieces ranked in one task
CACHED_WORDS = 500_000  # per worker


# -- tokens ---------------------------------------------------------------------------

class Tokens:
    """Token ids of the lower-casing word vocabulary, word by word.

    No token crosses white space, so the ids of a text are those of its words in
    turn. Words of letters that normalisation leaves alone go straight to the
    tokenizer's model, others through its whole encoder; either result is kept.
    """

    # No token crosses from an ASCII letter to ASCII punctuation, but for an apostrophe.
    SEAM = re.compile(rb"(?<=[a-z])(?=[!-&(-/:-@\[-`{-~])")
    PLAIN = re.compile("[\x21-\x7eÀ-ɏ]+")
    PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")  # fixed: the vocabulary's own

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        # The vocabulary writes a byte as a character: printable ones as themselves,
        # the others as the characters from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.spelled = {b: b for b in shown} | {b: 0x100 + i for i, b in enumerate(hidden)}
        self.known: dict[bytes, bytes] = _Known(self)

    def word(self, word: bytes) -> bytes:
        """Little-endian 32-bit ids of a run without ASCII white space."""
        text = word.decode()
        if self.PLAIN.fullmatch(text) and "<|" not in text:
            ids = []
            for part in self.PARTS.findall(text.lower()):
                ids += [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(self.spelled))]
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def text(self, text: bytes) -> bytes:
        if b"<|" not in text:  # no special token: case is nothing, and words come apart at seams
            text = self.SEAM.sub(b" ", text.lower())
        return b"".join(map(self.known.__getitem__, text.split()))


class _Known(dict):
    """Words seen so far; emptied when it has grown to its bound."""

    def __init__(self, tokens: Tokens):
        self.tokens = tokens

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self.tokens.word(word)
        if len(word) <= 64:
            self[word] = ids
        return ids


@lru_cache(maxsize=1)
def _tokens(path: str) -> Tokens:
    """One per worker process, so that tasks which follow each other share the words seen."""
    return Tokens(path)


def cut(ids: bytes, sequence: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, crc32) of the pieces of a document's ids."""
    n = len(ids) // 4
    for start in range(0, n, sequence):
        upto = min(n, start + sequence)
        yield start, upto - start, zlib.crc32(ids[4 * start : 4 * upto])


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece of every row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        tokens = _tokens(vocabulary or default_vocabulary())
        end = np.array([END_ID], "<u4").tobytes()
        for batch in slices(batches):
            of, rows = [], []
            for i, text in enumerate(raw(batch, "text")):
                ids = tokens.text(text) + end
                for piece in cut(ids, sequence):
                    of.append(i)
                    rows.append((*piece, len(ids) // 4))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(of)), *columns], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    )


# -- patterns --------------------------------------------------------------------------

class Pattern(NamedTuple):
    """Packs of one make: how many, and (length, repeats) of what each holds in order."""

    count: int
    parts: tuple[tuple[int, int], ...]


def pack_histogram(histogram: dict[int, int], sequence: int = SEQUENCE) -> list[Pattern]:
    """Patterns that hold each length as often as the histogram says."""
    packs: dict[int, list[Pattern]] = {}  # by the tokens they hold
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            fill = min((f for f in packs if f + length <= sequence), default=None)
            if fill is None:
                # New packs: one takes all it can before the next is begun.
                most = sequence // length
                for count, repeats in ((left // most, most), (1, left % most)):
                    if count and repeats:
                        packs.setdefault(repeats * length, []).append(Pattern(count, ((length, repeats),)))
                left = 0
                continue
            pattern = packs[fill].pop()
            if not packs[fill]:
                del packs[fill]
            used = min(left, pattern.count)
            if used < pattern.count:
                packs.setdefault(fill, []).append(pattern._replace(count=pattern.count - used))
            *first, (size, repeats) = pattern.parts
            parts = (*first, (size, repeats + 1)) if size == length else (*pattern.parts, (length, 1))
            packs.setdefault(fill + length, []).append(Pattern(used, parts))
            left -= used
    return [p for fill in sorted(packs, reverse=True) for p in packs[fill]]


def places(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, low, high, sequence, offset, repeats): where the pieces of ranks low to high - 1 of a length lie.

    Piece ``low + k`` is in sequence ``sequence + k // repeats``, the ``k % repeats``-th
    of its length from ``offset`` on.
    """
    rows, taken, sequence = [], {}, 0
    for pattern in patterns:
        offset = 0
        for length, repeats in pattern.parts:
            low = taken.get(length, 0)
            taken[length] = low + pattern.count * repeats
            rows.append((length, low, taken[length], sequence, offset, repeats))
            offset += length * repeats
        sequence += pattern.count
    return rows


# -- the operator ------------------------------------------------------------------------

def ranked(cut_pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """The pieces with ``_rank``, their number from 0 within their length."""
    spark = cut_pieces.sparkSession
    buckets = spark.createDataFrame(
        [(n, math.ceil(c / BUCKET)) for n, c in histogram.items()] or [], "length bigint, _buckets bigint"
    )  # one row per length
    key = F.xxhash64(F.col("doc_id").cast("string"), "start", "ids_crc32")
    dealt = cut_pieces.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(key, "_buckets")).drop("_buckets")
    counts = dealt.groupBy("length", "_bucket").count()
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = session.stage(
        counts.select("length", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_base")), "pack-buckets"
    )
    order = Window.partitionBy("length", "_bucket").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")
    return (
        dealt.join(bases, ["length", "_bucket"])
        .withColumn("_rank", F.col("_base") + F.row_number().over(order) - 1)
        .drop("_base", "_bucket")
    )


def pack(docs: DataFrame, sequence: int = SEQUENCE, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its tokens and the closing id; null and empty texts are that id
    alone. Each id lies in one piece; a sequence's pieces lie side by side from
    offset 0. Rows that share a doc_id are packed each for itself; rows that agree
    in all they carry are interchangeable. An empty table gives an empty result.
    ``vocabulary`` is a tokenizers file present on every worker.
    """
    spark = docs.sparkSession
    staged = session.stage(pieces(docs, sequence, vocabulary), "pack-pieces")
    histogram = {r["length"]: r["count"] for r in staged.groupBy("length").count().collect()}  # a row per length at most
    table = spark.createDataFrame(
        places(pack_histogram(histogram, sequence)), "length bigint, low bigint, high bigint, first bigint, begin bigint, repeats bigint"
    )
    # The places follow the histogram, not the corpus: their number is bounded by the lengths.
    at = F.col("_rank") - F.col("low")
    return (
        ranked(staged, histogram)
        .join(F.broadcast(table), "length")
        .filter((F.col("_rank") >= F.col("low")) & (F.col("_rank") < F.col("high")))
        .select(
            "doc_id", "start", "length", "ids_crc32", "doc_tokens",
            (F.col("first") + F.floor(at / F.col("repeats"))).cast("bigint").alias("sequence_id"),
            (F.col("begin") + (at % F.col("repeats")) * F.col("length")).cast("bigint").alias("offset"),
        )
    )
