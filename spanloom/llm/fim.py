"""Fill-in-middle order of texts, as a pipeline of Arrow kernels.

A text is a list of units: runs of ASCII letters, and every other code point by
itself. Two draws cut the units into prefix, middle and suffix, and the text is
written as prefix, suffix, middle (psm) or suffix, prefix, middle (spm) behind
sentinels. Per batch: split into list arrays, flatten with parent indices, number
the units within their text, filter by role, rebuild lists, join the pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import slices_of_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN_PERCENT = 10  # texts left in their own order
SPM_PERCENT = 20  # of the others, those with the suffix first
# UTF-8 units as bytes. The mark between units is a byte that UTF-8 never has.
UNIT = r"[A-Za-z]+|[\x00-\x40\x5b-\x60\x7b-\x7f]|[\xc0-\xff][\x80-\xbf]*"
MARK = b"\xff"


def draws(doc_id: Column, seed: int = 1, n: int = 4) -> list[Column]:
    """Unsigned 32-bit numbers from the seed and an id; an id that is null reads as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(n)]


def _modulo(a: pa.Array, b) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def _joined(units: pa.Array, role: pa.Array, counts: pa.Array) -> pa.Array:
    """The units of one role, joined within their text."""
    offsets = pa.concat_arrays([pa.array([0], pa.int64()), pc.cumulative_sum(counts)]).cast(pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pc.filter(units, role))
    return pc.binary_join(lists, b"").cast(pa.string())


def arrange(text: pa.Array, h: list[pa.Array], plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> dict[str, pa.Array]:
    """n, form, prefix_chars, middle_chars and output of a batch of texts without nulls."""
    marked = pc.replace_substring_regex(text.cast(pa.binary()), pattern=UNIT, replacement=b"\\0" + MARK)
    lists = pc.split_pattern(marked, MARK)
    n = pc.subtract(pc.list_value_length(lists).cast(pa.int64()), 1)  # an empty unit follows the last mark
    cuts = [_modulo(x, pc.add(n, 1)) for x in h[:2]]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)

    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    first = lists.offsets.slice(0, len(lists)).cast(pa.int64())
    ordinal = pc.subtract(pa.array(np.arange(len(units))), pc.take(first, parent))
    before, behind = pc.less(ordinal, pc.take(low, parent)), pc.greater_equal(ordinal, pc.take(high, parent))
    prefix = _joined(units, before, low)
    middle = _joined(units, pc.invert(pc.or_(before, behind)), pc.subtract(high, low))
    suffix = _joined(units, behind, pc.add(pc.subtract(n, high), 1))

    plain = pc.or_(pc.equal(n, 0), pc.greater_equal(_modulo(h[2], 100), 100 - plain_percent))
    for sentinel in (PREFIX, SUFFIX, MIDDLE):
        plain = pc.or_(plain, pc.match_substring(text, sentinel))
    spm = pc.less(_modulo(h[3], 100), spm_percent)
    psm_text = pc.binary_join_element_wise(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle, "")
    spm_text = pc.binary_join_element_wise(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle, "")
    none = pa.scalar(None, pa.int64())
    return {
        "n": n,
        "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
        "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
        "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
        "output": pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text)),
    }


def fill_in_middle(
    docs: DataFrame, seed: int = 1, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """One row per document: doc_id, n units, form, prefix_chars, middle_chars, output.

    ``form`` is plain, psm or spm. A text that is empty or null, or holds a
    sentinel, is plain: its output is the text (empty for null) and its pieces have
    null lengths. Equal ids draw alike, so repeated rows give repeated results.
    Bytes that are no UTF-8 are read as replacement characters. An empty table
    gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.make_valid_utf8(F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", text.alias("text"), *[h.alias(f"h{i}") for i, h in enumerate(draws(F.col("doc_id"), seed))])

    def run(batches):
        for batch in slices_of_bytes(batches, "text"):
            made = arrange(batch.column("text").cast(pa.string()), [batch.column(f"h{i}") for i in range(4)], plain_percent, spm_percent)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.values()], ["doc_id", *made])

    return rows.mapInArrow(
        run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    )


def restored(output: Column, form: Column) -> Column:
    """The text again, from nothing but an output and its form."""
    parts = F.split(output, "|".join(re.escape(s) for s in (PREFIX, SUFFIX, MIDDLE)), -1)
    first, second, middle = parts[1], parts[2], parts[3]
    return (
        F.when(form == "psm", F.concat(first, middle, second))
        .when(form == "spm", F.concat(second, middle, first))
        .otherwise(output)
    )
