"""Mixing sources to target weights by Sainte-Laguë apportionment.

1. A source is dealt to shards by a seeded hash of the document; a source with
   more documents gets more shards, so no task holds a hot source.
2. Word targets per source follow the weights, capped at a multiple of what the
   source holds, the excess reshared.
3. The mix is a number of equal blocks of words. Highest quotients deal the blocks
   to sources in proportion to their targets, and each source's blocks to its
   shards in proportion to their words: integer quotas.
4. In a shard the documents lie in seeded order on a line of words cut into blocks.
   A quota is so many whole passes over the shard and a seeded choice of blocks for
   the rest. What a document gives is its words in the chosen blocks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom import session
from spanloom.llm.common import WORD, small_or_not, word_count

WEIGHTS = (5.0, 2.0, 1.0)  # repeating over the sources in order
SHARE = 1.0  # the mix in proportion to all words
CAP = 3  # no source or document is taken more often than this
BLOCK = 16  # words
SHARD_DOCS = 2048
STEPS = (2_147_483_647, 2_147_483_629, 2_147_483_587)  # fixed values: primes


def sainte_lague(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats by highest quotients w / 1, w / 3, w / 5 ...; ties go to the earlier party."""
    weights = np.asarray(weights, float)
    if seats <= 0 or weights.sum() <= 0:
        return np.zeros(len(weights), np.int64)
    # The seats of a divisor that gives slightly too few, then the rest one by one.
    scaled = weights / weights.sum()
    low, high = 0.0, 2.0 * (seats + len(weights) + 1)
    while high - low > 1e-12 * high:
        mid = (low + high) / 2
        low, high = (mid, high) if np.floor(scaled * mid + 0.5).sum() <= seats else (low, mid)
    out = np.floor(scaled * low * (1 - 1e-9) + 0.5).astype(np.int64)
    next_up = [(-w / (2 * s + 1), i) for i, (w, s) in enumerate(zip(weights.tolist(), out.tolist())) if w > 0]
    heapq.heapify(next_up)
    for _ in range(seats - int(out.sum())):
        i = next_up[0][1]
        out[i] += 1
        heapq.heapreplace(next_up, (-weights[i] / (2 * out[i] + 1), i))
    return out


def capped_targets(sizes: np.ndarray, weights: np.ndarray, total: float, cap: float) -> np.ndarray:
    """``total`` shared by weight, no share over ``cap`` times its size, the excess reshared by weight."""
    target, limit = np.zeros(len(sizes)), cap * sizes
    open_ = sizes > 0
    while open_.any():
        share = max(0.0, total - limit[~open_].sum()) * weights / weights[open_].sum()
        over = open_ & (share > limit)
        if not over.any():
            target[open_] = share[open_]
            break
        target[over] = limit[over]
        open_ &= ~over
    return target


def _source_key(source: Column) -> Column:
    """The source as a value without nulls."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source.cast("string")))


def _targets(weights: tuple, share: float, cap: float, block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # By code point, the missing source last.
        pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: (pdf.source_key.iloc[i] == "n", pdf.source_key.iloc[i]))]
        sizes = pdf.words.to_numpy(float)
        w = np.array([weights[i % len(weights)] for i in range(len(pdf))], float)
        target = capped_targets(sizes, w, share * sizes.sum(), cap)
        quota = sainte_lague(target, int(round(target.sum() / block)))
        return pd.DataFrame({"source_key": pdf.source_key.to_numpy(), "source_size": pdf.words.to_numpy(np.int64), "target": target, "blocks": quota})

    return run


def _shard_quotas(cap: int, block: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("shard")
        words = pdf.words.to_numpy(np.int64)
        quota = sainte_lague(words, int(pdf.blocks.iloc[0]))
        # Words that the cap allows; a shard's last block may be short.
        quota = np.minimum(quota, cap * -(-words // block))
        return pd.DataFrame({"source_key": pdf.source_key.to_numpy(), "shard": pdf.shard.to_numpy(np.int32), "shard_words": words, "quota": quota})

    return run


def mix(docs: DataFrame, keep: tuple = ("doc_id",), **options) -> DataFrame:
    """One row per row of ``docs``: its columns named in ``keep``, size, source_size, target, taken, passes, pieces.

    A text's size is its number of words; null has none. ``passes`` counts how
    often the whole document is taken, ``pieces`` lists (start, end) word ranges
    taken once more, ``taken`` is the words of both. Sources go by code point, the
    missing one last. Rows that share a doc_id or a text are separate rows of the
    mix; such rows that agree in everything are interchangeable. A source without
    words has target 0, and so has all in an empty table. Options are those of
    ``_chosen``.
    """
    return _chosen(docs, keep, **options).select(*keep, "size", "source_size", "target", "taken", "passes", "pieces")


def _chosen(
    docs: DataFrame, keep: tuple, seed: int = 1, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP,
    block: int = BLOCK, shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """The rows with what the mix takes of them, and how its blocks are ranked."""
    def measured(columns: tuple) -> DataFrame:
        place = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"), F.col("text"))
        return docs.select(
            *columns, word_count(F.col("text")).alias("size"), _source_key(F.col("source")).alias("source_key"), place.alias("_place")
        )

    narrow = session.stage(measured(("doc_id",)), "mix-sizes")
    sized = narrow if keep == ("doc_id",) else measured(keep)
    # One row per source: what the weights are set for.
    counts = session.stage(narrow.groupBy("source_key").agg(F.count("*").alias("docs"), F.sum("size").alias("words")), "mix-sources")
    sources = small_or_not(counts).select("source_key", "docs")
    shard = F.pmod("_place", F.expr(f"(docs + {shard_docs - 1}) div {shard_docs}")).cast("int")
    dealt = sized.join(sources, "source_key").withColumn("shard", shard).drop("docs")
    spread = narrow.join(sources, "source_key").withColumn("shard", shard)
    shards = session.stage(spread.groupBy("source_key", "shard").agg(F.sum("size").alias("words")), "mix-shards")
    targets = counts.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(
        _targets(weights, share, cap, block), "source_key string, source_size bigint, target double, blocks bigint"
    )
    targets = session.stage(targets, "mix-targets")
    quotas = (
        shards.join(targets.select("source_key", "blocks"), "source_key")
        .groupBy("source_key")
        .applyInPandas(_shard_quotas(cap, block), "source_key string, shard int, shard_words bigint, quota bigint")
        .join(targets.drop("blocks"), "source_key")
    )
    line = Window.partitionBy("source_key", "shard").orderBy("_place", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = dealt.join(session.stage(quotas, "mix-quotas"), ["source_key", "shard"]).withColumn(
        "_at", F.coalesce(F.sum("size").over(line), F.lit(0))
    )
    return _choose(laid, seed, block)


def _is_chosen(k: Column) -> Column:
    rank = F.pmod(k * F.pmod(F.col("_step"), F.col("_blocks")) + F.col("_turn"), F.col("_blocks"))
    return rank < F.col("_rest")


def _choose(laid: DataFrame, seed: int, block: int) -> DataFrame:
    """Blocks are ranked by an affine walk k -> (step k + turn) mod blocks; the lowest ranks are chosen."""
    key = F.xxhash64(F.lit(seed), "source_key", "shard")
    step = F.get(F.array(*map(F.lit, STEPS)), F.pmod(key, F.lit(len(STEPS))).cast("int"))
    blocks = F.greatest(F.expr(f"(shard_words + {block - 1}) div {block}"), F.lit(1))
    rows = laid.withColumns({"_blocks": blocks, "_step": step}).withColumns(
        {
            "passes": F.expr("quota div _blocks"),
            "_rest": F.expr("quota % _blocks"),
            "_turn": F.pmod(key, F.col("_blocks")),
        }
    )
    covered = F.when(
        F.col("size") > 0, F.sequence(F.expr(f"_at div {block}"), F.expr(f"(_at + size - 1) div {block}"))
    ).otherwise(F.array().cast("array<bigint>"))
    chosen = F.filter(covered, _is_chosen)
    pieces = F.transform(
        chosen,
        lambda k: F.struct(
            F.greatest(k * block - F.col("_at"), F.lit(0)).alias("start"),
            F.least((k + 1) * block - F.col("_at"), F.col("size")).alias("end"),
        ),
    )
    rows = rows.withColumn("pieces", pieces)
    extra = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda a, p: a + p["end"] - p["start"])
    return rows.withColumn("taken", F.col("passes") * F.col("size") + extra)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: whole texts as often as taken whole, and one row of the words taken once more.

    Columns are those of ``docs`` without any that bear a name of the mix; n_chars,
    where there is one, follows the text.
    A document the mix takes nothing of has no row.
    """
    docs = docs.drop("size", "source_key", "source_size", "target", "taken", "passes", "pieces", "shard", "shard_words", "quota")
    columns = docs.columns
    block = options.get("block", BLOCK)
    taken = _chosen(docs, tuple(columns), **options)
    # One pass over the words of a text, each asked for its block.
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    cut = F.array_join(F.filter(words, lambda w, i: _is_chosen(F.floor((F.col("_at") + i) / F.lit(block)))), " ")

    def version(text: Column, chars: Column) -> Column:
        return F.struct(text.alias("text"), chars.alias("n_chars"))

    counted = F.col("n_chars").cast("bigint") if "n_chars" in columns else F.lit(None).cast("bigint")
    whole = F.array_repeat(version(F.col("text"), counted), F.col("passes").cast("int"))
    part = F.transform(F.array(cut), lambda t: version(t, F.length(t).cast("bigint")))
    every = F.when(F.size("pieces") > 0, F.concat(whole, part)).otherwise(whole)
    out = taken.withColumn("_version", F.explode(every))
    given = {"text": F.col("_version.text")}
    if "n_chars" in columns:
        given["n_chars"] = F.col("_version.n_chars").cast(docs.schema["n_chars"].dataType)
    return out.select(*[given[c].alias(c) if c in given else c for c in columns])
