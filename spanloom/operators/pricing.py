"""Model prices and frozen costs.

A price key claims a model id when it equals it or is a prefix of it that ends
before a dash; the longest key wins. Cutting the id at its dashes gives every
key that could claim it, so the prefix rule is a set of equality lookups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom import model, session
from spanloom.functions import model_ids

_RATES = ["input_usd_per_mtok", "output_usd_per_mtok", "cached_input_usd_per_mtok"]


def build_prices(listed: DataFrame, cache_factors: DataFrame | None = None) -> DataFrame:
    """Price table from stated rates; a vendor factor fills missing cached rates.

    ``cache_factors`` holds ``vendor, factor`` and needs ``vendor`` in ``listed``.
    """
    if cache_factors is None:
        return listed.select("model_key", *[F.col(r).cast(model.RATE).alias(r) for r in _RATES])
    filled = F.coalesce(
        "cached_input_usd_per_mtok", F.col("input_usd_per_mtok") * F.col("factor")
    )
    return (
        session.lookup_join(listed, cache_factors, ["vendor"], [F.col("model_key")])
        .withColumn("cached_input_usd_per_mtok", filled)
        .select("model_key", *[F.col(r).cast(model.RATE).alias(r) for r in _RATES])
    )


def _segments(key: Column) -> Column:
    return F.size(F.split(key, "-"))


def one_price_per_key(prices: DataFrame) -> DataFrame:
    """Prices with each key once; of repeated keys the one with the highest rates, input first, stays.

    A table without repeats, as it should be, is left as it is.
    """
    if prices.groupBy("model_key").count().filter("count > 1").limit(1).count() == 0:
        return prices
    best = F.max(F.struct(*[F.col(r) for r in _RATES]))
    once = prices.groupBy("model_key").agg(best.alias("_rates"))
    return session.cut_lineage(once.select("model_key", *[F.col("_rates")[r].alias(r) for r in _RATES]))


def attach_prices(
    observations: DataFrame,
    prices: DataFrame,
    bound: int = session.BROADCAST_ROW_BOUND,
    qualifiers: list[str] = model.VENDOR_QUALIFIERS,
) -> DataFrame:
    """Adds ``model_key`` of the claiming price (NULL if none) and its rates.

    A price table within the bound is broadcast once per number of dashes in
    its keys, so the observations are not shuffled. A larger one is resolved on
    the distinct model ids first.
    """
    named = observations.withColumn("model_norm", model_ids.normalize(F.col("model"), qualifiers))
    prices = one_price_per_key(prices)
    if not session.within(prices, bound):
        return _attach_by_distinct(named, prices)
    sized = prices.withColumn("segments", _segments(F.col("model_key")))
    lengths = [r.segments for r in sized.select("segments").distinct().orderBy("segments").collect()]
    best = F.lit(None)
    out = named
    for n in lengths:
        found = f"_price_{n}"
        side = sized.filter(F.col("segments") == n).select(
            F.col("model_key").alias(f"_cut_{n}"), F.struct("model_key", *_RATES).alias(found)
        )
        cut = F.when(
            _segments(F.col("model_norm")) >= n, F.substring_index("model_norm", "-", n)
        )
        out = out.withColumn("_cut", cut)
        out = out.join(F.broadcast(side), F.col("_cut") == F.col(f"_cut_{n}"), "left").drop(
            "_cut", f"_cut_{n}"
        )
        best = F.coalesce(F.col(found), best)
    if not lengths:
        return out.select("*", F.lit(None).cast("string").alias("model_key"),
                          *[F.lit(None).cast(model.RATE).alias(r) for r in _RATES])
    return (
        out.withColumn("_price", best)
        .select(*named.columns, *[F.col(f"_price.{c}").alias(c) for c in ("model_key", *_RATES)])
    )


def resolve_models(models: DataFrame, prices: DataFrame) -> DataFrame:
    """Distinct ``model_norm`` to the longest claiming price, without a size limit."""
    cuts = models.select("model_norm").distinct().select(
        "model_norm",
        F.explode(
            F.transform(
                F.sequence(F.lit(1), _segments(F.col("model_norm"))),
                lambda n: F.array_join(F.slice(F.split(F.col("model_norm"), "-"), F.lit(1), n), "-"),
            )
        ).alias("model_key"),
    )
    claims = cuts.join(prices.select("model_key", *_RATES), "model_key")
    best = F.max_by(F.struct("model_key", *_RATES), F.length("model_key"))
    return claims.groupBy("model_norm").agg(best.alias("p")).select("model_norm", "p.*")


def _attach_by_distinct(named: DataFrame, prices: DataFrame) -> DataFrame:
    known = resolve_models(named.filter(F.col("model_norm") != ""), prices)
    columns = named.columns
    # Salted by the row's plain values, so a repeated task salts alike.
    spread = [F.col(c) for c, t in named.dtypes if not t.startswith(("map", "variant", "array", "struct"))]
    joined = session.lookup_join(named, known, ["model_norm"], spread, bound=0)
    return joined.select(*columns, "model_key", *_RATES)


def cost_usd(prompt: Column, completion: Column, cached: Column) -> Column:
    """Cost in exact decimals, half-up at eight places; NULL means unknown."""
    whole = "decimal(10,0)"
    zero = F.lit(0).cast(whole)
    p = F.coalesce(prompt.cast(whole), zero)
    c = F.coalesce(completion.cast(whole), zero)
    hit = F.least(F.coalesce(cached.cast(whole), zero), p)
    rate_in, rate_out = F.col("input_usd_per_mtok"), F.col("output_usd_per_mtok")
    rate_hit = F.coalesce("cached_input_usd_per_mtok", rate_in)
    total = (p - hit) * rate_in + hit * rate_hit + c * rate_out
    per_token = F.lit("0.000001").cast("decimal(7,6)")
    known = rate_in.isNotNull() & (prompt.isNotNull() | completion.isNotNull())
    return F.when(known, F.round(total.cast("decimal(26,6)") * per_token, 8).cast(model.COST))


def price_observations(
    observations: DataFrame, prices: DataFrame, version: str | None = None, **options
) -> DataFrame:
    """Adds ``cost_usd`` and the version of the price table that produced it.

    Call it once, when observations are written: stored costs never follow
    later price edits.
    """
    priced = attach_prices(observations, prices, **options)
    cost = cost_usd(F.col("prompt_tokens"), F.col("completion_tokens"), F.col("cached_tokens"))
    return priced.withColumn("cost_usd", cost).select(
        *observations.columns, "cost_usd", F.lit(version).cast("string").alias("pricebook_version")
    )


def unpriced_models(observations: DataFrame, prices: DataFrame, **options) -> DataFrame:
    """Distinct normalised models no price claims, with how often they occur."""
    # Counting distinct ids first leaves little to resolve.
    counted = observations.filter(F.col("model").isNotNull()).groupBy("model").agg(
        F.count("*").alias("n")
    )
    return (
        attach_prices(counted, prices, **options)
        .filter(F.col("model_key").isNull() & (F.col("model_norm") != ""))
        .groupBy("model_norm")
        .agg(F.sum("n").alias("observations"))
    )


def price_rules() -> dict[str, Column]:
    """Hygiene of a price table, for :func:`admit.violations`."""
    key = F.col("model_key")
    rate_in, hit = F.col("input_usd_per_mtok"), F.col("cached_input_usd_per_mtok")
    return {
        "prices_positive": (rate_in > 0) & (F.col("output_usd_per_mtok") > 0),
        "key_normalised": (key != "") & (key == model_ids.normalize(key)),
        "cached_below_input": hit.isNull() | ((hit > 0) & (hit < rate_in)),
    }
