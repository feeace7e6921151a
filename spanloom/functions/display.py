"""Text forms of ids, tokens, costs, durations, ages, scores and metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import model
from spanloom.functions import measures, values

DASH = "—"


def plain_decimal(x: Column) -> Column:
    """Decimal without exponent."""
    return x.cast("string")


def short_id(x: Column) -> Column:
    return F.substring(x, 1, 8)


def tokens(x: Column) -> Column:
    return F.format_number(x, 0)


def _trim_zeros(x: Column) -> Column:
    return F.regexp_replace(x, r"\.?0+$", "")


def cost(x: Column) -> Column:
    """Four significant digits below a cent, four places below one, else two."""
    d = x.cast(model.COST)
    significant = F.when(d >= F.lit("0.001").cast(model.COST), F.round(d, 6).cast("string")).when(
        d >= F.lit("0.0001").cast(model.COST), F.round(d, 7).cast("string")
    ).otherwise(d.cast("string"))
    exponent = F.when(d >= F.lit("0.0000001").cast(model.COST), F.lit(7)).otherwise(F.lit(8))
    mantissa = F.when(exponent == 7, d * F.lit(10_000_000)).otherwise(d * F.lit(100_000_000))
    tiny = F.concat(mantissa.cast("decimal(5,3)").cast("string"), F.lit("e-"), exponent.cast("string"))
    body = (
        F.when(d == 0, F.lit("0"))
        .when(d < F.lit("0.000001").cast(model.COST), tiny)
        .when(d < F.lit("0.01").cast(model.COST), _trim_zeros(significant))
        .when(d < 1, F.round(d, 4).cast("decimal(18,4)").cast("string"))
        .otherwise(F.round(d, 2).cast("decimal(18,2)").cast("string"))
    )
    return F.when(d.isNull(), F.lit(DASH)).otherwise(F.concat(F.lit("$"), body))


def _seconds_two_places(ms: Column) -> Column:
    """ms/1000 to two places, by the binary value of the quotient.

    A last digit of five is a tie only on paper: the quotient's double lies
    just above or below it. Splitting the double into two halves makes the
    difference exact, and its sign picks the side.
    """
    x = ms.cast("double") / F.lit(1000.0)
    wide = x * F.lit(134217729.0)
    high = wide - (wide - x)
    low = x - high
    above = (high * F.lit(125.0) - ms.cast("double") / F.lit(8.0)) + low * F.lit(125.0)
    down = F.floor(ms / F.lit(10))
    hundredths = F.when(F.pmod(ms, F.lit(10)) < 5, down).when(
        (F.pmod(ms, F.lit(10)) == 5) & (above < 0), down
    ).otherwise(down + 1)
    return (hundredths.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(
        "decimal(12,2)"
    ).cast("string")


def duration(ms: Column) -> Column:
    minutes = F.floor(ms / F.lit(60000))
    rest = measures.round_half_up(F.pmod(ms, F.lit(60000)) / F.lit(1000))
    return (
        F.when(ms.isNull(), F.lit(DASH))
        .when(ms < 1000, F.concat(F.format_number(ms, 0), F.lit("ms")))
        .when(ms < 60000, F.concat(_seconds_two_places(ms.cast("bigint")), F.lit("s")))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m "), rest.cast("string"), F.lit("s")))
    )


def relative_age(at: Column, as_of: Column) -> Column:
    elapsed = F.unix_millis(as_of) - F.unix_millis(at)
    s = measures.round_half_up(elapsed / F.lit(1000))
    m = measures.round_half_up(s / F.lit(60))
    h = measures.round_half_up(m / F.lit(60))
    d = measures.round_half_up(h / F.lit(24))

    def ago(x: Column, unit: str) -> Column:
        return F.concat(x.cast("string"), F.lit(f"{unit} ago"))

    return (
        F.when(elapsed.isNull(), F.lit(DASH))
        .when(s < 0, F.lit("just now"))
        .when(s < 60, ago(s, "s"))
        .when(m < 60, ago(m, "m"))
        .when(h < 24, ago(h, "h"))
        .otherwise(ago(d, "d"))
    )


def percent(part: Column, whole: Column) -> Column:
    return F.concat(measures.percent(part, whole).cast("string"), F.lit("%"))


def score(data_type: Column, value: Column, label: Column) -> Column:
    plain = F.when(value == 0, F.lit("0")).otherwise(
        F.regexp_replace(value.cast(model.SCORE).cast("string"), r"\.?0+$", "")
    )
    return (
        F.when(data_type == "categorical", F.coalesce(label, F.lit(DASH)))
        .when(value.isNull(), F.lit(DASH))
        .when(data_type == "boolean", F.when(value >= 1, "yes").otherwise("no"))
        .otherwise(plain)
    )


def score_is_negative(data_type: Column, value: Column) -> Column:
    said_no = (data_type == "boolean") & (value < 1)
    return F.coalesce(said_no | ((data_type == "numeric") & (value < 0)), F.lit(False))


def is_error(level: Column) -> Column:
    return F.coalesce(F.lower(level).isin(model.ERROR_LEVELS), F.lit(False))


def ordered_metadata(metadata: Column) -> Column:
    """Entries with the leading keys first in their fixed order, the rest by key."""
    leading = F.array(*[F.lit(k) for k in model.LEADING_METADATA])
    entries = F.transform(
        F.map_keys(metadata),
        lambda k: F.struct(
            F.coalesce(F.nullif(F.array_position(leading, k), F.lit(0)), F.lit(10**6)).alias("rank"),
            k.alias("key"),
        ),
    )
    return F.transform(
        F.array_sort(entries),
        lambda e: F.struct(
            e["key"].alias("key"),
            metadata_value(e["key"], F.element_at(metadata, e["key"])).alias("value"),
        ),
    )


def metadata_value(key: Column, v: Column) -> Column:
    number = F.try_variant_get(v, "$", "double")
    whole = measures.round_half_up(number).cast("bigint")
    in_ms = F.when(F.abs(number) < 1000, duration(whole)).otherwise(duration(number.cast("bigint")))
    strings = F.try_variant_get(v, "$", "array<variant>")
    return (
        F.when(values.is_null(values.kind(v)), F.lit(DASH))
        .when(values.is_number(values.kind(v)) & F.endswith(key, F.lit("_ms")), in_ms)
        .when(values.is_text(values.kind(v)), F.try_variant_get(v, "$", "string"))
        .when(
            strings.isNotNull() & F.forall(strings, lambda x: values.is_text(values.kind(x))),
            F.array_join(F.transform(strings, lambda x: x.try_cast("string")), ", "),
        )
        .otherwise(F.to_json(v))
    )


def payload(v: Column) -> Column:
    """Strings as they are, anything else as JSON."""
    return F.when(values.is_text(values.kind(v)), F.try_variant_get(v, "$", "string")).when(
        ~values.is_null(values.kind(v)), F.to_json(v)
    )


def finish_reason(metadata: Column) -> Column:
    reason = F.try_element_at(metadata, F.lit("finish_reason"))
    return values.as_string(reason, values.kind(reason))


def partition_name(day: Column) -> Column:
    return F.concat(F.lit("p"), F.date_format(day, "yyyyMMdd"))


def iso(ts: Column) -> Column:
    """UTC ISO text; the fraction appears only when there is one."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.when(
        F.pmod(F.unix_micros(ts), F.lit(1000000)) != 0, F.date_format(ts, ".SSSSSS")
    ).otherwise("")
    return F.concat(whole, fraction, F.lit("+00:00"))
