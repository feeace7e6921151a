"""Typing of VARIANT members: presence, text, counts, ids, instants.

Each function takes the value and, where the JSON type matters, its kind as
computed once by :func:`kind`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import model


def member(doc: Column, key: str) -> Column:
    """The member under ``key``: SQL NULL when absent, variant null when null."""
    return F.try_variant_get(doc, f'$["{key}"]', "variant")


def members(doc: Column, keys: list[str]) -> Column:
    """Several members at once as a struct of variants; NULL unless an object."""
    wanted = ", ".join(f"`{k}`: variant" for k in keys)
    return doc.try_cast(f"struct<{wanted}>")


def first_present(picked: Column, keys: list[str]) -> Column:
    """First key that is present, even when it holds null.

    An explicit null is a non-NULL variant, so ``coalesce`` stops at it.
    """
    return F.coalesce(*[picked.getField(k) for k in keys])


def listed(v: Column) -> Column:
    """List members, NULL when the value is no list."""
    return F.try_variant_get(v, "$", "array<variant>")


def no_items() -> Column:
    return F.array().cast("array<variant>")


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_text(k: Column) -> Column:
    return k == "STRING"


def is_number(k: Column) -> Column:
    return k.isin("BIGINT", "DOUBLE") | k.startswith("DECIMAL")


def is_null(k: Column) -> Column:
    """Absent or explicit null."""
    return k.isNull() | (k == "VOID")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def as_string(v: Column, k: Column) -> Column:
    return F.when(is_text(k), F.try_variant_get(v, "$", "string"))


def as_double(v: Column) -> Column:
    return F.try_variant_get(v, "$", "double")


def text(v: Column, k: Column, clip: int | None = None) -> Column:
    """Clipped to a width first, stripped second."""
    raw = as_string(v, k)
    return strip(F.substring(raw, 1, clip) if clip else raw)


def version_text(v: Column, k: Column) -> Column:
    """Prompt versions: numbers become text, fractions keep their point."""
    return (
        F.when(k == "BIGINT", F.try_variant_get(v, "$", "string"))
        .when(is_number(k), as_double(v).cast("string"))
        .otherwise(text(v, k, model.CLIP_PROMPT_VERSION))
    )


def count(v: Column, k: Column) -> Column:
    """Numbers round half-even and clamp at zero; digits and booleans convert."""
    digits = F.regexp_extract(as_string(v, k), r"^\s*([+-]?\d+)(?:\.0+)?\s*$", 1)
    return (
        F.when(is_number(k), F.greatest(F.lit(0), F.bround(as_double(v), 0).try_cast("bigint")))
        .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("bigint"))
        .when(is_text(k), digits.try_cast("bigint"))
    )


_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_CANONICAL = _UUID[:-1] + r"\z"
_PACKED = r"^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$"
_DRESSED = r"^(?:urn:uuid:|\{)?([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\}?$"


def canonical_uuid(hexdigits: Column) -> Column:
    """32 hex digits to the hyphenated form."""
    return F.regexp_replace(hexdigits, _PACKED, "$1-$2-$3-$4-$5")


def uuid(v: Column, k: Column) -> Column:
    """Hyphenated, packed, braced and URN spellings, in lowercase canonical form."""
    raw = as_string(v, k)
    low = F.lower(raw)
    shaped = F.regexp_replace(F.regexp_replace(low, _DRESSED, "$1"), _PACKED, "$1-$2-$3-$4-$5")
    # Most ids come in canonical form, and one pattern tells that.
    return F.when(raw.rlike(_CANONICAL), raw).otherwise(F.regexp_substr(shaped, F.lit(_UUID)))


# Fixed value: numbers beyond this many seconds are read as milliseconds.
_SECONDS_LIMIT = 2e10
_DAY = r"\d{4}-\d{2}-\d{2}"
_CLOCK = r"\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?"
_ZONE = r"(?:[Zz]|[+-]\d{2}(?::?\d{2})?)"
_ISO = rf"^{_DAY}(?:[Tt _]{_CLOCK} ?{_ZONE}?)?$"


def instant(v: Column, k: Column) -> Column:
    """ISO text or a unix number; a text without offset is UTC."""
    raw = F.trim(as_string(v, k))
    iso = F.regexp_substr(raw, F.lit(_ISO))
    with_seconds = F.regexp_replace(
        F.translate(iso, "tz_,", "TZ ."), r"([T ]\d{2}:\d{2})(?=$|[Z+ -])", "$1:00"
    )
    shaped = F.regexp_replace(with_seconds, r"(:\d{2}(?:\.\d+)? ?[+-]\d{2})$", "$1:00")
    number = F.when(is_number(k), as_double(v)).otherwise(
        F.regexp_substr(raw, F.lit(r"^[+-]?\d+(\.\d+)?$")).try_cast("double")
    )
    micros = number * F.when(F.abs(number) > _SECONDS_LIMIT, F.lit(1e3)).otherwise(F.lit(1e6))
    return F.coalesce(
        shaped.try_cast("timestamp"), F.timestamp_micros(F.round(micros).try_cast("bigint"))
    )


def document(v: Column) -> Column:
    """Object to key/value map; absent means empty."""
    return F.when(v.isNull(), F.from_json(F.lit("{}"), model.DOC)).otherwise(v.try_cast(model.DOC))


def payload(v: Column) -> Column:
    """Any JSON value; a JSON null is no value."""
    return F.when(v.isNotNull() & ~F.is_variant_null(v), v)


def tags(v: Column, k: Column) -> Column:
    """Distinct, non-empty, bounded strings in first-seen order."""
    given = F.coalesce(listed(v), F.when(is_text(k), F.array(v)), no_items())
    texts = F.transform(given, lambda x: as_string(x, kind(x)))
    cut = F.transform(texts, lambda x: F.substring(strip(x), 1, model.MAX_TAG_CHARS))
    kept = F.array_distinct(F.filter(cut, lambda x: x.isNotNull() & (x != "")))
    return F.transform(F.slice(kept, 1, model.MAX_TAGS), strip)


def score_type(k: Column) -> Column:
    return (
        F.when(k == "BOOLEAN", "boolean")
        .when(is_number(k), "numeric")
        .when(is_text(k), "categorical")
    )


def score_number(v: Column, k: Column) -> Column:
    return F.when(
        k == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast(model.SCORE)
    ).when(is_number(k), as_double(v).try_cast(model.SCORE))


def score_label(v: Column, k: Column) -> Column:
    return F.substring(text(v, k), 1, model.CLIP_SCORE_LABEL)
