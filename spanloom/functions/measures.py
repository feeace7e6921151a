"""Time spans, token totals and percentages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_ms(started: Column, ended: Column) -> Column:
    """Whole milliseconds between two instants, through double seconds.

    The double path is visible in results: 1001 ms reads as 1000.
    """
    seconds = (F.unix_micros(ended) - F.unix_micros(started)) / F.lit(1000000.0)
    return (seconds * F.lit(1000.0)).cast("bigint")


def derived_latency(latency: Column, started: Column, ended: Column) -> Column:
    """The client's own measurement, else the span when it does not run backwards."""
    return F.coalesce(latency, F.when(ended >= started, span_ms(started, ended)))


def duration_ms(started: Column, ended: Column) -> Column:
    """Wall-clock duration, never negative, NULL while open."""
    return F.when(
        ended.isNotNull() & started.isNotNull(), F.greatest(F.lit(0), span_ms(started, ended))
    )


def total_tokens(prompt: Column, completion: Column) -> Column:
    zero = F.lit(0).cast("bigint")
    return F.coalesce(prompt, zero) + F.coalesce(completion, zero)


def round_half_up(x: Column) -> Column:
    """Halves go towards positive infinity."""
    return F.floor(x + F.lit(0.5))


def percent(part: Column, whole: Column) -> Column:
    """Whole percentage; zero when there is nothing to divide."""
    share = F.try_divide(part.cast("double"), whole.cast("double")) * F.lit(100.0)
    return F.when((whole != 0) & (part > 0), round_half_up(share)).otherwise(F.lit(0)).cast("bigint")
