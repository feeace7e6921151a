"""Provider model ids reduced to price-table keys."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom import model
from spanloom.functions.values import strip


def normalize(
    raw: Column,
    qualifiers: list[str] = model.VENDOR_QUALIFIERS,
    dotted: list[str] = model.DOTTED_VENDORS,
) -> Column:
    """Lowercase, qualifiers off, revision suffix off, dotted vendors off.

    Qualifiers repeat; each dotted vendor is taken off at most once, in order.
    """
    any_qualifier = "|".join(re.escape(q) for q in qualifiers)
    name = F.regexp_replace(F.lower(strip(raw)), f"^(?:{any_qualifier})+", "")
    name = F.substring_index(name, ":", 1)
    name = F.regexp_replace(name, r"-v[12]$", "")
    vendors = "".join(f"(?:{re.escape(v)})?" for v in dotted)
    return F.regexp_replace(name, f"^{vendors}", "")
