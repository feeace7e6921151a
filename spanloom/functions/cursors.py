"""Opaque page cursors over the sort key (started_at, id)."""

from __future__ import annotations

import base64
import binascii
from datetime import datetime, timezone
from uuid import UUID

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.functions import display

# Fixed value: a cursor of another version must not be read as this one.
VERSION = "v1"


class BadCursor(ValueError):
    """The text is not a cursor issued for this ordering."""


def encode(started_at: Column, trace_id: Column) -> Column:
    raw = F.concat_ws("|", F.lit(VERSION), display.iso(started_at), trace_id)
    plain = F.regexp_replace(F.base64(raw.cast("binary")), r"[=\r\n]", "")
    return F.translate(plain, "+/", "-_")


def decode(cursor: str) -> tuple[datetime, str]:
    try:
        padding = -len(cursor) % 4
        raw = base64.b64decode(
            cursor.encode("ascii") + b"=" * padding, altchars=b"-_", validate=False
        ).decode("utf-8")
    except (binascii.Error, UnicodeError, ValueError) as exc:
        raise BadCursor("not base64url text") from exc
    fields = raw.split("|")
    if len(fields) != 3 or fields[0] != VERSION:
        raise BadCursor("wrong shape or version")
    try:
        at = datetime.fromisoformat(fields[1])
        trace_id = str(UUID(fields[2]))
    except ValueError as exc:
        raise BadCursor("unreadable sort key") from exc
    return (at if at.tzinfo else at.replace(tzinfo=timezone.utc)), trace_id
