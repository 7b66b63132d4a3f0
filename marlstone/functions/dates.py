"""Dates as milliseconds since 1970 in UTC."""

from __future__ import annotations

import datetime as dt
import re
import time

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2})(?::(\d{2})(?:\.(\d+))?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
_DAY = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def parse_date(text: str) -> int:
    """Milliseconds of an ISO-8601 date or time (UTC unless it names an offset); ValueError if it isn't one."""
    m = re.match(_FORM, text.strip())
    if not m:
        raise ValueError(f"not a date: {text!r}")
    day, minute, second, fraction, zone = m.groups()
    at = dt.datetime.fromisoformat(f"{day}T{minute or '00:00'}:{second or '00'}").replace(tzinfo=dt.timezone.utc)
    ms = round((at - _DAY).total_seconds()) * 1000 + int(((fraction or "") + "000")[:3])
    if zone and zone != "Z":
        hours, minutes = int(zone[1:3]), int(zone[-2:])
        if hours > 23 or minutes > 59:
            raise ValueError(f"not an offset: {zone}")
        ms -= (1 if zone[0] == "+" else -1) * (hours * 60 + minutes) * 60_000
    return ms


def format_date(ms: int) -> str:
    at = _DAY + dt.timedelta(milliseconds=ms)
    return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"


def to_ms(value) -> int:
    """Milliseconds of a number, a text, or anything like a date or datetime; a naive one is in UTC."""
    if isinstance(value, bool):
        raise TypeError("a truth value is no date")
    if isinstance(value, str):
        return parse_date(value)
    if hasattr(value, "to_pydatetime"):
        value = value.to_pydatetime()
    if hasattr(value, "astype") and not isinstance(value, (int, float)) and getattr(value, "dtype", None) is not None and value.dtype.kind == "M":
        return int(value.astype("datetime64[ms]").astype("int64"))
    if isinstance(value, dt.datetime):
        value = value if value.tzinfo else value.replace(tzinfo=dt.timezone.utc)
        return (value - _DAY) // dt.timedelta(milliseconds=1)
    if isinstance(value, dt.date):
        return (value - _DAY.date()).days * 86_400_000
    return int(value)


def date_ms(text: Column) -> Column:
    """parse_date() of a column; null where the text isn't a date. The session's time zone doesn't matter."""
    part = lambda k: F.regexp_extract(F.trim(text), _FORM, k)
    filled = lambda k, other: F.when(part(k) == "", F.lit(other)).otherwise(part(k))
    day = F.try_to_date(F.nullif(part(1), F.lit("")), "yyyy-MM-dd")
    hour, minute = F.substring(filled(2, "00:00"), 1, 2).cast("long"), F.substring(filled(2, "00:00"), 4, 2).cast("long")
    second = filled(3, "00").cast("long")
    fraction = F.substring(F.concat(part(4), F.lit("000")), 1, 3).cast("long")
    zone = part(5)
    offset = F.when((zone == "") | (zone == "Z"), F.lit(0)).otherwise(F.substring(zone, 2, 2).cast("int") * 60 + F.substring(zone, -2, 2).cast("int"))
    offset = F.when(F.substring(zone, 1, 1) == "-", -offset).otherwise(offset)
    ms = F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * 86_400_000 + hour * 3_600_000 + minute * 60_000 + second * 1000 + fraction - offset.cast("long") * 60_000
    return F.when(text.rlike(_FORM) & (hour < 24) & (minute < 60) & (second < 60), ms)


def date_text(ms: Column) -> Column:
    """format_date() of a column; needs a session in UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
