"""Dates of archives as nanoseconds since 1970; None where the format has none or it is before."""

from __future__ import annotations

import re
from datetime import date

NS = 1_000_000_000
_EPOCH = date(1970, 1, 1).toordinal()


def civil(year: int, month: int, day: int, hour: int = 0, minute: int = 0, second: int = 0) -> int | None:
    """A day of 1 to 31 counts on from the first of its month, whatever the month's length; hours,
    minutes and seconds count on likewise."""
    if not (1970 <= year <= 9999 and 1 <= month <= 12 and 1 <= day <= 31):
        return None
    days = date(year, month, 1).toordinal() - _EPOCH + day - 1
    return (days * 86400 + hour * 3600 + minute * 60 + second) * NS


def unix(seconds: int) -> int:
    return seconds * NS


def unix_or_none(seconds: int) -> int | None:
    return seconds * NS if seconds > 0 else None


def dos(day: int, time: int) -> int | None:
    return civil((day >> 9) + 1980, (day >> 5) & 15, day & 31, time >> 11, (time >> 5) & 63, (time & 31) * 2)


def filetime(ticks: int) -> int | None:
    """Ticks of 100 ns since 1601."""
    out = (ticks - 116444736000000000) * 100
    return out if ticks and out >= 0 else None


def mac(seconds: int) -> int | None:
    """Seconds since 1904."""
    out = seconds - 2082844800
    return out * NS if out >= 0 else None


def iso8601(text: str, least: int) -> int | None:
    """yyyy-mm-ddThh:mm:ss and anything after, of at least least characters; the zone is ignored."""
    text = text.strip()
    m = re.match(r"(\d{4}).(\d\d).(\d\d).(\d\d).(\d\d).(\d\d)", text)
    return civil(*map(int, m.groups())) if m and len(text) >= least and m[0].isascii() else None
