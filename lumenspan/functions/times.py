"""Times as people and models write them."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

#: Smaller positive numbers are seconds or milliseconds by mistake.
LEAST_NS = 10**15
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}
_ISO = re.compile(r"^(\d{4}-\d{2}-\d{2})(?:[Tt ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,9})\d*)?(Z|z|[+-]\d{2}:\d{2}))?$")


def parse_time(text: str | int, now_ns: int) -> int:
    """Nanoseconds of ``now``, an age (``2h``), an RFC 3339 instant, a UTC date, or nanoseconds."""
    if isinstance(text, int):
        text = str(text)
    said = text.strip()
    if said.lower() == "now":
        return now_ns
    if m := re.fullmatch(r"(\d+)([smhdw])", said):
        return max(now_ns - int(m[1]) * UNITS[m[2]] * 10**9, 0)
    if said.isascii() and said.isdigit():
        value = int(said)
        if 0 < value < LEAST_NS:
            raise ValueError(f"{value} is too small for nanoseconds since 1970")
        return value
    if not (m := _ISO.match(said)):
        raise ValueError(f"{text!r} is not a time")
    day, clock, fraction, zone = m.groups()
    at = datetime.fromisoformat(f"{day}T{clock or '00:00:00'}").replace(tzinfo=timezone.utc)
    if zone and zone not in "Zz":
        sign = 1 if zone[0] == "+" else -1
        at -= sign * timedelta(hours=int(zone[1:3]), minutes=int(zone[4:6]))
    whole = int((at - datetime(1970, 1, 1, tzinfo=timezone.utc)).total_seconds())
    if whole < 0:
        raise ValueError(f"{text!r} is before 1970")
    return whole * 10**9 + int((fraction or "").ljust(9, "0"))
