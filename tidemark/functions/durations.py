"""Durations as whole seconds, and the names of lagged columns."""

from __future__ import annotations

import re

#: Unit spellings and their seconds.
UNITS = {"d": 86400, "day": 86400, "days": 86400, "h": 3600, "hr": 3600, "hour": 3600, "hours": 3600, "min": 60, "minute": 60, "minutes": 60, "t": 60, "s": 1, "sec": 1, "second": 1, "seconds": 1}


def seconds(freq: str) -> int:
    """``1h``, ``15min``, ``1D`` or ``day`` in seconds."""
    found = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", str(freq))
    if not found or found[2].lower() not in UNITS:
        raise ValueError(f"Invalid frequency: {freq!r}")
    n = int(found[1] or 1) * UNITS[found[2].lower()]
    if n <= 0:
        raise ValueError(f"Invalid frequency: {freq!r}")
    return n


def lag_name(column: str, lag: int, step: int) -> str:
    """``price_d-1``: the largest unit that divides the shift, with the sign of looking back or ahead."""
    total = abs(lag * step)
    unit, size = next((u, s) for u, s in (("d", 86400), ("h", 3600), ("min", 60), ("s", 1)) if total % s == 0)
    return f"{column}_{unit}{'-' if lag >= 0 else '+'}{total // size}"
