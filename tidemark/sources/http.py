"""Plain requests over HTTP, the sources' default transports."""

from __future__ import annotations

import urllib.error
import urllib.parse
import urllib.request

TIMEOUT = 30


def get(url: str, query: dict) -> tuple[int, str]:
    """Status and body; values that are lists are joined by commas. Refusals have a body as well."""
    flat = {k: ",".join(map(str, v)) if isinstance(v, (list, tuple)) else str(v) for k, v in query.items()}
    try:
        with urllib.request.urlopen(f"{url}?{urllib.parse.urlencode(flat)}", timeout=TIMEOUT) as reply:
            return reply.status, reply.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
