"""Which files a pattern names, and which decoder reads them."""

from __future__ import annotations

import glob
import os
import re
from datetime import datetime, timezone

FORMATS = {"pds": "pds", "ld": "motec", "vbo": "vbo", "mp4": "aimd"}


def _braces(pattern: str) -> list[str]:
    m = re.search(r"\{([^{}]*)\}", pattern)
    if not m:
        return [pattern]
    return [y for x in m[1].split(",") for y in _braces(pattern[: m.start()] + x + pattern[m.end() :])]


def format_of(path: str) -> str | None:
    return FORMATS.get(path.rsplit(".", 1)[-1].lower()) if "." in os.path.basename(path) else None


def created(path: str) -> datetime:
    """Creation time of a file, its last change where the file system keeps none."""
    s = os.stat(path)
    return datetime.fromtimestamp(getattr(s, "st_birthtime", s.st_mtime), timezone.utc)


def modified(path: str) -> datetime:
    return datetime.fromtimestamp(os.stat(path).st_mtime, timezone.utc)


def parse_stamp(text: str) -> datetime:
    """A bound in RFC 3339, ``Y-m-d H:M:S[.f]`` or ``Y-m-d``; without offset it is UTC."""
    try:
        t = datetime.fromisoformat(text.strip().replace("Z", "+00:00"))
    except ValueError:
        raise ValueError(f"cannot read the time {text!r}") from None
    return t if t.tzinfo else t.replace(tzinfo=timezone.utc)


def find_files(pattern: str, only: str | None = None, created_from: str | None = None, created_to: str | None = None) -> list[str]:
    """Sorted files of a path, wildcard pattern (``*``, ``?``, ``[]``, ``**``) or brace list.

    A wildcard skips unknown extensions; ``only`` keeps one format; creation times
    are compared, from inclusive and to exclusive, before any file is opened.  No
    file left is an error.
    """
    bounds = [parse_stamp(x) if x else None for x in (created_from, created_to)]
    if bounds[0] and bounds[1] and bounds[1] < bounds[0]:
        raise ValueError("created_to lies before created_from")
    found: set[str] = set()
    for p in _braces(pattern):
        if glob.has_magic(p):
            found.update(f for f in glob.glob(p, recursive=True) if os.path.isfile(f) and format_of(f))
        elif os.path.isdir(p):
            found.update(os.path.join(p, f) for f in os.listdir(p) if format_of(f))
        elif os.path.isfile(p):
            if not format_of(p):
                raise ValueError(f"{p}: no known format")
            found.add(p)
    if not found:
        raise ValueError(f"no file matches {pattern!r}")
    kept = [f for f in sorted(found) if (only is None or format_of(f) == only) and (not bounds[0] or created(f) >= bounds[0]) and (not bounds[1] or created(f) < bounds[1])]
    if not kept:
        raise ValueError(f"no file of {pattern!r} is left after the filters")
    return kept
