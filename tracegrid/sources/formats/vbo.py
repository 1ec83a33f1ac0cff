"""Text recordings in sections: header, channel units, column names, data."""

from __future__ import annotations

import numpy as np

from tracegrid.model import DECLARED, SPEC_DEFAULT, UNKNOWN
from tracegrid.sources.formats.common import Channel, Chunk, FormatError, Recording, Wanted, wants

#: Fixed values of the format: the short names of the built-in columns, in order, with long name and unit.
BUILT_IN = (
    ("sats", "satellites", ""), ("time", "time", "s"), ("lat", "latitude", "min"), ("long", "longitude", "min"), ("velocity", "velocity kmh", "km/h"), ("heading", "heading", "deg"),
    ("height", "height", "m"), ("vert-vel", "vertical velocity m/s", "m/s"), ("Tsample", "sampleperiod", "s"), ("solution_type", "solution type", ""), ("avifileindex", "avifileindex", ""), ("avitime", "avisynctime", ""),
)
_UNITS = {short.lower(): unit for short, _, unit in BUILT_IN if unit}
_DAY_S, _HALF_DAY_S = 86_400.0, 43_200.0


def _sections(text: str) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    name = None
    for line in text.splitlines():
        line = line.strip()
        if line.startswith("[") and line.endswith("]"):
            name = line[1:-1].strip().lower()
            out.setdefault(name, [])
        elif line and name is not None:
            out[name].append(line)
    return out


def _float(token: str) -> float:
    try:
        return float(token)
    except ValueError:
        return float("nan")


def _seconds(hms: np.ndarray) -> np.ndarray:
    """Seconds of the day of numbers HHMMSS.sss."""
    return np.floor(hms / 10_000) * 3600 + np.floor(hms / 100) % 100 * 60 + hms % 100


def _column(rows: list[list[str]], j: int) -> np.ndarray:
    """Column j of the data rows; NaN for a missing or unreadable token."""
    tokens = [t[j] if j < len(t) else "nan" for t in rows]
    try:
        return np.array(tokens, dtype=np.float64)
    except ValueError:
        return np.array([_float(t) for t in tokens])


def decode(raw: bytes, values: Wanted = True) -> Recording:
    """Every column of the data section as a float64 channel on the file's own, possibly uneven, clock.

    A missing or unreadable token is NaN; rows of fewer than two tokens are no rows.
    The time column counts seconds from the first row and passes midnight.  Columns
    whose values are not wanted are not read, but for the two that tell the clock.
    """
    raw = bytes(raw)
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        text = raw.decode("latin-1")
    part = _sections(text)
    short = part.get("column names", [""])[0].split() if part.get("column names") else []
    if not short:
        raise FormatError("no column names")
    rows = [t for t in (line.split() for line in part.get("data", [])) if len(t) >= 2]
    if not rows:
        raise FormatError("no data rows")
    lower = [s.lower() for s in short]
    if "time" not in lower:
        raise FormatError("no time column")
    clock = _seconds(_column(rows, lower.index("time")))
    if np.isnan(clock).any():
        raise FormatError("a row without time")
    clock = np.where(clock < clock[0] - _HALF_DAY_S, clock + _DAY_S, clock)
    elapsed = clock - clock[0]
    times = np.round(np.maximum(elapsed, 0) * 1e9).astype(np.int64)
    period = 0.1
    steps = np.diff(times)
    if (steps > 0).any():
        period = steps[steps > 0][0] / 1e9
    told = _column(rows, lower.index("tsample")) if "tsample" in lower else np.zeros(0)
    if (told > 0).any():
        period = told[told > 0][0]
    period_ns = int(round(period * 1e9))
    header, custom = part.get("header", []), part.get("channel units", [])
    channels = []
    for j, name in enumerate(short):
        title = header[j] if j < len(header) else BUILT_IN[j][1] if j < len(BUILT_IN) else name
        unit, source = "", UNKNOWN
        if lower[j] in _UNITS:
            unit, source = _UNITS[lower[j]], SPEC_DEFAULT
        elif j >= len(BUILT_IN) and j - len(BUILT_IN) < len(custom) and custom[j - len(BUILT_IN)] not in ("", "(null)"):
            unit, source = custom[j - len(BUILT_IN)], DECLARED
        chunk = Chunk(period_ns, len(rows), 0, 0, 0)
        x = None
        if wants(values, title):
            x = elapsed if lower[j] == "time" else _column(rows, j)
        channels.append(Channel(j, title, unit, source, 7, [chunk], times, x))
    return Recording("vbo", channels, clock="time_of_day", start_ns=int(round(clock[0] * 1e9)), session_hint="vbo:time_of_day")


def encode(channels: list[Channel], start: str = "000000.000") -> bytes:
    """A file with the given channels as custom columns; all share the times of the first."""
    t = channels[0].time_ns()
    base = int(float(start) // 10_000) * 3600 + int(float(start) // 100) % 100 * 60 + float(start) % 100

    def stamp(ns: int) -> str:
        s = (base + ns / 1e9) % _DAY_S
        return f"{int(s // 3600):02d}{int(s // 60) % 60:02d}{s % 60:012.9f}"

    names = [c.name.replace(" ", "_") for c in channels]
    lines = ["[channel units]", *(c.unit or "(null)" for c in channels), "[column names]", " ".join([b[0] for b in BUILT_IN] + names), "[data]"]
    for i, ns in enumerate(t):
        head = ["0", stamp(int(ns)), *["0"] * (len(BUILT_IN) - 2)]
        lines.append(" ".join(head + [repr(float(c.values[i])) for c in channels]))
    return "\n".join(lines).encode()
