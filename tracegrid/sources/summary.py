"""What one decoded recording says of itself, and how recordings follow each other: the file and session rows without a cluster.

The SQL table functions and the inspector use this; ``sources.library`` has the
same rows as DataFrame plans.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from tracegrid.operators import events as ev
from tracegrid.operators.sessions import FNV_BASIS, FNV_PRIME, WEEK_MS
from tracegrid.sources.formats.common import Channel, Recording

SECOND = 1_000_000_000
#: Normalised channel names by meaning.
GPS_WEEK, GPS_ITOW = ("gpsweek",), ("gpsitow", "itow")
VIDEO_FILE, VIDEO_SYNC = ("avifileindex",), ("avisynctime", "avitime")
_ROLES = frozenset(n for names in (ev.DRIVER_NAMES, ev.LAP_NAMES, ev.TIMER_NAMES, ev.REFERENCE_NAMES, ev.REPORTED_NAMES, GPS_WEEK, GPS_ITOW, VIDEO_FILE, VIDEO_SYNC) for n in names)
FILE_ROW = (
    "file string, format string, session_key string, absolute_start_ns bigint, absolute_end_ns bigint, duration_ns bigint, channel_count bigint, sampled_channel_count bigint, sample_count bigint, schema_hash decimal(20,0), driver_ids string,"
    " lap_count bigint, fastest_lap_number bigint, fastest_lap_time_ns bigint, video_frame_count bigint, driver string, vehicle string, venue string, event string, session string, date string, time string, absolute_clock string"
)
SESSION_ROW = "session_key string, file_count bigint, absolute_start_ns bigint, absolute_end_ns bigint, duration_ns bigint, driver_ids string, stint_count bigint, lap_count bigint, fastest_lap_number bigint, fastest_lap_time_ns bigint"


def plain_name(name: str) -> str:
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def plays_a_role(name: str) -> bool:
    """Whether the summary needs the values of a channel."""
    return plain_name(name) in _ROLES


def named(rec: Recording, names: tuple[str, ...]) -> Channel | None:
    """The first sampled channel whose normalised name is one of ``names``."""
    return next((c for c in rec.channels if c.sample_count and plain_name(c.name) in names), None)


def readings(c: Channel | None) -> tuple[np.ndarray, np.ndarray]:
    """Times and values of the finite samples of a channel."""
    if c is None:
        return np.zeros(0, np.int64), np.zeros(0)
    x = np.asarray(c.values, float)
    ok = np.isfinite(x)
    return c.time_ns()[ok], x[ok]


def whole(x: np.ndarray) -> np.ndarray:
    """Nearest integers, halves away from zero."""
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(np.int64)


def runs(c: Channel | None) -> list[tuple[int, int, int]]:
    """(value, start_ns, end_ns): stretches of one rounded value."""
    t, x = readings(c)
    if not len(t):
        return []
    v = whole(x)
    at = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
    ends = np.r_[t[at[1:]], max(c.duration_ns, int(t[at[-1]]))]
    return [(int(a), int(b), int(e)) for a, b, e in zip(v[at], t[at], ends, strict=True)]


def stints(rec: Recording) -> list[tuple[int, int, int]]:
    r = runs(named(rec, ev.DRIVER_NAMES))
    return [(v, a, b) for v, a, b in r if v >= 0 and (len(r) == 1 or b - a >= SECOND)]


@dataclass
class Lap:
    number: int
    start_ns: int
    end_ns: int
    complete: bool

    @property
    def duration_ns(self) -> int:
        return self.end_ns - self.start_ns


def _at(c: Channel | None, time_ns: int) -> int | None:
    """The rounded value of a channel's last finite sample up to a time."""
    t, x = readings(c)
    k = np.searchsorted(t, time_ns, "right") - 1
    return int(whole(x[k : k + 1])[0]) if k >= 0 else None


def laps(rec: Recording) -> list[Lap]:
    """Between the falls of a running lap time if there are two, else the runs of a lap counter."""
    counter = named(rec, ev.LAP_NAMES)
    timer = named(rec, ev.TIMER_NAMES)
    t, x = readings(timer)
    falls = t[1:][(x[:-1] - x[1:]) > (5000 if len(x) and x.max() > 1000 else 5)]
    if len(falls) >= 2:
        bounds = [0, *falls.tolist(), timer.duration_ns]
        found = []
        for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            number = _at(counter, a)
            found.append(Lap(i + 1 if number is None else number, a, b, 0 < i < len(bounds) - 2))
        return [lap for lap in found if lap.number > 0]
    r = runs(counter)
    return [Lap(v, a, b, 0 < i < len(r) - 1) for i, (v, a, b) in enumerate(r) if v > 0]


def _lap_times(c: Channel | None) -> tuple[np.ndarray, np.ndarray]:
    """(times, lap times in ns) above 0 of a channel in ms or s."""
    t, x = readings(c)
    scale = 1e6 if len(x) and x.max() > 1000 else 1e9
    return t[x > 0], whole(x[x > 0] * scale)


def fastest(rec: Recording, found: list[Lap]) -> tuple[int, int] | None:
    """(number, duration_ns) of the shortest plausible lap; one that the logger reports outranks the rest."""
    reference = _lap_times(named(rec, ev.REFERENCE_NAMES))[1][:1].tolist()
    plausible = lambda d: d >= 10 * SECOND and (not reference or reference[0] // 2 <= d <= reference[0] * 3 // 2)
    told = [(int(d), int(t)) for t, d in zip(*_lap_times(named(rec, ev.REPORTED_NAMES)), strict=True) if plausible(int(d))]
    if told:
        d, t = min(told)
        number = _at(named(rec, ev.LAP_NAMES), t)
        return (0 if number is None else number - 1), d
    own = min(((lap.duration_ns, lap.start_ns, lap.number) for lap in found if lap.complete and plausible(lap.duration_ns)), default=None)
    return (own[2], own[0]) if own else None


def schema_hash(rec: Recording) -> int:
    """FNV-1a over name, unit (A to Z in lower case) and one byte of type code of each channel."""
    fold = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    h = FNV_BASIS
    for c in rec.channels:
        for b in (c.name + c.unit).translate(fold).encode() + bytes([c.type_code]):
            h = (h ^ b) * FNV_PRIME % 2**64
    return h


def clock(rec: Recording) -> tuple[int | None, str | None, str | None]:
    """(absolute start in ns, clock, key hint): as declared, else by GPS week and milliseconds, else none."""
    if rec.start_ns is not None:
        return rec.start_ns, rec.clock, rec.session_hint
    (_, week), (t, itow) = readings(named(rec, GPS_WEEK)), readings(named(rec, GPS_ITOW))
    if len(week) and len(itow):
        w = int(whole(week[:1])[0])
        return (w * WEEK_MS + int(whole(itow[:1])[0])) * 1_000_000 - int(t[0]), "gps", f"gps:{w}"
    return None, rec.clock, rec.session_hint


@dataclass
class FileSummary:
    path: str
    rec: Recording
    start: int | None = None
    end: int | None = None
    key: str | None = None
    row: tuple = ()
    stints: list = field(default_factory=list)
    laps: list = field(default_factory=list)
    best: tuple[int, int] | None = None


def summarise(path: str, rec: Recording) -> FileSummary:
    """The summary of one recording; ``row`` has the columns ``FILE_ROW``."""
    s = FileSummary(path, rec, stints=stints(rec), laps=laps(rec))
    s.best = fastest(rec, s.laps)
    s.start, kind, hint = clock(rec)
    h = schema_hash(rec)
    s.key = f"{hint}:{h:016x}" if hint else None
    s.end = None if s.start is None else s.start + rec.duration_ns
    sampled = [c for c in rec.channels if c.sample_count]
    ids = ",".join(str(v) for v in sorted({v for v, *_ in s.stints}))
    s.row = (
        path, rec.format, s.key, s.start, s.end, rec.duration_ns, len(rec.channels), len(sampled), sum(c.sample_count for c in sampled), h, ids, len(s.laps), *(s.best or (None, None)),
        None if rec.frames is None else len(rec.frames), rec.driver, rec.vehicle, rec.venue, rec.event, rec.session, rec.date, rec.time, kind,
    )
    return s


def _merged(parts: list[tuple[int, int, int]], gap: int) -> list[list[int]]:
    """Neighbouring (id, start, end) of one id joined where the gap is small enough."""
    out: list[list[int]] = []
    for v, a, b in sorted(parts, key=lambda p: p[1]):
        if out and out[-1][0] == v and a <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], b)
        else:
            out.append([v, a, b])
    return out


@dataclass
class Session:
    key: str
    files: list[FileSummary]
    row: tuple = ()

    @property
    def start(self) -> int | None:
        return min((f.start for f in self.files if f.start is not None), default=None)


def sessions(files: list[FileSummary], max_gap_seconds: int = 60) -> list[Session]:
    """Files of one continuous recording; ``row`` has the columns ``SESSION_ROW``."""
    if not 0 <= max_gap_seconds <= 86_400:
        raise ValueError("max_gap_seconds must be between 0 and 86400")
    gap = max_gap_seconds * SECOND
    groups: list[list[FileSummary]] = []
    for f in sorted(files, key=lambda f: (f.key is not None, f.key or "", f.start is not None, f.start or 0)):
        last = groups[-1][-1] if groups else None
        if last and f.key is not None and last.key == f.key and None not in (last.end, f.start) and f.start <= last.end + gap:
            groups[-1].append(f)
        else:
            groups.append([f])
    out = []
    for i, g in enumerate(groups):
        s = Session(f"{g[0].key or f'unkeyed:{i}'}:{i}", g)
        end = max((f.end for f in g if f.end is not None), default=None)
        placed = [f for f in g if f.start is not None]
        drivers = _merged([(v, f.start + a, f.start + b) for f in placed for v, a, b in f.stints], gap)
        merged = _merged([(lap.number, f.start + lap.start_ns, f.start + lap.end_ns) for f in placed for lap in f.laps], gap)
        told = min(((b - a, a, v) for v, a, b in merged[1:-1] if b - a >= 10 * SECOND), default=None)
        own = min(((f.best[1], k, f.best[0]) for k, f in enumerate(g) if f.best), default=None)
        best = (own[2], own[0]) if own else (told[2], told[0]) if told else (None, None)
        ids = ",".join(str(v) for v in sorted({v for f in g for v, *_ in f.stints}))
        s.row = (s.key, len(g), s.start, end, 0 if s.start is None else end - s.start, ids, len(drivers), len(merged), *best)
        out.append(s)
    return out
