"""Binary recordings with a linked list of channel blocks: reader and lossless writer."""

from __future__ import annotations

import calendar
import re
import struct
from dataclasses import dataclass

import numpy as np

from tracegrid.model import DECLARED, STORAGE, UNKNOWN
from tracegrid.sources.formats.common import Channel, Chunk, FormatError, Recording, Wanted, latin1, wants

# Fixed values of the format: offsets, sizes and codes.
MAGIC, LEAST, BLOCK, MOST_CHANNELS = 0x40, 0x1A0, 124, 4096
FIRST_CHANNEL_AT, FIRST_DATA_AT, EVENT_AT = 0x08, 0x0C, 0x24
TEXTS = {"date": (0x5E, 16), "time": (0x7E, 16), "driver": (0x9E, 64), "vehicle": (0xDE, 64), "venue": (0x15E, 64)}
EVENT_TEXTS = {"event": (0, 64), "session": (64, 64), "comment": (128, 1024)}
FIRST_BLOCK_AT, EVENT_SIZE = 0x200, 1154
#: (data type, width) as written for each storage type; narrower integers are widened.
WRITTEN = {1: (3, 2, "<i2"), 2: (3, 2, "<i2"), 3: (5, 4, "<i4"), 4: (5, 4, "<i4"), 5: (8, 8, "<f8"), 6: (7, 4, "<f4"), 7: (8, 8, "<f8")}


def absolute_start_ns(date: str, time: str) -> int | None:
    """UTC nanoseconds of dd/mm/yyyy and hh:mm:ss; None if either says nothing."""
    d, t = re.fullmatch(r"(\d{1,2})/(\d{1,2})/(\d{4})", date.strip()), re.fullmatch(r"(\d{1,2}):(\d{2}):(\d{2})(?:\.(\d{1,9}))?", time.strip())
    if not d or not t:
        return None
    day, month, year = (int(x) for x in d.groups())
    if not (1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    s = calendar.timegm((year, month, day, int(t[1]), int(t[2]), int(t[3])))
    return s * 1_000_000_000 + int((t[4] or "0").ljust(9, "0"))


def _type_code(kind: int, width: int) -> int:
    if width == 8 and kind in (7, 8):
        return 7
    if kind == 7:
        return 6
    return {2: 2, 4: 4}.get(width, 6)


def decode(raw: bytes, values: Wanted = True) -> Recording:
    """Channels in list order; integers are scaled by the block's shift, multiplier, scale and decimals."""
    if len(raw) < LEAST or struct.unpack_from("<I", raw)[0] != MAGIC:
        raise FormatError("no recording of this format")
    rec = Recording("motec", [], **{k: latin1(raw[a : a + n]) for k, (a, n) in TEXTS.items()})
    event = struct.unpack_from("<I", raw, EVENT_AT)[0]
    if 0 < event < len(raw):
        rec.event, rec.session = (latin1(raw[event + a : event + a + n]) for a, n in (EVENT_TEXTS["event"], EVENT_TEXTS["session"]))
    at = struct.unpack_from("<I", raw, FIRST_CHANNEL_AT)[0]
    while at and at + BLOCK <= len(raw) and len(rec.channels) < MOST_CHANNELS:
        follow, data, count = struct.unpack_from("<III", raw, at + 4)
        kind, width, hz, shift, mul, scale, dec = struct.unpack_from("<HHHhhhh", raw, at + 0x12)
        name, unit = latin1(raw[at + 0x20 : at + 0x40]), latin1(raw[at + 0x48 : at + 0x54])
        if width in (2, 4, 8) and hz and name:
            count = min(count, max(0, (len(raw) - data) // width))
            code = _type_code(kind, width)
            c = Channel(len(rec.channels), name, unit, DECLARED if unit else UNKNOWN, code, [Chunk(1_000_000_000 // hz, count, data, 0, 0)] if count else [])
            if count and wants(values, name):
                x = np.frombuffer(raw, STORAGE[code][1], count, data).astype(np.float64)
                if code in (2, 4):
                    x = (x / (scale or 1) * 10.0 ** -dec + shift) * (mul or 1)
                c.values = x
            rec.channels.append(c)
        if follow <= at:
            break
        at = follow
    if not rec.channels:
        raise FormatError("no channels")
    rec.start_ns = absolute_start_ns(rec.date, rec.time)
    if rec.start_ns is not None:
        rec.clock, rec.session_hint = "utc", f"motec:{rec.date}:{rec.vehicle}:{rec.venue}".lower()
    return rec


@dataclass
class Identity:
    driver: str = ""
    vehicle: str = ""
    venue: str = ""
    event: str = ""
    session: str = ""
    comment: str = ""
    date: str = ""
    time: str = ""


def _text(value: str, capacity: int, what: str) -> bytes:
    try:
        raw = value.encode("latin-1")
    except UnicodeEncodeError:
        raise FormatError(f"{what} {value!r} has characters that the format lacks") from None
    if len(raw) >= capacity:
        raise FormatError(f"{what} {value!r} is longer than {capacity - 1} bytes")
    return raw.ljust(capacity, b"\0")


def _contiguous(c: Channel) -> tuple[int, int]:
    """(frequency, count) of a channel whose chunks follow each other on one whole-number clock."""
    periods = {k.period_ns for k in c.chunks}
    if len(periods) != 1 or 0 in periods:
        raise FormatError(f"{c.name}: chunks of different or no period")
    period = periods.pop()
    hz = round(1e9 / period)
    if hz < 1 or 1_000_000_000 // hz != period:
        raise FormatError(f"{c.name}: {1e9 / period:g} Hz is no whole number")
    if hz > 65_535:
        raise FormatError(f"{c.name}: {hz} Hz is too fast for the format")
    at = c.chunks[0].time_base_ns
    for k in c.chunks:
        if k.time_base_ns != at:
            raise FormatError(f"{c.name}: time between its chunks belongs to none")
        at += k.count * period
    if c.sample_count > 0xFFFFFFFF:
        raise FormatError(f"{c.name}: too many samples")
    return hz, c.sample_count


def encode(channels: list[Channel], who: Identity | None = None) -> bytes:
    """A file that gives back every value of the sampled channels bit by bit.

    What the format cannot hold (mixed, fractional or too fast clocks, gaps, long
    or foreign texts, too much data) raises ``FormatError``; nothing is narrowed.
    """
    who = who or Identity()
    channels = [c for c in channels if c.sample_count]
    if not channels:
        raise FormatError("nothing to write")
    clocks = [_contiguous(c) for c in channels]
    event_at = FIRST_BLOCK_AT
    first = event_at + EVENT_SIZE
    data = first + BLOCK * len(channels) + 0x40
    total = data + sum(n * WRITTEN[c.type_code][1] for c, (_, n) in zip(channels, clocks, strict=True))
    if total > 0xFFFFFFFF:
        raise FormatError("more than 4 GiB")
    out = bytearray(total)
    struct.pack_into("<I", out, 0, MAGIC)
    struct.pack_into("<II", out, FIRST_CHANNEL_AT, first, data)
    struct.pack_into("<I", out, EVENT_AT, event_at)
    for k, (a, n) in TEXTS.items():
        out[a : a + n] = _text(getattr(who, k), n, k)
    for k, (a, n) in EVENT_TEXTS.items():
        out[event_at + a : event_at + a + n] = _text(getattr(who, k), n, k)
    for i, (c, (hz, n)) in enumerate(zip(channels, clocks, strict=True)):
        at = first + i * BLOCK
        kind, width, dtype = WRITTEN[c.type_code]
        struct.pack_into("<IIII", out, at, at - BLOCK if i else 0, at + BLOCK if i + 1 < len(channels) else 0, data, n)
        struct.pack_into("<HHHHhhhh", out, at + 0x10, i, kind, width, hz, 0, 1, 1, 0)
        out[at + 0x20 : at + 0x40] = _text(c.name, 32, "channel name")
        out[at + 0x40 : at + 0x48] = c.name.encode("latin-1")[:7].ljust(8, b"\0")
        out[at + 0x48 : at + 0x54] = _text(c.unit, 12, "unit")
        body = np.asarray(c.values).astype(dtype).tobytes()
        out[data : data + len(body)] = body
        data += len(body)
    return bytes(out)
