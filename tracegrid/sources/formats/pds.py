"""Binary recordings with a directory, channel definitions, a chunk table and data."""

from __future__ import annotations

import struct

import numpy as np

from tracegrid.model import DECLARED, SPEC_DEFAULT, STORAGE, UNKNOWN
from tracegrid.sources.formats.common import Channel, Chunk, FormatError, Recording, Wanted, utf16, wants

# Fixed values of the format.
LEAST, ENTRY, ENTRIES, TICK_NS = 256, 32, 20, 100
STARTS = tuple(range(0x80, 0x3F, -8))
MARKER = 0x7C72
#: Quantity code -> SI unit in which the format stores it.
SI_UNITS = {1: "m", 2: "m^3", 3: "m/s", 4: "K", 6: "s", 7: "rad", 8: "rad/s", 9: "Pa", 10: "m/s^2", 11: "V", 12: "A", 13: "kg", 14: "N", 15: "N.m", 20: "s", 23: "rad/s^2"}
NO_UNIT = (0, 16)
#: Unit texts found with each quantity code.
ACCEPTED = {
    1: ("m", "mm", "cm", "km"),
    2: ("m^3", "l", "litre", "liter", "ml", "cc"),
    3: ("m/s", "km/h", "kph", "mph"),
    4: ("k", "c", "degc", "f"),
    6: ("s", "sec", "ms", "us", "min"),
    7: ("rad", "deg", "degree", "degrees"),
    8: ("rad/s", "rpm", "deg/s"),
    9: ("pa", "kpa", "bar", "mbar", "psi"),
    10: ("m/s^2", "m/s2", "g", "mps_2"),
    11: ("v", "mv", "volt", "volts"),
    12: ("a", "ma", "amp", "amps"),
    13: ("kg", "g", "lb"),
    14: ("n", "kn", "lbf"),
    15: ("nm", "n.m", "n-m", "lbft"),
    16: ("pp1", "%", "ratio"),
    20: ("s", "sec", "date", "time"),
    23: ("rad/s^2", "rad/s2", "deg/s^2"),
}
MARKERS = ("raw", "flag", "flags", "cnt", "count", "code", "pp1", "laps", "lambda", "bit", "bits", "state", "driver", "user defined", "defined", "none", "n/a")
DEFAULT_UNIT_AT = 0x90


def _directory(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(offset, count, class, next_count) of the entries at the likeliest start."""

    def entries(start: int) -> list[tuple[int, int, int, int]]:
        out = []
        for i in range(ENTRIES):
            at = start + i * ENTRY
            if at + ENTRY > len(raw):
                break
            offset, count = struct.unpack_from("<QI", raw, at)
            kind, follow = struct.unpack_from("<II", raw, at + 0x14)
            out.append((offset, count, kind, follow))
        return out

    def score(es: list[tuple[int, int, int, int]]) -> int:
        return sum(0 if kind > 3 else 2 if 0 < offset < len(raw) else 1 for offset, _, kind, _ in es)

    return max((entries(s) for s in STARTS), key=score)


def _tables(raw: bytes) -> tuple[int, int, int, int, int, int]:
    """(definitions at, their count, chunk table at, its end, chunk count, record size)."""
    es = _directory(raw)
    for (defs, n, kind, follow), (chunks, m, _, _), (end, _, _, _) in zip(es, es[1:], es[2:], strict=False):
        if kind == 1 and n > 0 and 0 < defs < chunks < end <= len(raw):
            for count in (follow, m):
                if count and (end - chunks) % count == 0 and 48 <= (end - chunks) // count <= 512:
                    return defs, n, chunks, end, count, (end - chunks) // count
    raise FormatError("no channel and chunk tables")


def _definitions(raw: bytes, at: int, n: int, end: int) -> list[tuple[int, str, int, bytes]]:
    """(id, name, type code, record) of each channel definition."""
    marks = [i for i in range(at, min(at + 8192, end - 8), 2) if struct.unpack_from("<Q", raw, i)[0] == MARKER]
    out = []
    if marks:
        first = marks[0]
        later = [m for m in marks[1:] if m - first <= 1024]
        size = later[0] - first if later else 304
        if size < 0xDC:
            raise FormatError("channel records are too short")
        for k in range(n):
            r = raw[first + k * size : first + (k + 1) * size]
            if len(r) < 0xDC:
                break
            code = struct.unpack_from("<I", r, 0xD8)[0]
            out.append((struct.unpack_from("<I", r, 8)[0], utf16(r[0x10:0x80]), code if code in STORAGE else 6, r))
        return out
    size = (end - at) // n
    if not 100 <= size <= 1024:
        raise FormatError("channel records of no known size")
    export = n <= 200
    for k in range(n):
        r = raw[at + k * size : at + (k + 1) * size]
        code = struct.unpack_from("<I", r, 0xD0)[0] if not export and size >= 0xD4 else 7
        out.append((struct.unpack_from("<I", r, 0)[0], utf16(r[8:0x78]), code if code in STORAGE else 7, r))
    return out


def _unit_fields(records: list[bytes]) -> tuple[int | None, int | None]:
    """Where the records hold the quantity code and the unit text, told from how the two agree."""
    if not records:
        return None, None
    size = min(map(len, records))
    codes, texts = [], []
    for at in range(0, size - 3, 4):
        values = [struct.unpack_from("<I", r, at)[0] for r in records]
        if max(values) <= 64 and len(set(values)) >= 2:
            codes.append((at, values))
        strings = [utf16(r[at : at + 24]) for r in records]
        if any(strings) and all(s.isascii() and (not s or s.isprintable()) for s in strings):
            texts.append((at, strings))
    best = (0, 0.0, None, None)
    for qa, values in codes:
        for ua, strings in texts:
            pairs = [(v, s.lower()) for v, s in zip(values, strings, strict=True) if s and v in ACCEPTED]
            good = sum(s in ACCEPTED[v] or s in MARKERS for v, s in pairs)
            if len(pairs) >= 4 and good >= 0.9 * len(pairs) and (good, good / len(pairs)) > best[:2]:
                best = (good, good / len(pairs), qa, ua)
    if best[2] is not None:
        return best[2], best[3]
    fixed = [utf16(r[DEFAULT_UNIT_AT : DEFAULT_UNIT_AT + 24]) if len(r) > DEFAULT_UNIT_AT + 2 else "" for r in records]
    if any(fixed) and all(s.isprintable() for s in fixed):
        return None, DEFAULT_UNIT_AT
    known = [at for at, values in codes if len(values) >= 8 and all(v in SI_UNITS or v in NO_UNIT for v in values)]
    return (known[0] if known else None), None


def _unit(record: bytes, quantity_at: int | None, unit_at: int | None) -> tuple[str, str]:
    text = utf16(record[unit_at : unit_at + 24]) if unit_at is not None else ""
    if text and text.isprintable():
        return text, SPEC_DEFAULT if text.lower() in MARKERS else DECLARED
    if quantity_at is not None:
        si = SI_UNITS.get(struct.unpack_from("<I", record, quantity_at)[0])
        if si:
            return si, SPEC_DEFAULT
    return "", UNKNOWN


def decode(raw: bytes, values: Wanted = True) -> Recording:
    """Channels in the order of their definitions, each with its chunks in the order of the chunk table."""
    if len(raw) < LEAST:
        raise FormatError("too short")
    defs, n, table, end, count, size = _tables(raw)
    definitions = _definitions(raw, defs, n, table)
    q_at, u_at = _unit_fields([r for *_, r in definitions])
    ids = {d[0] for d in definitions}
    valid = lambda at: at + 0x3C <= len(raw) and (c := struct.unpack_from("<II", raw, at + 4))[0] == c[1] and c[0] in ids
    start = next((s for s in range(table, min(table + 4096, end), 4) if all(valid(s + k * size) for k in range(min(3, count)))), None)
    chunks: dict[int, list[tuple[int, int, int]]] = {}
    for k in range(count):
        at = (table if start is None else start) + k * size
        if at + 0x3C > len(raw):
            break
        if start is None:
            channel = definitions[k % len(definitions)][0]  # compact exports name no channel
        elif valid(at):
            channel = struct.unpack_from("<I", raw, at + 4)[0]
        else:
            continue
        ticks, samples = struct.unpack_from("<II", raw, at + 0x18)
        chunks.setdefault(channel, []).append((ticks * TICK_NS, samples, struct.unpack_from("<I", raw, at + 0x38)[0]))
    out = []
    for cid, name, code, record in definitions:
        unit, source = _unit(record, q_at, u_at)
        c = Channel(cid, name, unit, source, code)
        dtype = np.dtype(STORAGE[code][1])
        base = time = 0
        parts = []
        for period, samples, at in chunks.get(cid, []):
            samples = min(samples, max(0, (len(raw) - at) // dtype.itemsize))
            if not samples or not period:
                continue
            c.chunks.append(Chunk(period, samples, at, base, time))
            base, time = base + samples, time + samples * period
            if wants(values, name):
                parts.append(np.frombuffer(raw, dtype, samples, at).astype(np.float64))
        c.values = (np.concatenate(parts) if parts else np.zeros(0)) if wants(values, name) else None
        out.append(c)
    if not out:
        raise FormatError("no channels")
    return Recording("pds", out)


def encode(channels: list[Channel]) -> bytes:
    """An export of float64 channels, one chunk-table record per chunk."""
    width, record = 0xC0, 0x40
    defs_at = 0x400
    chunk_at = defs_at + width * len(channels)
    chunk_list = [(c, k) for c in channels for k in c.chunks]
    data_at = chunk_at + record * len(chunk_list)
    out = bytearray(data_at + 8 * sum(k.count for _, k in chunk_list))
    out[0x40:0x80] = b"\xff" * 0x40
    for i, (offset, count, kind, follow) in enumerate([(defs_at, len(channels), 1, len(chunk_list)), (chunk_at, len(chunk_list), 2, 0), (data_at, 1, 3, 0)]):
        struct.pack_into("<QI", out, 0x80 + i * ENTRY, offset, count)
        struct.pack_into("<II", out, 0x80 + i * ENTRY + 0x14, kind, follow)
    for i, c in enumerate(channels):
        at = defs_at + i * width
        struct.pack_into("<I", out, at, c.id)
        name, unit = c.name.encode("utf-16-le")[:110], c.unit.encode("utf-16-le")[:22]
        out[at + 8 : at + 8 + len(name)] = name
        out[at + 0x90 : at + 0x90 + len(unit)] = unit
    for i, (c, k) in enumerate(chunk_list):
        at = chunk_at + i * record
        struct.pack_into("<II", out, at + 4, c.id, c.id)
        struct.pack_into("<II", out, at + 0x18, k.period_ns // TICK_NS, k.count)
        struct.pack_into("<I", out, at + 0x38, data_at)
        body = np.asarray(c.values[k.base : k.base + k.count], "<f8").tobytes()
        out[data_at : data_at + len(body)] = body
        data_at += len(body)
    return bytes(out)
