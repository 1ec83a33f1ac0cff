"""Logger records inside a track of an MP4 container, with the video's frame times."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from tracegrid.model import DECLARED
from tracegrid.sources.formats.common import Channel, Chunk, FormatError, Recording, Wanted, wants

# Fixed values of the format.
FOURCC, SIGNATURE, GPS_WIDTH = b"aimd", b"amv0", 56
WGS84_A, WGS84_E2 = 6_378_137.0, 6.694_379_990_14e-3
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
#: Channels of a GPS record: name, unit, type code.
GPS = (
    ("GPS Latitude", "deg", 7), ("GPS Longitude", "deg", 7), ("GPS Altitude", "m", 7), ("GPS Speed", "m/s", 7), ("GPS Heading", "deg", 7), ("GPS Satellites", "count", 1),
    ("GPS Position Accuracy", "m", 7), ("GPS Speed Accuracy", "m/s", 7), ("GPS ECEF Velocity X", "m/s", 7), ("GPS ECEF Velocity Y", "m/s", 7), ("GPS ECEF Velocity Z", "m/s", 7),
    ("GPS iTOW", "ms", 5), ("GPS Week", "count", 3), ("GPS DOP", "ratio", 7), ("GPS Fix Flags", "raw", 5),
)
#: A GPS record as stored.
GPS_RECORD = np.dtype({"names": ["stamp", "itow", "week", "position", "position_accuracy", "velocity", "speed_accuracy", "packed", "flags"], "formats": ["<u4", "<u4", "<u2", ("<i4", 3), "<u4", ("<i4", 3), "<u4", "<u4", "<u4"], "offsets": [0, 4, 12, 16, 28, 32, 44, 48, 52], "itemsize": GPS_WIDTH})


def _boxes(raw: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes between two places."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, start)
        head = 8
        if size == 1:
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise FormatError("a box reaches beyond its parent")
        yield kind, start + head, start + size
        start += size


def _flat(raw: bytes, start: int, end: int) -> dict[bytes, tuple[int, int]]:
    """The leaf boxes below a place by kind, the first of each."""
    out: dict[bytes, tuple[int, int]] = {}
    for kind, a, b in _boxes(raw, start, end):
        if kind in CONTAINERS:
            for k, v in _flat(raw, a, b).items():
                out.setdefault(k, v)
        else:
            out.setdefault(kind, (a, b))
    return out


def _numbers(raw: bytes, at: int, count: int, kind: str) -> np.ndarray:
    try:
        return np.frombuffer(raw, kind, count, at).astype(np.int64)
    except ValueError:
        raise FormatError("a sample table is cut off") from None


def _tracks(raw: bytes) -> list[dict[bytes, tuple[int, int]]]:
    for kind, a, b in _boxes(raw, 0, len(raw)):
        if kind == b"moov":
            return [_flat(raw, x, y) for k, x, y in _boxes(raw, a, b) if k == b"trak"]
    raise FormatError("no movie box")


def _sample_places(raw: bytes, t: dict[bytes, tuple[int, int]]) -> list[tuple[int, int]]:
    """(offset, size) of every sample of a track."""
    try:
        at = t[b"stsz"][0]
        fixed, n = struct.unpack_from(">II", raw, at + 4)
        sizes = np.full(n, fixed, np.int64) if fixed else _numbers(raw, at + 12, n, ">u4")
        wide = b"co64" in t
        at = t[b"co64" if wide else b"stco"][0]
        offsets = _numbers(raw, at + 8, struct.unpack_from(">I", raw, at + 4)[0], ">u8" if wide else ">u4")
        at = t[b"stsc"][0]
        m = struct.unpack_from(">I", raw, at + 4)[0]
        runs = _numbers(raw, at + 8, 3 * m, ">u4").reshape(m, 3)
    except KeyError as e:
        raise FormatError(f"the track lacks {e.args[0]!r}") from None
    firsts = np.r_[runs[:, 0], len(offsets) + 1]
    per_chunk = np.repeat(runs[:, 1], np.diff(firsts))
    if per_chunk.sum() != n or len(per_chunk) != len(offsets):
        raise FormatError("sample tables disagree")
    out, k = [], 0
    for offset, count in zip(offsets, per_chunk, strict=True):
        for size in sizes[k : k + count]:
            if offset + size > len(raw):
                raise FormatError("a sample lies beyond the file")
            out.append((int(offset), int(size)))
            offset += size
        k += count
    return out


def _frame_times(raw: bytes, t: dict[bytes, tuple[int, int]]) -> np.ndarray:
    """Presentation times of a video track in ns, sorted."""
    at = t[b"mdhd"][0]
    scale = struct.unpack_from(">I", raw, at + (20 if raw[at] else 12))[0]
    at = t[b"stts"][0]
    m = struct.unpack_from(">I", raw, at + 4)[0]
    table = _numbers(raw, at + 8, 2 * m, ">u4").reshape(m, 2)
    times = np.r_[0, np.cumsum(np.repeat(table[:, 1], table[:, 0]))][:-1]
    if b"ctts" in t:
        at = t[b"ctts"][0]
        m = struct.unpack_from(">I", raw, at + 4)[0]
        shift = _numbers(raw, at + 8, 2 * m, ">i4" if raw[at] else ">u4").reshape(m, 2)
        times = times + np.repeat(shift[:, 1], shift[:, 0])[: len(times)]
    if not scale:
        raise FormatError("a video track without time scale")
    return np.sort(np.maximum(times - times.min(initial=0), 0)) * 1_000_000_000 // scale


def _blocks(sample: bytes, tag: bytes) -> Iterator[bytes]:
    mark, at = b"<h" + tag, 0
    while (at := sample.find(mark, at)) >= 0:
        if at + 12 > len(sample):
            return
        size = struct.unpack_from("<I", sample, at + 6)[0]
        yield sample[at + 12 : at + 12 + size]
        at += 12


def _text(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1").strip()


def _schema(sample: bytes) -> tuple[dict[int, tuple[Channel, int]], int | None]:
    """Record id -> (channel, width), and the first id of the GPS channels."""
    if sample[6:10] != SIGNATURE:
        raise FormatError("the first sample is no schema")
    scalars: dict[int, tuple[Channel, int]] = {}
    gps = None
    for p in _blocks(sample, b"CHS\0"):
        if len(p) < 100:
            continue
        rid, kind, width, klass = (struct.unpack_from("<I", p, a)[0] for a in (0, 20, 72, 80))
        code, name = _text(p[24:32]), _text(p[32:64])
        if code == "GPS0" and width == GPS_WIDTH:
            gps = rid + 1
        elif rid <= 0xFFFF and name and width in (1, 4):
            if rid in scalars:
                raise FormatError(f"record id {rid} stands twice")
            type_code = 1 if width == 1 else 5 if klass == 0x1003 else 4 if kind == 12 else 6
            scalars[rid] = (Channel(rid, name, type_code=type_code), width)
    if not scalars and gps is None:
        raise FormatError("the schema has no channel")
    return scalars, gps


def geodetic(xyz: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Latitude and longitude in degrees and altitude in m of earth-centred metres, all rows at once."""
    x, y, z = xyz.T
    p = np.hypot(x, y)
    lat, alt = np.arctan2(z, p * (1 - WGS84_E2)), np.zeros_like(p)
    for _ in range(8):
        n = WGS84_A / np.sqrt(1 - WGS84_E2 * np.sin(lat) ** 2)
        alt = p / np.cos(lat) - n
        lat = np.arctan2(z, p * (1 - WGS84_E2 * n / (n + alt)))
    return np.degrees(lat), np.degrees(np.arctan2(y, x)), alt


def gps_values(records: np.ndarray) -> list[np.ndarray]:
    """The values of the GPS channels, in the order of ``GPS``."""
    lat, lon, alt = geodetic(records["position"] / 100.0)
    v = records["velocity"] / 100.0
    a, o = np.radians(lat), np.radians(lon)
    east = -np.sin(o) * v[:, 0] + np.cos(o) * v[:, 1]
    north = -np.sin(a) * (np.cos(o) * v[:, 0] + np.sin(o) * v[:, 1]) + np.cos(a) * v[:, 2]
    heading = np.where(np.hypot(east, north) < 0.01, 0.0, np.mod(np.degrees(np.arctan2(east, north)), 360.0))
    speed = np.hypot(np.hypot(v[:, 0], v[:, 1]), v[:, 2])
    packed = records["packed"]
    out = [lat, lon, alt, speed, heading, packed >> 24, records["position_accuracy"] / 100.0, records["speed_accuracy"] / 100.0, *v.T, records["itow"], records["week"], (packed & 0xFFFFFF) / 100.0, records["flags"]]
    return [np.asarray(x, np.float64) for x in out]


def period_chunks(times_ns: np.ndarray) -> list[Chunk]:
    """Chunks of jittery times: the most frequent step is the period, a step above two of them starts a chunk."""
    if not len(times_ns):
        return []
    steps = np.diff(times_ns)
    steps = steps[steps > 0]
    if not len(steps):
        return [Chunk(1_000_000_000, len(times_ns), 0, 0, int(times_ns[0]))]
    values, counts = np.unique(steps, return_counts=True)
    period = int(values[np.argmax(counts)])
    cut = np.r_[0, np.flatnonzero(np.diff(times_ns) > 2 * period) + 1, len(times_ns)]
    return [Chunk(period, int(b - a), 0, int(a), int(times_ns[a])) for a, b in zip(cut, cut[1:], strict=False)]


def decode(raw: bytes, values: Wanted = True) -> Recording:
    """Scalar and GPS channels of the logger track, times from the first stamp; frame times of the first video track.

    The stamps are read in any case, since they tell the counts; values only where they are wanted.
    """
    tracks = _tracks(raw)
    logger = next((t for t in tracks if b"stsd" in t and raw[t[b"stsd"][0] + 12 : t[b"stsd"][0] + 16] == FOURCC), None)
    if logger is None:
        raise FormatError("no logger track")
    places = _sample_places(raw, logger)
    if not places:
        raise FormatError("the logger track is empty")
    video = next((t for t in tracks if b"hdlr" in t and raw[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12] == b"vide"), None)
    frames = _frame_times(raw, video) if video else None
    scalars, gps_id = _schema(raw[places[0][0] : sum(places[0])])
    stamps: dict[int, list[int]] = {r: [] for r in scalars}
    bodies: dict[int, list[bytes]] = {r: [] for r in scalars}
    gps: list[bytes] = []
    for offset, size in places[1:]:
        s = raw[offset : offset + size]
        at = 0
        while (at := s.find(b"(S", at)) >= 0:
            if at + 8 <= len(s):
                stamp, rid = struct.unpack_from("<IH", s, at + 2)
                if rid in scalars and s[at + 8 + scalars[rid][1] : at + 9 + scalars[rid][1]] == b")":
                    stamps[rid].append(stamp)
                    bodies[rid].append(s[at + 8 : at + 8 + scalars[rid][1]])
                    at += 8 + scalars[rid][1]
            at += 1
        if gps_id is not None:
            gps.extend(b for b in _blocks(s, b"GPS\0") if len(b) == GPS_WIDTH)
    records = np.frombuffer(b"".join(gps), GPS_RECORD)
    seen = [x for v in stamps.values() for x in v[:1]] + records["stamp"][:1].tolist()
    if not seen:
        raise FormatError("the logger track holds no record")
    zero = min([x for v in stamps.values() for x in v] + records["stamp"].tolist())
    channels = []
    for rid, (c, _) in scalars.items():
        t = (np.array(stamps[rid], np.int64) - zero) * 1_000_000
        dtype = {1: "<u1", 4: "<i4", 5: "<u4", 6: "<f4"}[c.type_code]
        c.chunks = period_chunks(t)
        if wants(values, c.name):
            c.values = np.frombuffer(b"".join(bodies[rid]), dtype).astype(np.float64)
        channels.append(c)
    if gps_id is not None:
        t = (records["stamp"].astype(np.int64) - zero) * 1_000_000
        solved = gps_values(records) if any(wants(values, name) for name, *_ in GPS) else [None] * len(GPS)
        for k, ((name, unit, code), v) in enumerate(zip(GPS, solved, strict=True)):
            channels.append(Channel(gps_id + k, name, unit, DECLARED, code, period_chunks(t), None, v))
    return Recording("aimd", channels, frames=frames)


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def encode(scalars: list[tuple[int, str, list[tuple[int, float]]]], gps: list[bytes] = (), frames: int = 3, frame_ms: int = 40) -> bytes:
    """A container with float32 scalars [(id, name, [(ms, value)])], GPS records and a video track of even frames."""
    schema = b""
    for rid, code, name, width in [(r, b"", n, 4) for r, n, _ in scalars] + ([(55, b"GPS0", "GPS0", GPS_WIDTH)] if gps else []):
        p = bytearray(112)
        struct.pack_into("<I", p, 0, rid)
        p[24 : 24 + len(code)] = code
        p[32 : 32 + len(name)] = name.encode("latin-1")
        struct.pack_into("<I", p, 72, width)
        schema += b"<hCHS\0" + struct.pack("<I", len(p)) + b"\x01>" + bytes(p)
    first = b"\0\0\x40\0\0\0" + SIGNATURE + b"s1" + schema
    records = sorted((ms, rid, v) for rid, _, samples in scalars for ms, v in samples)
    second = b"\0\0\x40\0\0\0" + SIGNATURE + b"".join(b"(S" + struct.pack("<IHf", ms, rid, v) + b")" for ms, rid, v in records)
    second += b"".join(b"<hGPS\0" + struct.pack("<I", GPS_WIDTH) + b"\x01>" + g for g in gps)

    def track(handler: bytes, fourcc: bytes, sizes: list[int], offset: int, step: int) -> bytes:
        n = len(sizes)
        stbl = _box(b"stsd", struct.pack(">II", 0, 1) + struct.pack(">I4s", 16, fourcc) + b"\0" * 8)
        stbl += _box(b"stts", struct.pack(">IIII", 0, 1, n, step)) + _box(b"stsz", struct.pack(">III", 0, 0, n) + struct.pack(f">{n}I", *sizes))
        stbl += _box(b"stsc", struct.pack(">IIIII", 0, 1, 1, n, 1)) + _box(b"stco", struct.pack(">III", 0, 1, offset))
        mdia = _box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 1000, n * step)) + _box(b"hdlr", struct.pack(">II4s", 0, 0, handler) + b"\0" * 12) + _box(b"minf", _box(b"stbl", stbl))
        return _box(b"trak", _box(b"mdia", mdia))

    data_at = 24
    picture = b"\0" * frames
    body = first + second + picture
    head = _box(b"ftyp", b"isom\0\0\0\0")
    return head + _box(b"mdat", body) + _box(b"moov", track(b"vide", b"avc1", [1] * frames, data_at + len(first) + len(second), frame_ms) + track(b"meta", FOURCC, [len(first), len(second)], data_at, 1000))
