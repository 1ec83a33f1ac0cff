"""The XML sidecar of a written recording: beacons, details and lap times."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

#: The details in the order of the format.
DETAILS = ("Event", "Venue", "Driver", "Team", "Vehicle Id", "Vehicle Number", "Session", "Short Comment", "Long Comment")
_HEAD = '<?xml version="1.0"?>\n<LDXFile Locale="English_United States.1252" DefaultLocale="C" Version="1.6">\n <Layers>\n  <Layer>'


def sidecar_path(path: str) -> str:
    return (path[:-3] if path.lower().endswith(".ld") else path) + ".ldx"


def lap_time(ns: int) -> str:
    ms = round(ns / 1e6)
    return f"{ms // 60000}:{ms // 1000 % 60:02d}.{ms % 1000:03d}"


def sidecar(markers_ns: list[int] | None, details: dict[str, str] | None = None, date: str = "", time: str = "", source: str = "") -> str:
    """The sidecar text; laps are the markers and one, the fastest lies between two markers.

    ``markers_ns`` None: no channel tells the laps, which then stay empty.  Details
    that are not given are empty.
    """
    given = details or {}
    text = lambda key, value: f"   <String Id={quoteattr(key)} Value={quoteattr(value)}/>"
    lines = [_HEAD]
    laps = dict.fromkeys(("Total Laps", "Fastest Time", "Fastest Lap"), "")
    if markers_ns is not None:
        beacons = [f'     <Marker Version="100" ClassName="BCN" Name="Manual.{i}" Flags="77" Time="{t / 1000:.17e}"/>' for i, t in enumerate(markers_ns, 1)]
        lines += ['   <MarkerBlock>\n    <MarkerGroup Name="Beacons" Index="3">', *beacons, "    </MarkerGroup>\n   </MarkerBlock>"]
        gaps = [b - a for a, b in zip(markers_ns, markers_ns[1:], strict=False)]
        laps = {"Total Laps": str(len(markers_ns) + 1)}
        if gaps:
            best = gaps.index(min(gaps))
            laps |= {"Fastest Time": lap_time(gaps[best]), "Fastest Lap": str(best + 2)}
        laps["Beacon Source"] = source
    stamps = [f"   <DateTime Id={quoteattr(key)} Value={quoteattr(value)}/>" for key, value in (("Log Date", date), ("Log Time", time))]
    lines += ["  </Layer>\n  <Details>", *(text(key, given.get(key, "")) for key in DETAILS), *stamps, *(text(key, value) for key, value in laps.items()), "  </Details>\n </Layers>\n</LDXFile>\n"]
    return "\n".join(lines)
