"""``python -m tracegrid.inspect FILE...``: what a logger file holds, from its headers and role channels only."""

from __future__ import annotations

import sys

from tracegrid.sources.recordings import open_recording
from tracegrid.sources.summary import FILE_ROW, plays_a_role, summarise


def describe(path: str) -> str:
    """The summary of a file and one line per channel definition."""
    rec = open_recording(path, plays_a_role)
    names = [c.split()[0] for c in FILE_ROW.split(", ")]
    lines = [f"{n}: {v}" for n, v in zip(names, summarise(path, rec).row, strict=True) if v not in (None, "")]
    for c in rec.channels:
        hz = 1e9 / c.chunks[0].period_ns if c.chunks and c.chunks[0].period_ns else 0
        lines.append(f"{c.id:>6}  {c.name:<32}  {c.unit or '-':<10}  {c.unit_source:<12}  {c.data_type:<8}  {hz:>9.3f} Hz  {len(c.chunks):>4} chunks  {c.sample_count:>10} samples")
    return "\n".join(lines)


if __name__ == "__main__":
    for name in sys.argv[1:]:
        print(describe(name))
