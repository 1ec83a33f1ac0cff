"""What every decoder returns: identity, channels and one array of times and values per channel."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

from tracegrid.model import STORAGE, UNKNOWN


#: Which channels' values a decoder reads: all, none (headers only), or those whose name passes.
Wanted = bool | Callable[[str], bool]


def wants(values: Wanted, name: str) -> bool:
    return values if isinstance(values, bool) else values(name)


class FormatError(ValueError):
    """A file that is not what its extension says."""


@dataclass
class Chunk:
    period_ns: int
    count: int
    data_ptr: int
    base: int
    time_base_ns: int


@dataclass
class Channel:
    id: int
    name: str
    unit: str = ""
    unit_source: str = UNKNOWN
    type_code: int = 7
    chunks: list[Chunk] = field(default_factory=list)
    #: Times that are not those of the chunk clocks.
    times: np.ndarray | None = None
    values: np.ndarray | None = None

    @property
    def sample_count(self) -> int:
        return sum(c.count for c in self.chunks)

    @property
    def duration_ns(self) -> int:
        """The end of the last chunk, or one period past the last of the channel's own times."""
        if self.times is not None and len(self.times):
            return int(self.times[-1]) + self.chunks[0].period_ns
        return max((c.time_base_ns + c.count * c.period_ns for c in self.chunks), default=0)

    @property
    def data_type(self) -> str:
        return STORAGE.get(self.type_code, STORAGE[6])[0]

    def time_ns(self) -> np.ndarray:
        if self.times is not None:
            return self.times
        return np.concatenate([c.time_base_ns + np.arange(c.count, dtype=np.int64) * c.period_ns for c in self.chunks]) if self.chunks else np.zeros(0, np.int64)

    def frequency_hz(self) -> np.ndarray:
        return np.concatenate([np.full(c.count, 1e9 / c.period_ns if c.period_ns else np.nan) for c in self.chunks]) if self.chunks else np.zeros(0)


@dataclass
class Recording:
    format: str
    channels: list[Channel]
    driver: str = ""
    vehicle: str = ""
    venue: str = ""
    event: str = ""
    session: str = ""
    date: str = ""
    time: str = ""
    clock: str | None = None
    start_ns: int | None = None
    session_hint: str | None = None
    #: Presentation times of video frames, sorted.
    frames: np.ndarray | None = None

    @property
    def duration_ns(self) -> int:
        return max((c.duration_ns for c in self.channels), default=0)


def latin1(raw: bytes) -> str:
    return raw.split(b"\0", 1)[0].decode("latin-1").strip()


def utf16(raw: bytes) -> str:
    raw = raw[: len(raw) // 2 * 2]
    return raw.decode("utf-16-le", errors="replace").split("\0", 1)[0].strip()
