"""Logger recordings as a Spark data source.

    register(spark)
    spark.read.format("telemetry").option("relation", "samples").load("logs/*.ld")

Relations: ``samples`` (one row per stored sample), ``channels``, ``chunks`` and
``files``.  A partition is a file, several small ones, or with the option
``splits`` some channels of one; executors open files themselves and return Arrow batches.  Filters on
channel and time reach the reader (``spark.sql.python.filterPushdown.enabled``), as
do the options ``channels``, ``start_ns`` and ``end_ns``.
"""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThan

from tracegrid import units
from tracegrid.model import CHANNELS, CHUNKS, FILES, SAMPLES
from tracegrid.runtime import bounded_rows
from tracegrid.sources.formats import aim, ld, pds, vbo
from tracegrid.sources.formats.common import FormatError, Recording, Wanted
from tracegrid.sources.paths import find_files, format_of

RELATIONS = {"samples": SAMPLES, "channels": CHANNELS, "chunks": CHUNKS, "files": FILES}
_BATCH = 1 << 16
#: Names (with their units) that reach the driver at most, as columns or as a list of channels to read; more are an error.
MOST_NAMES = 1_000_000


def decode(raw: bytes, form: str, values: Wanted = True) -> Recording:
    """A recording from the bytes of a file of the given format; ``values`` tells which channels' values are read."""
    return {"vbo": vbo.decode, "motec": ld.decode, "pds": pds.decode, "aimd": aim.decode}[form](raw, values)


def open_recording(path: str, values: Wanted = True) -> Recording:
    """A recording from a file, mapped into memory: with ``values`` False or a test of names only the pages needed are read."""
    with open(path, "rb") as f:
        if not os.fstat(f.fileno()).st_size:
            raise FormatError(f"{path}: empty file")
        return decode(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ), format_of(path), values)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (c.split() for c in ddl.split(","))])


def _channel_rows(path: str, rec: Recording) -> list[tuple]:
    rows = []
    for c in rec.channels:
        u = units.lookup(c.unit) if c.unit else None
        first = c.chunks[0] if c.chunks else None
        hz = 1e9 / first.period_ns if first and first.period_ns else None
        rows.append((path, rec.format, c.id, c.name, c.unit, c.unit_source, u.unit if u else None, u.dimension if u else None, c.type_code, c.data_type, hz, first.period_ns if first else None, c.sample_count, len(c.chunks), c.duration_ns))
    return rows


def _chunk_rows(path: str, rec: Recording) -> list[tuple]:
    return [(path, c.id, i, k.period_ns, k.count, k.data_ptr, k.base, k.time_base_ns) for c in rec.channels for i, k in enumerate(c.chunks)]


def _file_rows(path: str, rec: Recording) -> list[tuple]:
    sampled = [c for c in rec.channels if c.sample_count]
    return [(path, rec.format, rec.duration_ns, len(rec.channels), len(sampled), sum(c.sample_count for c in sampled), rec.driver, rec.vehicle, rec.venue, rec.event, rec.session, rec.date, rec.time, rec.clock, rec.start_ns, rec.session_hint, None if rec.frames is None else len(rec.frames))]


def sample_batches(path: str, rec: Recording, channels: set[str] | None = None, start_ns: int = 0, end_ns: int | None = None, part: tuple[int, int] = (0, 1)) -> Iterator[pa.RecordBatch]:
    """Samples of a recording in channel order, those of the wanted channels and times only."""
    schema = _arrow(SAMPLES)
    for j, c in enumerate(rec.channels):
        if not c.sample_count or j % part[1] != part[0] or c.values is None or (channels is not None and c.name.lower() not in channels):
            continue
        t, hz, x = c.time_ns(), c.frequency_hz(), np.asarray(c.values, np.float64)
        keep = np.flatnonzero((t >= start_ns) & (t < end_ns if end_ns is not None else True))
        for at in range(0, len(keep), _BATCH):
            k = keep[at : at + _BATCH]
            n = len(k)
            same = lambda v, kind: pa.array([v], kind).take(pa.array(np.zeros(n, np.int32)))  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays(
                [same(path, pa.string()), same(rec.format, pa.string()), same(c.id, pa.int64()), same(c.name, pa.string()), same(c.unit, pa.string()), same(c.unit_source, pa.string()), pa.array(hz[k]), pa.array(k.astype(np.int64)), pa.array(t[k]), pa.array(x[k])],
                schema=schema,
            )


@dataclass
class FilePart(InputPartition):
    """Some files whole, or one part of the channels of one."""

    paths: tuple[str, ...]
    part: int = 0
    parts: int = 1


#: Small files share a task up to this size, but for so few tasks.
BYTES_A_PART, LEAST_PARTS = 64 << 20, 32


def grouped(paths: list[str]) -> list[tuple[str, ...]]:
    """Files in order, in groups of bounded size; never fewer groups than ``LEAST_PARTS`` where there are as many files."""
    most = max(1, len(paths) // LEAST_PARTS)
    out: list[list[str]] = []
    size = 0
    for p in paths:
        n = os.path.getsize(p)
        if not out or len(out[-1]) >= most or size + n > BYTES_A_PART:
            out.append([])
            size = 0
        out[-1].append(p)
        size += n
    return [tuple(g) for g in out]


class TelemetryReader(DataSourceReader):
    def __init__(self, options: dict[str, str], relation: str) -> None:
        self.relation = relation
        self.paths = find_files(options.get("path", ""), options.get("only"), options.get("created_from"), options.get("created_to"))
        names = options.get("channels")
        self.channels = {x.strip().lower() for x in names.split(",") if x.strip()} if names else None
        self.start_ns = max(0, int(options.get("start_ns", 0)))
        self.end_ns = max(0, int(options["end_ns"])) if "end_ns" in options else None
        if self.end_ns is not None and self.end_ns < self.start_ns:
            raise ValueError("end_ns lies before start_ns")
        self.split = int(options.get("splits", 1))

    def pushFilters(self, filters: list[Filter]):
        """Channel names and time bounds narrow what is decoded; Spark checks them again."""
        for f in filters:
            if self.relation == "samples" and f.attribute in (("channel",), ("time_ns",)):
                if isinstance(f, EqualTo | In) and f.attribute == ("channel",):
                    names = {str(x).lower() for x in ([f.value] if isinstance(f, EqualTo) else f.value)}
                    self.channels = names if self.channels is None else self.channels & names
                elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("time_ns",):
                    self.start_ns = max(self.start_ns, int(f.value))
                elif isinstance(f, LessThan) and f.attribute == ("time_ns",):
                    self.end_ns = int(f.value) if self.end_ns is None else min(self.end_ns, int(f.value))
            yield f

    def partitions(self) -> list[FilePart]:
        if self.relation == "samples" and self.split > 1:
            return [FilePart((p,), i, self.split) for p in self.paths for i in range(self.split)]
        return [FilePart(g) for g in grouped(self.paths)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            yield from self._read(path, partition)

    def _read(self, path: str, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if self.relation == "samples":
            # The headers tell which channels are this part's; only their values are decoded.
            heads = open_recording(path, False).channels
            mine = {c.name for j, c in enumerate(heads) if j % partition.parts == partition.part and (self.channels is None or c.name.lower() in self.channels)}
            yield from sample_batches(path, open_recording(path, mine.__contains__), self.channels, self.start_ns, self.end_ns, (partition.part, partition.parts))
            return
        rec = open_recording(path, False)
        rows = {"channels": _channel_rows, "chunks": _chunk_rows, "files": _file_rows}[self.relation](path, rec)
        if self.channels is not None and self.relation == "channels":
            rows = [r for r in rows if r[3].lower() in self.channels]
        schema = _arrow(RELATIONS[self.relation])
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class TelemetrySource(DataSource):
    """``telemetry``: the long relations of logger recordings."""

    @classmethod
    def name(cls) -> str:
        return "telemetry"

    def _relation(self) -> str:
        relation = self.options.get("relation", "samples")
        if relation not in RELATIONS:
            raise ValueError(f"relation must be one of {', '.join(RELATIONS)}")
        return relation

    def schema(self) -> str:
        return RELATIONS[self._relation()]

    def reader(self, schema) -> TelemetryReader:
        return TelemetryReader(self.options, self._relation())


def register(spark: SparkSession) -> None:
    """Makes the format ``telemetry`` known to a session and lets filters reach its reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TelemetrySource)


def read(spark: SparkSession, path: str, relation: str = "samples", **options) -> DataFrame:
    """A relation of the recordings that a path or pattern names; a missing channel is an error."""
    register(spark)
    reader = spark.read.format("telemetry").option("relation", relation)
    for k, v in options.items():
        if v is not None:
            reader = reader.option(k, str(v))
    if relation == "samples" and options.get("channels"):
        named = read(spark, path, "channels", **{k: v for k, v in options.items() if k in ("channels", "only", "created_from", "created_to")})
        have = {r[0].lower() for r in bounded_rows(named.select("name").distinct(), MOST_NAMES, "channel names")}
        missing = [c for c in options["channels"].split(",") if c.strip() and c.strip().lower() not in have]
        if missing:
            raise ValueError(f"channels not found: {', '.join(missing)}")
    return reader.load(path)


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """Samples of files on any file system Spark reads: binary files decoded where they land."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, raw in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield from sample_batches(p, decode(raw, format_of(p)))

    return files.mapInArrow(run, SAMPLES)


def read_wide(spark: SparkSession, path: str, rate: int = 100, channels: str | None = None, interpolate: str = "linear", start_ns: int = 0, end_ns: int | None = None, channel_map: str | None = None, filename: bool = False, unit_tags: bool = False, timestamps: bool = False, only: str | None = None, created_from: str | None = None, created_to: str | None = None) -> DataFrame:
    """The resampled wide relation: [filename], [create_date, modified_at], time_ns and a column per sampled channel.

    Columns are the union over the files in the order of the sorted files and
    their channels, without regard to case; a file that lacks one has NULL.
    """
    from tracegrid import channelmap
    from tracegrid.operators import resample as rs
    from tracegrid.sources import paths

    pick = {"only": only, "created_from": created_from, "created_to": created_to}
    cols = read(spark, path, "channels", **pick).where("sample_count > 0").select("file", "channel_id", "name", "unit", "data_type", "duration_ns")
    # One row per name and unit, with the first definition of each; a file lies in one partition, so the row number keeps its order.
    named = cols.withColumn("at", F.monotonically_increasing_id()).groupBy(F.lower("name").alias("k"), "unit").agg(F.min(F.struct("file", "at", "name")).alias("first"))
    listed = sorted((r.file, r.at, r.name, r.unit) for r in bounded_rows(named.select("first.*", "unit"), MOST_NAMES, "sampled channels"))
    wanted = {c.strip().lower() for c in channels.split(",") if c.strip()} if channels else None
    names: dict[str, tuple[str, str | None]] = {}
    for _, _, name, unit in listed:
        if wanted is None or name.lower() in wanted:
            known = names.setdefault(name.lower(), (name, units.normalise(unit)))
            if known[1] != units.normalise(unit):
                names[name.lower()] = (known[0], None)
    if wanted and wanted - set(names):
        raise ValueError(f"channels not found: {', '.join(sorted(wanted - set(names)))}")
    rules = channelmap.load_map(channel_map) if channel_map else []
    channelmap.validate_map(rules, [n for n, _ in names.values()])
    # The first of two sampled channels of one name in a file counts.
    first = cols.groupBy("file", F.lower("name").alias("k")).agg(F.min(F.struct("channel_id", "data_type", "duration_ns")).alias("c"))
    s = read(spark, path, "samples", channels=",".join(n for n, _ in names.values()), **pick)
    s = s.withColumn("k", F.lower("channel")).join(first, ["file", "k"]).where("channel_id = c.channel_id").select("file", "channel", "sample_index", "time_ns", "value", F.col("c.duration_ns").alias("duration_ns"), F.col("c.data_type").alias("data_type"))
    ch = read(spark, path, "chunks", **pick).join(cols.select("file", "channel_id", F.col("name").alias("channel")), ["file", "channel_id"])
    out = rs.resample_wide(rs.chunk_extents(s, ch), [n for n, _ in names.values()], rate, interpolate, start_ns, end_ns)
    by = {r.source.lower(): r for r in rules}
    shown = []
    for key, (name, unit) in names.items():
        rule = by.get(key)
        c = F.col(f"`{name}`")
        if rule and not rule.identity:
            c = c * rule.scale + rule.offset
        unit = units.normalise(rule.unit) if rule and rule.unit else unit if not rule or rule.identity else None
        shown.append(c.alias(rule.target if rule else name, metadata={units.TAG: unit} if unit_tags and unit else {}))
    head = [F.col("file").alias("filename")] if filename else []
    if timestamps:
        found = paths.find_files(path, only, created_from, created_to)
        stamp = spark.createDataFrame([(f, paths.created(f).replace(tzinfo=None), paths.modified(f).replace(tzinfo=None)) for f in found], "file string, create_date timestamp_ntz, modified_at timestamp_ntz")
        out = out.join(stamp, "file")
        head += [F.col("create_date"), F.col("modified_at")]
    return out.select(*head, "time_ns", *shown)


def read_aim(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_wide(spark, path, only="aimd", **options)


def read_cosworth(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_wide(spark, path, only="pds", **options)


def read_motec(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_wide(spark, path, only="motec", **options)


def read_vbo(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_wide(spark, path, only="vbo", **options)
