"""The SQL surface: table functions over files and unit functions, by ``install(spark)``.

    SELECT * FROM telemetry_samples('logs/*.ld', channel => 'Speed')
    SELECT s.* FROM telemetry_files('logs/*.ld') f, LATERAL telemetry_samples(f.file) s
    SELECT * FROM read_telemetry('logs/run.pds', rate => 10, unit_tags => true)
    SELECT telemetry_convert(v, 'km/h', 'm/s') FROM t
    CREATE TEMPORARY VIEW s USING telemetry OPTIONS (path 'logs/*.ld', relation 'samples')

A table function reads in one Python process per call, which suits exploration.
Three forms read in parallel: the LATERAL one above (one call per file, where the
rows of ``telemetry_files`` lie), the view over the data source, and the
DataFrame functions in ``sources.recordings`` and ``sources.library``.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampNTZType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from tracegrid import channelmap, model, units
from tracegrid.sources import recordings, sinks, summary
from tracegrid.sources.paths import created, find_files, format_of, modified


def _names(text: str | None) -> set[str] | None:
    return {c.strip().lower() for c in text.split(",") if c.strip()} if text else None


def _rules(text: str | None) -> dict[str, channelmap.ChannelRule]:
    return {r.source.lower(): r for r in channelmap.load_map(text)} if text else {}


def _check_map(rules: dict, paths: list[str]) -> None:
    if rules:
        have = {c.name.lower() for p in paths for c in recordings.open_recording(p, False).channels}
        channelmap.validate_map(list(rules.values()), sorted(have))


@udtf(returnType="file string, format string")
class Files:
    """The files a path or pattern names, without opening them."""

    def eval(self, path: str):
        for p in find_files(path):
            yield p, format_of(p)


@udtf(returnType=model.SAMPLES)
class Samples:
    def eval(self, path: str, channel: str | None = None, start_ns: int = 0, end_ns: int | None = None, channel_map: str | None = None):
        rules, wanted = _rules(channel_map), _names(channel)
        start, end = max(0, start_ns or 0), None if end_ns is None else max(0, end_ns)
        if end is not None and end < start:
            raise ValueError("end_ns lies before start_ns")
        paths = find_files(path)
        _check_map(rules, paths)
        heads = {c.name.lower() for p in paths for c in recordings.open_recording(p, False).channels} if wanted else set()
        if wanted and wanted - heads:
            raise ValueError(f"channels not found: {', '.join(sorted(wanted - heads))}")
        keep = True if wanted is None else lambda n: n.lower() in wanted
        for p in paths:
            for b in recordings.sample_batches(p, recordings.open_recording(p, keep), wanted, start, end):
                for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    rule = rules.get(r[3].lower())
                    if rule:
                        r = (*r[:3], rule.target, rule.unit or r[4], "declared" if rule.unit else r[5], *r[6:9], r[9] * rule.scale + rule.offset)
                    yield r


def _definitions(path: str, channels: str | None, channel_map: str | None):
    """(source name, row of ``model.CHANNELS`` under mapped names and units) of every definition asked for, by source or mapped name."""
    rules, wanted = _rules(channel_map), _names(channels)
    paths = find_files(path)
    _check_map(rules, paths)
    for p in paths:
        for r in recordings._channel_rows(p, recordings.open_recording(p, False)):
            rule = rules.get(r[3].lower())
            shown = rule.target if rule else r[3]
            if wanted is not None and not wanted & {r[3].lower(), shown.lower()}:
                continue
            if rule and rule.unit:
                u = units.lookup(rule.unit)
                r = (*r[:4], rule.unit, "declared", u.unit if u else None, u.dimension if u else None, *r[8:])
            yield r[3], (*r[:3], shown, *r[4:])


@udtf(returnType=model.CHANNELS)
class Metadata:
    def eval(self, path: str, channel_map: str | None = None, channels: str | None = None):
        for _, r in _definitions(path, channels, channel_map):
            yield r


def _summaries(path: str, only: str | None = None, created_from: str | None = None, created_to: str | None = None) -> list[summary.FileSummary]:
    return [summary.summarise(p, recordings.open_recording(p, summary.plays_a_role)) for p in find_files(path, only, created_from, created_to)]


@udtf(returnType=summary.FILE_ROW)
class FileMetadata:
    def eval(self, path: str):
        for p in find_files(path):
            row = list(summary.summarise(p, recordings.open_recording(p, summary.plays_a_role)).row)
            row[9] = Decimal(row[9])
            yield tuple(row)


@udtf(returnType=summary.SESSION_ROW)
class SessionMetadata:
    def eval(self, path: str, max_gap_seconds: int = 60):
        for s in summary.sessions(_summaries(path), max_gap_seconds):
            yield s.row


#: Arguments of the wide table functions besides the path, with their defaults.
OPTIONS = {
    "rate": 100, "channels": None, "start_ns": 0, "end_ns": None, "interpolate": "linear", "max_gap_seconds": 60, "filename": False, "add_filename_as_column": False, "timestamps": False, "unit_tags": False,
    "add_create_date_as_column": False, "add_modified_at_as_column": False, "create_date_from": None, "create_date_to": None, "channel_map": None,
}


def _options(given: dict) -> dict:
    """The options of a call, checked."""
    unknown = set(given) - set(OPTIONS)
    if unknown:
        raise ValueError(f"unknown arguments: {', '.join(sorted(unknown))}")
    o = OPTIONS | {k: v for k, v in given.items() if v is not None}
    if not 1 <= o["rate"] <= 5000:
        raise ValueError("rate must be between 1 and 5000")
    if o["interpolate"] not in ("linear", "previous"):
        raise ValueError("interpolate must be 'linear' or 'previous'")
    if not 0 <= o["max_gap_seconds"] <= 86_400:
        raise ValueError("max_gap_seconds must be between 0 and 86400")
    o["start_ns"], o["end_ns"] = max(0, o["start_ns"]), None if o["end_ns"] is None else max(0, o["end_ns"])
    if o["end_ns"] is not None and o["end_ns"] < o["start_ns"]:
        raise ValueError("end_ns lies before start_ns")
    return o


def _layout(paths: list[str], o: dict) -> dict[str, tuple[str, str | None, channelmap.ChannelRule | None]]:
    """By folded source name in file and channel order: column name, unit tag and rule of the sampled channels asked for."""
    wanted, rules = _names(o["channels"]), _rules(o["channel_map"])
    seen: dict[str, tuple[str, set]] = {}
    for p in paths:
        for c in recordings.open_recording(p, False).channels:
            if c.sample_count and (wanted is None or c.name.lower() in wanted):
                seen.setdefault(c.name.lower(), (c.name, set()))[1].add(units.normalise(c.unit))
    if wanted and wanted - set(seen):
        raise ValueError(f"channels not found: {', '.join(sorted(wanted - set(seen)))}")
    if rules:
        channelmap.validate_map(list(rules.values()), list(seen))
    out = {}
    for key, (name, found) in seen.items():
        rule = rules.get(key)
        unit = next(iter(found)) if len(found) == 1 else None
        if rule and (rule.unit or not rule.identity):
            unit = units.normalise(rule.unit) if rule.unit else None
        out[key] = (rule.target if rule else name, unit, rule)
    return out


def sampled(c, at: np.ndarray, linear: bool) -> np.ndarray:
    """The value of a decoded channel at each time: the sample before, or a line to the next; NaN from its end on."""
    t, x = c.time_ns(), np.asarray(c.values, float)
    i = np.clip(np.searchsorted(t, at, "right") - 1, 0, len(t) - 1)
    out = x[i].copy()
    j = np.minimum(i + 1, len(t) - 1)
    if c.times is None:
        ends = np.concatenate([np.r_[np.full(k.count - 1, np.iinfo(np.int64).max), k.time_base_ns + k.count * k.period_ns] for k in c.chunks])
        late = (at >= ends[i]) & (j > i)
        out[late] = x[j[late]]
    else:
        late = np.zeros(len(at), bool)
    name = "".join(ch for ch in c.name.lower() if ch.isalnum())
    if linear and c.data_type in model.FLOATING and not any(s in name for s in model.STEP_NAMES):
        k = ~late & (j > i) & (at > t[i]) & (t[j] > t[i])
        out[k] = x[i[k]] + (x[j[k]] - x[i[k]]) * ((at[k] - t[i[k]]) / (t[j[k]] - t[i[k]]))
    out[at >= c.duration_ns] = np.nan
    return out


def _table(path: str, layout: dict, o: dict, start: int, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(tick times, one column per channel of the layout) of one file from ``start`` on; NaN where there is no value."""
    picked: dict = {}
    for c in recordings.open_recording(path, lambda n: n.lower() in layout).channels:
        if c.sample_count and c.name.lower() in layout:
            picked.setdefault(c.name.lower(), c)
    stop = max((c.duration_ns for c in picked.values()), default=0)
    stop = stop if end is None else min(stop, end)
    ticks = np.arange(max(0, -(-(stop - start) * o["rate"] // 1_000_000_000)), dtype=np.int64)
    at = start + ticks * 1_000_000_000 // o["rate"]
    values = np.full((len(at), len(layout)), np.nan)
    for k, (key, (_, _, rule)) in enumerate(layout.items()):
        if key in picked:
            x = sampled(picked[key], at, o["interpolate"] == "linear")
            values[:, k] = x * rule.scale + rule.offset if rule else x
    return at, values


def _value(x: float) -> float | None:
    return None if x != x else x


def _fields(layout: dict, o: dict) -> list[StructField]:
    return [StructField(name, DoubleType(), True, {units.TAG: unit} if o["unit_tags"] and unit else {}) for name, unit, _ in layout.values()]


def wide_function(only: str | None = None):
    """The wide table function over all formats or one."""

    @udtf
    class ReadTelemetry:
        """The wide relation; its schema follows from the files when the query is analysed."""

        @staticmethod
        def analyze(path: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
            o = _options({k: v.value for k, v in options.items()})
            paths = find_files(path.value, only, o["create_date_from"], o["create_date_to"])
            head = [StructField("filename", StringType())] if o["filename"] or o["add_filename_as_column"] else []
            head += [StructField(n, TimestampNTZType()) for n, on in (("create_date", "add_create_date_as_column"), ("modified_at", "add_modified_at_as_column")) if o["timestamps"] or o[on]]
            return AnalyzeResult(StructType([*head, StructField("time_ns", LongType()), *_fields(_layout(paths, o), o)]))

        def eval(self, path: str, **options):
            o = _options(options)
            paths = find_files(path, only, o["create_date_from"], o["create_date_to"])
            layout = _layout(paths, o)
            for p in paths:
                head = [p] if o["filename"] or o["add_filename_as_column"] else []
                head += [f(p).replace(tzinfo=None) for f, on in ((created, "add_create_date_as_column"), (modified, "add_modified_at_as_column")) if o["timestamps"] or o[on]]
                at, values = _table(p, layout, o, o["start_ns"], o["end_ns"])
                for t, row in zip(at.tolist(), values.tolist(), strict=True):
                    yield (*head, t, *map(_value, row))

    return ReadTelemetry


@udtf
class ReadSession:
    """The wide relation on the clock of the one session that the files form."""

    HEAD = (("session_key", StringType()), ("time_ns", LongType()), ("file_time_ns", LongType()), ("source_file", StringType()), ("video_file_index", LongType()), ("video_frame_index", LongType()), ("video_sync_time", DoubleType()), ("driver_id", LongType()), ("lap_number", LongType()))

    @staticmethod
    def analyze(path: AnalyzeArgument, **options: AnalyzeArgument) -> AnalyzeResult:
        o = _options({k: v.value for k, v in options.items()})
        paths = find_files(path.value, None, o["create_date_from"], o["create_date_to"])
        return AnalyzeResult(StructType([*(StructField(n, t) for n, t in ReadSession.func.HEAD), *_fields(_layout(paths, o), o)]))

    def eval(self, path: str, **options):
        o = _options(options)
        files = _summaries(path, None, o["create_date_from"], o["create_date_to"])
        found = summary.sessions(files, o["max_gap_seconds"])
        if len(found) != 1:
            raise ValueError(f"the files form {len(found)} sessions, not one")
        session = found[0]
        layout = _layout([f.path for f in files], o)
        for f in session.files:
            offset = 0 if f.start is None else f.start - session.start
            end = None if o["end_ns"] is None else max(0, o["end_ns"] - offset)
            at, values = _table(f.path, layout, o, max(0, o["start_ns"] - offset), end)
            marks = [summary.named(f.rec, names) for names in (summary.VIDEO_FILE, summary.VIDEO_SYNC, summary.ev.DRIVER_NAMES, summary.ev.LAP_NAMES)]
            video, sync, driver, lap = (np.full(len(at), np.nan) if c is None else sampled(c, at, False) for c in marks)
            shown = np.searchsorted(f.rec.frames, at, "right") - 1 if f.rec.frames is not None and len(f.rec.frames) else None
            whole = lambda x: None if not np.isfinite(x) else int(summary.whole(np.array([x]))[0])
            for i, (t, row) in enumerate(zip(at.tolist(), values.tolist(), strict=True)):
                frame = None if shown is None else max(0, int(shown[i]))
                yield (session.key, t + offset, t, f.path, whole(video[i]) if video[i] >= 0 else None, frame, _value(sync[i].item()), whole(driver[i]), whole(lap[i]), *map(_value, row))


@udtf(returnType="column_name string, unit string, ddl string, kv_metadata string, channel_map_rule string")
class ColumnComments:
    def eval(self, path: str, table: str, channel_map: str | None = None, channels: str | None = None):
        seen = set()
        for source, r in _definitions(path, channels, channel_map):
            name, unit, hz, period = r[3], r[4], r[10], r[11]
            if name.lower() in seen:
                continue
            seen.add(name.lower())
            payload = f"unit={unit}" + (f"; native_frequency_hz={hz:g}; native_sample_period_ns={period}" if period else "")
            double = lambda x: '"' + x.replace('"', '""') + '"'
            yield name, unit, f"COMMENT ON COLUMN {double(table)}.{double(name)} IS '{payload.replace(chr(39), chr(39) * 2)}'", payload, channelmap.rule_text(source, name, unit or None)


@udtf(returnType="unit string, canonical_unit string, is_canonical boolean, dimension string, base_unit string, to_base_factor double, to_base_offset double, is_convertible boolean")
class Units:
    def eval(self):
        for u in units.UNITS:
            for s in u.spellings:
                yield s, u.unit, s == u.unit, u.dimension, u.base_unit, u.factor, u.offset, u.convertible


@udtf(returnType=sinks.SUMMARY)
class WriteTelemetry:
    """One recording written to a file and its sidecar; one summary row."""

    def eval(self, source: str, output: str, **options):
        yield sinks.export_file(source, output, **{k: v for k, v in options.items() if v is not None})


@dataclass
class _Converted(AnalyzeResult):
    """What the conversion of a column needs to know of its table."""

    at: int = 0
    source: str = ""


@udtf
class ConvertColumn:
    """``telemetry_convert_column(TABLE(t), column, unit)``: the table with a tagged column in another unit, which it is tagged with."""

    @staticmethod
    def analyze(table: AnalyzeArgument, column: AnalyzeArgument, unit: AnalyzeArgument) -> AnalyzeResult:
        if not table.isTable or column.value not in table.dataType.names:
            raise ValueError(f"telemetry_convert_column needs TABLE(...) with a column {column.value!r}")
        at = table.dataType.names.index(column.value)
        fields = list(table.dataType.fields)
        tag = fields[at].metadata.get(units.TAG)
        if not tag:
            raise ValueError(f"column {column.value!r} carries no unit")
        units.convert_value(0.0, tag, unit.value)
        fields[at] = StructField(column.value, DoubleType(), True, {**fields[at].metadata, units.TAG: units.normalise(unit.value)})
        return _Converted(StructType(fields), at=at, source=tag)

    def __init__(self, analyzed: _Converted) -> None:
        self.at, self.source = analyzed.at, analyzed.source

    def eval(self, row, column: str, unit: str):
        r = list(row)
        x = r[self.at]
        r[self.at] = None if x is None else units.convert_value(float(x), self.source, unit)
        yield tuple(r)


def _unit_functions() -> list[str]:
    """The unit functions as SQL expressions that Spark compiles: no Python runs for a row."""
    entry = "STRUCT<unit: STRING, dimension: STRING, factor: DOUBLE, offset: DOUBLE, convertible: BOOLEAN>"

    def book(spellings: dict) -> str:
        text = json.dumps({s: {"unit": u.unit, "dimension": u.dimension, "factor": u.factor, "offset": u.offset, "convertible": u.convertible} for s, u in spellings.items()})
        return "from_json('" + text.replace("\\", "\\\\").replace("'", "\\'") + f"', 'MAP<STRING, {entry}>')"

    exact, folded = book(units._EXACT), book(units._FOLDED)
    fail = lambda what: f"CAST(raise_error(concat('{what}', source, ' -> ', target)) AS DOUBLE)"
    a, b = "telemetry_unit(source)", "telemetry_unit(target)"
    return [
        f"CREATE OR REPLACE TEMPORARY FUNCTION telemetry_unit(spelling STRING) RETURNS {entry} RETURN coalesce(try_element_at({exact}, trim(spelling)), try_element_at({folded}, lower(trim(spelling))))",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION telemetry_convert(value DOUBLE, source STRING, target STRING) RETURNS DOUBLE RETURN CASE
        WHEN value IS NULL OR source IS NULL OR target IS NULL THEN NULL
        WHEN {a} IS NULL OR {b} IS NULL THEN {fail("unknown unit: ")} WHEN {a}.dimension <> {b}.dimension THEN {fail("different dimensions: ")}
        WHEN {a}.unit = {b}.unit THEN value WHEN NOT {a}.convertible THEN {fail("not convertible: ")}
        ELSE (value * {a}.factor + {a}.offset - {b}.offset) / {b}.factor END""",
        f"""CREATE OR REPLACE TEMPORARY FUNCTION telemetry_can_convert(source STRING, target STRING) RETURNS BOOLEAN RETURN CASE
        WHEN source IS NULL OR target IS NULL THEN NULL ELSE coalesce({a}.dimension = {b}.dimension AND ({a}.unit = {b}.unit OR {a}.convertible), false) END""",
    ]


TABLE_FUNCTIONS = {
    "telemetry_files": Files, "telemetry_samples": Samples, "telemetry_metadata": Metadata, "telemetry_file_metadata": FileMetadata, "telemetry_session_metadata": SessionMetadata, "telemetry_column_comments": ColumnComments,
    "telemetry_units": Units, "write_telemetry": WriteTelemetry, "telemetry_convert_column": ConvertColumn, "read_telemetry_session": ReadSession,
    **{name: wide_function(only) for name, only in (("read_telemetry", None), ("read_aim", "aimd"), ("read_aimd", "aimd"), ("read_cosworth", "pds"), ("read_motec", "motec"), ("read_vbo", "vbo"))},
}


def install(spark: SparkSession) -> None:
    """Registers the data source, the table functions, the unit functions and the view ``telemetry_units``."""
    recordings.register(spark)
    for name, f in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, f)
    for statement in _unit_functions():
        spark.sql(statement)
    units.units_table(spark).createOrReplaceTempView("telemetry_units")
