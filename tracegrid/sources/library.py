"""Summaries and stitched reads of a set of recordings: files, sessions, laps and drivers."""

from __future__ import annotations

from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.model import finite, normalised, round_half_away
from tracegrid.operators import events as ev
from tracegrid.operators import resample as rs
from tracegrid.operators import sessions as se
from tracegrid.operators.blocks import along, time_block
from tracegrid.runtime import bounded_rows, materialise
from tracegrid.sources.recordings import MOST_NAMES, open_recording, read, read_wide
from tracegrid.sources.summary import GPS_ITOW, GPS_WEEK, VIDEO_FILE, VIDEO_SYNC

_ROLES = {"driver": ev.DRIVER_NAMES, "lap": ev.LAP_NAMES, "timer": ev.TIMER_NAMES, "reference": ev.REFERENCE_NAMES, "reported": ev.REPORTED_NAMES, "week": GPS_WEEK, "itow": GPS_ITOW, "video_file": VIDEO_FILE, "video_sync": VIDEO_SYNC}
_PICK = ("only", "created_from", "created_to")


class Library:
    """The recordings that a path or pattern names; every relation is a DataFrame."""

    def __init__(self, spark: SparkSession, path: str, **pick: str) -> None:
        unknown = set(pick) - set(_PICK)
        if unknown:
            raise ValueError(f"unknown options: {', '.join(sorted(unknown))}")
        self.spark, self.path, self.pick = spark, path, pick
        self._semantic: DataFrame | None = None

    @cached_property
    def channels(self) -> DataFrame:
        """The definitions of all files; headers are read once and written, since every summary needs them."""
        return materialise(read(self.spark, self.path, "channels", **self.pick), "library-channels")

    @cached_property
    def files(self) -> DataFrame:
        return materialise(read(self.spark, self.path, "files", **self.pick), "library-files")

    def role(self, role: str) -> DataFrame:
        """(file, time_ns, value, duration_ns) of the first sampled channel of each file that plays a role."""
        if self._semantic is None:
            wanted = [n for names in _ROLES.values() for n in names]
            found = self.channels.where((F.col("sample_count") > 0) & normalised(F.col("name")).isin(wanted))
            names = [r[0] for r in bounded_rows(found.select("name").distinct(), MOST_NAMES, "spellings of role channels")]
            c = found.select("file", "channel_id", normalised(F.col("name")).alias("role_name"), "duration_ns")
            s = read(self.spark, self.path, "samples", channels=",".join(names) if names else ",", **self.pick).join(c, ["file", "channel_id"]) if names else None
            empty = "file string, channel_id bigint, time_ns bigint, value double, role_name string, duration_ns bigint"
            self._semantic = materialise(s.select("file", "channel_id", "time_ns", "value", "role_name", "duration_ns"), "semantic") if names else self.spark.createDataFrame([], empty)
        s = self._semantic.where(F.col("role_name").isin(*_ROLES[role]))
        first = s.groupBy("file").agg(F.min("channel_id").alias("channel_id"))
        return s.join(first, ["file", "channel_id"], "left_semi").select("file", "time_ns", "value", "duration_ns")

    def stints(self) -> DataFrame:
        return ev.driver_stints(self.role("driver"))

    def laps(self) -> DataFrame:
        """Laps of a running lap time that resets at least twice, else of a lap counter."""
        timer = ev.laps_from_timer(self.role("timer"), self.role("lap"))
        counter = ev.laps_from_counter(self.role("lap"))
        return timer.unionByName(counter.join(timer.select("file").distinct(), "file", "left_anti"))

    def fastest(self, laps: DataFrame) -> DataFrame:
        # The lap in which a reported time first stands is the one after it.
        r = ev.lap_at(self.role("reported").select("file", "time_ns", "value"), self.role("lap")).withColumnRenamed("lap", "number")
        return ev.fastest_lap(laps, ev.reference_lap(self.role("reference")), r)

    def clocks(self) -> DataFrame:
        """(file, session_key, absolute_start_ns, absolute_end_ns, absolute_clock): the declared start, else the GPS clock, else none."""
        hashes = se.schema_hash(self.channels).select("file", "schema_hash", se.hash_hex(F.col("schema_hash")).alias("hash_text"))
        f = self.files.join(hashes, "file").join(se.gps_clock(self.role("week"), self.role("itow")).withColumnRenamed("absolute_start_ns", "gps_start"), "file", "left")
        start = F.coalesce("absolute_start_ns", "gps_start")
        hint = F.coalesce("session_hint", F.when(F.col("absolute_start_ns").isNull() & F.col("gps_start").isNotNull(), F.concat(F.lit("gps:"), F.col("gps_week").cast("string"))))
        return f.select("file", "schema_hash", se.session_key(hint, F.col("hash_text")).alias("session_key"), start.alias("absolute_start_ns"), (start + F.col("duration_ns")).alias("absolute_end_ns"), F.coalesce("absolute_clock", F.when(F.col("gps_start").isNotNull(), "gps")).alias("absolute_clock"))

    def file_metadata(self) -> DataFrame:
        """One row per file: clock, counts, schema hash, drivers, laps, fastest lap, video frames and identity."""
        laps = materialise(self.laps(), "laps")
        drivers = self.stints().groupBy("file").agg(F.array_join(F.array_sort(F.collect_set("driver_id")).cast("array<string>"), ",").alias("driver_ids"))
        counts = laps.groupBy("file").agg(F.count(F.lit(1)).alias("lap_count"))
        best = self.fastest(laps).select("file", F.col("number").alias("fastest_lap_number"), F.col("duration_ns").alias("fastest_lap_time_ns"))
        f = self.files.drop("absolute_start_ns", "absolute_clock").join(self.clocks(), "file")
        for side in (drivers, counts, best):
            f = f.join(side, "file", "left")
        return f.select(
            "file", "format", "session_key", "absolute_start_ns", "absolute_end_ns", "duration_ns", "channel_count", "sampled_channel_count", "sample_count", "schema_hash", F.coalesce("driver_ids", F.lit("")).alias("driver_ids"),
            F.coalesce("lap_count", F.lit(0)).alias("lap_count"), "fastest_lap_number", "fastest_lap_time_ns", "video_frame_count", "driver", "vehicle", "venue", "event", "session", "date", "time", "absolute_clock",
        )

    def session_metadata(self, max_gap_seconds: int = 60) -> DataFrame:
        """One row per session of files that continue each other."""
        laps = materialise(self.laps(), "laps")
        return se.session_metadata(self.clocks().select("file", "session_key", "absolute_start_ns", "absolute_end_ns"), self.stints(), laps.select("file", "number", "start_ns", "end_ns"), max_gap_seconds, self.fastest(laps))

    def read_session(
        self, rate: int = 100, channels: str | None = None, interpolate: str = "linear", max_gap_seconds: int = 60, start_ns: int | None = None, end_ns: int | None = None, unit_tags: bool = False, channel_map: str | None = None, timestamps: bool = False
    ) -> DataFrame:
        """The wide relation on the clock of the one session that the files form.

        session_key, time_ns, file_time_ns, source_file, video_file_index,
        video_frame_index, video_sync_time, driver_id, lap_number and the channels;
        files that form no or more than one session are an error.  The named values
        are those of the last sample, before the first one its value, and NULL from
        the end of their channel on.
        """
        w = read_wide(self.spark, self.path, rate, channels, interpolate, channel_map=channel_map, filename=True, unit_tags=unit_tags, timestamps=timestamps, **self.pick).withColumnRenamed("filename", "file")
        shown = [c for c in w.columns if c not in ("file", "time_ns")]
        tags = {c: w.schema[c].metadata for c in shown}
        out = se.stitch(w, self.clocks().select("file", "session_key", "absolute_start_ns", "absolute_end_ns"), max_gap_seconds)
        out = rs.time_range(out, start_ns, end_ns)
        marks = {"driver_id": self.role("driver"), "lap_number": self.role("lap"), "video_file_index": self.role("video_file"), "video_sync_time": self.role("video_sync")}
        rows = out.withColumn("__k", F.lit(1)).unionByName(self.frames().select(F.col("file").alias("source_file"), F.col("time_ns").alias("file_time_ns"), F.lit(0).alias("__k"), F.col("frame_index").alias("__frame")), allowMissingColumns=True)
        for name, samples in marks.items():
            value = samples.select(F.col("file").alias("source_file"), F.col("time_ns").alias("file_time_ns"), F.lit(0).alias("__k"), F.struct("value", "duration_ns").alias(f"__{name}"))
            rows = rows.unionByName(value, allowMissingColumns=True)
        held = along(
            rows, ["source_file"], ["file_time_ns", "__k"], time_block("file_time_ns"),
            latest={"video_frame_index": F.col("__frame"), **{name: F.col(f"__{name}") for name in marks}}, upcoming={f"{name}_first": F.col(f"__{name}") for name in marks},
        ).where("__k = 1")
        at = lambda c: (lambda v: F.when((F.col("file_time_ns") < v["duration_ns"]) & finite(v["value"]), v["value"]))(F.coalesce(c, f"{c}_first"))
        whole = lambda c: round_half_away(at(c)).alias(c)
        video = F.when(at("video_file_index") >= 0, round_half_away(at("video_file_index"))).alias("video_file_index")
        return held.select("session_key", "time_ns", "file_time_ns", "source_file", video, "video_frame_index", at("video_sync_time").alias("video_sync_time"), whole("driver_id"), whole("lap_number"), *[F.col(f"`{c}`").alias(c, metadata=tags[c]) for c in shown])

    def frames(self) -> DataFrame:
        """(file, time_ns, frame_index): when each frame of the files' video tracks is shown, read where the files are read."""
        paths = self.files.where("video_frame_count > 0").select("file")

        def run(batches):
            for b in batches:
                for p in b.column("file").to_pylist():
                    t = open_recording(p, False).frames
                    yield pa.RecordBatch.from_arrays([pa.array([p] * len(t), pa.string()), pa.array(t, pa.int64()), pa.array(range(len(t)), pa.int64())], names=["file", "time_ns", "frame_index"])

        return paths.mapInArrow(run, "file string, time_ns bigint, frame_index bigint")
