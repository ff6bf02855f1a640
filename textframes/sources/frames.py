"""What a plan reads of a clip: samples by ranges, samples that set thresholds, and single frames later on."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textframes.operators.segments import with_chunks
from textframes.operators.timing import Clock
from textframes.sources.clips import crop, sample, with_halo
from textframes.sources.coded_clip import source_of
from textframes.sources.raw_clip import RawClips, open_clip
from textframes.sources.shared import few

#: What fetch() adds to its rows.
CROP = "w int, h int, fmt string, color_range tinyint, data binary"


class TableFrames:
    """Frames of a table (clips.FRAMES), in no order: samples move once, by ranges; single frames are fetched by a join."""

    ordered = False

    def __init__(self, frames: DataFrame, roi: tuple | None = None, start: int = 0, end: int | None = None, stride: int = 1) -> None:
        self.frames, self.roi, self.start, self.stride = frames, roi, start, max(1, int(stride))
        self.spark = frames.sparkSession
        self.samples = sample(self._cut(frames), start, end, stride).where("data is not null")

    def _cut(self, frames: DataFrame) -> DataFrame:
        return crop(frames, self.roi) if self.roi is not None else frames

    def totals(self) -> DataFrame:
        """clip_id, n: samples of each clip."""
        return self.samples.groupBy("clip_id").agg(F.count("*").alias("n"))

    def ranges(self) -> DataFrame:
        return with_halo(self.samples)

    def first(self, n: int, chunks: int = 0) -> DataFrame:
        """The first n samples of each clip, or of each of its chunks: a filter on fi, which a scan of files can use."""
        if chunks:
            return with_chunks(self.samples, chunks, totals=few(self.totals())).where(F.col("k") < n)
        return self.samples.where(F.col("fi") < self.start + n * self.stride)

    def spread(self, n: int) -> DataFrame:
        """About n samples of each clip, at equal steps."""
        steps = self.totals().select("clip_id", F.greatest(F.lit(1), F.floor(F.col("n") / n)).alias("_step"))
        return self.samples.join(few(steps), "clip_id").where((F.col("k") % F.col("_step") == 0) & (F.col("k") < F.col("_step") * n)).drop("_step")

    def fetch(self, wanted: DataFrame, clock: Clock | None = None) -> DataFrame:
        """wanted (clip_id, rep_frame and more) with the frame's w, h, fmt, color_range and data."""
        ids = few(wanted.withColumnRenamed("rep_frame", "fi"))
        return self._cut(self.frames.join(ids, ["clip_id", "fi"])).withColumnRenamed("fi", "rep_frame")


class FileFrames:
    """Clips in files: a partition of the reader is a range of samples in order, and a frame is found by its place in its file."""

    ordered = True

    def __init__(self, spark: SparkSession, path: str, roi: tuple | None = None, start: int = 0, end: int | None = None, stride: int = 1,
                 clip_id: str | None = None, source: type[RawClips] | None = None, rows: int = 512, **formats: bool) -> None:
        self.spark, self.path, self.clip, self.source = spark, path, clip_id, source or source_of(path)
        self.options = {"roi": roi, "start": start, "end": end, "stride": stride, "clip_id": clip_id, "source": self.source} | formats
        self.rows = rows

    def _open(self, **more: object) -> DataFrame:
        return open_clip(self.spark, self.path, halo=True, rows=self.rows, **self.options, **more)

    def _reader(self) -> object:
        o = self.options
        text = {"path": self.path, "start": str(o["start"]), "end": str(o["end"] or 0), "stride": str(o["stride"]), "rows": str(self.rows)}
        if o["roi"] is not None:
            text["roi"] = ",".join(map(str, o["roi"]))
        if o.get("yuv_output") or o.get("gray_output"):
            text["fmt"] = "nv12" if o.get("yuv_output") else "gray"
        if self.clip:
            text["clip_id"] = self.clip
        return self.source(text).reader(None)

    def totals(self) -> DataFrame:
        reader = self._reader()
        rows = [(reader.clip_id(f), reader.samples(reader.header(f))) for f in reader.files()]
        return self.spark.createDataFrame([r for r in rows if r[1]], "clip_id string, n bigint")

    def ranges(self) -> DataFrame:
        return self._open()

    def first(self, n: int, chunks: int = 0) -> DataFrame:
        rows = self._open(first=n, chunks=chunks)
        return with_chunks(rows, chunks, totals=few(self.totals())) if chunks else rows

    def spread(self, n: int) -> DataFrame:
        return self._open(spread=n)

    def fetch(self, wanted: DataFrame, clock: Clock | None = None) -> DataFrame:
        """wanted with the frames' crops. Only ids move, so that a task reads frames of a file in order."""
        reader, schema = self._reader(), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in wanted.schema.fields)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            file_of = {reader.clip_id(f): f for f in reader.files()}
            heads: dict = {}
            for batch in batches:
                clip, fi = batch.column("clip_id").to_pylist(), batch.column("rep_frame").to_pylist()
                at = 0
                while at < len(clip):
                    to = at + 1
                    while to < len(clip) and to - at < reader.BATCH and clip[to] == clip[at]:
                        to += 1
                    began = time.perf_counter()
                    file = file_of[clip[at]]
                    if file not in heads:
                        heads[file] = reader.header(file)
                    head = heads[file]
                    got = reader.batch(head, clip[at], fi[at:to], reader.frames(file, head, fi[at:to]), [])
                    if clock:
                        clock.add("fetch", time.perf_counter() - began)
                    own = batch.slice(at, to - at)
                    yield pa.RecordBatch.from_arrays([*own.columns, *(got.column(c) for c in ("w", "h", "fmt", "color_range", "data"))], [*own.schema.names, "w", "h", "fmt", "color_range", "data"])
                    at = to

        ordered = wanted.repartitionByRange("clip_id", "rep_frame").sortWithinPartitions("clip_id", "rep_frame")
        return ordered.mapInArrow(run, f"{schema}, {CROP}")
