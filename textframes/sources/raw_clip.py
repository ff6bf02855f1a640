"""A Python data source for raw clips: a header line and frames of gray, rgb or packed 4:2:0 bytes.

Header (ASCII, one line): `RAWCLIP w h fmt color_range fps_numerator fps_denominator`. Frames follow
without gaps. Options: path (a file, or a folder of clips, that every executor can read), clip_id
(default: the file), start, end, stride, roi (`x1,y1,x2,y2`, closed), fmt (`gray` or `nv12`), rows
(frames of a partition), filters (`true`: take bounds on fi from filters, which needs
spark.sql.python.filterPushdown.enabled). Range, stride, region and format are taken in the reader, so
that other bytes are not read into rows.

Samples for a plan (`halo` set to `true`): rows also have k (the sample's number), part (the
partition's number in its clip) and own; a partition begins with the last sample of the one before (own is
false). first: only so many samples at the start of each of `chunks` parts of a clip. spread: only about
so many samples, at equal steps.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from textframes.functions.arrays import expand_range, gray
from textframes.operators.segments import chunk_bounds
from textframes.sources.clips import FRAMES, HALO

MAGIC = "RAWCLIP"


def write_clip(path: str, frames: np.ndarray, fmt: str, color_range: int = 1, fps: tuple[int, int] = (30, 1)) -> None:
    """frames: (n, h, w, channels), or (n, rows, w) for nv12."""
    h, w = (frames.shape[1] * 2 // 3, frames.shape[2]) if fmt == "nv12" else frames.shape[1:3]
    with open(path, "wb") as f:
        f.write(f"{MAGIC} {w} {h} {fmt} {color_range} {fps[0]} {fps[1]}\n".encode())
        f.write(np.ascontiguousarray(frames, np.uint8).tobytes())


def write_clips(frames: DataFrame, folder: str, write: Callable = write_clip, **options: object) -> DataFrame:
    """Writes each clip of a table of frames to a file of its own in a folder that all tasks share: clip_id, frames of each.

    Frames of a clip go to one task in order, so a clip must fit a task's memory: long recordings are
    many clips. A file appears whole, under the clip's name, and a task that runs again writes the same.
    """
    columns = ("clip_id", "fi", "w", "h", "fmt", "color_range", "data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clip, held = None, []
        os.makedirs(folder, exist_ok=True)

        def put() -> pa.RecordBatch:
            _, w, h, fmt, color_range, _ = held[0]
            shape = (-1, w) if fmt == "nv12" else (h, w, 3 if fmt == "rgb" else 1)
            g = np.stack([np.frombuffer(x[-1], np.uint8).reshape(shape) for x in held])
            temporary = os.path.join(folder, f".{clip}.{os.getpid()}")
            write(temporary, g, fmt, color_range, **options)
            os.replace(temporary, os.path.join(folder, clip))
            return pa.RecordBatch.from_arrays([pa.array([clip]), pa.array([len(held)], pa.int64())], ["clip_id", "frames"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                if row[0] != clip:
                    if held:
                        yield put()
                    clip, held = row[0], []
                held.append(row[1:])
        if held:
            yield put()

    dealt = frames.where("data is not null").select(*columns).repartition("clip_id").sortWithinPartitions("clip_id", "fi")
    return dealt.mapInArrow(run, "clip_id string, frames bigint")


class Header:
    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            line = f.readline(200)
        magic, w, h, self.fmt, color_range, num, den = line.decode("ascii").split()
        if magic != MAGIC:
            raise ValueError(f"{path} is no raw clip")
        self.w, self.h, self.color_range, self.offset = int(w), int(h), int(color_range), len(line)
        self.fps = int(num) / int(den) if int(num) > 0 and int(den) > 0 else 30.0
        rows = self.h + (self.h + 1) // 2 if self.fmt == "nv12" else self.h
        self.size = rows * self.w * (3 if self.fmt == "rgb" else 1)
        self.frames = (os.path.getsize(path) - self.offset) // self.size


class RawClips(DataSource):
    @classmethod
    def name(cls) -> str:
        return "rawclip"

    def schema(self) -> str:
        return HALO if self.options.get("halo") == "true" else FRAMES

    def reader(self, schema) -> RawClipReader:  # noqa: ANN001
        return (FilteringReader if self.options.get("filters") == "true" else RawClipReader)(self.options)


class RawClipReader(DataSourceReader):
    #: Frames of a batch.
    BATCH = 16
    #: Ranges up to which each is a partition of its own. Of more, short ones share partitions, each up to so many frames and bytes.
    ALONE, FILLED, FILLED_BYTES = 32, 8192, 32 << 20

    def __init__(self, options: dict) -> None:
        self.path, self.clip = options["path"], options.get("clip_id")
        self.start, self.end = int(options.get("start", 0)), int(options.get("end", 0))
        self.stride, self.rows = max(1, int(options.get("stride", 1))), int(options.get("rows", 512))
        self.roi = tuple(map(int, options["roi"].split(","))) if options.get("roi") else None
        self.fmt = options.get("fmt", "")
        self.halo, self.first, self.spread, self.chunks = options.get("halo") == "true", int(options.get("first", 0)), int(options.get("spread", 0)), int(options.get("chunks", 0))
        self.least, self.most = 0, 1 << 62

    def files(self) -> list[str]:
        return sorted(str(p) for p in Path(self.path).iterdir() if p.is_file() and not p.name.startswith(".")) if os.path.isdir(self.path) else [self.path]

    def clip_id(self, file: str) -> str:
        return self.clip or (os.path.basename(file) if os.path.isdir(self.path) else self.path)

    def samples(self, head: Header) -> int:
        """Samples of a file in the range."""
        end = min(head.frames, self.end or head.frames)
        return max(0, -(-(end - self.start) // self.stride))

    def spans(self, n: int, head: Header | None = None) -> list[tuple[int, int, int]]:
        """First sample, end and step of what is read of n samples, for each partition."""
        if self.first:
            bounds = chunk_bounds(n, self.chunks) if self.chunks and n else [(0, n)]
            return [(a, min(b, a + self.first), 1) for a, b in bounds]
        if self.spread:
            step = max(1, n // self.spread)
            return [(0, min(n, step * self.spread), step)]
        least = max(0, -(-(self.least - self.start) // self.stride))
        most = min(n, max(0, -(-(self.most - self.start) // self.stride)))
        return [(at, min(at + self.rows, most), 1) for at in range(least, most, self.rows)]

    def partitions(self) -> list[InputPartition]:
        spans, sizes = [], []
        for file in self.files():
            head = self.header(file)
            for part, (a, b, step) in enumerate(self.spans(self.samples(head), head)):
                if b > a:
                    spans.append((file, a, b, step, part))
                    sizes.append((-(-(b - a) // step), -(-(b - a) // step) * head.size))
        most = (0, 0) if len(spans) <= self.ALONE else (min(self.FILLED, sum(n for n, _ in sizes) // self.ALONE), self.FILLED_BYTES)
        out: list[list[tuple]] = []
        frames = size = 0
        for span, (n, m) in zip(spans, sizes, strict=True):
            if not out or frames + n > most[0] or size + m > most[1]:
                out.append([])
                frames = size = 0
            out[-1].append(span)
            frames, size = frames + n, size + m
        return [InputPartition((*first, tuple(rest))) for first, *rest in out] or [InputPartition(("", 0, 0, 1, 0, ()))]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        last = head = None
        for span in (partition.value[:5], *partition.value[5]):
            if span[2] <= span[1]:
                continue
            if span[0] != last:
                last, head = span[0], self.header(span[0])
            yield from self._span(head, *span)

    def _span(self, head: Header, file: str, begin: int, end: int, step: int, part: int) -> Iterator[pa.RecordBatch]:
        before = [begin - 1] if self.halo and begin and not self.first and not self.spread else []
        wanted = [*before, *range(begin, end, step)]
        for at in range(0, len(wanted), self.BATCH):
            k = wanted[at : at + self.BATCH]
            ids = [self.start + x * self.stride for x in k]
            more = [pa.array(k, pa.int64()), pa.array([part] * len(k), pa.int64()), pa.array([x >= begin for x in k])] if self.halo else []
            yield self.batch(head, self.clip_id(file), ids, self.frames(file, head, ids), more)

    @staticmethod
    def header(file: str) -> Header:
        return Header(file)

    def frames(self, file: str, head: Header, ids: list[int]) -> np.ndarray:
        """Bytes of frames, which are found by their place in the file."""
        with open(file, "rb") as f:
            raw = []
            for fi in ids:
                f.seek(head.offset + fi * head.size)
                raw.append(f.read(head.size))
        return np.frombuffer(b"".join(raw), np.uint8)

    def batch(self, head: Header, clip: str, ids: list[int], flat: np.ndarray, more: list[pa.Array]) -> pa.RecordBatch:
        fmt, frames = self.taken(head, flat)
        h, w = (head.h, frames.shape[2]) if fmt == "nv12" and not self.roi else (self.roi[3] - self.roi[1] + 1, frames.shape[2]) if self.roi else frames.shape[1:3]
        n, data = len(ids), [np.ascontiguousarray(x).tobytes() for x in frames]
        columns = [pa.array([clip] * n, pa.string()), pa.array(ids, pa.int64()), pa.array([w] * n, pa.int32()), pa.array([h] * n, pa.int32()),
                   pa.array([fmt] * n, pa.string()), pa.array([head.color_range] * n, pa.int8()), pa.array(data, pa.binary()), *more]
        return pa.RecordBatch.from_arrays(columns, ["clip_id", "fi", "w", "h", "fmt", "color_range", "data", "k", "part", "own"][: len(columns)])

    def taken(self, head: Header, flat: np.ndarray) -> tuple[str, np.ndarray]:
        """Frames in the format asked for, cut to the region. `nv12` of a clip that isn't falls back to gray."""
        if head.fmt == "nv12":
            frames = flat.reshape(-1, head.h + (head.h + 1) // 2, head.w)
            if self.fmt == "gray":
                plane = expand_range(frames[:, : head.h], head.color_range)[..., None]
                return "gray", self.cut(plane)
            return "nv12", cut_packed(frames, head.h, self.roi) if self.roi else frames
        frames = self.cut(flat.reshape(-1, head.h, head.w, 3 if head.fmt == "rgb" else 1))
        if self.fmt in ("gray", "nv12") and head.fmt == "rgb":
            return "gray", gray(frames)[..., None]
        return head.fmt, frames

    def cut(self, frames: np.ndarray) -> np.ndarray:
        if not self.roi:
            return frames
        x1, y1, x2, y2 = self.roi
        return frames[:, y1 : y2 + 1, x1 : x2 + 1]


class FilteringReader(RawClipReader):
    """Also takes bounds on fi from filters; Spark refuses such a reader unless spark.sql.python.filterPushdown.enabled is set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on fi narrow the range; Spark still applies all filters."""
        for f in filters:
            if getattr(f, "attribute", None) == ("fi",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, EqualTo | GreaterThanOrEqual):
                    self.least = max(self.least, f.value)
                if isinstance(f, GreaterThan):
                    self.least = max(self.least, f.value + 1)
                if isinstance(f, EqualTo | LessThanOrEqual):
                    self.most = min(self.most, f.value + 1)
                if isinstance(f, LessThan):
                    self.most = min(self.most, f.value)
            yield f


def cut_packed(frames: np.ndarray, h: int, roi: tuple[int, ...]) -> np.ndarray:
    """The closed box of packed 4:2:0 frames (n, rows, w), packed again.

    Luma is exact; a 2 x 2 block of the box has the chroma of its first pixel.
    """
    x1, y1, x2, y2 = roi
    y2 = min(y2, h - 1)
    luma = frames[:, y1 : y2 + 1, x1 : x2 + 1]
    n, rows, w = luma.shape
    out = np.full((n, rows + (rows + 1) // 2, w), 128, np.uint8)
    out[:, :rows] = luma
    last = frames.shape[2] // 2 - 1  # an odd last column has no chroma
    for i in range((rows + 1) // 2):
        for j in range(w // 2):
            y, x = h + (y1 + 2 * i) // 2, (x1 + 2 * j) // 2
            if x <= last:
                out[:, rows + i, 2 * j : 2 * j + 2] = frames[:, y, 2 * x : 2 * x + 2]
    return out


def open_clip(spark: SparkSession, path: str, *, gray_output: bool = False, yuv_output: bool = False, roi: tuple | None = None,
              start: int = 0, end: int | None = None, stride: int = 1, clip_id: str | None = None, source: type[DataSource] = RawClips, **more: object) -> DataFrame:
    """Frames of a clip, or of all clips in a folder. Formats: packed 4:2:0 before gray before what is stored. more: further options."""
    spark.dataSource.register(source)
    reader = spark.read.format(source.name()).option("path", path).option("start", start).option("end", end or 0).option("stride", stride)
    reader = reader.option("filters", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if yuv_output or gray_output:
        reader = reader.option("fmt", "nv12" if yuv_output else "gray")
    if roi is not None:
        reader = reader.option("roi", ",".join(map(str, roi)))
    for name, value in more.items():
        reader = reader.option(name, str(value).lower())
    return (reader.option("clip_id", clip_id) if clip_id else reader).load()
