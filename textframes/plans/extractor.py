"""The whole plan: frames of a fixed region in, text segments out."""

from __future__ import annotations

import functools
import resource
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textframes.functions.arrays import nv12_to_rgb
from textframes.operators import features as feats
from textframes.operators import scan
from textframes.operators import segments as segs
from textframes.operators.features import shaped
from textframes.operators.recognise import Recogniser, StandIn, recognise
from textframes.operators.timing import Clock
from textframes.plans.settings import resolved
from textframes.sources.coded_clip import source_of
from textframes.sources.frames import FileFrames, TableFrames
from textframes.sources.shared import few, removed, saved


@dataclass
class ExtractedSegment:
    """Frames start to end with one text, and the representative frame it was read from."""

    start: int
    end: int
    frames: tuple = ()
    rep_frame: int = -1
    text: str | None = None
    confidence: float = 0.0
    rep_crop: Any = None


@dataclass
class ExtractionResult:
    segments: list = field(default_factory=list)
    frames: list = field(default_factory=list)
    fps: float = 0.0
    timing: dict = field(default_factory=dict)
    meta: dict = field(default_factory=dict)


@dataclass
class Options:
    """What the plan computes; checked when made.

    roi: closed box x1, y1, x2, y2, or None for frames that are cut already. threshold: `first`
    (median over the first samples), `strided` or `pooled`. merge: fold similar neighbours.
    chunks: 0, or the number of parts that each clip is calibrated and segmented in alone.
    """

    roi: tuple[int, int, int, int] | None = None
    frame_start: int = 0
    frame_end: int | None = None
    sample_stride: int = 1
    change: float = segs.CHANGE
    gamma: float = 0.0
    threshold: str = "first"
    merge: bool = True
    merge_threshold: float = segs.SIMILAR
    merge_separation: str = "binary"
    chunks: int = 0
    keep_frames: bool = True
    keep_crops: bool = True
    force_aspect: float = 0.0
    fill_width: int = 224
    input_gamma: float = 2.0
    input_separation: str = ""
    batch_rows: int = 16

    def __post_init__(self) -> None:
        if self.roi is not None:
            if len(self.roi) != 4:
                raise ValueError(f"roi needs four values, got {len(self.roi)}")
            x1, y1, x2, y2 = self.roi
            if min(self.roi) < 0:
                raise ValueError(f"roi must not be negative: {self.roi}")
            if x2 <= x1 or y2 <= y1:
                raise ValueError(f"roi needs x2 > x1 and y2 > y1: {self.roi}")
        if self.frame_start < 0:
            raise ValueError(f"frame_start must not be negative: {self.frame_start}")
        if self.frame_end and self.frame_end <= self.frame_start:
            raise ValueError(f"frame_end must be above frame_start, or 0 for the end: {self.frame_start}, {self.frame_end}")
        self.sample_stride = max(1, int(self.sample_stride))

    def most_changed(self, w: int, h: int) -> int:
        if self.roi is not None:
            w, h = self.roi[2] - self.roi[0] + 1, self.roi[3] - self.roi[1] + 1
        return max(32, int(w * h * 0.01))


def check_chunks(found: set[int], n: int, chunks: int) -> None:
    """Raises if a chunk of a clip of n samples has no result."""
    want = len(segs.chunk_bounds(n, chunks))
    if found != set(range(want)):
        raise RuntimeError(f"chunks without a result: {len(found)} of {want} are there")


def merged_timings(parts: list[dict]) -> dict[str, float]:
    """Timings of parts that ran beside each other: sums of what is a number, but of `ocr` the longest."""
    out: dict[str, float] = {}
    for part in parts:
        for k, v in part.items():
            if isinstance(v, (int, float)):
                out[k] = max(out.get(k, 0.0), float(v)) if k == "ocr" else out.get(k, 0.0) + float(v)
    return out


def rss_mb() -> float:
    """The driver's Python memory at its largest, in MB."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


class SegmentPlan:
    """DataFrames of each stage; nothing runs until one is asked for.

    frames: a table of frames, or a source (sources/frames.py). Few samples of each clip are read first, for its
    threshold; then all samples once, by ranges that know the sample before them: features, scores and
    the segments of ranges come out of the task that reads them, with one plane for each segment. The frames of
    representatives are fetched by number when the segments are known. What is written to the shared
    folder is removed by close(), after which the plan's tables can't be read.
    """

    def __init__(self, frames: DataFrame | TableFrames | FileFrames, options: Options | None = None, size: tuple[int, int] | None = None, clock: Clock | None = None) -> None:
        self.options = o = options or Options()
        self.source = TableFrames(frames, o.roi, o.frame_start, o.frame_end, o.sample_stride) if isinstance(frames, DataFrame) else frames
        self.keys = ("clip_id", "chunk") if o.chunks else ("clip_id",)
        self._size, self._clock, self._paths = size or (0, 0), clock, []

    def close(self) -> None:
        """Removes what the plan wrote."""
        removed(self.source.spark, self._paths)

    @property
    def samples(self) -> DataFrame:
        return self.source.samples

    @property
    def features(self) -> DataFrame:
        """Of every sample (FEATURES), for those who want them: the plan itself doesn't read them."""
        return feats.frame_features(self.samples, self.options.gamma)

    @functools.cached_property
    def thresholds(self) -> DataFrame:
        kind, n = self.options.threshold, feats.CALIBRATION
        some = self.source.spread(n) if kind == "strided" else self.source.first(n, self.options.chunks)
        few_ = feats.frame_features(some, self.options.gamma, more="chunk" if self.options.chunks else "")
        return saved(feats.pooled_thresholds(few_) if kind == "pooled" else feats.median_thresholds(few_, self.keys), "thresholds", self._paths)

    @functools.cached_property
    def _ranges(self) -> tuple[DataFrame, bool]:
        """Samples by ranges, with at: the sample's number in its clip; and whether they come in order."""
        rows, chunks = self.source.ranges().withColumn("at", F.col("k")), self.options.chunks
        if not chunks:
            return rows, self.source.ordered
        totals = self.source.totals()
        measured = few(totals)
        return segs.with_chunks(rows, chunks, totals=measured), self.source.ordered and measured is not totals

    @functools.cached_property
    def scores(self) -> DataFrame:
        rows, ordered = self._ranges
        return scan.change_scores(rows, self.thresholds, self.keys, self.options.gamma, ordered)

    @functools.cached_property
    def raw_segments(self) -> DataFrame:
        """Segments before the merge, with the plane of each representative if there is one to come."""
        o = self.options
        rows, ordered = self._ranges
        ranges = scan.range_segments(rows, self.thresholds, o.change, self.keys, o.gamma, True, o.merge, self._clock, ordered)
        return saved(segs.joined_segments(saved(ranges, "ranges", self._paths), self.keys), "segments", self._paths)

    @functools.cached_property
    def segments(self) -> DataFrame:
        o, raw = self.options, self.raw_segments
        if not o.merge:
            return raw.drop("h", "w", "luma")
        ids = segs.merged_ids(raw, self.thresholds, o.merge_separation, o.merge_threshold, o.most_changed(*self._size), self.keys, self._paths)
        return segs.merge(raw.drop("h", "w", "luma"), ids, self.keys)

    @functools.cached_property
    def _written(self) -> DataFrame:
        return saved(self.segments, "merged", self._paths) if self.options.merge else self.segments

    def _picked(self) -> DataFrame:
        """keys, seg, rep_frame and the crop of each segment's representative, read from the source now."""
        return self.source.fetch(self._written.select(*self.keys, "seg", "rep_frame"), self._clock)

    def representatives(self) -> DataFrame:
        """clip_id, keys, seg, w, h, fmt, color_range, data of each segment's representative."""
        return self._picked().select(*self.keys, F.col("rep_frame").alias("fi"), "seg", "w", "h", "fmt", "color_range", "data")

    def texts(self, make: Callable[[], Recogniser] = StandIn) -> DataFrame:
        """Segments with text and confidence: one recognition for each segment that is left, in the pass that fetches its crop.

        A chunk's segments get numbers that are unique in the clip and in order.
        """
        o = self.options
        read = recognise(self._picked(), make, o.force_aspect, o.input_gamma, o.input_separation, o.fill_width, o.batch_rows, self._clock)
        crop_ = [F.col("data").alias("rep_crop")] if o.keep_crops else [F.lit(None).cast("binary").alias("rep_crop")]
        read = read.select(*self.keys, "seg", "text", "confidence", "w", "h", "fmt", *crop_)
        frames = F.col("frames") if o.keep_frames else F.array().cast("array<bigint>").alias("frames")
        out = self._written.select(*self.keys, "seg", "start", "end", "n", "rep_frame", frames).join(read, [*self.keys, "seg"])
        return out.withColumn("seg", F.col("chunk").cast("bigint") * (1 << 32) + F.col("seg")) if o.chunks else out


class FieldExtractor:
    """One clip's segments as Python objects; for many clips or large ones use SegmentPlan.

    video: a DataFrame of frames, or the path of a clip in a file. C: the change score from which a segment
    ends. dual_pipeline: calibrate and segment the clip in dual_pipeline_chunks (0: four) parts alone.
    dual_backends, decode_backend and ocr_backend are kept in the result's metadata: there is one kind
    of executor. Session and environment may set some options (settings.HOOKS); what they set is noted in the
    metadata. progress and cancelled are called again and again while Spark runs: progress with the share of samples
    that tasks have done; an exception of cancelled ends the run.
    """

    #: Seconds between calls; percent of the way when all samples are segmented.
    POLL, SEGMENTED = 0.5, 80.0

    def __init__(self, video: DataFrame | str, roi: tuple | None = None, *, recogniser: Callable[[], Recogniser] = StandIn, fps: float | None = None,
                 progress: Callable[[str, float], None] | None = None, cancelled: Callable[[], Any] | None = None, C: float | None = None,
                 gray_output: bool = False, yuv_output: bool = False, dual_pipeline: bool | None = None, dual_pipeline_chunks: int = 0,
                 dual_backends: list | None = None, decode_backend: str = "auto", ocr_backend: str = "auto", profile: bool | None = None, **options: Any) -> None:
        self._video, self._fps, self._make = video, fps if fps and fps > 0 else 30.0, recogniser
        self._progress, self._cancelled, self._says = progress or (lambda *_: None), cancelled or (lambda: None), progress is not None
        self._formats = {"gray_output": gray_output, "yuv_output": yuv_output}
        spark = SparkSession.getActiveSession() if isinstance(video, str) else video.sparkSession
        options, self.settings = resolved(options | {"dual_pipeline": dual_pipeline, "profile": profile}, spark)
        self._profile = options.pop("profile", True)
        if C is not None:
            options["change"] = C
        if options.pop("dual_pipeline", False):
            options["chunks"] = max(0, int(dual_pipeline_chunks or 0)) or 4
        self._threads = options.pop("threads", None)
        self.options = Options(roi=tuple(roi) if roi is not None else None, **options)
        pairs = [tuple(map(str, x)) for x in dual_backends] if dual_backends else [(decode_backend, ocr_backend)]
        self._backends = pairs[:2]
        self.timing: dict[str, Any] = {}
        self.segment_frames: list = []
        self.ocr_texts: list = []
        self.ocr_confidences: list = []
        self.ocr_values: list = []
        self.corrected_values: list = []
        self.confidence_values: list = []
        self.n_corrected = 0
        self.frames: list = []
        self.segments: list[ExtractedSegment] = []

    @property
    def n_segments(self) -> int:
        return len(self.segments)

    def _plan(self, clock: Clock) -> tuple[SegmentPlan, str]:
        frames, o, codec = self._video, self.options, "raw"
        if isinstance(frames, str):
            source = source_of(frames)
            head = source({"path": frames}).reader(None).header(frames)
            self._fps, codec, size = head.fps, head.fmt, (head.w, head.h)
            # the reader takes the region and the range
            frames = FileFrames(SparkSession.active(), frames, o.roi, o.frame_start, o.frame_end, o.sample_stride, "clip", source, **self._formats)
        elif o.roi is None:
            first = frames.select("w", "h").head(1)
            size = (first[0]["w"], first[0]["h"]) if first else None
        else:
            size = None  # of no use: the region's counts
        return SegmentPlan(frames, o, size, clock), codec

    def _recogniser(self) -> Callable[[], Recogniser]:
        make, threads = self._make, self._threads

        def made() -> Recogniser:
            own = make()
            if threads and hasattr(own, "threads"):
                own.threads = threads
            return own

        return made

    def _watched(self, spark: SparkSession, work: Callable[[], Any], clock: Clock, total: Callable[[], int]) -> Any:
        """What work returns, run in a job group of its own beside calls of progress and cancelled."""
        import uuid

        from pyspark import InheritableThread

        group, out = f"extract-{uuid.uuid4().hex}", {}

        def run() -> None:
            spark.sparkContext.setJobGroup(group, "extract", True)
            try:
                out["value"] = work()
            except BaseException as e:  # noqa: BLE001  raised again by the caller
                out["error"] = e

        thread = InheritableThread(target=run)
        thread.start()
        done = 0.0
        while thread.is_alive():
            thread.join(self.POLL)
            try:
                self._cancelled()
            except BaseException:
                spark.sparkContext.cancelJobGroup(group)
                thread.join()
                raise
            seen, of = clock.samples, total()
            done = max(done, min(self.SEGMENTED, self.SEGMENTED * seen / of) if of else 0.0)
            self._progress(f"{seen} samples", done)
        if "error" in out:
            raise out["error"]
        return out["value"]

    def extract(self) -> ExtractionResult:
        """Runs the plan and collects its segments. A range without frames, or a chunk without segments, is an error."""
        began = time.perf_counter()
        self._cancelled()
        spark = SparkSession.active() if isinstance(self._video, str) else self._video.sparkSession
        clock, n = Clock(spark.sparkContext), [0]

        def work() -> tuple[list[dict], str]:
            plan, codec = self._plan(clock)
            try:
                if self._says:
                    n[0] = sum(r["n"] for r in plan.source.totals().collect())  # one clip
                return [r.asDict() for r in plan.texts(self._recogniser()).collect()], codec
            finally:
                plan.close()

        rows, codec = self._watched(spark, work, clock, lambda: n[0])
        if not rows:
            raise ValueError("no frame in the range")
        if self.options.chunks:
            check_chunks({r["chunk"] for r in rows}, sum(r["n"] for r in rows), self.options.chunks)
        rows.sort(key=lambda r: r["start"])
        keep = self.options.keep_frames
        for r in rows:
            crop_ = None
            if r["rep_crop"] is not None:
                crop_ = shaped([bytes(r["rep_crop"])], r["w"], r["h"], r["fmt"])[0]
            self.segments.append(ExtractedSegment(r["start"], r["end"], tuple(r["frames"]) if keep else (), r["rep_frame"], r["text"], r["confidence"], crop_))
        self.segment_frames = [list(s.frames) for s in self.segments]
        self.ocr_texts = [s.text for s in self.segments]
        self.ocr_confidences = [s.confidence for s in self.segments]
        self.frames = [f for s in self.segments for f in s.frames]
        self.timing |= {"total": time.perf_counter() - began, "rss_mb": rss_mb()} | (merged_timings(clock.parts) if self._profile else {})
        self._progress(f"{len(rows)} segments", 100.0)
        backend = "spark" if not self.options.chunks else "dual:spark"
        meta = {"n_segments": len(self.segments), "ocr_backend": getattr(self._make, "__name__", "custom"), "backend": backend, "codec": codec, "asked": self._backends, "settings": self.settings}
        return ExtractionResult(list(self.segments), list(self.frames), self._fps, dict(self.timing), meta)

    def prepare_review_rgb(self) -> None:
        """Turns packed 4:2:0 crops of the segments into rgb."""
        for s in self.segments:
            if s.rep_crop is not None and s.rep_crop.ndim == 2:
                s.rep_crop = nv12_to_rgb(s.rep_crop)

    def timing_flat(self) -> dict:
        return {k: v for k, v in self.timing.items() if isinstance(v, (int, float))}
