"""One query for each operator, over the clip that is made of `embeddings`."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textframes.functions import arrays, columns
from textframes.operators import ctc, features, segments
from textframes.operators.recognise import LinearRecogniser
from textframes.plans.extractor import Options, SegmentPlan
from textframes.sources import clips, coded_clip, raw_clip
from textframes.sources.frames import FileFrames
from textframes.sources.shared import shared_path

Query = Callable[[SparkSession, str], DataFrame]
#: A threshold of similarity at which 8 x 8 frames merge, and at which the order of merging matters.
LOOSE = 90.0
#: Frames that a numpy function gets together: bounds a worker's memory, whatever the rows of a batch.
TOGETHER = 128


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")


def clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.clip_of_vectors(vectors(spark, sf_dir))


def plan(spark: SparkSession, sf_dir: str, **options) -> SegmentPlan:
    return SegmentPlan(clip(spark, sf_dir), Options(**options), (8, 8))


def _pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.pixels(clip(spark, sf_dir)).drop("clip_id")


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.frame_features(clips.sample(clip(spark, sf_dir)))


def _values(df: DataFrame, make: Callable[[np.ndarray], np.ndarray], names: str = "v", shape: tuple[int, int] = (8, 8)) -> DataFrame:
    """fi, y, x and a column for each name: a numpy function of frames (n, *shape), TOGETHER at most at once.

    It gives whole numbers (n, h, w), or (n, h, w, names).
    """
    columns = names.split()

    def run(batches):
        for batch in (whole.slice(at, TOGETHER) for whole in batches for at in range(0, whole.num_rows, TOGETHER)):
            out = make(np.frombuffer(b"".join(batch.column("data").to_pylist()), np.uint8).reshape(-1, *shape)).astype(np.int64)
            out = out.reshape(*out.shape[:3], len(columns))
            n, h, w, _ = out.shape
            y, x = np.divmod(np.arange(h * w, dtype=np.int32), np.int32(w))
            fi = np.repeat(batch.column("fi").to_numpy(zero_copy_only=False), h * w)
            values = [pa.array(out[..., k].ravel()) for k in range(len(columns))]
            yield pa.RecordBatch.from_arrays([pa.array(fi), pa.array(np.tile(y, n)), pa.array(np.tile(x, n)), *values], ["fi", "y", "x", *columns])

    return df.select("fi", "data").mapInArrow(run, "fi bigint, y int, x int, " + ", ".join(f"{c} bigint" for c in columns))


def _planes(df: DataFrame, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """fi, y, x, v: as _values, in thousandths, rounded half up."""
    return _values(df, lambda g: np.floor(make(g).astype(np.float64) * 1000 + 0.5))


def luma_range_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("fi", "y", "x", columns.expand_range(F.col("g"), 0).alias("limited"), columns.expand_range(F.col("g"), 1).alias("full"))


def rgb_to_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pixels(spark, sf_dir)
    return p.select("fi", "y", "x", columns.gray(F.col("g"), 255 - F.col("g"), (F.col("g") * 7) % 256).alias("gray"))


def seg_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(spark, sf_dir).select("fi", "y", "x", columns.curve(F.col("g"), 2.0).alias("out"))


def luma_plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = clip(spark, sf_dir)  # eight rows of packed 4:2:0: five of luma
    return _planes(packed, arrays.luma_plane)


def roi_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.pixels(clips.crop(clip(spark, sf_dir), (1, 2, 5, 6))).drop("clip_id")


def sample_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clips.sample(clip(spark, sf_dir), 10, None, 7).select("fi", "k")


def stride_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", columns.stride(F.col("vec_id") % 7 - 3).alias("stride"))


def sharpness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("fi", F.round("sharp", 6).alias("sharp"))


def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.histogram(_pixels(spark, sf_dir), "fi")


def otsu_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir).select("fi", F.col("otsu").alias("threshold"))


def otsu_frame_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.otsu(histogram(spark, sf_dir), "fi")


def otsu_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.pooled_thresholds(_features(spark, sf_dir)).select("threshold")


def clip_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.clip_thresholds(_features(spark, sf_dir)).select("threshold")


def clip_threshold_strided(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.clip_thresholds_strided(_features(spark, sf_dir)).select("threshold")


def binarize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = plan(spark, sf_dir)
    joined = clips.pixels(p.samples).join(p.thresholds, "clip_id")
    return joined.select("fi", "y", "x", (F.col("g") > F.col("threshold")).cast("int").alias("bit"))


def change_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir).scores.where("score is not null").select("fi", "score")


def _rows(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "seg", F.col("start").alias("start_fi"), F.col("end").alias("end_fi"), "rep_frame", "n")


def segments_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(plan(spark, sf_dir, merge=False).segments)


def segments_serial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(plan(spark, sf_dir, merge=False, threshold="strided").segments)


def segments_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(plan(spark, sf_dir, merge=False, threshold="pooled").segments)


def segments_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(plan(spark, sf_dir, merge=False, chunks=4).segments, "chunk")


def segments_chunked_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that are calibrated, segmented and merged alone, at a threshold that merges."""
    return _rows(plan(spark, sf_dir, merge_threshold=LOOSE, chunks=4).segments, "chunk")


def segment_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = plan(spark, sf_dir, merge=False).segments
    return s.select("seg", F.array_join(F.transform("frames", lambda f: f.cast("string")), ",").alias("frames"))


def rep_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan(spark, sf_dir, merge=False).segments.select("seg", "rep_frame")


def merge_anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(plan(spark, sf_dir, merge_threshold=LOOSE).segments)


def merge_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(plan(spark, sf_dir).segments)


def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring segments whose representatives are similar in binary mode, at 36."""
    p = plan(spark, sf_dir)
    reps = p.raw_segments.select("clip_id", "seg", "luma").join(p.thresholds, "clip_id")
    pairs = reps.select("seg", "luma", "threshold").join(reps.select((F.col("seg") - 1).alias("seg"), F.col("luma").alias("next")), "seg")

    def run(batches):
        for batch in batches:
            planes = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 8, 8) for c in ("luma", "next")]
            yes = arrays.similar_planes(*planes, "binary", batch.column("threshold").to_numpy(zero_copy_only=False), 36.0, 32)
            yield pa.RecordBatch.from_arrays([batch.column("seg"), pa.array(yes.astype(np.int32))], ["seg", "similar"])

    return pairs.mapInArrow(run, "seg bigint, similar int")


def mean_abs_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of each frame and the next, in thousandths."""
    f = _features(spark, sf_dir)
    pairs = f.select("k", "luma").join(f.select((F.col("k") - 1).alias("k"), F.col("luma").alias("next")), "k")

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, 64).astype(np.float64) for c in ("luma", "next"))
            v = np.floor(np.abs(a - b).mean(axis=1) * 1000 + 0.5).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(v)], ["k", "diff"])

    return pairs.mapInArrow(run, "k bigint, diff bigint")


def text_sep_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planes(clip(spark, sf_dir), lambda g: arrays.separate(g, "binary"))


def text_sep_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In whole levels, cut from the exact fraction."""

    def make(g: np.ndarray) -> np.ndarray:
        value, unit = arrays.contrast(g)
        return np.minimum(255, value // unit)

    return _values(clip(spark, sf_dir), make)


def box_blur(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _planes(clip(spark, sf_dir), lambda g: np.floor(arrays.box_blur(g, 3) * 9 + 0.5))


def box_blur_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a square of 5."""
    return _values(clip(spark, sf_dir), lambda g: np.floor(arrays.box_blur(g, 5).astype(np.float64) * 25 + 0.5))


def resize_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 to 16 x 16: weights are sixteenths, so values are exact."""
    return _planes(clip(spark, sf_dir), lambda g: arrays.resize_planes(g, 16, 16))


def normalize_pad(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame as a 48-high input (each row six times) of three channels: normalised, filled with 0 to width 12 on the right.

    A row of the result for each row of the frame.
    """

    def make(g: np.ndarray) -> np.ndarray:
        images = np.stack([g, 255 - g, g // 2], axis=-1).astype(np.float32).repeat(6, axis=1)
        return np.stack([np.floor(arrays.normalise(x, 12 / 48)[:, ::6].astype(np.float64) * 255 + 0.5).transpose(1, 2, 0) for x in images])

    return _values(clip(spark, sf_dir), make, "r g b")


def nv12_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames read as packed 4:2:0 of 8 x 5."""
    return _values(clip(spark, sf_dir), arrays.packed_to_rgb, "r g b")


def luma_of_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plane that segmentation looks at, of gray and rgb frames, with and without a curve, and of packed 4:2:0 of limited range."""

    def make(g: np.ndarray) -> np.ndarray:
        rgb = np.stack([g, 255 - g, g // 2], axis=-1)
        nv12 = np.zeros_like(g)
        nv12[:, :5] = arrays.luma(g, "nv12", 0)
        return np.stack([arrays.luma(g[..., None], "gray"), arrays.luma(rgb, "rgb"), arrays.luma(g[..., None], "gray", gamma=2.0), nv12], axis=-1)

    return _values(clip(spark, sf_dir), make, "gray rgb curved nv12")


def _prepared(spark: SparkSession, sf_dir: str, make: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Crops of representatives as recogniser's inputs of 48 x 16 without a curve (weights are 48ths); their segment as fi."""
    crops = plan(spark, sf_dir, merge=False).representatives().select(F.col("seg").alias("fi"), "data")
    return _values(crops, lambda g: make(arrays.prepare_all(g[..., None], 16 / 48, 0.0))).withColumnRenamed("fi", "seg")


def ocr_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs in units of 1/48."""
    return _prepared(spark, sf_dir, lambda images: np.floor(images[..., 0].astype(np.float64) * 48 + 0.5))


def ocr_prepare_free(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of a region of 4 x 6 at the recogniser's height, their width in proportion (32), in units of 1/256."""
    plan_ = plan(spark, sf_dir, merge=False, roi=(1, 1, 4, 6))
    crops = plan_.representatives().select(F.col("seg").alias("fi"), "data")

    return _values(crops, lambda g: np.floor(arrays.prepare_all(g[..., None], 0.0, 0.0)[..., 0].astype(np.float64) * 256 + 0.5), shape=(6, 4)).withColumnRenamed("fi", "seg")


def ocr_separate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs, in whole units of 1/48, with text apart from its background."""
    return _prepared(spark, sf_dir, lambda images: arrays.separate_input(np.floor(images * 48 + np.float32(0.5)), "binary")[..., 1])


def ocr_separate_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inputs, in whole units of 1/48, by contrast with a square of 29; cut to whole levels."""

    def make(images: np.ndarray) -> np.ndarray:
        value, unit = arrays.contrast(np.floor(images[..., 0] * 48 + np.float32(0.5)).astype(np.int64))
        return np.minimum(255, value // unit)

    return _prepared(spark, sf_dir, make)


def _files(spark: SparkSession, sf_dir: str, fmt: str, write: Callable, **options: object) -> str:
    """A folder of clips in files, written by tasks: 250 frames to a clip, as gray frames or as packed 4:2:0 of limited range."""
    frames = clip(spark, sf_dir)
    if fmt == "nv12":
        frames = frames.withColumns({"fmt": F.lit("nv12"), "h": F.lit(5), "color_range": F.lit(0).cast("tinyint")})
    parts = frames.withColumn("clip_id", F.lpad(F.floor(F.col("fi") / 250).cast("string"), 6, "0"))
    folder = shared_path(spark, "clips").removeprefix("file://")
    raw_clip.write_clips(parts, folder, write, **options).count()
    return folder


def clip_files_gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of packed clips of limited range, read from files as gray: expanded to the full range."""
    folder = _files(spark, sf_dir, "nv12", raw_clip.write_clip)
    frames = raw_clip.open_clip(spark, folder, roi=(1, 1, 5, 3), gray_output=True, start=3, stride=2)
    return clips.pixels(frames)


def clip_files_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region of packed clips, read from coded files as packed frames: all bytes, chroma included."""
    folder = _files(spark, sf_dir, "nv12", coded_clip.write_keyclip, every=16)
    frames = raw_clip.open_clip(spark, folder, roi=(2, 2, 5, 4), yuv_output=True, source=coded_clip.CodedClips, rows=40)
    return clips.pixels(frames).select("clip_id", "fi", F.col("y").alias("row"), "x", "g")


def segments_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of clips in coded files: partitions begin at key frames and know the frame before; each clip has its own threshold."""
    folder = _files(spark, sf_dir, "gray", coded_clip.write_keyclip, every=16)
    source = FileFrames(spark, folder, rows=40)
    return _rows(SegmentPlan(source, Options(merge=False), (8, 8)).segments, "clip_id")


def ocr_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of the recogniser's input for crops of many shapes, and that of a batch which is padded to it."""
    shape = vectors(spark, sf_dir).select("vec_id", (F.col("vec_id") % 97 + 1).cast("int").alias("w"), (F.col("vec_id") % 31 + 1).cast("int").alias("h"))
    return shape.select("vec_id", columns.input_width(F.col("w"), F.col("h")).alias("width"), columns.batch_width(F.col("w") / F.col("h")).alias("padded"))


def ctc_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as 8 steps of 8 classes, with letters for classes."""
    v = vectors(spark, sf_dir)
    steps = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda s: F.slice("embedding", s * 8 + 1, 8))
    letters = spark.range(8).select(F.col("id").cast("int").alias("idx"), F.when(F.col("id") == 0, "").otherwise(F.char(F.col("id") + 96)).alias("ch"))
    return ctc.ctc_decode(v.select(F.col("vec_id").alias("seg"), steps.alias("p")), letters)


def format_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("vec_id", columns.duration_text(F.col("vec_id") * 37.5 - 100).alias("duration"))


def frame_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = clip(spark, sf_dir)
    return c.groupBy((F.col("fi") % 10).alias("part")).agg(F.sum(F.octet_length("data")).alias("bytes"), F.count("*").alias("frames"))


def fps_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("vec_id", F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 3 * 12.5 - 12.5).alias("a"), F.when(F.col("vec_id") % 4 > 0, F.col("vec_id") % 4 * 10.0 - 10.0).alias("b"))
    return v.select("vec_id", columns.rate(F.col("a"), F.col("b")).alias("fps"))


def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunked = segments.with_chunks(_features(spark, sf_dir).select("clip_id", "fi", "k"), 4)
    return chunked.groupBy("chunk").agg(F.min("fi").alias("start_fi"), F.max("fi").alias("end_fi"), F.count("*").alias("n"))


def hybrid_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = segments.hybrid_ranges(clips.sample(clip(spark, sf_dir)).select("clip_id", "fi", "k"), 50, 0.4)
    return sides.groupBy("side").agg(F.min("fi").alias("start_fi"), F.max("fi").alias("end_fi"), F.count("*").alias("n"))


def merge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, x = vectors(spark, sf_dir), F.col("vec_id").cast("int")
    return v.select("vec_id", columns.most_changed(F.lit(0), F.lit(0), x, x % 90 + 1).alias("cap"))


def rep_crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crops of the representatives, joined back by frame."""
    return plan(spark, sf_dir).representatives().select("seg", F.col("fi").alias("rep_frame"), F.lower(F.hex("data")).alias("crop"))


#: A recogniser's weights: two bands of a step's height by blank and four letters.
WEIGHT, BIAS, LETTERS = [[1, -3, 4, -2, 0], [1, 4, -3, 0, -2]], [40, 0, 10, 300, 290], ["", "a", "b", "c", "d"]


def extract_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan, with merge, inputs of 48 x 16 and a recogniser of one linear layer."""
    texts = plan(spark, sf_dir, force_aspect=16 / 48, input_gamma=0.0).texts(lambda: LinearRecogniser(WEIGHT, BIAS, LETTERS))
    return texts.select("seg", F.col("start").alias("start_fi"), F.col("end").alias("end_fi"), "rep_frame", "text", "confidence")


def queries() -> dict[str, Query]:
    own = [
        luma_range_expand, rgb_to_gray, seg_gamma, luma_plane, roi_crop, sample_stride, stride_clamp, sharpness, histogram, otsu_frame, otsu_frame_sql, otsu_pooled,
        clip_threshold, clip_threshold_strided, binarize, change_score, segments_serial, segments_pooled, segments_chunked, segments_chunked_merged, segment_frames, rep_frame, merge_anchored,
        merge_default, similar_pairs, mean_abs_diff, text_sep_binary, text_sep_contrast, box_blur, box_blur_wide, luma_of_formats, ocr_prepare, ocr_prepare_free, ocr_separate, ocr_separate_contrast, resize_bilinear, normalize_pad, nv12_to_rgb, ocr_input, ctc_decode,
        format_duration, frame_bytes, fps_fallback, chunk_bounds, hybrid_ranges, merge_cap, rep_crops, extract_texts,
        clip_files_gray, clip_files_packed, segments_of_files,
    ]
    return {"segments": segments_default} | {f.__name__: f for f in own}
