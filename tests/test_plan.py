from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from textframes.functions import arrays
from textframes.operators import ctc as ctc_ops
from textframes.operators import features, segments
from textframes.operators.ordered import running_total
from textframes.operators.recognise import OnnxRecogniser, StandIn
from textframes.plans.extractor import FieldExtractor, Options, SegmentPlan
from textframes.sources import clips
from textframes.sources.frames import FileFrames
from textframes.sources.raw_clip import Header, RawClips, write_clip


def made(seed: int, n: int = 120, h: int = 48, w: int = 60) -> np.ndarray:
    """Frames that hold for a while, with noise that isn't a change, and changes of 1 to 4 pixels squared."""
    r = np.random.default_rng(seed)
    out, now = [], r.integers(0, 60, (h, w))
    for k in range(n):
        if k % 7 == 0:
            y, x, s = r.integers(0, h - 8), r.integers(0, w - 8), r.integers(1, 9)
            now = now.copy()
            now[y : y + s, x : x + s] = 255 - now[y : y + s, x : x + s]
        out.append(np.clip(now + r.integers(-2, 3, (h, w)), 0, 255))
    return np.array(out, np.uint8)


def frames_of(spark, g, clip="c"):
    rows = [(clip, k, g.shape[2], g.shape[1], "gray", 1, bytearray(x.tobytes())) for k, x in enumerate(g)]
    return spark.createDataFrame(rows, clips.FRAMES)


def brute(g, mode="first", change=5.0, merge=True, most_mean=3.0, most_changed=32, start=0, end=None, stride=1):
    """The rules, frame by frame."""
    fis = [*range(start, min(end or len(g), len(g)), stride)]
    own = [int(arrays.otsu(arrays.histograms(g[f][None]))[0]) for f in fis]
    step = max(1, len(fis) // 50) if mode == "strided" else 1
    threshold = int(np.median(own[::step][:50]))
    groups, last = [], None
    for f in fis:
        bits = g[f] > threshold
        if last is None or arrays.cluster((bits != last)[None])[0] >= change:
            groups.append([])
        groups[-1].append(f)
        last = bits
    reps = [max(x, key=lambda f: (float(arrays.sharpness(g[f][None])[0]), -f)) for x in groups]
    if not merge:
        return [(x[0], x[-1], rep, tuple(x)) for x, rep in zip(groups, reps, strict=True)]
    out = []
    for x, rep in zip(groups, reps, strict=True):
        if out and arrays.similar(g[out[-1][1]], g[rep], "binary", threshold, most_mean, most_changed):
            out[-1][0].extend(x)
        else:
            out.append([list(x), rep])
    return [(x[0], x[-1], rep, tuple(x)) for x, rep in out]


def got(plan):
    return sorted((r["start"], r["end"], r["rep_frame"], tuple(r["frames"])) for r in plan.segments.collect())


@pytest.mark.parametrize("options", [{}, {"merge": False}, {"threshold": "strided"}, {"frame_start": 5, "frame_end": 100, "sample_stride": 3}, {"merge_threshold": 60.0}])
def test_plan_against_brute_force(spark, options):
    g = made(1)
    plan = SegmentPlan(frames_of(spark, g), Options(**options), (60, 48))
    want = brute(g, options.get("threshold", "first"), merge=options.get("merge", True), most_mean=options.get("merge_threshold", 3.0),
                 start=options.get("frame_start", 0), end=options.get("frame_end"), stride=options.get("sample_stride", 1))
    assert len(want) > 3
    assert got(plan) == want


def test_chunks_are_alone(spark):
    g = made(2)
    plan = SegmentPlan(frames_of(spark, g), Options(chunks=3), (60, 48))
    want = []
    for a, b in segments.chunk_bounds(len(g), 3):
        want += [(s + a, e + a, r + a, tuple(f + a for f in fs)) for s, e, r, fs in brute(g[a:b])]
    assert got(plan) == want
    assert plan.texts().count() == len(want)


@pytest.mark.parametrize("n", [1, 2, 33, 100, 1250])
def test_chunk_bounds(spark, n):
    bounds = segments.chunk_bounds(n)
    assert bounds[0][0] == 0 and bounds[-1][1] == n and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))
    rows = spark.range(n).select(F.lit("c").alias("clip_id"), F.col("id").alias("fi"), F.col("id").alias("k"))
    found = segments.with_chunks(rows).groupBy("chunk").agg(F.min("fi"), F.max("fi") + 1, F.min("k")).orderBy("chunk").collect()
    assert [(r[1], r[2]) for r in found] == bounds and all(r[3] == 0 for r in found)


def test_anchor_not_chain(spark):
    """A, B, C: B is near A, C is near B but not near A: C is kept."""
    g = np.zeros((3, 60, 60), np.uint8)
    g[0, :30] = 200
    g[1:, :30] = 200
    g[1, 50:54, :6] = 200
    g[2, 50:58, :6] = 200
    plan = SegmentPlan(frames_of(spark, g), Options(merge_threshold=3.0), (60, 60))
    assert [x[:3] for x in got(plan)] == [x[:3] for x in brute(g, most_changed=36)]
    assert len(got(plan)) == 2


def test_several_clips_and_no_frames(spark):
    both = frames_of(spark, made(3, 40), "a").union(frames_of(spark, made(4, 55), "b"))
    plan = SegmentPlan(both, Options(), (60, 48))
    for clip, seed, n in (("a", 3, 40), ("b", 4, 55)):
        found = sorted((r["start"], r["end"], r["rep_frame"], tuple(r["frames"])) for r in plan.segments.where(F.col("clip_id") == clip).collect())
        assert found == brute(made(seed, n))
    assert SegmentPlan(frames_of(spark, made(3, 2)).limit(0), Options(), (60, 48)).segments.count() == 0


def test_extractor(spark):
    g = made(5, 30)
    e = FieldExtractor(frames_of(spark, g))
    result = e.extract()
    assert [(s.start, s.end, s.rep_frame, s.frames) for s in result.segments] == brute(g)
    assert result.frames == [*range(30)] and result.fps == 30.0 and e.n_segments == len(result.segments) == result.meta["n_segments"]
    for s in result.segments:
        assert (s.rep_crop[..., 0] == g[s.rep_frame]).all()
        assert (s.text or "", s.confidence) == StandIn()([arrays.prepare(s.rep_crop)])[0]
    assert set(e.timing_flat()) == {"total", "rss_mb", "decode", "segment", "ocr"}
    bare = FieldExtractor(frames_of(spark, g), keep_frames=False, keep_crops=False).extract()
    assert bare.frames == [] and all(s.frames == () and s.rep_crop is None for s in bare.segments)
    with pytest.raises(ValueError):
        FieldExtractor(frames_of(spark, g), frame_start=1000).extract()


def test_roi_is_closed(spark):
    g = made(6, 3)
    cut = clips.crop(frames_of(spark, g), (3, 4, 10, 20)).orderBy("fi").collect()
    assert [(r["w"], r["h"]) for r in cut] == [(8, 17)] * 3
    assert all(bytes(r["data"]) == g[r["fi"], 4:21, 3:11].tobytes() for r in cut)
    again = clips.crop(clips.crop(frames_of(spark, g), (3, 4, 10, 20)), (3, 4, 10, 20))
    assert bytes(again.where("fi = 1").head()["data"]) == g[1, 4:21, 3:11].tobytes()


def test_raw_clip_source(spark, tmp_path):
    spark.dataSource.register(RawClips)
    g = made(7, 20)[..., None]
    path = str(tmp_path / "a.raw")
    write_clip(path, g, "gray", fps=(0, 1))
    assert Header(path).fps == 30.0 and Header(path).frames == 20
    df = spark.read.format("rawclip").option("path", path).option("clip_id", "c").option("rows", 4).option("start", 2).option("stride", 3).option("roi", "1,2,8,9").load()
    rows = df.orderBy("fi").collect()
    assert [r["fi"] for r in rows] == [*range(2, 20, 3)]
    assert all(bytes(r["data"]) == g[r["fi"], 2:10, 1:9].tobytes() and (r["w"], r["h"]) == (8, 8) for r in rows)
    packed = np.random.default_rng(8).integers(0, 255, (3, 9, 6)).astype(np.uint8)
    write_clip(path, packed, "nv12", color_range=0)
    yuv = spark.read.format("rawclip").option("path", path).load()
    f = features.frame_features(clips.sample(yuv)).orderBy("fi").collect()
    assert all(bytes(r["luma"]) == arrays.luma(packed[r["fi"]][None], "nv12", 0)[0].tobytes() for r in f)
    rgb = np.random.default_rng(9).integers(0, 255, (2, 4, 6, 3)).astype(np.uint8)
    write_clip(path, rgb, "rgb")
    as_gray = spark.read.format("rawclip").option("path", path).option("fmt", "gray").load().orderBy("fi").collect()
    assert all(bytes(r["data"]) == arrays.gray(rgb[r["fi"]]).tobytes() for r in as_gray)


def test_charset(spark, tmp_path):
    (tmp_path / "chars.txt").write_text("a\nb\né\n", encoding="utf-8")
    rows = clips.charset(spark, str(tmp_path / "chars.txt")).orderBy("idx").collect()
    assert [r["ch"] for r in rows] == ["", "a", "b", "é", " "]


def test_ctc_columns_agree_with_numpy(spark):
    r = np.random.default_rng(10)
    p = r.random((60, 9, 4))
    p[:20, 4] = p[:20, 3]
    p[20:30, :, 0] = 2
    letters = ["", "a", "b", "c"]
    outputs = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(p)], "seg bigint, p array<array<double>>")
    chars = spark.createDataFrame([*enumerate(letters)], "idx int, ch string")
    for row in ctc_ops.ctc_decode(outputs, chars).collect():
        text, confidence = arrays.ctc(p[row["seg"]], letters)
        assert (row["text"] or "") == text and abs(row["confidence"] - confidence) < 1.1e-5


def test_running_total(spark):
    df = spark.range(10_000).select((F.col("id") * 3).alias("at"), (F.col("id") % 5).alias("v"))
    rows = running_total(df, [], "at", F.col("v"), "total", size=100).orderBy("at").collect()
    assert [r["total"] for r in rows] == np.cumsum([r["v"] for r in rows]).tolist()


def test_onnx_recogniser_needs_no_session_without_images():
    assert OnnxRecogniser("absent.onnx", ["", "a"]).__class__.__name__ == "OnnxRecogniser"


def test_live_segments(spark, tmp_path):
    from textframes.streaming.live import live_segments

    g = made(11, 90)
    f = features.frame_features(clips.sample(frames_of(spark, g))).select("clip_id", "fi", "h", "w", "luma", (F.col("fi") == 89).alias("done"))
    for k in range(3):
        f.where(F.col("fi").between(30 * k, 30 * k + 29)).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema(f.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = live_segments(stream).writeStream.format("memory").queryName("live").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        rows = spark.table("live").orderBy("seg").collect()
    finally:
        q.stop()
    want = brute(g, merge=False)
    assert [(r["start"], r["end"], r["rep_frame"], r["n"]) for r in rows] == [(a, b, rep, len(fs)) for a, b, rep, fs in want]


def plans_of_a_run(monkeypatch, work) -> str:
    """The executed plans of all that a run writes, and of its result."""
    from textframes.operators import segments as segs
    from textframes.plans import extractor
    from textframes.sources import shared

    ran: list[str] = []

    def recorded(df, name, paths=None, write=shared.saved):
        ran.append(f"@@ {name}\n" + df._jdf.queryExecution().executedPlan().toString())
        return write(df, name, paths)

    monkeypatch.setattr(extractor, "saved", recorded)
    monkeypatch.setattr(segs, "saved", recorded)
    out = work()
    out.collect()
    return "\n".join([*ran, "@@ result\n" + out._jdf.queryExecution().executedPlan().toString()])


def part(text: str, name: str) -> str:
    """The plan of one written table, up to its end in the adaptive part."""
    own = next(x for x in text.split("@@ ") if x.startswith(name + "\n"))
    return own.split("+- == Initial Plan")[0]


def test_samples_move_once(spark, monkeypatch):
    """A table's samples are dealt by ranges once, as they come; features, scores and segments are made in one Python stage after it."""
    frames = frames_of(spark, made(12, 60))
    text = plans_of_a_run(monkeypatch, lambda: SegmentPlan(frames, Options(merge=False), (60, 48)).texts())
    ranges = part(text, "ranges")
    assert ranges.count("MapInArrow") == 1 and ranges.count("Exchange hashpartitioning") == 1
    assert "luma" not in ranges.split("MapInArrow")[1]  # no plane below the stage that makes it
    assert [part(text, n).count("MapInArrow") for n in ("thresholds", "ranges", "segments", "result")] == [1, 1, 0, 1]


def test_a_file_is_scanned_without_an_exchange(spark, tmp_path, monkeypatch):
    """Ranges of a file know the sample before them: neither frames nor planes are shuffled, and only calibration's samples are read for it."""
    g, path = made(12, 300), str(tmp_path / "c.raw")
    write_clip(path, g[..., None], "gray")
    plan = SegmentPlan(FileFrames(spark, path, rows=50), Options(), (60, 48))
    text = plans_of_a_run(monkeypatch, plan.texts)
    ranges = part(text, "ranges")
    assert ranges.count("MapInArrow") == 1 and "Exchange hashpartitioning" not in ranges and "BatchScan" in ranges
    assert got(plan) == brute(g)
    reader = plan.source._reader()
    reader.first = features.CALIBRATION
    assert sum(b - a for a, b, _ in reader.spans(300)) == 50
    assert plan.source.first(50).count() == 50
    plan.close()


def test_what_a_run_writes_holds_no_crop(spark, tmp_path):
    """Bytes written grow with segments and ranges, not with samples; crops are fetched by number, and folders go when the plan is closed."""
    import os

    g, path = np.repeat(made(12, 40), 16, axis=0), str(tmp_path / "c.raw")
    write_clip(path, np.stack([g] * 3, axis=-1), "rgb")
    plan = SegmentPlan(FileFrames(spark, path, rows=100), Options(), (60, 48))
    rows = plan.texts().collect()
    assert all(bytes(r["rep_crop"]) == np.stack([g[r["rep_frame"]]] * 3, axis=-1).tobytes() for r in rows)
    folders = [p.removeprefix("file://") for p in plan._paths]
    size = sum(os.path.getsize(os.path.join(d, f)) for p in folders for d, _, files in os.walk(p) for f in files)
    plane = 60 * 48
    written = len(rows) + 7  # a plane for each segment, and one more for each range that begins inside one
    assert size < 8 * written * plane < len(g) * plane * 3 / 4
    assert all("data" not in spark.read.parquet(p).columns for p in folders)
    plan.close()
    assert not any(os.path.exists(p) for p in folders)


@pytest.mark.parametrize("rows", [1, 3, 7])
def test_merge_by_ranges(spark, rows, monkeypatch):
    """Ranges that are folded alone and repaired give what one fold gives."""
    monkeypatch.setattr(segments, "MERGE_RANGE", rows)
    clips_ = {"a": made(13), "b": np.repeat(made(14, 12), 7, axis=0), "c": made(15)[:, :, ::-1]}
    frames = None
    for name, g in clips_.items():
        frames = frames_of(spark, g, name) if frames is None else frames.union(frames_of(spark, g, name))
    for limit in (3.0, 60.0, 254.0):
        plan = SegmentPlan(frames, Options(merge_threshold=limit, merge_separation="raw"), (600, 480))
        found = plan.segments.collect()
        for name, g in clips_.items():
            own = sorted((r["start"], r["end"], r["rep_frame"], tuple(r["frames"])) for r in found if r["clip_id"] == name)
            assert own == brute_raw(g, limit), (name, limit)
        plan.close()


def brute_raw(g, limit):
    threshold = int(np.median([int(arrays.otsu(arrays.histograms(x[None]))[0]) for x in g[:50]]))
    groups, last = [], None
    for f, x in enumerate(g):
        bits = x > threshold
        if last is None or arrays.cluster((bits != last)[None])[0] >= 5:
            groups.append([])
        groups[-1].append(f)
        last = bits
    out = []
    for own in groups:
        rep = max(own, key=lambda f: (float(arrays.sharpness(g[f][None])[0]), -f))
        if out and arrays.similar(g[out[-1][1]], g[rep], "raw", threshold, limit, 2880):
            out[-1][0].extend(own)
        else:
            out.append([list(own), rep])
    return [(x[0], x[-1], rep, tuple(x)) for x, rep in out]


def test_long_ranges(spark, monkeypatch):
    """A segment that spans several ranges of samples is one."""
    monkeypatch.setattr(clips, "RANGE", 4)
    g = np.repeat(made(16, 30), 5, axis=0)
    plan = SegmentPlan(frames_of(spark, g), Options(merge=False), (60, 48))
    assert got(plan) == brute(g, merge=False)
    scores = {r["k"]: r["score"] for r in plan.scores.collect()}
    t = plan.thresholds.head()["threshold"]
    assert scores[0] is None and all(scores[k] == arrays.cluster(((g[k] > t) != (g[k - 1] > t))[None])[0] for k in range(1, len(g)))


def test_extractor_of_a_file(spark, tmp_path):
    g = made(17, 70)
    path = str(tmp_path / "clip.raw")
    write_clip(path, np.stack([g] * 3, axis=-1), "rgb", fps=(25, 1))
    said: list[float] = []
    e = FieldExtractor(path, (2, 3, 51, 42), C=5.0, gray_output=True, frame_start=4, sample_stride=2, progress=lambda m, p: said.append(p), dual_backends=[("cpu", "auto")])
    result = e.extract()
    plane = arrays.gray(np.stack([g] * 3, axis=-1))[:, 3:43, 2:52]
    assert [(s.start, s.end, s.rep_frame, s.frames) for s in result.segments] == brute(plane, start=4, stride=2)
    assert result.fps == 25.0 and said[-1] == 100.0 and result.meta["codec"] == "rgb" and result.meta["asked"] == [("cpu", "auto")]
    assert all(s.rep_crop.shape == (40, 50, 1) for s in result.segments)
    chunks = FieldExtractor(path, dual_pipeline=True, dual_pipeline_chunks=3).extract()
    assert chunks.meta["backend"] == "dual:spark"
    want = []
    for a, b in segments.chunk_bounds(len(g), 3):
        want += [(s + a, e_ + a) for s, e_, *_ in brute(arrays.gray(np.stack([g] * 3, axis=-1))[a:b])]
    assert [(s.start, s.end) for s in chunks.segments] == want

    class Stop(Exception):
        pass

    calls: list[int] = []

    def stop():
        calls.append(1)
        if len(calls) > 1:
            raise Stop

    with pytest.raises(Stop):
        FieldExtractor(path, cancelled=stop).extract()


def test_chunks_and_timings():
    from textframes.plans.extractor import check_chunks, merged_timings

    check_chunks({0, 1, 2, 3}, 100, 4)
    with pytest.raises(RuntimeError):
        check_chunks({0, 1, 3}, 100, 4)
    assert merged_timings([{"ocr": 2, "a": 1.5, "x": "no"}, {"ocr": 3, "a": 1}]) == {"ocr": 3.0, "a": 2.5}


def test_reader_of_folders_and_packed_regions(spark, tmp_path):
    from textframes.sources.raw_clip import cut_packed, open_clip

    packed = np.random.default_rng(18).integers(0, 255, (5, 12, 8)).astype(np.uint8)
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        write_clip(str(tmp_path / "in" / name), packed, "nv12", color_range=0)
    rows = open_clip(spark, str(tmp_path / "in"), roi=(2, 2, 6, 6), yuv_output=True).orderBy("clip_id", "fi").collect()
    assert [(r["clip_id"], r["fi"], r["w"], r["h"], r["fmt"]) for r in rows] == [(c, k, 5, 5, "nv12") for c in "ab" for k in range(5)]
    assert all(bytes(r["data"]) == cut_packed(packed, 8, (2, 2, 6, 6))[r["fi"]].tobytes() for r in rows)
    rgb = arrays.packed_to_rgb(packed)
    assert (arrays.packed_to_rgb(cut_packed(packed, 8, (2, 2, 5, 5))) == rgb[:, 2:6, 2:6]).all()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        as_gray = open_clip(spark, str(tmp_path / "in"), roi=(1, 1, 6, 4), gray_output=True).where("clip_id = 'a' and fi >= 3").collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert sorted(r["fi"] for r in as_gray) == [3, 4]
    assert all(bytes(r["data"]) == arrays.expand_range(packed[r["fi"], 1:5, 1:7], 0).tobytes() for r in as_gray)


def test_filters_narrow_the_range(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, LessThanOrEqual

    from textframes.sources.raw_clip import FilteringReader

    path = str(tmp_path / "a.raw")
    write_clip(path, np.zeros((50, 4, 4, 1), np.uint8), "gray")
    reader = FilteringReader({"path": path, "start": "1", "stride": "3", "rows": "4"})
    filters = [GreaterThan(("fi",), 10), LessThanOrEqual(("fi",), 30), EqualTo(("clip_id",), "x")]
    assert [*reader.pushFilters(filters)] == filters
    assert [fi for p in reader.partitions() for b in reader.read(p) for fi in b.column("fi").to_pylist()] == [*range(13, 31, 3)]


def tiny_model(path: str, steps: int, weight: np.ndarray, bias: np.ndarray) -> None:
    """A model file: mean of each of `steps` equal parts of the width over channels and rows, a linear layer, softmax."""

    def field(n: int, kind: int, value) -> bytes:
        head = varint(n << 3 | kind)
        return head + (varint(value) if kind == 0 else varint(len(value)) + value)

    def varint(x: int) -> bytes:
        out = b""
        while True:
            out += bytes([x & 127 | (128 if x > 127 else 0)])
            x >>= 7
            if not x:
                return out

    def tensor(name: str, x: np.ndarray) -> bytes:
        kind = 1 if x.dtype == np.float32 else 7
        return b"".join(field(1, 0, d) for d in x.shape) + field(2, 0, kind) + field(8, 2, name.encode()) + field(9, 2, x.tobytes())

    def node(op: str, ins: list[str], out: str, *attributes: bytes) -> bytes:
        return b"".join(field(1, 2, i.encode()) for i in ins) + field(2, 2, out.encode()) + field(4, 2, op.encode()) + b"".join(field(5, 2, a) for a in attributes)

    def ints(name: str, values: list[int]) -> bytes:
        return field(1, 2, name.encode()) + b"".join(field(8, 0, v) for v in values) + field(20, 0, 7)

    def integer(name: str, value: int) -> bytes:
        return field(1, 2, name.encode()) + field(3, 0, value) + field(20, 0, 2)

    def value(name: str, shape: list) -> bytes:
        dims = b"".join(field(1, 2, field(1, 0, d) if isinstance(d, int) else field(2, 2, d.encode())) for d in shape)
        return field(1, 2, name.encode()) + field(2, 2, field(1, 2, field(1, 0, 1) + field(2, 2, dims)))

    graph = b"".join(
        field(1, 2, x)
        for x in (
            node("Reshape", ["x", "shape"], "cut"), node("ReduceMean", ["cut"], "mean", ints("axes", [1, 2, 4]), integer("keepdims", 0)),
            node("Unsqueeze", ["mean", "last"], "column"), node("MatMul", ["column", "w"], "scaled"), node("Add", ["scaled", "b"], "z"), node("Softmax", ["z"], "p"),
        )
    )
    graph += field(2, 2, b"g") + b"".join(field(5, 2, tensor(n, x)) for n, x in (("shape", np.array([0, 3, 48, steps, -1], np.int64)), ("last", np.array([2], np.int64)), ("w", weight.astype(np.float32)[None]), ("b", bias.astype(np.float32))))
    graph += field(11, 2, value("x", ["n", 3, 48, "w"])) + field(12, 2, value("p", ["n", steps, len(bias)]))
    with open(path, "wb") as f:
        f.write(field(1, 0, 8) + field(7, 2, graph) + field(8, 2, field(2, 0, 13)))


def test_onnx_recogniser_runs_a_model(spark, tmp_path):
    """Texts of the plan by a real CTC model, against numpy."""
    path, steps, letters = str(tmp_path / "tiny.onnx"), 8, ["", "a", "b", "c", "d"]
    weight, bias = np.array([0.0, 9, -9, 4, -4]), np.array([0.5, -3, -3, 0.4, 0.4])
    tiny_model(path, steps, weight, bias)
    g = made(19, 60)
    got_ = SegmentPlan(frames_of(spark, g), Options(fill_width=64, input_gamma=0.0), (60, 48)).texts(lambda: OnnxRecogniser(path, letters)).collect()
    assert len(got_) > 3 and len({r["text"] for r in got_}) > 1
    for r in got_:
        image = np.repeat(arrays.prepare(g[r["rep_frame"]][..., None], 0.0, 0.0), 3, axis=-1)
        x = arrays.normalise(image, arrays.batch_ratio([image.shape[:2]], 64))
        mean = x.reshape(3, 48, steps, -1).mean(axis=(0, 1, 3))
        z = mean[:, None] * weight + bias
        p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
        text, score = arrays.ctc(p, letters)
        assert (r["text"] or "") == text and abs(r["confidence"] - score) < 2e-5
