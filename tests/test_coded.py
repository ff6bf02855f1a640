"""Coded clips: ranges and single frames against a full decode."""

from __future__ import annotations

import numpy as np
import pytest

from textframes.functions import arrays
from textframes.plans.extractor import FieldExtractor, Options, SegmentPlan
from textframes.sources.coded_clip import CodedClips, CodedHeader, CodedReader, Decoder, source_of, write_keyclip, write_y4m
from textframes.sources.frames import FileFrames
from textframes.sources.raw_clip import RawClips, cut_packed, open_clip, write_clip


def moving(n: int, shape: tuple, seed: int = 1) -> np.ndarray:
    """Frames that change little from one to the next."""
    r = np.random.default_rng(seed)
    out = np.zeros((n, *shape), np.uint8)
    out[0] = r.integers(0, 255, shape)
    for k in range(1, n):
        out[k] = out[k - 1]
        out[k, int(r.integers(0, shape[0])), int(r.integers(0, shape[1]))] ^= np.uint8(r.integers(1, 255))
    return out


@pytest.mark.parametrize("index", [True, False])
def test_any_frame_by_number(tmp_path, index):
    g, path = moving(50, (6, 8, 3)), str(tmp_path / "c.key")
    write_keyclip(path, g, "rgb", fps=(24, 1), every=7, index=index)
    head = CodedHeader(path)
    assert (head.frames, head.fps, head.keys) == (50, 24.0, [*range(0, 50, 7)])
    decoder = Decoder(path, head)
    for fi in np.random.default_rng(2).integers(0, 50, 60).tolist():
        assert decoder.get(fi).tobytes() == g[fi].tobytes()
    one = Decoder(path, head)
    one.get(41)
    assert one.decoded == 41 - 35 + 1  # from its key frame, not from the start
    one.get(43)
    assert one.decoded == 9  # and on from there
    with pytest.raises(ValueError):
        one.get(50)


def test_cut_off_file(tmp_path):
    g, path = moving(20, (6, 8, 1)), str(tmp_path / "c.key")
    write_keyclip(path, g, "gray", every=6)
    body = open(path, "rb").read()
    with open(path, "wb") as f:
        f.write(body[: len(body) * 2 // 3])
    head = CodedHeader(path)
    assert 0 < head.frames < 20
    assert Decoder(path, head).get(head.frames - 1).tobytes() == g[head.frames - 1].tobytes()


@pytest.mark.parametrize("options", [{}, {"start": "5", "stride": "3"}, {"start": "2", "end": "40", "stride": "2"}])
def test_partitions_begin_at_key_frames(tmp_path, options):
    g, path = moving(60, (6, 8, 1)), str(tmp_path / "c.key")
    write_keyclip(path, g, "gray", every=8)
    reader = CodedReader({"path": path, "rows": "10", "halo": "true"} | options)
    start, end, stride = int(options.get("start", 0)), int(options.get("end", 60)), int(options.get("stride", 1))
    own, halo, parts = [], [], reader.partitions()
    assert len(parts) > 1
    for part in parts:
        rows = [r for b in reader.read(part) for r in b.to_pylist()]
        assert [r["k"] for r in rows] == [*range(rows[0]["k"], rows[-1]["k"] + 1)] and {r["part"] for r in rows} == {part.value[4]}
        assert all(r["data"] == g[r["fi"]].tobytes() for r in rows)
        own += [r["fi"] for r in rows if r["own"]]
        halo += [r["fi"] for r in rows if not r["own"]]
    assert own == [*range(start, end, stride)] and halo == [start + (p.value[1] - 1) * stride for p in parts[1:]]
    if stride == 1 and not options:
        assert all(p.value[1] % 8 == 0 for p in parts)


def test_y4m_of_packed_and_gray_frames(spark, tmp_path):
    packed, path = moving(12, (9, 8)), str(tmp_path / "a.y4m")  # six rows of luma
    write_y4m(path, packed, "nv12", 0, (25, 1), marks=[None, "p", "longer"] * 4)
    assert source_of(path) is CodedClips
    rows = open_clip(spark, path, source=CodedClips, yuv_output=True).orderBy("fi").collect()
    assert [(r["fi"], r["w"], r["h"], r["fmt"], r["color_range"]) for r in rows] == [(k, 8, 6, "nv12", 0) for k in range(12)]
    assert all(bytes(r["data"]) == packed[r["fi"]].tobytes() for r in rows)
    g, path = moving(5, (4, 6, 1)), str(tmp_path / "b.y4m")
    write_y4m(path, g, "gray", 1)
    rows = open_clip(spark, path, source=CodedClips, roi=(1, 1, 4, 2)).orderBy("fi").collect()
    assert CodedHeader(path).color_range == 1 and all(bytes(r["data"]) == g[r["fi"], 1:3, 1:5].tobytes() for r in rows)


def test_y4m_odd_sizes_and_other_formats(tmp_path):
    r, path = np.random.default_rng(4), str(tmp_path / "o.y4m")
    y, u, v = r.integers(0, 255, (5, 7)).astype(np.uint8), *(r.integers(0, 255, (3, 4)).astype(np.uint8) for _ in range(2))
    with open(path, "wb") as f:
        f.write(b"YUV4MPEG2 W7 H5 F30000:1001 C420mpeg2\nFRAME\n" + y.tobytes() + u.tobytes() + v.tobytes() + b"FRAME\n" + y.tobytes()[:9])
    head = CodedHeader(path)
    assert head.frames == 1 and abs(head.fps - 29.97) < 0.01
    packed = Decoder(path, head).get(0).reshape(8, 7)
    assert (packed[:5] == y).all() and (packed[5:, 0:6:2] == u[:, :3]).all() and (packed[5:, 1:6:2] == v[:, :3]).all()
    with open(path, "wb") as f:
        f.write(b"YUV4MPEG2 W7 H5 F30:1 C444\n")
    with pytest.raises(ValueError, match="444"):
        CodedHeader(path)


def test_extraction_of_coded_clips_equals_that_of_raw_ones(spark, tmp_path):
    from tests.test_plan import brute, made

    g = made(21, 90)
    paths = {n: str(tmp_path / n) for n in ("raw", "key", "y4m")}
    write_clip(paths["raw"], g[..., None], "gray")
    write_keyclip(paths["key"], g[..., None], "gray", every=9)
    write_y4m(paths["y4m"], g[..., None], "gray", 1)
    want = brute(g, start=3, end=80, stride=2)
    for path in paths.values():
        source = FileFrames(spark, path, None, 3, 80, 2, "c", rows=16)
        assert source.source is (RawClips if path == paths["raw"] else CodedClips)
        plan = SegmentPlan(source, Options(frame_start=3, frame_end=80, sample_stride=2), (60, 48))
        rows = plan.texts().collect()
        assert sorted((r["start"], r["end"], r["rep_frame"], tuple(r["frames"])) for r in rows) == want
        assert all(bytes(r["rep_crop"]) == g[r["rep_frame"]].tobytes() for r in rows)
        plan.close()
    e = FieldExtractor(paths["key"], (2, 3, 41, 40), sample_stride=3)
    e.extract()
    assert [(s.start, s.end, s.rep_frame, s.frames) for s in e.segments] == brute(np.ascontiguousarray(g[:, 3:41, 2:42]), stride=3)
    assert all((s.rep_crop[..., 0] == g[s.rep_frame, 3:41, 2:42]).all() for s in e.segments)


def test_folder_of_coded_clips(spark, tmp_path):
    from tests.test_plan import brute, made

    (tmp_path / "in").mkdir()
    clips = {"a": made(22, 40), "b": made(23, 33)}
    for name, g in clips.items():
        write_keyclip(str(tmp_path / "in" / name), g[..., None], "gray", every=5)
    for options in ({}, {"chunks": 2}, {"threshold": "strided"}, {"threshold": "pooled", "merge": False}):
        rows = SegmentPlan(FileFrames(spark, str(tmp_path / "in"), rows=12), Options(**options), (60, 48)).segments.collect()
        for name, g in clips.items():
            found = sorted((r["start"], r["end"], r["rep_frame"], tuple(r["frames"])) for r in rows if r["clip_id"] == name)
            if options.get("chunks"):
                half = len(g) // 2
                want = brute(g[:half]) + [(s + half, e + half, p + half, tuple(f + half for f in fs)) for s, e, p, fs in brute(g[half:])]
            elif options.get("threshold") == "pooled":
                threshold = int(arrays.otsu(arrays.histograms(g[:50].reshape(1, -1, 60)))[0])
                want = [(x[0], x[-1]) for x in cut(g, threshold)]
                found = [f[:2] for f in found]
            else:
                want = brute(g, options.get("threshold", "first"))
            assert found == want, (name, options)


def cut(g, threshold):
    groups, last = [], None
    for f, x in enumerate(g):
        bits = x > threshold
        if last is None or arrays.cluster((bits != last)[None])[0] >= 5:
            groups.append([])
        groups[-1].append(f)
        last = bits
    return groups


def test_clips_are_written_by_tasks(spark, tmp_path):
    """Each clip becomes a file that appears whole; writing again gives the same; rows come in any order."""
    from textframes.sources import clips
    from textframes.sources.raw_clip import Header, write_clips

    g = moving(30, (5, 4, 1))
    rows = [(f"c{k % 3}", k // 3, 4, 5, "gray", 1, bytearray(g[k].tobytes())) for k in range(30)] + [("c0", 99, 4, 5, "gray", 1, None)]
    frames = spark.createDataFrame(rows[::-1], clips.FRAMES).repartition(4)
    folder = str(tmp_path / "out")
    for write in (write_clip, write_keyclip):
        for _ in range(2):
            assert sorted(tuple(r) for r in write_clips(frames, folder, write, fps=(25, 1)).collect()) == [("c0", 10), ("c1", 10), ("c2", 10)]
        head = Header if write is write_clip else CodedHeader
        assert head(f"{folder}/c1").frames == 10 and head(f"{folder}/c1").fps == 25.0
        back = open_clip(spark, folder, source=source_of(folder)).collect()
        assert {(r["clip_id"], r["fi"]): bytes(r["data"]) for r in back} == {(r[0], r[1]): bytes(r[6]) for r in rows[:30]}


def test_linear_recogniser_by_hand():
    from textframes.operators.recognise import LinearRecogniser

    r = np.random.default_rng(9)
    weight, bias, letters = r.integers(-5, 6, (2, 4)), r.integers(-9, 9, 4), ["", "x", "y", "z"]
    own = LinearRecogniser(weight.tolist(), bias.tolist(), letters, steps=4, heat=32.0)
    image = np.repeat(r.integers(0, 255, (48, 22, 1)), 3, axis=-1).astype(np.float32)
    p = own.outputs(image)
    for k in range(4):
        cols = range(k * 22 // 4, (k + 1) * 22 // 4)
        level = [sum(int(image[y, x, 0]) for y in range(b * 24, b * 24 + 24) for x in cols) // (24 * len(cols)) for b in range(2)]
        z = [(sum(level[b] * int(weight[b, c]) for b in range(2)) + int(bias[c])) / 32 for c in range(4)]
        e = [np.exp(v - max(z)) for v in z]
        assert np.allclose(p[k], [np.floor(v / sum(e) * 100 + 0.5) / 100 for v in e])
    assert own([image]) == [arrays.ctc(p, letters)] and own([]) == []


def test_many_short_ranges_share_partitions(tmp_path):
    """90 clips of 50 frames, in ranges of 20: partitions hold several ranges, and give the rows of each."""
    rng = np.random.default_rng(8)
    for k in range(90):
        write_keyclip(str(tmp_path / f"{k:03d}"), rng.integers(0, 256, (50, 4, 4, 1), np.uint8), "gray", every=8)
    reader = CodedClips({"path": str(tmp_path), "rows": "20", "halo": "true"}).reader(None)
    parts = reader.partitions()
    assert len(parts) <= 45
    many = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    alone = []
    for k in range(90):
        one = CodedClips({"path": str(tmp_path / f"{k:03d}"), "clip_id": f"{k:03d}", "rows": "20", "halo": "true"}).reader(None)
        alone += [r for p in one.partitions() for b in one.read(p) for r in b.to_pylist()]
    assert many == alone and sum(r["own"] for r in many) == 90 * 50


def test_short_ranges_of_packed_clips_share_partitions(tmp_path):
    """100 packed clips of 90 frames, read as clip_files_packed does: partitions hold several ranges, and give every frame's bytes once."""
    rng, want = np.random.default_rng(9), []
    for k in range(100):
        frames = rng.integers(0, 256, (90, 8, 8), np.uint8)
        write_keyclip(str(tmp_path / f"{k:03d}"), frames, "nv12", 0, every=16)
        want += [(f"{k:03d}", fi, x.tobytes()) for fi, x in enumerate(cut_packed(frames, 5, (2, 2, 5, 4)))]
    reader = CodedClips({"path": str(tmp_path), "rows": "40", "fmt": "nv12", "roi": "2,2,5,4"}).reader(None)
    parts = reader.partitions()
    assert len(parts) <= 60
    assert [(r["clip_id"], r["fi"], r["data"]) for p in parts for b in reader.read(p) for r in b.to_pylist()] == want
