from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from textframes import queries
from textframes.functions import arrays as a
from textframes.plans.extractor import Options


def test_gray_is_cut_and_keeps_one_channel():
    rgb = np.random.default_rng(21).integers(0, 256, (3, 6, 7, 3)).astype(np.uint8)
    weighed = rgb.astype(float) @ [0.299, 0.587, 0.114]
    sure = np.abs(weighed - weighed.round()) > 1e-3
    assert (a.gray(rgb) == np.floor(weighed))[sure].all()
    assert a.gray(rgb[..., 1:2]) is not None and (a.gray(rgb[..., 1:2]) == rgb[..., 1]).all()


@pytest.mark.parametrize("color_range", [0, 1])
def test_expand_range(color_range):
    y = np.arange(256, dtype=np.uint8).reshape(16, 16)
    out = a.expand_range(y, color_range)
    expected = y if color_range else np.clip(np.floor((y.astype(float) - 16) * 255 / 219 + 0.5), 0, 255)
    assert (out == expected).all()


def test_luma_of_packed_frames():
    packed = np.full((2, 12, 12), 128, np.uint8)
    packed[:, :8] = np.arange(96).reshape(8, 12)
    assert a.luma(packed, "nv12", 1).shape == (2, 8, 12)
    assert (a.luma(packed, "nv12", 0) == a.expand_range(packed[:, :8], 0)).all()


@pytest.mark.parametrize(("h", "w"), [(4, 6), (5, 7), (1, 1)])
def test_nv12_gray(h, w):
    packed = np.full((h + (h + 1) // 2, w), 128, np.uint8)
    packed[:h] = 180
    rgb = a.nv12_to_rgb(packed)
    assert rgb.shape == (h, w, 3)
    assert np.abs(rgb.astype(int) - 191).max() <= 1
    three = np.zeros((2, 3, 3), np.uint8)
    assert a.nv12_to_rgb(three) is not None and a.nv12_to_rgb(three).shape == (2, 3, 3)


def test_nv12_chroma_counts_for_its_square():
    packed = np.full((6, 4), 128, np.uint8)
    packed[4, 1] = 200  # V of the first square
    red = a.nv12_to_rgb(packed)[..., 0].astype(int)
    assert (red[:2, :2] > red[2, 2]).all() and (red[:2, 2:] == red[2, 2]).all()


def test_otsu_by_definition():
    """Every level is tried; the first best one counts."""
    r = np.random.default_rng(22)
    planes = [r.choice([30, 31, 90, 200, 251], (5, 9)) for _ in range(6)] + [np.where(r.random((5, 9)) < 0.3, 12, 13), r.integers(0, 256, (5, 9))]
    for g in planes:
        best, at = -1.0, None
        for t in range(256):
            low, high = g[g <= t], g[g > t]
            if low.size and high.size and (s := low.size * high.size * (low.mean() - high.mean()) ** 2) > best * (1 + 1e-12):
                best, at = s, t
        assert a.otsu(a.histograms(g[None].astype(np.uint8))).tolist() == [at]
    for empty in (np.zeros((1, 256), int), a.histograms(np.full((1, 3, 11), 254, np.uint8))):
        assert a.otsu(empty).tolist() == [a.FLAT]


def test_cluster_by_definition():
    r = np.random.default_rng(23)
    masks = np.stack([r.random((7, 12)) < p for p in (0.0, 0.05, 0.3, 0.6, 1.0)])
    for mask, found in zip(masks, a.cluster(masks).tolist(), strict=True):
        around = np.pad(mask, 1)
        assert found == max(int(around[y : y + 3, x : x + 3].sum()) for y in range(7) for x in range(12))


@pytest.mark.parametrize("gamma", [0, 1, 2])
def test_curve(gamma):
    g = np.arange(256, dtype=np.uint8)
    out = a.curve(g, gamma)
    assert out.min() >= 0 and out.max() <= 255
    assert gamma or (out == g).all()


def test_mean_abs_diff():
    x, y = np.random.default_rng(24).integers(0, 256, (2, 6, 9)).astype(np.uint8)
    assert math.isclose(a.mean_abs_diff(x, y), sum(abs(int(p) - int(q)) for p, q in zip(x.ravel(), y.ravel(), strict=True)) / 54, rel_tol=1e-6)
    assert a.mean_abs_diff(y, None) == math.inf and a.mean_abs_diff(x[:, :8], y) == math.inf


def test_similar():
    """A region of 80 x 60 allows 48 changed pixels, and the mean 56."""
    cap = Options(roi=(10, 20, 89, 79)).most_changed(0, 0)
    assert cap == 48
    base = np.random.default_rng(25).choice([20, 230], (60, 80)).astype(np.uint8)
    for n, same in ((1, True), (48, True), (49, False), (600, False)):
        other = base.ravel().copy()
        other[17 : 17 + n] = 250 - other[17 : 17 + n]
        assert a.similar(base, other.reshape(60, 80), "binary", 99, 3.0, cap) == same
    assert not a.similar(base, base[:, :79], "binary", 99, 3.0, cap) and not a.similar(None, base, "binary", 99, 3.0, cap)


def test_similar_by_changed_pixels_alone():
    x = np.zeros((100, 100), np.uint8)
    y = x.copy()
    y[:10, :11] = 11  # mean 0.121, but 110 pixels by more than 10
    assert not a.similar(x, y, "", None, 3.0, 100)
    assert a.similar(x, y, "", None, 3.0, 110)


def test_resize_and_prepare():
    x = np.random.default_rng(1).integers(0, 255, (48, 90, 3)).astype(np.uint8)
    same = a.resize(x, 90, 48)
    assert same.dtype == np.float32 and (same == x).all()
    assert a.prepare(np.zeros((60, 200, 3), np.uint8)).shape == (48, 160, 3)
    assert a.prepare(np.zeros((60, 90, 3), np.uint8), aspect=2.0).shape == (48, 96, 3)
    assert a.prepare(np.zeros((60, 90, 1), np.uint8)).shape == (48, 72, 3)
    assert a.prepare(x, gamma=0).shape == (48, 90, 3)


def test_resize_against_definition():
    g = np.random.default_rng(2).integers(0, 255, (5, 7)).astype(np.uint8)
    out = a.resize(g, 11, 3)
    for i in range(3):
        for j in range(11):
            y, x = min(4, max(0, (i + 0.5) * 5 / 3 - 0.5)), min(6, max(0, (j + 0.5) * 7 / 11 - 0.5))
            y0, x0 = int(y), int(x)
            y1, x1, fy, fx = min(4, y0 + 1), min(6, x0 + 1), y - y0, x - x0
            want = (1 - fy) * ((1 - fx) * g[y0, x0] + fx * g[y0, x1]) + fy * ((1 - fx) * g[y1, x0] + fx * g[y1, x1])
            assert abs(out[i, j] - want) < 1e-3


def test_box_blur_against_definition():
    g = np.random.default_rng(3).integers(0, 255, (9, 6)).astype(np.uint8)
    padded = np.pad(g, 2, mode="edge").astype(float)
    want = [[padded[y : y + 5, x : x + 5].mean() for x in range(6)] for y in range(9)]
    assert np.allclose(a.box_blur(g, 5), want, atol=1e-3)
    assert (a.box_blur(g, 1) == g).all()


def test_separate():
    g = np.full((8, 8), 10, np.uint8)
    assert (a.separate(g, "contrast") == 0).all()
    g[4, 4] = 200
    assert (a.separate(g, "binary", 100) == 255).sum() == 1
    assert a.separate(g, "contrast").max() == 255
    assert a.separate_input(np.zeros((48, 5, 3), np.float32), "binary").shape == (48, 5, 3)


def test_normalise():
    out = a.normalise(np.full((48, 10, 3), 255, np.float32), 20 / 48)
    assert out.shape == (3, 48, 20)
    assert (out[:, :, :10] == 1).all() and (out[:, :, 10:] == 0).all()
    assert a.batch_ratio([(48, 10)]) == 224 / 48 and a.batch_ratio([(10, 100)]) == 10


def test_duration():
    assert [a.duration_text(x) for x in (-1, 0.5, 1.5, 59.5, 3599.6, 3661)] == ["0:00", "0:00", "0:02", "1:00", "1:00:00", "1:01:01"]


def _steps(*classes):
    p = np.full((len(classes), 4), 0.1)
    for k, c in enumerate(classes):
        p[k, c] = 0.9 - 0.1 * k
    return p


def test_ctc():
    letters = ["", "a", "b", " "]
    assert a.ctc(_steps(0, 0, 0), letters) == ("", 0.0)
    assert a.ctc(_steps(1, 1), letters) == ("a", 0.9)
    assert a.ctc(_steps(1, 0, 1), letters) == ("aa", 0.8)
    assert a.ctc(_steps(1, 2, 2, 3), letters)[0] == "ab "


@pytest.mark.parametrize("roi", [(1, 2, 3), (-1, 0, 5, 5), (5, 0, 5, 5), (0, 5, 5, 5)])
def test_roi_errors(roi):
    with pytest.raises(ValueError):
        Options(roi=roi)


@pytest.mark.parametrize(("start", "end"), [(-1, None), (10, 10), (10, 5)])
def test_range_errors(start, end):
    with pytest.raises(ValueError):
        Options(frame_start=start, frame_end=end)


def test_range_to_the_end_and_stride():
    assert Options(frame_start=10, frame_end=0).frame_end == 0
    assert [Options(sample_stride=n).sample_stride for n in (0, -2, 3)] == [1, 1, 3]


def test_values_hand_over_few_frames(spark):
    """A batch may hold 10,000 frames: a numpy function never gets them all."""
    frames = spark.range(0, 1000, 1, 1).select(F.col("id").alias("fi"), F.lit(bytes(64)).alias("data"))
    out = queries._values(frames, lambda g: np.full((len(g), 1, 1), len(g))).toPandas()
    assert sorted(out["fi"]) == [*range(1000)] and out["v"].max() <= 128


def test_crops_of_free_width_are_prepared_by_few(spark):
    """300 crops of 4 x 6 in one batch, as in ocr_prepare_free: 128 at most are prepared together, and each as it is alone."""
    g = np.random.default_rng(4).integers(0, 256, (300, 6, 4), np.uint8)
    frames = spark.createDataFrame([(k, x.tobytes()) for k, x in enumerate(g)], "fi bigint, data binary").coalesce(1)

    def make(crops):
        v = np.floor(a.prepare_all(crops[..., None], 0.0, 0.0)[..., 0].astype(np.float64) * 256 + 0.5)
        return np.stack([v, np.full_like(v, len(crops))], axis=-1)

    out = queries._values(frames, make, "v n", (6, 4)).toPandas().sort_values(["fi", "y", "x"])
    want = np.concatenate([make(x[None])[..., 0] for x in g])
    assert (out["v"].to_numpy().reshape(want.shape) == want).all() and out["n"].max() <= 128
