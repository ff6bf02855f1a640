"""Pixel functions over numpy arrays; leading axes are batches unless a function says otherwise."""

from __future__ import annotations

import functools
import math

import numpy as np

#: Weights of red, green and blue in gray.
GRAY_WEIGHTS = (0.299, 0.587, 0.114)
#: The conversion from limited-range YUV: luma, V to red, U and V to green, U to blue.
YUV_LUMA, YUV_RED, YUV_GREEN, YUV_BLUE = 1.164383, 1.596027, (-0.391762, -0.812968), 2.017232
#: Fixed value: height of a recogniser's input.
INPUT_HEIGHT = 48
#: Fixed value: a threshold where a histogram has no two sides.
FLAT = 127


def gray(rgb: np.ndarray) -> np.ndarray:
    """(..., 3) or (..., 1) to uint8 without the last axis; the weighted sum is cut, not rounded."""
    if rgb.shape[-1] == 1:
        return rgb[..., 0]
    return (rgb[..., :3].astype(np.float32) @ np.array(GRAY_WEIGHTS, np.float32)).astype(np.uint8)


def luma_plane(packed: np.ndarray) -> np.ndarray:
    """The luma rows of packed 4:2:0 frames (..., rows, width)."""
    return packed[..., : packed.shape[-2] * 2 // 3, :]


def expand_range(y: np.ndarray, color_range: int) -> np.ndarray:
    """Limited range (0) to 0..255, rounding half up; full range (1) as it is."""
    if color_range == 1:
        return y
    wide = (y.astype(np.float32) - np.float32(16)) * np.float32(255) / np.float32(219)
    return np.clip(np.floor(wide + np.float32(0.5)), 0, 255).astype(np.uint8)


def curve(g: np.ndarray, gamma: float) -> np.ndarray:
    """255 (g / 255)^gamma, cut to uint8; unchanged for gamma <= 0."""
    return g if gamma <= 0 else (255.0 * np.power(g.astype(np.float32) / 255.0, gamma)).astype(np.uint8)


def luma(frames: np.ndarray, fmt: str, color_range: int = 0, gamma: float = 0.0) -> np.ndarray:
    """The plane that segmentation looks at: fmt is rgb or gray (..., h, w, channels) or nv12 (..., rows, w)."""
    if fmt == "nv12":
        return curve(expand_range(luma_plane(frames), color_range), gamma)
    return curve(gray(frames), gamma)


def packed_to_rgb(packed: np.ndarray) -> np.ndarray:
    """Packed 4:2:0 frames (..., rows, w) to (..., h, w, 3).

    Chroma counts for its 2 x 2 block; an odd last row or column has neutral chroma.
    """
    w = packed.shape[-1]
    h = packed.shape[-2] * 2 // 3
    y = (packed[..., :h, :].astype(np.float32) - 16) / 255
    pairs = packed[..., h : h + (h + 1) // 2, : w // 2 * 2].astype(np.float32)
    chroma = np.full((2, *y.shape), 128, np.float32)
    for k in range(2):
        full = pairs[..., k::2].repeat(2, axis=-2).repeat(2, axis=-1)[..., :h, :w]
        chroma[k, ..., : full.shape[-2], : full.shape[-1]] = full
    u, v = (chroma - 128) / 255
    base = np.float32(YUV_LUMA) * y
    channels = [base + np.float32(YUV_RED) * v, base + np.float32(YUV_GREEN[0]) * u + np.float32(YUV_GREEN[1]) * v, base + np.float32(YUV_BLUE) * u]
    return (np.clip(np.stack(channels, axis=-1), 0, 1) * 255).astype(np.uint8)


def nv12_to_rgb(packed: np.ndarray) -> np.ndarray:
    """One packed 4:2:0 frame to (h, w, 3); three-dimensional input keeps its first three channels."""
    if packed.ndim != 2:
        return packed[..., :3] if packed.ndim == 3 else packed
    return packed_to_rgb(packed)


def sharpness(g: np.ndarray) -> np.ndarray:
    """Population standard deviation of each frame (n, h, w)."""
    return g.reshape(len(g), -1).astype(np.float64).std(axis=1)


def histograms(g: np.ndarray) -> np.ndarray:
    """256 bins of each frame (n, h, w)."""
    flat = g.reshape(len(g), -1).astype(np.int64) + 256 * np.arange(len(g))[:, None]
    return np.bincount(flat.ravel(), minlength=256 * len(g)).reshape(-1, 256)


def otsu(counts: np.ndarray) -> np.ndarray:
    """For each histogram (n, 256) the first level that best parts it in two; FLAT if none does."""
    counts = counts.astype(np.float64)
    below = counts.cumsum(axis=1)
    above = below[:, -1:] - below
    mass = (counts * np.arange(256)).cumsum(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        apart = mass / below - (mass[:, -1:] - mass) / above
    spread = np.where((below > 0) & (above > 0), below * above * apart * apart, -1.0)
    best = spread.argmax(axis=1)
    return np.where(spread.max(axis=1, initial=-1) > 0, best, FLAT)


def cluster(changed: np.ndarray) -> np.ndarray:
    """For masks (n, h, w) the largest number of set pixels in any 3 x 3 square."""
    n, h, w = changed.shape
    padded = np.zeros((n, h + 2, w + 2), np.int16)
    padded[:, 1:-1, 1:-1] = changed
    rows = padded[:, :-2] + padded[:, 1:-1] + padded[:, 2:]
    return (rows[..., :-2] + rows[..., 1:-1] + rows[..., 2:]).max(axis=(1, 2), initial=0)


def mean_abs_diff(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None or a.shape != b.shape:
        return math.inf
    return float(np.abs(a.astype(np.float32) - b.astype(np.float32)).mean())


def square_sums(g: np.ndarray, k: int) -> np.ndarray:
    """Sums of the k x k square around each pixel of planes (..., h, w); the edge is repeated."""
    edge = [(0, 0)] * (g.ndim - 2)
    padded = np.pad(g, [*edge, (k // 2, k // 2), (k // 2, k // 2)], mode="edge").astype(np.int64 if g.dtype.kind in "iu" else np.float64)
    sums = np.pad(padded.cumsum(axis=-2).cumsum(axis=-1), [*edge, (1, 0), (1, 0)])
    return sums[..., k:, k:] - sums[..., :-k, k:] - sums[..., k:, :-k] + sums[..., :-k, :-k]


def box_blur(g: np.ndarray, k: int) -> np.ndarray:
    """Mean of the k x k square around each pixel of planes (..., h, w); the edge is repeated."""
    return g.astype(np.float32) if k <= 1 else (square_sums(g, k) / (k * k)).astype(np.float32)


def blur_size(height: int) -> int:
    return max(9, min(31, round(height * 0.6 / 2) * 2 + 1))


def contrast(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance of each pixel of planes (..., h, w) from its surroundings as a fraction, exact for whole levels: numerator, denominator.

    Scaled so that the 95th percentile (between its neighbours in proportion) of a plane is 255, if
    that is above one level.
    """
    k = blur_size(g.shape[-2])
    g = g.astype(np.int64) if g.dtype.kind in "iu" else g.astype(np.float64)
    apart = np.abs(k * k * g - square_sums(g, k))
    flat = np.sort(apart.reshape(*apart.shape[:-2], -1), axis=-1)
    at, rest = divmod(95 * (flat.shape[-1] - 1), 100)
    high = 100 * flat[..., at] + rest * (flat[..., min(at + 1, flat.shape[-1] - 1)] - flat[..., at])
    strong = (high > 100 * k * k)[..., None, None]
    return np.where(strong, 25500 * apart, apart), np.where(strong, high[..., None, None], k * k) + np.zeros_like(apart)


def separate(g: np.ndarray, mode: str, threshold: int | None = None) -> np.ndarray:
    """Planes (..., h, w) with text apart from its background: `binary` or `contrast`; other modes keep them."""
    if mode == "binary":
        mean = g.mean(axis=(-2, -1), keepdims=True, dtype=np.float64)
        return np.where(g > (np.floor(mean) if threshold is None else threshold), np.float32(255), np.float32(0))
    if mode != "contrast":
        return g.astype(np.float32)
    value, unit = contrast(g)
    return np.clip(value / unit, 0, 255).astype(np.float32)


def similar_planes(a: np.ndarray, b: np.ndarray, mode: str, threshold: np.ndarray | int | None, most_mean: float, most_changed: int) -> np.ndarray:
    """For pairs of planes (n, h, w): little mean difference and few pixels that differ by more than 10, after separation by mode."""
    limit = threshold if threshold is None or np.ndim(threshold) == 0 else np.asarray(threshold)[:, None, None]
    diff = np.abs(separate(a, mode, limit) - separate(b, mode, limit))
    return (diff.mean(axis=(-2, -1)) <= most_mean) & ((diff > 10).sum(axis=(-2, -1)) <= most_changed)


def similar(a: np.ndarray | None, b: np.ndarray | None, mode: str, threshold: int | None, most_mean: float, most_changed: int) -> bool:
    """The same for one pair; planes of different shapes, or none, are not similar."""
    if a is None or b is None or a.shape != b.shape:
        return False
    return bool(similar_planes(a[None], b[None], mode, threshold, most_mean, most_changed)[0])


@functools.lru_cache(maxsize=64)
def _axis(size: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    at = np.clip((np.arange(to) + 0.5) * (size / to) - 0.5, 0, size - 1)
    low = np.floor(at).astype(int)
    return low, np.minimum(low + 1, size - 1), (at - low).astype(np.float32)


def resize_planes(planes: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, (..., h, w) to float32 (..., height, width)."""
    planes = planes.astype(np.float32)
    if planes.shape[-2:] == (height, width):
        return planes
    y0, y1, fy = _axis(planes.shape[-2], height)
    x0, x1, fx = _axis(planes.shape[-1], width)
    rows = planes[..., y0, :] * (1 - fy[:, None]) + planes[..., y1, :] * fy[:, None]
    return rows[..., x0] * (1 - fx) + rows[..., x1] * fx


def resize(image: np.ndarray, width: int, height: int) -> np.ndarray:
    """Bilinear, one image (h, w) or (h, w, channels) to float32."""
    if image.ndim == 2:
        return resize_planes(image, width, height)
    return np.ascontiguousarray(resize_planes(image.transpose(2, 0, 1), width, height).transpose(1, 2, 0))


def prepare_all(crops: np.ndarray, aspect: float = 0.0, gamma: float = 2.0) -> np.ndarray:
    """Crops of one size (n, h, w, channels) at the recogniser's height, float32; gamma > 0 makes them gray and applies it."""
    h, w = crops.shape[1:3]
    width = max(1, round(INPUT_HEIGHT * aspect)) if aspect > 0 else max(1, int(w * INPUT_HEIGHT / h)) if h else w
    out = np.ascontiguousarray(resize_planes(crops.transpose(0, 3, 1, 2), width, INPUT_HEIGHT).transpose(0, 2, 3, 1))
    if gamma <= 0:
        return out
    plane = out[..., 0] if out.shape[-1] == 1 else out[..., :3] @ np.array(GRAY_WEIGHTS, np.float32)
    return np.repeat((255 * np.power(plane / 255, gamma)).astype(np.float32)[..., None], 3, axis=-1)


def prepare(crop: np.ndarray, aspect: float = 0.0, gamma: float = 2.0) -> np.ndarray:
    """prepare_all of one crop (h, w, channels)."""
    return prepare_all(crop[None], aspect, gamma)[0]


def separate_input(image: np.ndarray, mode: str, threshold: int | None = None) -> np.ndarray:
    plane = image[..., 0] if image.shape[-1] == 1 else image[..., :3] @ np.array(GRAY_WEIGHTS, np.float32)
    return np.repeat(separate(plane, mode, threshold)[..., None], 3, axis=-1)


def normalise(image: np.ndarray, ratio: float) -> np.ndarray:
    """(h, w, 3) to (3, 48, int(48 ratio)): -1..1, filled with 0 on the right."""
    width = int(INPUT_HEIGHT * ratio)
    own = min(width, math.ceil(INPUT_HEIGHT * (image.shape[1] / image.shape[0])))
    out = np.zeros((3, INPUT_HEIGHT, width), np.float32)
    out[:, :, :own] = (resize(image, own, INPUT_HEIGHT).transpose(2, 0, 1) / 255 - 0.5) / 0.5
    return out


def batch_ratio(sizes: list[tuple[int, int]], floor: int = 224) -> float:
    """Width to height of a batch of (height, width): its widest image, floor / 48 at least."""
    return max([floor / INPUT_HEIGHT, *(w / h for h, w in sizes)])


def duration_text(seconds: float) -> str:
    minutes, s = divmod(round(max(0.0, float(seconds))), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}:{minutes:02d}:{s:02d}" if hours else f"{minutes}:{s:02d}"


def ctc(p: np.ndarray, charset: list[str]) -> tuple[str, float]:
    """Text and confidence of one output (steps, classes): runs count once, by their first step; class 0 is blank."""
    best = p.argmax(axis=1)
    keep = np.flatnonzero((np.r_[-1, best[:-1]] != best) & (best != 0))
    scores = [round(float(x), 5) for x in p[keep, best[keep]]]
    return "".join(charset[k] for k in best[keep]), round(float(np.mean(scores)), 5) if scores else 0.0
