"""The anchored merge by ranges against one fold in a row."""

from __future__ import annotations

import numpy as np
import pytest

from textframes.functions import arrays
from textframes.operators import segments

SEGS = "clip_id string, seg bigint, h int, w int, luma binary"


def planes_of(spark, clips: dict[str, np.ndarray]):
    rows = [(name, k, *x.shape, bytearray(x.tobytes())) for name, g in clips.items() for k, x in enumerate(g)]
    return spark.createDataFrame(rows, SEGS), spark.createDataFrame([(name, 100) for name in clips], "clip_id string, threshold int")


def in_a_row(g: np.ndarray, limit: float, changed: int = 1 << 20) -> list[int]:
    out, anchor = [], None
    for k, x in enumerate(g):
        if anchor is None or not arrays.similar(g[anchor], x, "raw", 100, limit, changed):
            anchor = k
        out.append(anchor)
    return out


def cases() -> dict[str, np.ndarray]:
    r = np.random.default_rng(3)
    drift = np.repeat(np.arange(60, dtype=np.uint8)[:, None, None], 4, axis=1).repeat(5, axis=2)  # an anchor lasts for a number of segments that the limit sets
    held = np.repeat(r.integers(0, 255, (6, 4, 5)).astype(np.uint8), 11, axis=0)
    return {
        "noise": r.integers(0, 255, (50, 4, 5)).astype(np.uint8),
        "one": np.full((70, 4, 5), 9, np.uint8),
        "held": held,
        "drift": drift * 3,
        "walk": np.clip(128 + np.cumsum(r.integers(-6, 7, (80, 1, 1)), axis=0) + np.zeros((1, 4, 5), int), 0, 255).astype(np.uint8),
        "back": np.concatenate([held[:20], held[:20][::-1], held[:20]]),
        "single": held[:1],
    }


@pytest.mark.parametrize(("size", "limit"), [(1, 20.0), (3, 3.0), (3, 60.0), (3, 254.0), (7, 20.0)])
def test_ranges_give_what_one_fold_gives(spark, monkeypatch, size, limit):
    monkeypatch.setattr(segments, "MERGE_RANGE", size)
    clips = cases()
    rows = segments.merged_ids(*planes_of(spark, clips), "raw", limit, 1 << 20).collect()
    for name, g in clips.items():
        assert [r["first_seg"] for r in sorted((r for r in rows if r["clip_id"] == name), key=lambda r: r["seg"])] == in_a_row(g, limit), name


def test_one_picture_needs_few_rounds(spark, monkeypatch):
    """1,000 ranges of one picture: each is folded again twice, not once for each range before it."""
    monkeypatch.setattr(segments, "MERGE_RANGE", 4)
    g = np.full((4000, 2, 3), 9, np.uint8)
    g[2000:, 0, 0] += 1  # near, but another plane
    rounds: list[int] = []
    rows = segments.merged_ids(*planes_of(spark, {"c": g}), "raw", 3.0, 100, rounds=rounds).collect()
    assert {r["first_seg"] for r in rows} == {0} and len(rows) == 4000
    assert len(rounds) <= 12 and sum(rounds) <= 2 * 1000 and rounds[-1] == 0


def test_written_tables_are_named(spark, monkeypatch):
    """What the merge writes can be removed afterwards."""
    import os

    from textframes.sources.shared import removed

    paths: list[str] = []
    monkeypatch.setattr(segments, "MERGE_RANGE", 8)
    segments.merged_ids(*planes_of(spark, {"c": cases()["held"]}), "raw", 3.0, 100, paths=paths).count()
    assert paths and all(os.path.isdir(p.removeprefix("file://")) for p in paths)
    gone = list(paths)
    removed(spark, paths)
    assert not paths and not any(os.path.exists(p.removeprefix("file://")) for p in gone)
