"""Settings: each hook by session, environment and code; models that are sent to workers; timers and progress."""

from __future__ import annotations

import os

import numpy as np
import pytest

from textframes.operators import models
from textframes.operators.recognise import OnnxRecogniser
from textframes.operators.timing import Clock
from textframes.plans.extractor import FieldExtractor, Options, SegmentPlan
from textframes.plans.settings import HOOKS, resolved

#: option, setting, good text, its value, bad text (None: every text can be read), value given in code
TABLE = [
    ("gamma", "segmentation.gamma", "2.5", 2.5, "x", 1.0),
    ("input_gamma", "input.gamma", "0", 0.0, "", 1.5),
    ("input_separation", "input.separation", "1", "contrast", None, "binary"),
    ("merge_separation", "merge.separation", "contrast", "contrast", None, "binary"),
    ("fill_width", "input.width", "320", 320, "-1", 100),
    ("batch_rows", "input.batch", "4", 4, "0", 16),
    ("threads", "input.threads", "2", 2, "many", 3),
    ("dual_pipeline", "chunks.enabled", "on", True, "perhaps", False),
    ("profile", "profile", "0", False, "2", True),
]


class Session:
    """The part of a session that is read."""

    def __init__(self, values):
        self.conf = values


@pytest.mark.parametrize("option, name, good, value, bad, code", TABLE)
def test_each_hook(option, name, good, value, bad, code):
    first = HOOKS[option][2]
    outside = "TEXTFRAMES_" + name.upper().replace(".", "_")
    session = Session({f"textframes.{name}": good})
    out, notes = resolved({option: None}, session, {})
    assert out[option] == value and notes[option] == f"textframes.{name}={good}"
    assert resolved({option: None}, None, {outside: good})[0][option] == value
    assert resolved({option: code}, session, {})[0][option] == (code if first else value)
    assert resolved({option: code}, Session({}), {}) == ({option: code}, {})
    if bad:
        out, notes = resolved({option: None}, Session({f"textframes.{name}": bad}), {})
        assert out == {} and notes == {option: f"textframes.{name}={bad} ignored"}
        assert resolved({option: None}, Session({f"textframes.{name}": bad}), {outside: good})[0] == {option: value}  # the next one counts


def test_every_hook_is_in_the_table():
    assert {r[0] for r in TABLE} == set(HOOKS)


def test_merge_mode_goes_before_input_mode():
    both = {"textframes.input.separation": "2"}
    assert resolved({"merge_separation": "contrast"}, Session(both), {})[0]["merge_separation"] == "binary"
    assert resolved({}, Session(both | {"textframes.merge.separation": "1"}), {})[0] == {"merge_separation": "contrast", "input_separation": "binary"}
    assert resolved({}, Session({"textframes.merge.separation": "neither"}), {})[0]["merge_separation"] == "raw"
    assert resolved({}, Session({}), {"TEXTFRAMES_INPUT_SEPARATION": "1", "TEXTFRAMES_MERGE_SEPARATION": "2"})[0]["merge_separation"] == "binary"


def test_settings_reach_the_extractor(spark):
    from tests.test_plan import frames_of, made

    spark.conf.set("textframes.input.width", "96")
    spark.conf.set("textframes.segmentation.gamma", "oops")
    try:
        e = FieldExtractor(frames_of(spark, made(30, 20)))
        assert e.options.fill_width == 96 and e.options.gamma == 0.0
        assert FieldExtractor(frames_of(spark, made(30, 20)), fill_width=64).options.fill_width == 64
        meta = e.extract().meta
    finally:
        spark.conf.unset("textframes.input.width")
        spark.conf.unset("textframes.segmentation.gamma")
    assert meta["settings"] == {"fill_width": "textframes.input.width=96", "gamma": "textframes.segmentation.gamma=oops ignored"}


def test_models_are_found_where_only_the_driver_has_them(spark, tmp_path):
    """The files are gone from the driver's folder when workers look: they have what was sent."""
    from tests.test_plan import frames_of, made, tiny_model

    weight, bias = np.array([0.0, 9, -9, 4, -4, -9]), np.array([0.5, -3, -3, 0.4, 0.4, -9])
    own = tmp_path / "driver"
    own.mkdir()
    tiny_model(str(own / "shipped.onnx"), 8, weight, bias)
    (own / "shipped.txt").write_text("a\nb\nc\nd\n", encoding="utf-8")
    names = models.ship(spark, str(own / "shipped.onnx"), str(own / "shipped.txt"))
    assert names == ["shipped.onnx", "shipped.txt"]
    g, options = made(31, 40), Options(fill_width=64, input_gamma=0.0)
    before = SegmentPlan(frames_of(spark, g), options, (60, 48)).texts(lambda: OnnxRecogniser(str(own / "shipped.onnx"), ["", "a", "b", "c", "d", " "])).collect()
    os.remove(own / "shipped.onnx")
    os.remove(own / "shipped.txt")
    after = SegmentPlan(frames_of(spark, g), options, (60, 48)).texts(lambda: OnnxRecogniser("shipped.onnx", "shipped.txt")).collect()
    key = lambda rows: sorted((r["seg"], r["text"] or "", r["confidence"]) for r in rows)
    assert key(after) == key(before) and len({r["text"] for r in after}) > 1
    with pytest.raises(FileNotFoundError, match="absent.onnx"):
        models.found("absent.onnx", [str(tmp_path)])
    with pytest.raises(FileNotFoundError):
        models.ship(spark, str(own / "shipped.onnx"))


def test_folders_are_looked_at_in_order(tmp_path):
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "m").write_text(name)
    assert models.found("m", [str(tmp_path / "none"), str(tmp_path / "b"), str(tmp_path / "a")]) == str(tmp_path / "b" / "m")


def test_timers_by_stage_and_chunk(spark):
    from tests.test_plan import frames_of, made

    clock = Clock(spark.sparkContext)
    plan = SegmentPlan(frames_of(spark, made(32, 64)), Options(chunks=4), (60, 48), clock)
    plan.texts().collect()
    assert len(clock.parts) >= 2 and clock.samples == 64
    assert all(v > 0 for p in clock.parts for v in p.values()) and {k for p in clock.parts for k in p} == {"decode", "segment", "ocr"}
    e = FieldExtractor(frames_of(spark, made(32, 64)), dual_pipeline=True)
    e.extract()
    assert {"decode", "segment", "ocr", "total", "rss_mb"} <= set(e.timing_flat()) and all(e.timing[k] > 0 for k in ("decode", "segment", "ocr"))
    bare = FieldExtractor(frames_of(spark, made(32, 20)), profile=False)
    bare.extract()
    assert set(bare.timing_flat()) == {"total", "rss_mb"}


def test_progress_grows_with_samples(spark, tmp_path):
    from tests.test_plan import made
    from textframes.sources.frames import FileFrames
    from textframes.sources.raw_clip import write_clip

    g, path = made(33, 400), str(tmp_path / "c.raw")
    write_clip(path, g[..., None], "gray")
    clock = Clock(spark.sparkContext)
    plan = SegmentPlan(FileFrames(spark, path, rows=25), Options(), (60, 48), clock)
    seen: list[int] = []
    import threading

    done = threading.Event()
    watch = threading.Thread(target=lambda: [seen.append(clock.samples) for _ in iter(lambda: done.wait(0.01), True)])
    watch.start()
    plan.raw_segments.count()
    done.set()
    watch.join()
    assert clock.samples == 400 and seen == sorted(seen)
    assert len({x for x in seen if 0 < x < 400}) >= 2  # told while tasks end, a range at a time
    said: list[tuple[str, float]] = []
    FieldExtractor(path, progress=lambda m, p: said.append((m, p))).extract()
    assert said[-1][1] == 100.0 and [p for _, p in said] == sorted(p for _, p in said) and any(m == "400 samples" for m, _ in said[:-1])
