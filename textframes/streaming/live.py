"""Segments of live clips: an extension that gives the batch plan's segments, without merge, from a stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textframes.functions import arrays
from textframes.operators.features import CALIBRATION
from textframes.operators.segments import CHANGE

OUT = "clip_id string, seg bigint, start bigint, end bigint, n bigint, rep_frame bigint"
STATE = "waiting array<struct<fi: bigint, h: int, w: int, luma: binary>>, threshold int, seg bigint, start bigint, end bigint, n bigint, rep bigint, sharp double, h int, w int, last binary"


def live_segments(features: DataFrame, change: float = CHANGE) -> DataFrame:
    """features: a stream of clip_id, fi, h, w, luma, and done (true on a clip's last row). Emits closed segments.

    State of a clip: up to CALIBRATION samples until the threshold is set, then one sample and the
    open segment. Rows of a clip must come in order from batch to batch; in a batch they are sorted.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.exists:
            waiting, threshold, seg, start, end, n, rep, sharp, h, w, last = state.get
            waiting = [tuple(x) for x in waiting] if waiting is not None else []
        else:
            waiting, threshold, seg, start, end, n, rep, sharp, h, w, last = [], None, 0, -1, -1, 0, -1, -1.0, 0, 0, None
        pdf = pd.concat([*batches]).sort_values("fi")
        done = bool(pdf["done"].any())
        rows = [(int(f), int(a), int(b), bytes(g)) for f, a, b, g in zip(pdf["fi"], pdf["h"], pdf["w"], pdf["luma"], strict=True)]
        if threshold is None:
            waiting += rows
            rows = []
            if len(waiting) >= CALIBRATION or done:
                own = [arrays.otsu(arrays.histograms(np.frombuffer(g, np.uint8).reshape(1, a, b)))[0] for _, a, b, g in waiting[:CALIBRATION]]
                threshold, rows, waiting = int(np.median(own)), waiting, []
        out = []
        for fi, a, b, g in rows:
            plane = np.frombuffer(g, np.uint8).reshape(a, b)
            s = float(arrays.sharpness(plane[None])[0])
            changed = last is not None and ((a, b) != (h, w) or arrays.cluster(((plane > threshold) != (np.frombuffer(last, np.uint8).reshape(h, w) > threshold))[None])[0] >= change)
            if changed:
                out.append((key[0], seg, start, end, n, rep))
                seg, n, sharp = seg + 1, 0, -1.0
            start = fi if n == 0 else start
            end, n = fi, n + 1
            if s > sharp:
                rep, sharp = fi, s
            h, w, last = a, b, g
        if done:
            out.append((key[0], seg, start, end, n, rep))
            state.remove()
        else:
            state.update(([x for x in waiting], threshold, seg, start, end, n, rep, sharp, h, w, last))
        yield pd.DataFrame(out, columns=["clip_id", "seg", "start", "end", "n", "rep_frame"])

    rows = features.select("clip_id", "fi", "h", "w", "luma", "done")
    return rows.groupBy("clip_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
