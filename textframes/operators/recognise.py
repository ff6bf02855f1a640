"""Batched text recognition of representative frames with a pluggable recogniser."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from textframes.functions import arrays
from textframes.functions.arrays import INPUT_HEIGHT
from textframes.operators.models import characters, found
from textframes.operators.timing import Clock

#: Takes images (48 x w x 3, float32 0..255, in order) and gives text and score of each.
Recogniser = Callable[[list[np.ndarray]], list[tuple[str, float]]]
#: Images of a batch that a recogniser gets together.
BATCH = 16


class StandIn:
    """Stands in for a recogniser where there is no model: the levels of eight parts of the width, as a CTC output.

    A part's level (cut to a whole one) names its class, blank among them, and its probability.
    """

    STEPS, LETTERS = 8, ["", "a", "b", "c", "d"]

    def __call__(self, images: list[np.ndarray]) -> list[tuple[str, float]]:
        out = []
        for image in images:
            w = image.shape[1]
            units = np.floor(image[..., 0].astype(np.float64) * INPUT_HEIGHT + 0.5).astype(np.int64)  # bilinear weights leave whole units
            p = np.zeros((self.STEPS, len(self.LETTERS)))
            for k in range(self.STEPS):
                part = units[:, k * w // self.STEPS : (k + 1) * w // self.STEPS]
                level = int(part.sum()) // (INPUT_HEIGHT * max(1, part.size))
                p[k, level // 8 % len(self.LETTERS)] = (50 + level % 50) / 100
            out.append(arrays.ctc(p, self.LETTERS))
        return out


class LinearRecogniser:
    """A CTC recogniser of one linear layer: each step sees the mean levels of its part of the width in bands of the height.

    weight: bands x classes, bias: classes; logits are their product with the levels (cut to whole ones), divided by
    `heat`. Probabilities are a softmax, rounded half up to hundredths. Class 0 is blank. The same product can be written in SQL.
    """

    def __init__(self, weight: list[list[int]], bias: list[int], charset: list[str], steps: int = 8, heat: float = 64.0) -> None:
        self.weight, self.bias, self.charset, self.steps, self.heat = np.array(weight), np.array(bias), charset, steps, heat

    def outputs(self, image: np.ndarray) -> np.ndarray:
        """Probabilities (steps, classes) of one image."""
        bands, w = len(self.weight), image.shape[1]
        units = np.floor(image[..., 0].astype(np.float64) * INPUT_HEIGHT + 0.5).astype(np.int64)  # bilinear weights leave whole units
        rows = np.add.reduceat(units, np.arange(bands) * INPUT_HEIGHT // bands, axis=0)
        cuts = np.arange(self.steps + 1) * w // self.steps
        sums = np.pad(rows.cumsum(axis=1), ((0, 0), (1, 0)))
        wide = np.maximum(1, np.diff(cuts))
        levels = (sums[:, cuts[1:]] - sums[:, cuts[:-1]]) // (INPUT_HEIGHT * (INPUT_HEIGHT // bands) * wide)
        z = (levels.T @ self.weight + self.bias) / self.heat
        p = np.exp(z - z.max(axis=1, keepdims=True))
        return np.floor(p / p.sum(axis=1, keepdims=True) * 100 + 0.5) / 100

    def __call__(self, images: list[np.ndarray]) -> list[tuple[str, float]]:
        return [arrays.ctc(self.outputs(image), self.charset) for image in images]


class OnnxRecogniser:
    """A CTC model file and a character table, run by onnxruntime: padded batches, then arrays.ctc.

    model, and charset if it is a path, are found where the recogniser runs: as paths, in folders, or
    among the files that models.ship() sent.
    """

    def __init__(self, model: str, charset: list[str] | str, fill_width: int = 224, threads: int = 1, folders: tuple[str, ...] = ()) -> None:
        self.model, self.charset, self.fill_width, self.threads, self.folders, self.session = model, charset, fill_width, threads, folders, None

    def __call__(self, images: list[np.ndarray]) -> list[tuple[str, float]]:
        if self.session is None:
            import onnxruntime

            options = onnxruntime.SessionOptions()
            options.intra_op_num_threads = self.threads
            self.session = onnxruntime.InferenceSession(found(self.model, self.folders), options, providers=["CPUExecutionProvider"])
            if isinstance(self.charset, str):
                self.charset = characters(found(self.charset, self.folders))
        if not images:
            return []
        order = np.argsort([i.shape[1] / i.shape[0] for i in images], kind="stable").tolist()
        ratio = arrays.batch_ratio([i.shape[:2] for i in images], self.fill_width)
        batch = np.stack([arrays.normalise(images[k], ratio) for k in order])
        texts: list[tuple[str, float]] = [("", 0.0)] * len(images)
        for at in range(0, len(batch), BATCH):
            (p,) = self.session.run(None, {self.session.get_inputs()[0].name: batch[at : at + BATCH]})
            for k, one in zip(order[at : at + BATCH], p, strict=True):
                texts[k] = arrays.ctc(one, self.charset)
        return texts


def recognise(reps: DataFrame, make: Callable[[], Recogniser], aspect: float = 0.0, gamma: float = 2.0, separation: str = "",
              fill_width: int = 0, batch_rows: int = BATCH, clock: Clock | None = None) -> DataFrame:
    """reps (w, h, fmt, data and other columns, which are carried; a row for each segment) with text and confidence.

    make() builds the recogniser once in each Python worker. It gets batch_rows images at most,
    those of like width together; fill_width is the width that it pads to at least, if it pads. Results
    go back to their rows. An empty text becomes null and
    keeps its confidence; a row without data has neither.
    """
    held: list[Recogniser] = []
    fields = [f for f in reps.schema.fields if f.name not in ("text", "confidence")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from textframes.operators.features import shaped

        if not held:
            held.append(make())
            if fill_width and hasattr(held[0], "fill_width"):
                held[0].fill_width = fill_width
        for batch in batches:
            began = time.perf_counter()
            text: list[str | None] = [None] * batch.num_rows
            score = [0.0] * batch.num_rows
            data = batch.column("data")
            kinds = [*zip(*(batch.column(c).to_pylist() for c in ("w", "h", "fmt")), strict=True)]
            full = [i for i in range(batch.num_rows) if data[i].is_valid]
            full.sort(key=lambda i: kinds[i][0] / max(1, kinds[i][1]))
            for at in range(0, len(full), batch_rows):
                rows = full[at : at + batch_rows]
                of: dict[int, np.ndarray] = {}
                for kind in dict.fromkeys(kinds[i] for i in rows):  # crops of one size and format together
                    alike = [i for i in rows if kinds[i] == kind]
                    crops = shaped([data[i].as_py() for i in alike], *kind)
                    of.update(zip(alike, arrays.prepare_all(arrays.packed_to_rgb(crops) if kind[2] == "nv12" else crops, aspect, gamma), strict=True))
                images = [arrays.separate_input(of[i], separation) if separation else of[i] for i in rows]
                for i, (t, s) in zip(rows, held[0](images), strict=True):
                    text[i], score[i] = t or None, float(s)
            if clock:
                chunk = batch.column("chunk")[0].as_py() if "chunk" in batch.schema.names and batch.num_rows else 0
                clock.add("ocr", time.perf_counter() - began, chunk)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(text, pa.string()), pa.array(score)], [*batch.schema.names, "text", "confidence"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return reps.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, schema + ", text string, confidence double")
