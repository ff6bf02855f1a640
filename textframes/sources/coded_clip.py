"""Clips whose frames have no fixed place in the file: YUV4MPEG2, and frames coded against the one before.

`y4m`: the public format of uncompressed planar frames, each after a header of its own length. 4:2:0 is
read as packed rows, mono as gray. Every frame is a key frame.

`keyclip`: a header line as a raw clip's (magic KEYCLIP), then records: a byte for the kind, the payload's
length as four bytes (little-endian), the payload. K: a deflated frame. D: a frame's exclusive or with the
frame before it, deflated. I: the index, pairs of 64-bit numbers (key frame, place in the file), the last pair being the number of
frames and the place of I itself; the file's last 8 bytes give that place. A file without an index is walked once.

A reader starts at the key frame at or before what it wants and decodes forward; partitions begin at key
frames where there are any near. Options are those of raw clips.
"""

from __future__ import annotations

import os
import struct
import zlib
from bisect import bisect_right

import numpy as np
from pyspark.sql.datasource import DataSource

from textframes.sources.raw_clip import FilteringReader, RawClipReader, RawClips

Y4M, KEYS = "YUV4MPEG2", "KEYCLIP"


def write_keyclip(path: str, frames: np.ndarray, fmt: str, color_range: int = 1, fps: tuple[int, int] = (30, 1), every: int = 12, index: bool = True) -> None:
    """frames: as for write_clip. A key frame every so many frames."""
    h, w = (frames.shape[1] * 2 // 3, frames.shape[2]) if fmt == "nv12" else frames.shape[1:3]
    keys, before = [], None
    with open(path, "wb") as f:
        f.write(f"{KEYS} {w} {h} {fmt} {color_range} {fps[0]} {fps[1]}\n".encode())
        for k, frame in enumerate(frames):
            flat = np.ascontiguousarray(frame, np.uint8).ravel()
            if k % every == 0:
                keys.append((k, f.tell()))
            body = zlib.compress((flat if k % every == 0 else flat ^ before).tobytes(), 6)
            f.write((b"K" if k % every == 0 else b"D") + struct.pack("<I", len(body)) + body)
            before = flat
        if index:
            at = f.tell()
            body = np.array([*keys, (len(frames), at)], "<i8").tobytes()
            f.write(b"I" + struct.pack("<I", len(body)) + body + struct.pack("<q", at))


def write_y4m(path: str, frames: np.ndarray, fmt: str, color_range: int = 0, fps: tuple[int, int] = (30, 1), marks: list[str] | None = None) -> None:
    """frames: gray (n, h, w, 1), or packed 4:2:0 (n, rows, w) of even size. marks: a parameter of each frame's header."""
    h, w = (frames.shape[1] * 2 // 3, frames.shape[2]) if fmt == "nv12" else frames.shape[1:3]
    with open(path, "wb") as f:
        f.write(f"{Y4M} W{w} H{h} F{fps[0]}:{fps[1]} Ip A1:1 {'C420jpeg' if fmt == 'nv12' else 'Cmono'} XCOLORRANGE={'FULL' if color_range else 'LIMITED'}\n".encode())
        for k, frame in enumerate(frames):
            f.write(b"FRAME" + (f" I{marks[k]}".encode() if marks and marks[k] else b"") + b"\n")
            if fmt == "nv12":
                pairs = frame[h:].reshape(-1, w // 2, 2)
                f.write(frame[:h].tobytes() + pairs[..., 0].tobytes() + pairs[..., 1].tobytes())
            else:
                f.write(np.ascontiguousarray(frame, np.uint8).tobytes())


class CodedHeader:
    """A coded clip's size, format and rate, and where its key frames are."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            words = f.readline(400).decode("ascii", "replace").split()
            self.offset = f.tell()
            self.kind = words[0] if words else ""
            if self.kind == Y4M:
                self._y4m(path, f, {x[0]: x[1:] for x in words[1:] if x[0] != "X"} | {"X": " ".join(x for x in words if x[0] == "X")})
            elif self.kind == KEYS:
                self._keyclip(path, f, words)
            else:
                raise ValueError(f"{path} is no coded clip")

    def _shape(self, num: int, den: int) -> None:
        self.fps = num / den if num > 0 and den > 0 else 30.0
        rows = self.h + (self.h + 1) // 2 if self.fmt == "nv12" else self.h
        self.size = rows * self.w * (3 if self.fmt == "rgb" else 1)

    def _y4m(self, path: str, f, named: dict[str, str]) -> None:  # noqa: ANN001
        self.w, self.h = int(named["W"]), int(named["H"])
        chroma = named.get("C", "420")
        if not (chroma.startswith("mono") or chroma.startswith("420")) or chroma in ("420p10", "420p12", "420p16", "mono16"):
            raise ValueError(f"{path}: {chroma} is not read; mono and 4:2:0 of 8 bits are")
        self.fmt, self.color_range = ("gray" if chroma.startswith("mono") else "nv12"), int("COLORRANGE=FULL" in named["X"])
        num, _, den = named.get("F", "30:1").partition(":")
        self._shape(int(num), int(den or 1))
        self.planes = self.w * self.h + (2 * ((self.w + 1) // 2) * ((self.h + 1) // 2) if self.fmt == "nv12" else 0)
        self.keys, self.places = [], []
        end = os.path.getsize(path)
        while (line := f.readline(400)).startswith(b"FRAME") and f.tell() + self.planes <= end:
            self.keys.append(len(self.keys))
            self.places.append(f.tell())  # of the planes, after the header
            f.seek(self.planes, 1)
        del line
        self.frames = len(self.keys)

    def _keyclip(self, path: str, f, words: list[str]) -> None:  # noqa: ANN001
        _, w, h, self.fmt, color_range, num, den = words
        self.w, self.h, self.color_range = int(w), int(h), int(color_range)
        self._shape(int(num), int(den))
        end = os.path.getsize(path)
        if end - self.offset >= 13:
            f.seek(end - 8)
            (at,) = struct.unpack("<q", f.read(8))
            if self.offset <= at < end - 13:
                f.seek(at)
                kind, (n,) = f.read(1), struct.unpack("<I", f.read(4))
                if kind == b"I" and at + 5 + n == end - 8 and n % 16 == 0:
                    pairs = np.frombuffer(f.read(n), "<i8").reshape(-1, 2)
                    if pairs[-1, 1] == at:
                        self.keys, self.places, self.frames = pairs[:-1, 0].tolist(), pairs[:-1, 1].tolist(), int(pairs[-1, 0])
                        return
        f.seek(self.offset)
        self.keys, self.places, self.frames = [], [], 0
        while len(head := f.read(5)) == 5 and head[:1] in (b"K", b"D"):
            (n,) = struct.unpack("<I", head[1:])
            if f.tell() + n > end:
                break
            if head[:1] == b"K":
                self.keys.append(self.frames)
                self.places.append(f.tell() - 5)
            self.frames += 1
            f.seek(n, 1)


class Decoder:
    """Frames of one file by number; forward from the last one where no key frame is nearer."""

    def __init__(self, path: str, head: CodedHeader) -> None:
        self.file, self.head, self.at, self.frame, self.decoded = open(path, "rb"), head, -1, None, 0

    def get(self, fi: int) -> np.ndarray:
        key = bisect_right(self.head.keys, fi) - 1
        if key < 0 or fi >= self.head.frames:
            raise ValueError(f"no frame {fi} can be decoded")
        if not self.head.keys[key] <= self.at <= fi:
            self.file.seek(self.head.places[key])
            self.at = self.head.keys[key] - 1
        while self.at < fi:
            self.frame = self._next()
            self.at += 1
            self.decoded += 1
        return self.frame

    def _next(self) -> np.ndarray:
        head = self.head
        if head.kind == Y4M:
            place = head.places[self.at + 1]
            self.file.seek(place)
            flat = np.frombuffer(self.file.read(head.planes), np.uint8)
            return flat if head.fmt == "gray" else self._packed(flat)
        kind, (n,) = self.file.read(1), struct.unpack("<I", self.file.read(4))
        flat = np.frombuffer(zlib.decompress(self.file.read(n)), np.uint8)
        return flat if kind == b"K" else flat ^ self.frame

    def _packed(self, flat: np.ndarray) -> np.ndarray:
        """Planar 4:2:0 as packed rows; an odd last column of chroma has no place there."""
        w, h = self.head.w, self.head.h
        cw, ch = (w + 1) // 2, (h + 1) // 2
        out = np.full((h + ch, w), 128, np.uint8)
        out[:h] = flat[: w * h].reshape(h, w)
        u, v = (flat[w * h + k * cw * ch :][: cw * ch].reshape(ch, cw)[:, : w // 2] for k in range(2))
        out[h:, 0 : w // 2 * 2 : 2], out[h:, 1 : w // 2 * 2 : 2] = u, v
        return out.ravel()

    def close(self) -> None:
        self.file.close()


class CodedReader(RawClipReader):
    """Ranges that begin at key frames where one lies in them; a range's halo is decoded from the key frame before it."""

    _open: tuple[str, Decoder] | None = None

    @staticmethod
    def header(file: str) -> CodedHeader:
        return CodedHeader(file)

    def spans(self, n: int, head: CodedHeader | None = None) -> list[tuple[int, int, int]]:
        plain = super().spans(n, head)
        if self.first or self.spread or head is None or len(plain) < 2:
            return plain
        starts = [plain[0][0]]
        for a, b, _ in plain[1:]:
            key = bisect_right(head.keys, self.start + a * self.stride - 1)  # the first key frame from here on
            at = -(-(head.keys[key] - self.start) // self.stride) if key < len(head.keys) else b
            starts.append(at if a <= at < b else a)
        return [(a, b, 1) for a, b in zip(starts, [*starts[1:], plain[-1][1]], strict=True)]

    def frames(self, file: str, head: CodedHeader, ids: list[int]) -> np.ndarray:
        if self._open is None or self._open[0] != file:
            if self._open is not None:
                self._open[1].close()
            self._open = (file, Decoder(file, head))
        return np.concatenate([self._open[1].get(fi) for fi in ids])


class FilteringCodedReader(CodedReader, FilteringReader):
    """With bounds on fi from filters."""


class CodedClips(RawClips):
    @classmethod
    def name(cls) -> str:
        return "codedclip"

    def reader(self, schema) -> CodedReader:  # noqa: ANN001
        return (FilteringCodedReader if self.options.get("filters") == "true" else CodedReader)(self.options)


def source_of(path: str) -> type[DataSource]:
    """The source that reads a clip, or the clips of a folder, by the first one's first word."""
    first = path
    if os.path.isdir(path):
        files = sorted(x.path for x in os.scandir(path) if x.is_file())
        first = files[0] if files else ""
    if first and os.path.isfile(first):
        with open(first, "rb") as f:
            if f.read(16).split(b" ")[0].decode("ascii", "replace") in (Y4M, KEYS):
                return CodedClips
    return RawClips
