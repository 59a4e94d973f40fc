"""Bitmap subtitle streams (PGS): segments, display sets, and what they show, read from binary columns.

A stream is a row of segments; bytes between them that start none are passed over. Compositions put objects up with a palette, an
empty composition takes them down. Truncated segments and runs give what can be read of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Segment types.
PALETTE, OBJECT, COMPOSITION, END = 0x14, 0x15, 0x16, 0x80
STACK_GAP = 8  # fixed value: rows between objects of one set


class Segment(NamedTuple):
    time: float
    kind: int
    body: bytes
    stop: int


def segments(data: bytes) -> Iterator[Segment]:
    at = data.find(b"PG")
    while at >= 0 and at + 13 <= len(data):
        stop = at + 13 + int.from_bytes(data[at + 11 : at + 13], "big")
        yield Segment(int.from_bytes(data[at + 2 : at + 6], "big") / 90000, data[at + 10], data[at + 13 : stop], stop)
        at = data.find(b"PG", stop)


def bitmap(code: bytes, width: int, height: int) -> np.ndarray:
    """(height, width) palette indices of a run-length code; what it leaves out is 0."""
    out, at, y, x = np.zeros((height, width), np.uint8), 0, 0, 0
    while at < len(code) and y < height:
        size, colour, step = 1, code[at], 1
        if colour == 0:
            flags = code[at + 1] if at + 1 < len(code) else 0
            long, coloured = flags >> 6 & 1, flags >> 7
            step = 2 + long + coloured
            if at + step > len(code):
                break
            if flags == 0:
                y, x, at = y + 1, 0, at + 2
                continue
            size = (flags & 0x3F) << 8 | code[at + 2] if long else flags & 0x3F
            colour = code[at + step - 1] if coloured else 0
        out[y, x : x + size] = colour
        x, at = x + size, at + step
    return out


def _references(body: bytes) -> list[tuple[int, int, int]]:
    """(object, x, y) of a composition; a cropped object has eight bytes more."""
    out, at = [], 11
    for _ in range(body[10]):
        if at + 8 > len(body):
            break
        number = lambda k: int.from_bytes(body[at + k : at + k + 2], "big")  # noqa: B023, E731
        out.append((number(0), number(4), number(6)))
        at += 16 if body[at + 3] & 0x80 else 8
    return out


def _rgba(palette: dict[int, tuple[int, int, int, int]]) -> np.ndarray:
    """(256, 4) colours of (Y, Cr, Cb, alpha) entries, BT.601 limited range in integers."""
    table = np.zeros((256, 4), np.int64)
    for i, entry in palette.items():
        table[i] = entry
    y, cr, cb, alpha = table.T
    c, d, e = 298 * (y - 16) + 128, cb - 128, cr - 128
    rgb = np.stack([c + 409 * e, c - 100 * d - 208 * e, c + 516 * d], axis=1) >> 8
    out = np.concatenate([rgb.clip(0, 255), alpha[:, None]], axis=1).astype(np.uint8)
    out[[i for i in range(256) if i not in palette]] = 0
    return out


class Shown(NamedTuple):
    start: float
    end: float
    image: np.ndarray  # (height, width, 4)


def shown(data: bytes) -> Iterator[Shown]:
    """Each picture with its time on screen: until it is taken down or replaced. One never ended is not told."""
    palettes: dict[int, dict] = {}
    objects: dict[int, list] = {}
    up: dict | None = None
    for s in segments(data):
        if s.kind == COMPOSITION and len(s.body) >= 11:
            if up and up["image"] is not None and s.time > up["start"]:
                yield Shown(up["start"], s.time, up["image"])
            up = {"start": s.time, "palette": s.body[9], "objects": _references(s.body), "image": None} if s.body[10] else None
        elif s.kind == PALETTE and len(s.body) >= 2:
            entries = (s.body[k : k + 5] for k in range(2, len(s.body) - 4, 5))
            palettes.setdefault(s.body[0], {}).update((x[0], tuple(x[1:])) for x in entries)
        elif s.kind == OBJECT and len(s.body) >= 7:
            name = int.from_bytes(s.body[:2], "big")
            if s.body[3] & 0x80:
                objects[name] = [int.from_bytes(s.body[7:9], "big"), int.from_bytes(s.body[9:11], "big"), s.body[11:]]
            elif name in objects:
                objects[name][2] += s.body[4:]
        elif s.kind == END and up and up["image"] is None:
            placed = [(y, x, *objects[o]) for o, x, y in up["objects"] if o in objects and objects[o][0] > 0 and objects[o][1] > 0]
            if placed:
                up["image"] = _composed(sorted(placed, key=lambda p: p[0]), _rgba(palettes.get(up["palette"], {})))


def _composed(placed: list[tuple], colours: np.ndarray) -> np.ndarray:
    """Objects below each other by their height on screen, at their distances from the leftmost."""
    left = min(x for _, x, *_ in placed)
    image = np.zeros((sum(h for *_, h, _ in placed) + STACK_GAP * (len(placed) - 1), max(x + w for _, x, w, *_ in placed) - left, 4), np.uint8)
    row = 0
    for _, x, w, h, code in placed:
        image[row : row + h, x - left : x - left + w] = colours[bitmap(bytes(code), w, h)]
        row += h + STACK_GAP
    return image


def intervals(data: bytes) -> Iterator[tuple[float, float]]:
    """When something is on screen, whatever it is."""
    since = None
    for s in segments(data):
        if s.kind == COMPOSITION and len(s.body) >= 11:
            if s.body[10] and since is None:
                since = s.time
            elif not s.body[10] and since is not None:
                if s.time > since:
                    yield since, s.time
                since = None


def trimmed(data: bytes, sets: int) -> bytes:
    """The stream up to the end of the set after the first ``sets`` pictures."""
    pictures = 0
    for s in segments(data):
        pictures += s.kind == COMPOSITION and len(s.body) >= 11 and s.body[10] > 0
        if s.kind == END and pictures > sets:
            return data[: s.stop]
    return data


def _per_file(files: DataFrame, read: Callable[[bytes], Iterator[dict]], schema: str) -> DataFrame:
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    out = T.StructType.fromDDL("path string, " + schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pylist([{"path": path} | r for r in read(content or b"")], schema=to_arrow_schema(out))

    return files.select("path", "content").mapInArrow(run, out)


def decode_pgs(files: DataFrame) -> DataFrame:
    """files: path, content. path, n, s, e, width, height, pixels (visible), rgba of each picture."""

    def read(data: bytes) -> Iterator[dict]:
        for n, x in enumerate(shown(data)):
            yield {"n": n, "s": x.start, "e": x.end, "width": x.image.shape[1], "height": x.image.shape[0], "pixels": int((x.image[:, :, 3] > 0).sum()), "rgba": x.image.tobytes()}

    return _per_file(files, read, "n long, s double, e double, width long, height long, pixels long, rgba binary")


def pgs_intervals(files: DataFrame) -> DataFrame:
    """path, n, s, e: the stretches with something on screen."""
    return _per_file(files, lambda data: ({"n": n, "s": s, "e": e} for n, (s, e) in enumerate(intervals(data))), "n long, s double, e double")


def trim_pgs(files: DataFrame, sets: int) -> DataFrame:
    """path, content: each stream cut behind so many pictures."""
    return _per_file(files, lambda data: iter([{"content": trimmed(data, sets)}]), "content binary")
