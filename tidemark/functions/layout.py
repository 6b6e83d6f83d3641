"""Persistent overlays in sampled frames: motion counts, binary maps, connected boxes.

Work on whole pictures (thousands of pixels a row) has no useful relational form, so these
are Arrow-backed grouped functions over numpy arrays; one recording is one group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Scan size, moved-by, least share of pairs, pairs looked at, padding.
WIDTH, HEIGHT = 160, 90
MOVED_BY, FLOOR, CEILING = 4, 0.12, 0.5
LEAST_PAIRS, MOST_PAIRS = 24, 400


def motion_counts(frames: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many consecutive pairs (at most ``MOST_PAIRS``, evenly spread) each pixel moved."""
    pairs = len(frames) - 1
    at = np.arange(pairs) if pairs <= MOST_PAIRS else (np.arange(MOST_PAIRS) * pairs // MOST_PAIRS)
    return (np.abs(frames[at + 1].astype(int) - frames[at].astype(int)) > MOVED_BY).sum(0).ravel(), len(at)


def persistent(counts: np.ndarray, pairs: int) -> np.ndarray:
    """Pixels that move in more pairs than max(floor, min(0.5, upper median + 4 * its deviation)) of them."""
    share = np.sort(counts / max(pairs, 1))
    middle = share[len(share) // 2]
    off = np.sort(np.abs(share - middle))[len(share) // 2]
    return counts > pairs * max(FLOOR, min(CEILING, middle + 4 * off))


def closed(bitmap: np.ndarray) -> np.ndarray:
    """3 x 3 closing; pixels outside count neither way."""
    def around(b: np.ndarray, outside: bool, f) -> np.ndarray:
        p = np.pad(b, 1, constant_values=outside)
        h, w = b.shape
        return f.reduce([p[y : y + h, x : x + w] for y in range(3) for x in range(3)])

    return around(around(bitmap, False, np.logical_or), True, np.logical_and)


def boxes(bitmap: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(x0, y0, x1, y1, area) of 4-connected regions, in the order of their first pixel: labels sink until they agree."""
    h, w = bitmap.shape
    label = np.where(bitmap, np.arange(h * w).reshape(h, w), h * w)
    while True:
        p = np.pad(label, 1, constant_values=h * w)
        low = np.where(bitmap, np.minimum.reduce([label, p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]]), h * w)
        flat = np.append(low.ravel(), h * w)
        low = np.where(bitmap, flat[low], h * w)
        if (low == label).all():
            break
        label = low
    out = []
    for k in np.unique(label[bitmap]):
        y, x = np.nonzero(label == k)
        out.append((int(x.min()), int(y.min()), int(x.max()) + 1, int(y.max()) + 1, len(x)))
    return out


def kind_of(box: tuple[int, int, int, int, int], width: int, height: int) -> str | None:
    w, h = box[2] - box[0], box[3] - box[1]
    if h <= 0.10 * height and w >= 0.80 * width:
        return "bar"
    fits = w <= 0.6 * width and h <= 0.6 * height and 0.01 <= w * h / (width * height) <= 0.20 and 0.8 <= w / h <= 2.4
    return "webcam" if fits and box[4] >= 0.3 * w * h else None


def overlap(a: tuple, b: tuple) -> float:
    both = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return both / max(area(a) + area(b) - both, 1)


def overlays(frames: np.ndarray) -> list[tuple[str, tuple]]:
    """Boxes that always move a little, in all frames and, at an overlap of half, in each half of them."""
    if len(frames) < LEAST_PAIRS + 1:
        return []
    found = lambda f: boxes(closed(persistent(*motion_counts(f)).reshape(f.shape[1:])))
    half = len(frames) // 2
    halves = [found(f) for f in (frames[: half + 1], frames[half:]) if len(f) >= LEAST_PAIRS // 2 + 1]
    out = []
    for box in found(frames):
        kind = kind_of(box, frames.shape[2], frames.shape[1])
        if kind and all(any(overlap(box, other) >= 0.5 for other in part) for part in halves):
            out.append((kind, box))
    return out


def box_average(pixels: np.ndarray, width: int, height: int, to_width: int, to_height: int) -> np.ndarray:
    """A smaller picture whose pixels are means of boxes (the one of the two ways to scale down that this engine uses)."""
    y = np.arange(to_height + 1) * height // to_height
    x = np.arange(to_width + 1) * width // to_width
    total = np.zeros((height + 1, width + 1))
    total[1:, 1:] = pixels.reshape(height, width).astype(float).cumsum(0).cumsum(1)
    sums = total[y[1:]][:, x[1:]] - total[y[1:]][:, x[:-1]] - total[y[:-1]][:, x[1:]] + total[y[:-1]][:, x[:-1]]
    return np.rint(sums / np.outer(np.diff(y), np.diff(x))).astype(np.uint8)


def find_overlays(frames: DataFrame, keys: list[str], width: int = WIDTH, height: int = HEIGHT) -> DataFrame:
    """(keys, kind, x0, y0, x1, y1) of frames (i, pixels BINARY, row after row)."""
    kinds = dict(frames.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", kind string, x0 double, y0 double, x1 double, y1 double"

    def scan(key, pdf):
        pdf = pdf.sort_values("i", kind="stable")
        pictures = np.stack([np.frombuffer(p, np.uint8).reshape(height, width) for p in pdf["pixels"]])
        rows = [(*key, k, b[0] / width, b[1] / height, b[2] / width, b[3] / height) for k, b in overlays(pictures)]
        return pd.DataFrame(rows, columns=[*keys, "kind", "x0", "y0", "x1", "y1"])

    return frames.groupBy(*keys).applyInPandas(scan, schema)
