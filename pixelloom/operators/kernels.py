"""The same operations over packed rasters: a row is a whole image or mask, its work a few numpy passes.

Long pixels let Catalyst plan joins, filters and aggregates; where a chain only moves values within an image, packed rows
cost no shuffle at all and one pass of Arrow each way. Images are dealt over tasks, each task holds one batch of rows, and
BATCH_ROWS bounds that for large images. Results equal those of operators.window, mask and aggregate.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.codec import joined_lines
from .point import channel_tables

#: Rows that a task takes up at a time.
BATCH_ROWS = 16


def pack_masks(m: DataFrame) -> DataFrame:
    """(mask_id, width, height, cov) of long masks, scanlines first."""
    return joined_lines(m)


def _mapped(df: DataFrame, column: str, depth: int, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """df with column's bytes, as an array (height, width[, depth]), put through kernel; the shape stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            names = whole.schema.names
            at, w, h = (names.index(n) for n in (column, "width", "height"))
            for begin in range(0, whole.num_rows, BATCH_ROWS):
                b = whole.slice(begin, BATCH_ROWS)
                out = []
                for data, width, height in zip(b.column(at), b.column(w).to_pylist(), b.column(h).to_pylist(), strict=True):
                    shape = (height, width, depth) if depth > 1 else (height, width)
                    out.append(np.ascontiguousarray(kernel(np.frombuffer(data.as_buffer(), np.uint8).reshape(shape)), np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()) if k == at else c for k, c in enumerate(b.columns)], names)

    return df.mapInArrow(run, df.schema)


def means(a: np.ndarray, radius: int, axis: int) -> np.ndarray:
    """Truncated means over frames cut at the edges."""
    n = a.shape[axis]
    run = np.zeros([s + (k == axis) for k, s in enumerate(a.shape)], np.int32)
    np.cumsum(a, axis=axis, dtype=np.int32, out=run[tuple(slice(1, None) if k == axis else slice(None) for k in range(a.ndim))])
    at = np.arange(n)
    low, high = np.maximum(at - radius, 0), np.minimum(at + radius + 1, n)
    count = (high - low).reshape([-1 if k == axis else 1 for k in range(a.ndim)])
    return ((run.take(high, axis) - run.take(low, axis)) // count).astype(np.uint8)


def extremes(a: np.ndarray, radius: int, axis: int, largest: bool) -> np.ndarray:
    """Largest or smallest values over frames cut at the edges: running extremes within blocks, both ways."""
    a = np.moveaxis(a, axis, 0)
    n, size = len(a), 2 * radius + 1
    fill, best = (0, np.maximum) if largest else (255, np.minimum)
    blocks = -(-(n + 2 * radius) // size)
    wide = np.full((blocks * size, *a.shape[1:]), fill, np.uint8)
    wide[radius : radius + n] = a
    wide = wide.reshape(blocks, size, *a.shape[1:])
    to, back = best.accumulate(wide, 1).reshape(-1, *a.shape[1:]), np.flip(best.accumulate(np.flip(wide, 1), 1), 1).reshape(-1, *a.shape[1:])
    return np.moveaxis(best(back[:n], to[2 * radius : 2 * radius + n]), 0, axis)


def feather(masks: DataFrame, radius: int) -> DataFrame:
    radius = min(radius, 256)
    return masks if radius == 0 else _mapped(masks, "cov", 1, lambda a: means(means(a, radius, 1), radius, 0))


def expand(masks: DataFrame, radius: int) -> DataFrame:
    radius = min(radius, 256)
    return masks if radius == 0 else _mapped(masks, "cov", 1, lambda a: extremes(extremes(a, radius, 1, True), radius, 0, True))


def shrink(masks: DataFrame, radius: int) -> DataFrame:
    radius = min(radius, 256)
    return masks if radius == 0 else _mapped(masks, "cov", 1, lambda a: extremes(extremes(a, radius, 1, False), radius, 0, False))


def contrast_table(factor: float) -> np.ndarray:
    f = np.float32
    v = (np.arange(256, dtype=f) - f(127.5)) * f(max(0.05, factor)) + f(127.5)
    return np.clip(np.floor(v.astype(np.float64) + 0.5), 0, 255).astype(np.uint8)


def refine(masks: DataFrame, smooth: int, feather_radius: int, contrast: float, shift: int) -> DataFrame:
    """Smoothing, moved edge, feather and contrast in one pass over each mask."""
    last = contrast_table(float(np.float32(1) + np.float32(contrast) * np.float32(3)))

    def run(a: np.ndarray) -> np.ndarray:
        if smooth:
            r = min(smooth, 128)
            a = contrast_table(1.8)[means(means(a, r, 1), r, 0)]
        if shift:
            r = min(abs(shift), 256)
            a = extremes(extremes(a, r, 1, shift > 0), r, 0, shift > 0)
        if feather_radius:
            r = min(feather_radius, 256)
            a = means(means(a, r, 1), r, 0)
        return last[a]

    return _mapped(masks, "cov", 1, run)


def channelwise(rasters: DataFrame, *ops) -> DataFrame:
    """Channel-wise operations over packed RGBA images: one table look-up a channel, however many operations."""
    line = list(range(256))
    tables = [line, line, line]
    for o in ops:
        new = channel_tables(o)
        if new is None:
            raise ValueError(f"{o.type} is not channel-wise")
        tables = [[t[v] for v in old] for old, t in zip(tables, new, strict=True)]
    held = [np.array(t, np.uint8) for t in [*tables, line]]

    def run(a: np.ndarray) -> np.ndarray:
        out = np.empty_like(a)
        for k in range(4):
            np.take(held[k], a[..., k], out=out[..., k])
        return out

    return _mapped(rasters, "data", 4, run)


def histograms(rasters: DataFrame) -> DataFrame:
    """(image_id, channel, bin, n) of red, green, blue and luminance, counted within each image's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = np.float32
        for b in batches:
            ids, names, bins, n = [], [], [], []
            for key, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                px = np.frombuffer(data.as_buffer(), np.uint8).reshape(-1, 4)
                r, g, bl = (px[:, k].astype(f) for k in range(3))
                light = np.floor((f(0.2126) * r + f(0.7152) * g + f(0.0722) * bl).astype(np.float64) + 0.5).astype(np.int64)
                for name, v in (("red", px[:, 0]), ("green", px[:, 1]), ("blue", px[:, 2]), ("luminance", light)):
                    c = np.bincount(v, minlength=256)
                    k = np.flatnonzero(c)
                    ids += [key] * len(k)
                    names += [name] * len(k)
                    bins.append(k)
                    n.append(c[k])
            cat = lambda v, t: pa.array(np.concatenate(v) if v else [], t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), cat(bins, pa.int64()).cast(pa.int32()), cat(n, pa.int64())], ["image_id", "channel", "bin", "n"])

    return rasters.select("image_id", "data").mapInArrow(run, "image_id bigint, channel string, bin int, n bigint")
