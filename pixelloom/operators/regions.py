"""Operations on connected regions: one picture or mask at a time in numpy, pictures in parallel.

Regions need a flood over the whole picture; each group is one picture, whose size is limited (sources.rasters), so a
task holds one at most.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SCHEMA = "mask_id bigint, y int, x int, cov int"


def _plane(pdf: pd.DataFrame, column: str) -> np.ndarray:
    out = np.zeros((pdf["y"].max() + 1, pdf["x"].max() + 1), np.int64)
    out[pdf["y"], pdf["x"]] = pdf[column]
    return out


def _frame(mask_id, cov: np.ndarray) -> pd.DataFrame:
    y, x = np.indices(cov.shape)
    return pd.DataFrame({"mask_id": mask_id, "y": y.ravel(), "x": x.ravel(), "cov": cov.ravel()})


def reached(open_: np.ndarray, seeds: np.ndarray, eight: bool = False) -> np.ndarray:
    """The open places connected with a seed: fronts move along whole rows and columns at a time until they stay."""
    got = seeds & open_
    while True:
        before = int(got.sum())
        for axis in (0, 1):
            for flip in (False, True):
                o, g = (np.flip(open_, axis), np.flip(got, axis)) if flip else (open_, got)
                # a place is reached if the last seed before it along the axis has no closed place in between
                at = np.arange(o.shape[axis]).reshape((-1, 1) if axis == 0 else (1, -1))
                seed = np.maximum.accumulate(np.where(g, at, -1), axis)
                wall = np.maximum.accumulate(np.where(o, -1, at), axis)
                new = o & (seed > wall)
                got = got | (np.flip(new, axis) if flip else new)
        if eight:
            wide = np.pad(got, 1)
            got = got | (open_ & (wide[:-2, :-2] | wide[:-2, 2:] | wide[2:, :-2] | wide[2:, 2:]))
        if int(got.sum()) == before:
            return got


def labels(open_: np.ndarray) -> np.ndarray:
    """Numbers of the 4-connected regions of open places, -1 elsewhere: runs of rows joined by union-find."""
    h, w = open_.shape
    first = open_ & ~np.pad(open_, ((0, 0), (1, 0)))[:, :-1]
    run = np.where(open_, np.cumsum(first.ravel()).reshape(h, w) - 1, -1)
    parent = np.arange(int(first.sum()))

    def top(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    both = open_[1:] & open_[:-1]
    for a, b in np.unique(np.stack([run[:-1][both], run[1:][both]], 1), axis=0):
        a, b = top(a), top(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([top(k) for k in range(len(parent))], np.int64)
    return np.where(open_, roots[run] if len(roots) else -1, -1)


def fill_holes(m: DataFrame) -> DataFrame:
    """Background (below 128) that no path through background joins with the edge becomes full."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cov = _plane(pdf, "cov")
        low, edge = cov < 128, np.zeros(cov.shape, bool)
        edge[[0, -1]], edge[:, [0, -1]] = True, True
        return _frame(pdf["mask_id"].iloc[0], np.where(low & ~reached(low, edge), 255, cov))

    return m.groupBy("mask_id").applyInPandas(run, SCHEMA)


def remove_islands(m: DataFrame, minimum_pixels: int) -> DataFrame:
    """Regions of 128 and more with fewer pixels than the minimum become empty."""
    least = min(minimum_pixels, 10_000_000)
    if least <= 1:
        return m

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        cov = _plane(pdf, "cov")
        lab = labels(cov >= 128)
        sizes = np.bincount(lab[lab >= 0], minlength=int(lab.max()) + 1 if lab.size else 0)
        small = (lab >= 0) & (sizes[np.maximum(lab, 0)] < least) if len(sizes) else np.zeros(cov.shape, bool)
        return _frame(pdf["mask_id"].iloc[0], np.where(small, 0, cov))

    return m.groupBy("mask_id").applyInPandas(run, SCHEMA)


def wand_region(p: DataFrame, seed: tuple[int, int], tolerance: float, anti_alias: bool = True, eight: bool = False) -> DataFrame:
    """Coverage of the pixels like the one at seed (x, y) that are connected with it.

    The selection spreads through pixels within the tolerance only; those in the soft band are covered where it
    touches them.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = np.float32
        px = {c: _plane(pdf, c).astype(f) for c in "rgba"}
        at = (seed[1], seed[0])
        part = {c: np.abs(px[c] - px[c][at]) / f(255) for c in "rgba"}
        dist = np.maximum.reduce([part[c] for c in "rgba"])
        dist = np.where((px["a"] == 0) | (px["a"][at] == 0), part["a"], dist)
        t = f(tolerance)
        soft = min(f(1), t + f(0.08 if anti_alias else 0))
        start = np.zeros(dist.shape, bool)
        start[at] = True
        core = reached(dist <= t, start, eight)
        wide = np.pad(core, 1)
        near = core | wide[:-2, 1:-1] | wide[2:, 1:-1] | wide[1:-1, :-2] | wide[1:-1, 2:]
        if eight:
            near = near | wide[:-2, :-2] | wide[:-2, 2:] | wide[2:, :-2] | wide[2:, 2:]
        near &= dist <= soft
        ramp = np.floor((f(255) * (f(1) - (dist - t) / (soft - t if soft > t else f(1)))).astype(np.float64) + 0.5)
        cov = np.where((dist <= t) | (soft <= t), 255, np.where(dist >= soft, 0, np.clip(ramp, 0, 255))).astype(np.int64)
        return _frame(pdf["image_id"].iloc[0], np.where(near, cov, 0))

    return p.groupBy("image_id").applyInPandas(run, SCHEMA)
