"""Masks carried from one chain of geometry to another: maps of coordinates, composed, and one resampling.

A chain is the geometry of a plan over an original of known size. Where the two chains agree up to a point and the rest of
the new one only turns, mirrors or crops, masks move exactly; otherwise each place of the new stage is taken back to the
original and on to the old stage, and the mask is sampled there once, between four pixels. Maps are numpy over the
coordinates of the target grid; the gather itself is an equality join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.ops import GEOMETRY, InvalidOperation, Op, Plan
from . import geometry

MOST_STEPS = 200
#: Steps and tolerances of the inverses, the least slopes they bear, how far outside counts as inside, and the most masks of a
#: batch; fixed values.
NEWTON, RESIDUAL, NEWTON_QUAD, NEAR_QUAD = 40, 1e-12, 20, 1e-8
LEAST_QUAD, LEAST_LENS, BEYOND = 1e-6, 1e-6, 1e-7
MOST_MASKS = 256
EXACT = ("reflect_horizontal", "rotate", "crop")


class Chain:
    """Steps with the size before each of them; ``sizes[-1]`` is the final stage's."""

    def __init__(self, width: int, height: int, steps: tuple[Op, ...] | Plan = ()):
        steps = tuple(o for o in (steps.ops if isinstance(steps, Plan) else steps) if o.type in GEOMETRY)
        if len(steps) > MOST_STEPS:
            raise InvalidOperation(f"a chain has at most {MOST_STEPS} steps")
        from ..plans.compiler import stage_sizes

        self.steps, self.sizes = steps, stage_sizes(Plan(steps), width, height)
        for o, size in zip(self.steps, self.sizes[:-1], strict=True):
            check_geometry(o, *size)

    def to_input(self, x, y):
        """From places of the final stage to the original; not a number where a step shows nothing."""
        for o, size in zip(reversed(self.steps), reversed(self.sizes[:-1]), strict=True):
            x, y = backward(o, x, y, *size)
        return x, y

    def to_output(self, x, y):
        """From places of the original to the final stage; not a number where a step loses them."""
        for o, size in zip(self.steps, self.sizes[:-1], strict=True):
            x, y = forward(o, x, y, *size)
        return x, y


def _middle(w: int, h: int):
    return (w - 1) / 2, (h - 1) / 2


def backward(o: Op, x, y, w: int, h: int):
    """The place before a step that a place after it shows; (w, h) is the size before."""
    if o.type == "reflect_horizontal":
        return w - 1 - x, y
    if o.type == "rotate":
        return {0: (x, y), 90: (y, h - 1 - x), 180: (w - 1 - x, h - 1 - y), 270: (w - 1 - y, x)}[o.degrees % 360]
    if o.type == "crop":
        left, top, _, _ = geometry.crop_box(o.x, o.y, o.width, o.height, w, h)
        return x + left, y + top
    mx, my = _middle(w, h)
    if o.type == "straighten":
        t = np.radians(o.degrees)
        dx, dy = x - mx, y - my
        return mx + dx * np.cos(t) + dy * np.sin(t), my - dx * np.sin(t) + dy * np.cos(t)
    if o.type == "perspective":
        u, v = x / max(w - 1, 1), y / max(h - 1, 1)
        px, py = _quad(o.corners, u, v)
        return px * (w - 1), py * (h - 1)
    kx, ky = max(mx, 1), max(my, 1)
    nx, ny = (x - mx) / kx, (y - my) / ky
    radial = 1 + o.distortion * (nx * nx + ny * ny)
    return mx + nx * radial * kx, my + ny * radial * ky


def forward(o: Op, x, y, w: int, h: int):
    """The place after a step that shows a place before it."""
    if o.type == "reflect_horizontal":
        return w - 1 - x, y
    if o.type == "rotate":
        return {0: (x, y), 90: (h - 1 - y, x), 180: (w - 1 - x, h - 1 - y), 270: (y, w - 1 - x)}[o.degrees % 360]
    if o.type == "crop":
        left, top, cw, ch = geometry.crop_box(o.x, o.y, o.width, o.height, w, h)
        return _within(x - left, y - top, cw, ch)
    if o.type == "straighten":
        mx, my = _middle(w, h)
        t = np.radians(o.degrees)
        dx, dy = x - mx, y - my
        return mx + dx * np.cos(t) - dy * np.sin(t), my + dx * np.sin(t) + dy * np.cos(t)
    if o.type == "perspective":
        u, v = unquad(o.corners, x / max(w - 1, 1), y / max(h - 1, 1))
        return u * (w - 1), v * (h - 1)
    return unlens(o.distortion, x, y, w, h)


def _within(x, y, w, h):
    inside = (x >= -0.5) & (y >= -0.5) & (x <= w - 0.5) & (y <= h - 0.5)
    return np.where(inside, x, np.nan), np.where(inside, y, np.nan)


def _quad(corners, u, v):
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = corners  # top left, top right, bottom right, bottom left
    mix = lambda a, b, t: a + (b - a) * t
    return mix(mix(ax, bx, u), mix(dx, cx, u), v), mix(mix(ay, by, u), mix(dy, cy, u), v)


def _spans(corners):
    """First corner, the sides from it along both axes, and the twist: place = origin + u across + v down + u v twist."""
    tl, tr, br, bl = (np.array(c, float) for c in corners)
    return tl, tr - tl, bl - tl, br - tr + tl - bl


def _slopes(corners, u, v):
    _, across, down, twist = _spans(corners)
    return (across[0] + twist[0] * v, across[1] + twist[1] * v), (down[0] + twist[0] * u, down[1] + twist[1] * u)


def unquad(corners, px, py):
    """u, v in 0..1 whose bilinear place is (px, py), by Newton's method from the affine guess.

    Not a number where the steps leave +-4, meet a singular place, do not get there in time, or end outside 0..1.
    """
    origin, across, down, _ = _spans(corners)
    px, py = np.array(px, float), np.array(py, float)
    flat = across[0] * down[1] - across[1] * down[0]
    if abs(flat) >= LEAST_QUAD:
        u, v = ((px - origin[0]) * down[1] - (py - origin[1]) * down[0]) / flat, (across[0] * (py - origin[1]) - across[1] * (px - origin[0])) / flat
    else:
        u, v = px.copy(), py.copy()
    off = lambda u, v: [g - t for g, t in zip(_quad(corners, u, v), (px, py), strict=True)]
    lost, there = ~(np.isfinite(u) & np.isfinite(v)), np.zeros(px.shape, bool)
    for _ in range(NEWTON_QUAD):
        ex, ey = off(u, v)
        there |= np.maximum(np.abs(ex), np.abs(ey)) <= NEAR_QUAD
        (xu, yu), (xv, yv) = _slopes(corners, u, v)
        det = xu * yv - yu * xv
        moving = ~there & ~lost
        lost |= moving & ~(np.abs(det) >= LEAST_QUAD * 0.01)
        det = np.where(det == 0, 1, det)
        u, v = np.where(moving, u - (ex * yv - ey * xv) / det, u), np.where(moving, v - (xu * ey - yu * ex) / det, v)
        lost |= moving & ~((np.abs(u) <= 4) & (np.abs(v) <= 4))
    ex, ey = off(u, v)
    good = ~lost & (there | (np.maximum(np.abs(ex), np.abs(ey)) <= NEAR_QUAD))
    good &= (u >= -BEYOND) & (u <= 1 + BEYOND) & (v >= -BEYOND) & (v <= 1 + BEYOND)
    return np.where(good, np.clip(u, 0, 1), np.nan), np.where(good, np.clip(v, 0, 1), np.nan)


def unlens(k: float, x, y, w: int, h: int):
    """The place within the picture whose radial image is (x, y), by Newton's method kept within a shrinking bracket.

    The bracket ends where the direction leaves the picture; beyond it, and where slopes vanish, there is none. A side of one
    pixel does not count.
    """
    mx, my = _middle(w, h)
    sx, sy = max(mx, 1), max(my, 1)
    nx, ny = ((x - mx) / sx if w > 1 else np.zeros_like(x)), ((y - my) / sy if h > 1 else np.zeros_like(y))
    target = np.hypot(nx, ny)
    still = target <= RESIDUAL
    safe = np.where(still | ~np.isfinite(target), 1, target)
    dx, dy = nx / safe, ny / safe
    most = np.full_like(safe, np.inf)
    for d, active in ((dx, w > 1), (dy, h > 1)):
        if active:
            most = np.minimum(most, 1 / np.maximum(np.abs(d), RESIDUAL))
    still |= ~np.isfinite(most)
    most = np.where(np.isfinite(most), most, 1)
    off = lambda r: r * (1 + k * r * r) - target
    lost = ~np.isfinite(target) | (off(most) < -RESIDUAL)
    low, high = np.zeros_like(safe), most
    r, there = np.clip(safe, low, high), np.zeros(safe.shape, bool)
    for _ in range(NEWTON):
        e = off(r)
        there |= np.abs(e) <= RESIDUAL
        moving = ~there & ~lost & ~still
        high, low = np.where(moving & (e > 0), r, high), np.where(moving & (e <= 0), r, low)
        slope = 1 + 3 * k * r * r
        lost |= moving & ~(slope > LEAST_LENS)
        step = r - e / np.where(slope > LEAST_LENS, slope, 1)
        r = np.where(moving, np.where((step > low) & (step < high), step, (low + high) / 2), r)
    good = still | (~lost & (there | (np.abs(off(r)) <= RESIDUAL)))
    ux, uy = np.where(still, 0, dx * r), np.where(still, 0, dy * r)
    good &= (np.abs(ux) <= 1 + BEYOND) & (np.abs(uy) <= 1 + BEYOND)
    return np.where(good, mx + np.clip(ux, -1, 1) * sx, np.nan), np.where(good, my + np.clip(uy, -1, 1) * sy, np.nan)


def check_geometry(o: Op, width: int, height: int) -> None:
    """Raises InvalidOperation for a step that folds the picture, or nearly: masks could not be carried back through it."""
    if o.type == "perspective":
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = o.corners
        if not all(0 <= v <= 1 for c in o.corners for v in c) or ax >= bx or dx >= cx or ay >= dy or by >= cy:
            raise InvalidOperation("corners must form an ordered quadrilateral within the picture")
        dets = []
        for u, v in ((0, 0), (1, 0), (0, 1), (1, 1)):
            (xu, yu), (xv, yv) = _slopes(o.corners, u, v)
            dets.append(xu * yv - yu * xv)
        if min(map(abs, dets)) < LEAST_QUAD:
            raise InvalidOperation("the perspective is nearly singular")
        if min(dets) < 0 < max(dets):
            raise InvalidOperation("the perspective folds over itself")
    if o.type == "lens_correction":
        if not -0.16 <= o.distortion <= 1 or not all(-1 <= v <= 1 for v in (o.vignetting, o.chromatic_aberration)):
            raise InvalidOperation("lens parameters are out of range")
        r2 = int(width > 1) + int(height > 1)
        if r2 and o.distortion < 0 and min(1 + o.distortion * r2, 1 + 3 * o.distortion * r2) <= LEAST_LENS:
            raise InvalidOperation("the lens folds the picture")


def remap_masks(m: DataFrame, old: Chain, new: Chain, places: DataFrame | None = None) -> DataFrame:
    """Masks made at the end of the old chain, at the end of the new one; what is not shown by both is empty.

    The result has all places of the new stage, or those of ``places`` (mask_id, y, x), where pictures lack some. Exact moves
    keep the places that there are.
    """
    same = 0
    while same < min(len(old.steps), len(new.steps)) and old.steps[same] == new.steps[same]:
        same += 1
    if same == len(old.steps) and all(o.type in EXACT for o in new.steps[same:]):
        p = m.withColumnRenamed("mask_id", "image_id")
        for o, (w, h) in zip(new.steps[same:], new.sizes[same:-1], strict=True):
            if o.type == "reflect_horizontal":
                p = geometry.reflect_horizontal(p, w)
            elif o.type == "rotate":
                p = geometry.rotate(p, o.degrees, w, h)
            else:
                p = geometry.crop(p, o.x, o.y, o.width, o.height, w, h)
        return p.withColumnRenamed("image_id", "mask_id").select("mask_id", "y", "x", "cov")
    (ow, oh), (nw, nh) = old.sizes[-1], new.sizes[-1]
    if places is None:
        rows = m.select("mask_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(nh - 1))))
        places = rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(nw - 1))))

    def run(batches: Iterator):
        for b in batches:
            sx, sy = old.to_output(*new.to_input(b["x"].to_numpy(float), b["y"].to_numpy(float)))
            yield b.assign(sx=np.broadcast_to(sx, len(b)), sy=np.broadcast_to(sy, len(b)))

    g = places.select("mask_id", "y", "x").mapInPandas(run, "mask_id bigint, y int, x int, sx double, sy double")
    near = f"not isnan(sx) and not isnan(sy) and sx >= -1e-6D and sy >= -1e-6D and sx <= {ow - 1 + 1e-6!r}D and sy <= {oh - 1 + 1e-6!r}D"
    g = g.withColumn("inside", F.expr(f"coalesce({near}, false)"))
    ask = g.filter("inside").withColumns({"sx": F.expr(f"greatest(0D, least({ow - 1}D, sx))"), "sy": F.expr(f"greatest(0D, least({oh - 1}D, sy))")})
    ask = ask.withColumns({"l": F.expr("cast(floor(sx) as int)"), "t": F.expr("cast(floor(sy) as int)")}).withColumns({"fx": F.expr("sx - l"), "fy": F.expr("sy - t")})
    ask = ask.select("mask_id", F.col("y").alias("oy"), F.col("x").alias("ox"), F.explode(F.expr(
        f"array(named_struct('y', t, 'x', l, 'w', (1 - fx) * (1 - fy)), named_struct('y', t, 'x', least(l + 1, {ow - 1}), 'w', fx * (1 - fy)), "
        f"named_struct('y', least(t + 1, {oh - 1}), 'x', l, 'w', (1 - fx) * fy), named_struct('y', least(t + 1, {oh - 1}), 'x', least(l + 1, {ow - 1}), 'w', fx * fy))")).alias("q"))
    got = ask.select("mask_id", "oy", "ox", F.col("q.y").alias("y"), F.col("q.x").alias("x"), F.col("q.w").alias("w")).join(m, ["mask_id", "y", "x"])
    got = got.groupBy("mask_id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.expr("cast(floor(round(sum(w * cov), 9) + 0.5D) as int)").alias("cov"))
    return g.select("mask_id", "y", "x").join(got, ["mask_id", "y", "x"], "left").select("mask_id", "y", "x", F.coalesce("cov", F.lit(0)).alias("cov"))


def remap_batch(m: DataFrame, old: Chain, new: Chain, key: str = "mask_id", most: int | None = MOST_MASKS, whole: bool = True, places: DataFrame | None = None) -> DataFrame:
    """remap_masks for all masks or none: more than ``most``, or one that is not a whole picture of the old stage, is an error.

    Without ``most`` there may be any number of masks; unless ``whole``, they may lack places of the stage, but have none twice
    or beyond it.
    """
    w, h = old.sizes[-1]
    sizes = m.groupBy(key).agg(F.count("*").alias("n"), F.count_distinct("y", "x").alias("places"), F.max("x").alias("x"), F.max("y").alias("y"), F.min("x").alias("x0"), F.min("y").alias("y0"))
    wrong = f"places != n or x0 < 0 or y0 < 0 or x > {w - 1} or y > {h - 1}" + (f" or n != {w * h}" if whole else "")
    found = sizes.agg(F.count("*").alias("masks"), F.expr(f"min(case when {wrong} then {key} end)").alias("bad")).first()
    if most is not None and found.masks > most:
        raise ValueError(f"at most {most} masks are carried at once")
    if found.bad is not None:
        raise ValueError(f"mask {found.bad} does not fit the stage it was made at")
    return remap_masks(m, old, new, places)


def remapped(asked: DataFrame, results: DataFrame, key: str = "key") -> DataFrame:
    """asked with the columns of results, joined by key: each key exactly once on both sides, or the job fails."""
    twice = "if(count(*) = 1, true, cast(raise_error(concat('key given twice: ', first({0}))) as boolean))".format(key)
    own = [c for c in results.columns if c != key]
    once = results.groupBy(key).agg(F.expr(twice).alias("_once"), F.first(F.struct(*own)).alias("_got"))
    both = asked.withColumn("_asked", F.lit(True)).join(once, key, "full")
    sound = f"if(_asked and _once, true, cast(raise_error(concat('key asked or answered only: ', {key})) as boolean))"
    return both.filter(F.expr(f"coalesce({sound}, cast(raise_error(concat('key asked or answered only: ', {key})) as boolean))")).select(*asked.columns, *[F.col(f"_got.{c}").alias(c) for c in own])


def preview_masks(masks: dict[int, DataFrame], plan: Plan, full: tuple[int, int], preview: tuple[int, int]) -> dict[int, DataFrame]:
    """Masks of a plan's masked operations, by their place in it, from the full picture's stages to a preview's.

    A mask must have the size of the stage that its operation works on; the two stages differ in scale only.
    """
    from ..plans.compiler import stage_sizes

    large, small = stage_sizes(plan, *full), stage_sizes(plan, *preview)
    return {k: geometry.resample_mask(m, *large[k], *small[k]) for k, m in masks.items()}
