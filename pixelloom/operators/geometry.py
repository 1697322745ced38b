"""Geometry as coordinate expressions: exact moves are projections; others gather four pixels by equality of places."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import div, f32, u8
from .window import KEY


def reflect_horizontal(p: DataFrame, width: int) -> DataFrame:
    return p.withColumn("x", F.expr(f"{width - 1} - x"))


def rotate(p: DataFrame, degrees: int, width: int, height: int) -> DataFrame:
    """Clockwise, by a multiple of 90 degrees."""
    new = {0: ("x", "y"), 90: (f"{height - 1} - y", "x"), 180: (f"{width - 1} - x", f"{height - 1} - y"), 270: ("y", f"{width - 1} - x")}
    if degrees % 90:
        raise ValueError("rotation must be a multiple of 90 degrees")
    nx, ny = new[degrees % 360]
    return p.withColumns({"x": F.expr(nx), "y": F.expr(ny)})


def crop_box(x: float, y: float, w: float, h: float, width: int, height: int) -> tuple[int, int, int, int]:
    """left, top, width and height in pixels of a box given in shares, in single precision."""
    import numpy as np

    f = np.float32
    left, top = int(np.floor(f(x) * f(width))), int(np.floor(f(y) * f(height)))
    nearest = lambda v: int(np.floor(v + f(0.5)))
    return left, top, min(max(1, nearest(f(w) * f(width))), width - left), min(max(1, nearest(f(h) * f(height))), height - top)


def crop(p: DataFrame, x: float, y: float, w: float, h: float, width: int, height: int) -> DataFrame:
    left, top, cw, ch = crop_box(x, y, w, h, width, height)
    inside = p.filter(f"x >= {left} and x < {left + cw} and y >= {top} and y < {top + ch}")
    return inside.withColumns({"x": F.expr(f"x - {left}"), "y": F.expr(f"y - {top}")})


def gather(grid: DataFrame, p: DataFrame, width: int, height: int, sx: str, sy: str, tag: str = "") -> DataFrame:
    """grid (image_id, y, x, ..) with channels r, g, b, a (each with tag) sampled between the four pixels around (sx, sy).

    Places outside the picture are transparent black. Each place asks for its four pixels, which are grouped back
    with maxima, so one shuffle joins and one groups, whatever the map.
    """
    own = [c for c in grid.columns if c not in (KEY, "y", "x")]
    g = grid.withColumns({"_sx": F.expr(f32(sx)), "_sy": F.expr(f32(sy))})
    g = g.withColumn("_in", F.expr(f"_sx >= 0 and _sy >= 0 and _sx <= {f32(float(width - 1))} and _sy <= {f32(float(height - 1))}"))
    ask = g.filter("_in").withColumns({"_l": F.expr("cast(floor(_sx) as int)"), "_t": F.expr("cast(floor(_sy) as int)")})
    ask = ask.select(KEY, F.col("y").alias("oy"), F.col("x").alias("ox"), F.explode(F.expr(
        f"array(named_struct('k', 0, 'y', _t, 'x', _l), named_struct('k', 1, 'y', _t, 'x', least(_l + 1, {width - 1})), "
        f"named_struct('k', 2, 'y', least(_t + 1, {height - 1}), 'x', _l), named_struct('k', 3, 'y', least(_t + 1, {height - 1}), 'x', least(_l + 1, {width - 1})))")).alias("q"))
    got = ask.select(KEY, "oy", "ox", "q.k", F.col("q.y").alias("y"), F.col("q.x").alias("x")).join(p.select(KEY, "y", "x", *"rgba"), [KEY, "y", "x"])
    got = got.groupBy(KEY, F.col("oy").alias("y"), F.col("ox").alias("x")).agg(*[F.max(F.when(F.col("k") == k, F.col(c))).alias(f"_at_{c}{k}") for c in "rgba" for k in range(4)])
    out = g.join(got, [KEY, "y", "x"], "left").withColumns({"_fx": F.expr(f"_sx - {f32('floor(_sx)')}"), "_fy": F.expr(f"_sy - {f32('floor(_sy)')}")})
    one = f32(1.0)
    line = lambda c, a, b: f"({f32(f'_at_{c}{a}')} * ({one} - _fx) + {f32(f'_at_{c}{b}')} * _fx)"
    value = lambda c: u8(f"{line(c, 0, 1)} * ({one} - _fy) + {line(c, 2, 3)} * _fy")
    return out.select(KEY, "y", "x", *own, *[F.expr(f"case when _in then {value(c)} else 0 end").alias(c + tag) for c in "rgba"])


def _grid(p: DataFrame) -> DataFrame:
    return p.select(KEY, "y", "x")


def straighten(p: DataFrame, degrees: float, width: int, height: int) -> DataFrame:
    """A turn about the middle; the size stays and uncovered corners are transparent."""
    import numpy as np

    f = np.float32
    if abs(degrees) < 1.2e-7:
        return p
    angle = f(math.radians(degrees))
    s, c = f32(float(np.sin(angle))), f32(float(np.cos(angle)))
    mx, my = f32((width - 1) * 0.5), f32((height - 1) * 0.5)
    dx, dy = f"({f32('x')} - {mx})", f"({f32('y')} - {my})"
    return gather(_grid(p), p, width, height, f"{mx} + {dx} * {c} + {dy} * {s}", f"{my} - {dx} * {s} + {dy} * {c}")


def perspective(p: DataFrame, corners, width: int, height: int) -> DataFrame:
    """Samples a quadrilateral (top left, top right, bottom right, bottom left, in shares) by bilinear position."""
    tl, tr, br, bl = corners
    u = div(f32("x"), f32(float(width - 1))) if width > 1 else f32(0.0)
    v = div(f32("y"), f32(float(height - 1))) if height > 1 else f32(0.0)
    mix = lambda a, b, t: f"({a} + ({b} - {a}) * {t})"
    at = lambda k: mix(mix(f32(float(tl[k])), f32(float(tr[k])), u), mix(f32(float(bl[k])), f32(float(br[k])), u), v)
    return gather(_grid(p), p, width, height, f"{at(0)} * {f32(float(width - 1))}", f"{at(1)} * {f32(float(height - 1))}")


def lens_correction(p: DataFrame, distortion: float, vignetting: float, chromatic_aberration: float, width: int, height: int) -> DataFrame:
    """Radial distortion with red and blue sampled apart, and light by distance from the middle."""
    mx, my = f32((width - 1) * 0.5), f32((height - 1) * 0.5)
    wx, wy = f32(max(1.0, (width - 1) * 0.5)), f32(max(1.0, (height - 1) * 0.5))
    g = _grid(p).withColumns({"_nx": F.expr(div(f"{f32('x')} - {mx}", wx)), "_ny": F.expr(div(f"{f32('y')} - {my}", wy))})
    g = g.withColumn("_r2", F.expr("_nx * _nx + _ny * _ny"))
    g = g.withColumns({"_px": F.expr(f"{mx} + _nx * ({f32(1.0)} + {f32(float(distortion))} * _r2) * {wx}"), "_py": F.expr(f"{my} + _ny * ({f32(1.0)} + {f32(float(distortion))} * _r2) * {wy}")})
    g = g.withColumn("_sh", F.expr(f"{f32(float(chromatic_aberration))} * _r2 * {f32(2.0)}"))
    g = gather(g, p, width, height, "_px + _nx * _sh", "_py + _ny * _sh", "1")
    g = gather(g, p, width, height, "_px", "_py", "2")
    g = gather(g, p, width, height, "_px - _nx * _sh", "_py - _ny * _sh", "3")
    light = f"greatest({f32(0.0)}, {f32(1.0)} + {f32(float(vignetting))} * _r2)"
    return g.select(KEY, "y", "x", *[F.expr(u8(f"{f32(s)} * {light}")).alias(c) for c, s in (("r", "r1"), ("g", "g2"), ("b", "b3"))], F.col("a2").alias("a"))


def resample_mask(m: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """A mask at another size of the same shape (ratios within 0.002), by half-pixel centres."""
    if (width, height) == (new_width, new_height):
        return m
    if abs(width / height - new_width / new_height) > 0.002:
        raise ValueError("the shapes differ")
    kx, ky = width / new_width, height / new_height
    grid = m.select("mask_id").distinct().withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(new_height - 1)))).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(new_width - 1))))
    at = lambda v, k, n: f"greatest(0D, least({n - 1}D, ({v} + 0.5D) * {k!r}D - 0.5D))"
    g = grid.withColumns({"_sx": F.expr(at("x", kx, width)), "_sy": F.expr(at("y", ky, height))})
    ask = g.withColumns({"_l": F.expr("cast(floor(_sx) as int)"), "_t": F.expr("cast(floor(_sy) as int)")}).withColumns({"_fx": F.expr("_sx - _l"), "_fy": F.expr("_sy - _t")})
    ask = ask.select("mask_id", F.col("y").alias("oy"), F.col("x").alias("ox"), "_fx", "_fy", F.explode(F.expr(
        f"array(named_struct('k', 0, 'y', _t, 'x', _l), named_struct('k', 1, 'y', _t, 'x', least(_l + 1, {width - 1})), "
        f"named_struct('k', 2, 'y', least(_t + 1, {height - 1}), 'x', _l), named_struct('k', 3, 'y', least(_t + 1, {height - 1}), 'x', least(_l + 1, {width - 1})))")).alias("q"))
    got = ask.select("mask_id", "oy", "ox", "_fx", "_fy", "q.k", F.col("q.y").alias("y"), F.col("q.x").alias("x")).join(m, ["mask_id", "y", "x"])
    got = got.groupBy("mask_id", F.col("oy").alias("y"), F.col("ox").alias("x"), "_fx", "_fy").agg(*[F.max(F.when(F.col("k") == k, F.col("cov"))).alias(f"c{k}") for k in range(4)])
    return got.select("mask_id", "y", "x", F.expr("cast(floor((c0 * (1D - _fx) + c1 * _fx) * (1D - _fy) + (c2 * (1D - _fx) + c3 * _fx) * _fy + 0.5D) as int)").alias("cov"))


def preview(p: DataFrame, width: int, height: int, longest: int = 1600) -> DataFrame:
    """Pixels at a size whose longer side is at most ``longest``: area means by source pixel centre."""
    share = max(width, height) / longest
    if share <= 1:
        return p
    return p.groupBy(KEY, F.expr(f"cast(floor((y + 0.5D) / {share!r}D) as int)").alias("y"), F.expr(f"cast(floor((x + 0.5D) / {share!r}D) as int)").alias("x")).agg(*[F.expr(f"cast(floor(avg({c}) + 0.5D) as int)").alias(c) for c in "rgba"])
