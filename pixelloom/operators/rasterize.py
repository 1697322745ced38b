"""Shapes to coverage: closed formulas over the grid, and dabs spread over the pixels that they can reach."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.color import clamp, div, f32, u8

MOST_POINTS, MOST_DABS, MOST_WORK = 20_000, 1_000_000, 128_000_000
#: A pixel's sub-samples lie at these shares of it, both ways.
SUB = (0.125, 0.375, 0.625, 0.875)


def grid(spark: SparkSession, mask_id: int, width: int, height: int) -> DataFrame:
    """(mask_id, y, x) of all places, made by rows in parallel."""
    rows = spark.range(height).select(F.lit(mask_id).cast("bigint").alias("mask_id"), F.col("id").cast("int").alias("y"))
    return rows.withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))


def _box(start, end, width: int, height: int):
    import numpy as np

    f = np.float32
    xs, ys = sorted((f(start[0]), f(end[0]))), sorted((f(start[1]), f(end[1])))
    cut = lambda v, n: float(np.clip(v, f(0), f(n)))
    return cut(xs[0], width), cut(ys[0], height), cut(xs[1], width), cut(ys[1], height)


def rectangle(g: DataFrame, width: int, height: int, start, end) -> DataFrame:
    """Coverage is the share of each pixel that the rectangle overlaps."""
    left, top, right, bottom = _box(start, end, width, height)
    part = lambda v, lo, hi: clamp(f"least({f32(hi)}, {f32(v)} + {f32(1.0)}) - greatest({f32(lo)}, {f32(v)})", f32(0.0), f32(1.0))
    return g.withColumn("cov", F.expr(u8(f"{part('x', left, right)} * {part('y', top, bottom)} * {f32(255.0)}")))


def _hits(test) -> str:
    """Coverage from how many of the sixteen sub-samples pass."""
    total = " + ".join(f"cast({test(i, j)} as int)" for j in SUB for i in SUB)
    return f"(({total}) * 255 + 8) div 16"


def ellipse(g: DataFrame, width: int, height: int, start, end) -> DataFrame:
    import numpy as np

    f = np.float32
    left, top, right, bottom = (f(v) for v in _box(start, end, width, height))
    rx, ry = (right - left) / f(2), (bottom - top) / f(2)
    if rx == 0 or ry == 0:
        return g.withColumn("cov", F.lit(0))
    d = lambda v, o, c, r: div(f"{f32(v)} + {f32(o)} - {f32(float(c))}", f32(float(r)))
    inside = lambda i, j: f"({d('x', i, left + rx, rx)} * {d('x', i, left + rx, rx)} + {d('y', j, top + ry, ry)} * {d('y', j, top + ry, ry)} <= {f32(1.0)})"
    box = f"x >= {math.floor(left)} and x < {math.ceil(right)} and y >= {math.floor(top)} and y < {math.ceil(bottom)}"
    return g.withColumn("cov", F.expr(f"case when {box} then cast({_hits(inside)} as int) else 0 end"))


def simplify(points, tolerance: float):
    """Drops points nearer than tolerance to the last one kept; the ends stay."""
    import numpy as np

    f = np.float32
    if len(points) <= 2 or tolerance <= 0:
        return list(points)
    kept = [points[0]]
    for q in points[1:-1]:
        dx, dy = f(q[0]) - f(kept[-1][0]), f(q[1]) - f(kept[-1][1])
        if dx * dx + dy * dy >= f(tolerance) * f(tolerance):
            kept.append(q)
    return [*kept, points[-1]]


def polygon(g: DataFrame, points) -> DataFrame:
    """Even-odd rule at the sub-samples: a sample is inside if an odd number of crossings of its line lie at or before it.

    Each of a row's four lines takes its crossings from the edges once, as a short array, and pixels only count.
    """
    if not 3 <= len(points) <= MOST_POINTS:
        raise ValueError("a polygon has 3 to 20,000 points")
    edges = F.lit([[float(a[0]), float(a[1]), float(b[0]), float(b[1])] for a, b in zip(points, [points[-1], *points[:-1]], strict=True)])
    rows = g.select("mask_id", "y").distinct().withColumn("edges", edges)
    e = lambda k: f32(f"e[{k}]")
    for n, j in enumerate(SUB):
        sy = f"({f32('y')} + {f32(j)})"
        cross = f"{div(f'({e(2)} - {e(0)}) * ({sy} - {e(1)})', f'{e(3)} - {e(1)}')} + {e(0)}"
        rows = rows.withColumn(f"_c{n}", F.expr(f"transform(filter(edges, e -> ({e(1)} > {sy}) != ({e(3)} > {sy})), e -> {cross})"))
    q = g.join(rows.drop("edges"), ["mask_id", "y"])
    inside = lambda i, j: f"(size(filter(_c{SUB.index(j)}, c -> c <= {f32('x')} + {f32(i)})) % 2 = 1)"
    return q.withColumn("cov", F.expr(f"cast({_hits(inside)} as int)")).select("mask_id", "y", "x", "cov")


def freehand(g: DataFrame, points) -> DataFrame:
    return polygon(g, simplify(points, 0.35))


def brush_samples(points, diameter: float, opacity: float = 1.0):
    """(x, y, diameter, opacity) of the dabs along a path, spaced by max(0.18 diameter, 0.5)."""
    import numpy as np

    f = np.float32
    if len(points) == 1:
        return [(float(points[0][0]), float(points[0][1]), diameter, opacity)]
    step, out = max(f(diameter) * f(0.18), f(0.5)), []
    for a, b in zip(points, points[1:], strict=False):
        dx, dy = f(b[0]) - f(a[0]), f(b[1]) - f(a[1])
        n = max(1, int(np.ceil(np.hypot(dx, dy) / step)))
        if len(out) + n > MOST_DABS:
            raise ValueError("a brush has at most a million dabs")
        out += [(float(f(a[0]) + dx * (f(k) / f(n))), float(f(a[1]) + dy * (f(k) / f(n))), diameter, opacity) for k in range(n + 1)]
    if sum((d[2] + 3) ** 2 for d in out) > MOST_WORK:
        raise ValueError("the brush touches too many pixels")
    return out


def resolved_samples(samples, width: int, height: int):
    """Dabs along samples (x, y, diameter, opacity), all four changing evenly within a segment; its spacing is the finer end's.

    Raises ValueError for what would touch too many pixels, before any is painted.
    """
    import numpy as np

    f = np.float32
    out, work = [], 0

    def count(n: int, largest: float) -> None:
        nonlocal work
        side = int(np.ceil(f(largest))) + 3
        work += n * min(width, side) * min(height, side)
        if len(out) + n > MOST_DABS or work > MOST_WORK:
            raise ValueError("the brush has too many dabs or touches too many pixels")

    if len(samples) == 1:
        count(1, samples[0][2])
        return [tuple(map(float, samples[0]))]
    for a, b in zip(samples, samples[1:], strict=False):
        a, b = np.array(a, f), np.array(b, f)
        gap = max(f(min(a[2], b[2]) * f(0.18)), f(0.5))
        n = max(1, int(np.ceil(float(np.hypot(b[0] - a[0], b[1] - a[1])) / float(gap))))
        if n > 2 * (width + height + 4096):
            raise ValueError("a segment of the brush is too long")
        count(n + 1, float(max(a[2], b[2])))
        out += [tuple(float(v) for v in a + (b - a) * (f(k) / f(n))) for k in range(n + 1)]
    return out


def resolved_brush(g: DataFrame, width: int, height: int, samples, hardness: float) -> DataFrame:
    return dabs(g, width, height, resolved_samples(samples, width, height), hardness)


def shape(g: DataFrame, kind: str, points, width: int, height: int, **more) -> DataFrame:
    """A selection by its kind and its points; ValueError for kinds and numbers of points that are not."""
    least = {"rectangle": 2, "ellipse": 2, "polygon": 3, "freehand": 3, "brush": 1, "resolved_brush": 1}
    if kind not in least or len(points) < least[kind] or (kind in ("rectangle", "ellipse") and len(points) != 2):
        raise ValueError(f"no {kind} of {len(points)} points")
    if kind in ("rectangle", "ellipse"):
        return (rectangle if kind == "rectangle" else ellipse)(g, width, height, *points)
    if kind in ("polygon", "freehand"):
        return (polygon if kind == "polygon" else freehand)(g, points)
    if kind == "brush":
        return brush(g, width, height, points, more["diameter"], more["hardness"], more["opacity"])
    return resolved_brush(g, width, height, points, more["hardness"])


def dabs(g: DataFrame, width: int, height: int, samples, hardness: float) -> DataFrame:
    """The largest coverage of all dabs; each falls off linearly beyond its hard part.

    Dabs are spread over the places that they can reach and reduced with partial maxima, then meet the grid once.
    """
    spark = g.sparkSession
    d = spark.createDataFrame([(float(x), float(y), float(dia), float(o)) for x, y, dia, o in samples], "cx double, cy double, dia double, op double")
    d = d.withColumns({"r": F.expr(div(f32("dia"), f32(2.0)))})
    reach = lambda c, n: F.explode(F.expr(f"sequence(greatest(0, cast(floor({c} - r - 1) as int)), greatest(0, least({n - 1}, cast(ceil({c} + r + 1) as int) - 1)))"))
    q = d.withColumn("y", reach("cy", height)).withColumn("x", reach("cx", width))
    gap = lambda v, c: f"({f32(v)} + {f32(0.5)} - {f32(c)})"
    q = q.withColumn("dist", F.expr(f"cast(sqrt(cast({gap('x', 'cx')} as double) * {gap('x', 'cx')} + cast({gap('y', 'cy')} as double) * {gap('y', 'cy')}) as float)")).filter("dist <= r")
    hard = f"(r * {f32(float(hardness))})"
    fall = f"case when dist <= {hard} or {hard} >= r then {f32(1.0)} else {f32(1.0)} - {div(f"dist - {hard}", f"r - {hard}")} end"
    q = q.groupBy("y", "x").agg(F.max(F.expr(u8(f"{f32(255.0)} * {f32('op')} * ({fall})"))).alias("cov"))
    return g.join(q, ["y", "x"], "left").select("mask_id", "y", "x", F.coalesce("cov", F.lit(0)).alias("cov"))


def brush(g: DataFrame, width: int, height: int, points, diameter: float, hardness: float, opacity: float) -> DataFrame:
    return dabs(g, width, height, brush_samples(points, diameter, opacity), hardness)
