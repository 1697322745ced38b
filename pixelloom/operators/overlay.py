"""Views of masks, pen pressure, and crop boxes of given ratios."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MODES = ("marching_ants", "color", "grayscale", "mask_only", "white", "black")
#: Width by height of the crop ratios; fixed values.
RATIOS = {"square": 1.0, "16:9": 16 / 9, "4:3": 4 / 3, "a4": 210 / 297}


def outline(m: DataFrame) -> DataFrame:
    """m with ``edge``: whether a neighbour is on the other side of 128; what lies outside counts as not selected."""
    row, col = Window.partitionBy("mask_id", "y").orderBy("x"), Window.partitionBy("mask_id", "x").orderBy("y")
    inside = F.col("cov") >= 128
    near = [F.coalesce(f("cov").over(w) >= 128, F.lit(False)) for w in (row, col) for f in (F.lag, F.lead)]
    return m.withColumn("edge", (near[0] != inside) | (near[1] != inside) | (near[2] != inside) | (near[3] != inside))


def overlay(m: DataFrame, width: int, height: int, out_width: int, out_height: int, mode: str, color: tuple[int, int, int] = (255, 0, 0), opacity: float = 0.5, frame: int = 0) -> DataFrame:
    """(mask_id, y, x, r, g, b, a): a mask shown at another size, each place taking its nearest source pixel.

    Source pixels are spread over the places that show them, so nothing is joined.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    q = outline(m) if mode == "marching_ants" else m
    spots = lambda v, n, o: F.explode(F.expr(f"filter(sequence(cast(greatest(0D, floor({v} * {o / n!r}D) - 1) as int), cast(least({o - 1}D, ceil(({v} + 1) * {o / n!r}D) + 1) as int)), k -> least({n - 1}, cast(floor((k + 0.5D) * {n}D / {o}D) as int)) = {v})"))
    q = q.withColumn("oy", spots("y", height, out_height)).withColumn("ox", spots("x", width, out_width))
    near = lambda e: f"cast(floor({e} + 0.5D) as int)"
    o = f"{float(opacity)!r}D"
    if mode == "marching_ants":
        light = f"case when edge and (ox + oy + {frame}) % 8 < 4 then 255 else 0 end"
        px = (light, light, light, "case when edge then 255 else 0 end")
    elif mode == "color":
        px = (*map(str, color), near(f"cov * {o}"))
    elif mode in ("grayscale", "mask_only"):
        px = ("cov", "cov", "cov", "255" if mode == "mask_only" else near(f"255 * {o}"))
    else:
        v = "255" if mode == "white" else "0"
        px = (v, v, v, near(f"(255 - cov) * {o}"))
    return q.select("mask_id", F.col("oy").alias("y"), F.col("ox").alias("x"), *[F.expr(e).cast("int").alias(c) for c, e in zip("rgba", px, strict=True)])


def pressed(samples: DataFrame, diameter: float, opacity: float, size: bool = True, strength: bool = True, least_size: float = 0.35, least_opacity: float = 0.25, enabled: bool = True) -> DataFrame:
    """samples (pointer, pressure, ..) with diameter and opacity of each dab, in steps of a millionth.

    Only pens press; a pressure that is missing or not a number leaves the base values.
    """
    cut = lambda v, lo, hi: min(hi, max(lo, v))
    base_d, base_o = cut(diameter, 1.0, 512.0), cut(opacity, 0.01, 1.0)
    p = "greatest(0D, least(1D, pressure))"
    live = f"({str(enabled).lower()} and pointer = 'pen' and pressure is not null and not isnan(pressure))"
    step = lambda e, lo, hi: f"floor(greatest({lo}D, least({hi}D, {e})) * 1000000D + 0.5D) / 1000000D"
    grow = lambda f: f"({f!r}D + (1D - {f!r}D) * {p})"
    d = step(f"{base_d!r}D * {grow(cut(least_size, 0.05, 1.0)) if size else '1D'}", 1.0, 512.0)
    o = step(f"{base_o!r}D * {grow(cut(least_opacity, 0.01, 1.0)) if strength else '1D'}", 0.01, 1.0)
    return samples.withColumns({"diameter": F.expr(f"case when {live} then {d} else {base_d!r}D end"), "opacity": F.expr(f"case when {live} then {o} else {base_o!r}D end")})


def crop_of_ratio(width: int, height: int, ratio: str) -> tuple[float, float, float, float]:
    """x, y, width and height in shares of the largest centred box of a ratio; original: everything."""
    have, want = width / height, RATIOS.get(ratio, width / height)
    w, h = (1.0, min(1.0, have / want)) if want > have else (min(1.0, want / have), 1.0)
    return (1 - w) / 2, (1 - h) / 2, w, h
