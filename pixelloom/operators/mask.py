"""Coverage masks (mask_id, y, x, cov): algebra, blending, soft and hard edges, selection by colour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import CHANNELS, EPSILON, clamp, div, f32, hue_of, luma, u8
from .window import KEY, frame_extreme, frame_sum

MASK = "mask_id"
MODES = {
    "replace": "n.cov",
    "add": "greatest(b.cov, n.cov)",
    "subtract": "(b.cov * (255 - n.cov) + 127) div 255",
    "intersect": "(b.cov * n.cov + 127) div 255",
}


def _cov(m: DataFrame, expression: str) -> DataFrame:
    return m.withColumn("cov", F.expr(f"cast({expression} as int)"))


def select_all(m: DataFrame) -> DataFrame:
    return _cov(m, "255")


def deselect(m: DataFrame) -> DataFrame:
    return _cov(m, "0")


def invert(m: DataFrame) -> DataFrame:
    return _cov(m, "255 - cov")


def contrast(m: DataFrame, factor: float) -> DataFrame:
    return _cov(m, u8(f"({f32('cov')} - {f32(127.5)}) * {f32(max(0.05, float(factor)))} + {f32(127.5)}"))


def compose(base: DataFrame | None, incoming: DataFrame, mode: str) -> DataFrame:
    """Two masks of the same size by place. Without a base, replace and add give the incoming mask, the others nothing."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    if base is None:
        return incoming if mode in ("replace", "add") else deselect(incoming)
    both = base.alias("b").join(incoming.alias("n"), [MASK, "y", "x"])
    return both.select(MASK, "y", "x", F.expr(f"cast({MODES[mode]} as int)").alias("cov"))


def union(masks: DataFrame, group: str) -> DataFrame:
    """The largest coverage over the masks of each group, with partial maxima before the shuffle."""
    return masks.groupBy(group, "y", "x").agg(F.max("cov").alias("cov"))


def blend(before: DataFrame, after: DataFrame, m: DataFrame, invert_mask: bool = False) -> DataFrame:
    """after over before by coverage, in integers; alpha stays that of before."""
    new = after.select(KEY, "y", "x", *[F.col(c).alias(f"_{c}") for c in CHANNELS])
    return blend_columns(before.join(new, [KEY, "y", "x"]), m, invert_mask)


def blend_columns(p: DataFrame, m: DataFrame, invert_mask: bool = False) -> DataFrame:
    """The same where the changed channels are columns _r, _g, _b already: one join, with the mask."""
    k = "(255 - cov)" if invert_mask else "cov"
    q = p.join(m.withColumnRenamed(MASK, KEY), [KEY, "y", "x"])
    return q.withColumns({c: F.expr(f"({c} * (255 - {k}) + _{c} * {k} + 127) div 255").cast("int") for c in CHANNELS}).drop("cov", *[f"_{c}" for c in CHANNELS])


def feather(m: DataFrame, radius: int) -> DataFrame:
    """Truncated means over frames cut at the edges, along rows and then columns."""
    radius = min(radius, 256)
    if radius == 0:
        return m
    for axis in ("x", "y"):
        m = _cov(frame_sum(m, "cov", radius, axis, "_sum", MASK), "_sum div _sum_n").drop("_sum", "_sum_n")
    return m


def _morph(m: DataFrame, radius: int, largest: bool, out: str = "cov") -> DataFrame:
    radius = min(radius, 256)
    if radius == 0:
        return m.withColumn(out, F.col("cov"))
    m = frame_extreme(m, "cov", radius, "x", "_row", largest, MASK)
    return frame_extreme(m, "_row", radius, "y", out, largest, MASK).drop("_row")


def expand(m: DataFrame, radius: int) -> DataFrame:
    return _morph(m, radius, True)


def shrink(m: DataFrame, radius: int) -> DataFrame:
    return _morph(m, radius, False)


def smooth(m: DataFrame, radius: int) -> DataFrame:
    return contrast(feather(m, min(radius, 128)), 1.8)


def border(m: DataFrame, width: int) -> DataFrame:
    """Expanded less shrunk, both computed beside each other."""
    m = _morph(_morph(m, width, True, "_out"), width, False, "_in")
    return _cov(m, "greatest(0, _out - _in)").drop("_out", "_in")


def refine(m: DataFrame, smooth_radius: int, feather_radius: int, contrast_amount: float, shift_edge: int) -> DataFrame:
    import numpy as np

    if not -1 <= contrast_amount <= 1:
        raise ValueError("contrast must lie in -1..1")
    if smooth_radius:
        m = smooth(m, smooth_radius)
    if shift_edge:
        m = _morph(m, abs(shift_edge), shift_edge > 0)
    if feather_radius:
        m = feather(m, feather_radius)
    return contrast(m, float(np.float32(1) + np.float32(contrast_amount) * np.float32(3)))


def align_to_edges(m: DataFrame, p: DataFrame, strength: float) -> DataFrame:
    """Steepens boundary coverage where the picture has a gradient; the outermost pixels stay."""
    if strength == 0:
        return m
    light = f"case when a = 0 then {f32(0.0)} else {div(f"{luma()} * {f32('a')}", f32(255.0))} end"
    q = m.join(p.select(F.col(KEY).alias(MASK), "y", "x", F.expr(light).alias("l")), [MASK, "y", "x"])
    row, col = Window.partitionBy(MASK, "y").orderBy("x"), Window.partitionBy(MASK, "x").orderBy("y")
    q = q.withColumns({"w": F.lag("l").over(row), "e": F.lead("l").over(row), "cw": F.lag("cov").over(row), "ce": F.lead("cov").over(row)})
    q = q.withColumn("_t", F.struct("w", "l", "e"))
    q = q.withColumns({"up": F.lag("_t").over(col), "dn": F.lead("_t").over(col), "cn": F.lag("cov").over(col), "cs": F.lead("cov").over(col)})
    two = f32(2.0)
    gx = f"(- up.w + up.e - {two} * w + {two} * e - dn.w + dn.e)"
    gy = f"(- up.w - {two} * up.l - up.e + dn.w + {two} * dn.l + dn.e)"
    g = div(f"cast(least(1020D, sqrt(cast({gx} as double) * {gx} + cast({gy} as double) * {gy})) as float)", f32(1020.0))
    edge = "(cov between 1 and 254 or (cw >= 128) != (cov >= 128) or (ce >= 128) != (cov >= 128) or (cn >= 128) != (cov >= 128) or (cs >= 128) != (cov >= 128))"
    inner = "w is not null and e is not null and up is not null and dn is not null"
    new = u8(f"({f32('cov')} - {f32(127.5)}) * ({f32(1.0)} + {f32(float(strength))} * {g} * {f32(3.0)}) + {f32(127.5)}")
    return q.select(MASK, "y", "x", F.expr(f"case when {inner} and {edge} then {new} else cov end").alias("cov"))


def wand_distance(r: int, g: int, b: int, a: int) -> str:
    """Largest channel difference to a sample as a share; transparent pixels only differ by alpha."""
    part = lambda c, v: div(f"abs({f32(c)} - {f32(float(v))})", f32(255.0))
    every = f"greatest({part('r', r)}, {part('g', g)}, {part('b', b)}, {part('a', a)})"
    return part("a", a) if a == 0 else f"case when a = 0 then {part('a', a)} else {every} end"


def wand_coverage(distance: str, tolerance: float, anti_alias: bool) -> str:
    import numpy as np

    t = np.float32(tolerance)
    soft = min(np.float32(1), t + np.float32(0.08 if anti_alias else 0))
    d = f"({distance})"
    ramp = u8(f"{f32(255.0)} * ({f32(1.0)} - {div(f"{d} - {f32(float(t))}", f32(float(soft - t)))})") if soft > t else "255"
    return f"case when {d} <= {f32(float(t))} {'or true' if soft <= t else ''} then 255 when {d} >= {f32(float(soft))} then 0 else {ramp} end"


def wand_everywhere(p: DataFrame, sample: tuple[int, int, int, int], tolerance: float, anti_alias: bool = True) -> DataFrame:
    """Coverage by likeness to a sample colour, anywhere in the picture."""
    return p.select(F.col(KEY).alias(MASK), "y", "x", F.expr(wand_coverage(wand_distance(*sample), tolerance, anti_alias)).cast("int").alias("cov"))


def linear_table() -> list[float]:
    """Linear light of each byte."""
    import numpy as np

    v = np.arange(256, dtype=np.float32) / np.float32(255)
    return np.where(v <= np.float32(0.04045), v / np.float32(12.92), ((v + np.float32(0.055)) / np.float32(1.055)) ** np.float32(2.4)).astype(np.float32).astype(float).tolist()


def _features(p: DataFrame) -> DataFrame:
    """Adds hue (turns), sat and lum of linear light."""
    table = ", ".join(f"{v!r}D" for v in linear_table())
    q = p.withColumns({f"_{c}": F.expr(f"cast(element_at(array({table}), {c} + 1) as float)") for c in CHANNELS})
    q = q.withColumns({"_hi": F.greatest("_r", "_g", "_b"), "_lo": F.least("_r", "_g", "_b")}).withColumn("_d", F.expr("_hi - _lo"))
    q = q.withColumn("sat", F.expr(f"case when _hi <= {f32(EPSILON)} then {f32(0.0)} else {div("_d", "_hi")} end"))
    q = q.withColumn("hue", F.expr(div(hue_of("_hi", "_d", "_r", "_g", "_b", f32(1.0)), f32(6.0))))
    return q.withColumn("lum", F.expr(luma("_r", "_g", "_b"))).drop("_r", "_g", "_b", "_hi", "_lo", "_d")


def color_range(p: DataFrame, points: list[tuple[int, int]], tolerance: float, luminance: float = 1.0, hue: float = 1.0, saturation: float = 1.0) -> DataFrame:
    """Coverage by distance to the nearest of up to 32 sampled pixels of the same picture, times alpha.

    The samples are gathered as one short array a picture, so the picture itself is not joined pair by pair.
    """
    import numpy as np

    if not 1 <= len(points) <= 32:
        raise ValueError("1 to 32 sample points")
    if not 0 < tolerance <= 1:
        raise ValueError("tolerance must lie in (0, 1]")
    q = _features(p)
    where = " or ".join(f"(x = {x} and y = {y})" for x, y in points)
    samples = q.filter(where).groupBy(KEY).agg(F.collect_list(F.struct("hue", "sat", "lum")).alias("samples"))
    weights = [np.float32(v) for v in (hue, saturation, luminance)]
    total = np.sqrt(weights[0] + weights[1] + weights[2])
    turn = f"(least(abs(hue - v.hue), {f32(1.0)} - abs(hue - v.hue)) * {f32(2.0)})"
    dh = f"({turn} * least({f32(1.0)}, least(sat, v.sat)) * {f32(float(weights[0]))})"
    ds = f"(abs(sat - v.sat) * {f32(float(weights[1]))})"
    dl = f"(cast(sqrt(cast(abs(lum - v.lum) as double)) as float) * {f32(float(weights[2]))})"
    dist = div(f"cast(sqrt(cast({dh} * {dh} + {ds} * {ds} + {dl} * {dl} as double)) as float)", f32(float(total)))
    q = q.join(samples, KEY).withColumn("_dist", F.expr(f"array_min(transform(samples, v -> {dist}))"))
    t = np.float32(tolerance)
    soft = min(np.float32(1), t + np.float32(0.1))
    ramp = u8(f"{f32(255.0)} * ({f32(1.0)} - {div(f"_dist - {f32(float(t))}", f32(float(soft - t)))})") if soft > t else "0"
    cov = f"case when _dist <= {f32(float(t))} then 255 when _dist >= {f32(float(soft))} then 0 else {ramp} end"
    return q.select(F.col(KEY).alias(MASK), "y", "x", F.expr(f"case when a = 0 then 0 else cast((({cov}) * a + 127) div 255 as int) end").alias("cov"))


def decontaminate(p: DataFrame, m: DataFrame, strength: float, radius: int, invert_mask: bool = False, enabled: bool = True) -> DataFrame:
    """Edge pixels move towards the weighted colour of certain foreground within a disc.

    Only edge pixels are spread over the disc's offsets, and they meet the picture by equality of places.
    """
    if not enabled or strength == 0:
        return p
    q = p.join(m.withColumnRenamed(MASK, KEY), [KEY, "y", "x"])
    q = q.withColumn("k", F.expr("255 - cov") if invert_mask else F.col("cov")).drop("cov")
    scale = 65535
    import numpy as np

    s = int(np.floor(np.float32(strength) * np.float32(scale) + np.float32(0.5)))
    r2 = radius * radius
    disc = [(i, j, r2 + 1 - i * i - j * j) for j in range(-radius, radius + 1) for i in range(-radius, radius + 1) if i * i + j * j <= r2]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in disc])
    edge = q.filter("k > 0 and k < 224").select(KEY, F.col("y").alias("ey"), F.col("x").alias("ex"), F.explode(offsets).alias("o"))
    edge = edge.select(KEY, "ey", "ex", F.expr("ey + o.j").alias("y"), F.expr("ex + o.i").alias("x"), F.col("o.w").alias("w"))
    sure = q.filter("k >= 224 and a != 0").select(KEY, "y", "x", *CHANNELS, "k")
    sums = edge.join(sure, [KEY, "y", "x"]).groupBy(KEY, F.col("ey").alias("y"), F.col("ex").alias("x")).agg(
        F.expr("sum(cast(k as bigint) * w)").alias("tw"), *[F.expr(f"sum(cast({c} as bigint) * k * w)").alias(f"t{c}") for c in CHANNELS]
    )
    out = q.join(sums, [KEY, "y", "x"], "left")
    near = lambda c: f"((t{c} + tw div 2) div tw)"
    new = lambda c: f"cast(({c} * {scale - s}L + {near(c)} * {s}L + {scale // 2}) div {scale} as int)"
    return out.withColumns({c: F.expr(f"case when tw is null or tw = 0 then {c} else {new(c)} end") for c in CHANNELS}).drop("k", "tw", "tr", "tg", "tb")
