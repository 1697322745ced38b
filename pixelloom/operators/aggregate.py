"""Statistics of pictures and masks: grouped aggregates with partial sums, one row or one histogram a picture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.color import CHANNELS, LUMA, div, f32, luma, u8
from .window import KEY

NAMES = {"r": "red", "g": "green", "b": "blue"}


def histogram(p: DataFrame, zeros: bool = False) -> DataFrame:
    """(image_id, channel, bin, n) of red, green, blue and luminance; transparent pixels count too.

    Pixels are first counted by value in partial sums, four rows a pixel never leave the task. With zeros, bins without
    pixels have a row as well.
    """
    long = p.select(KEY, F.expr(f"stack(4, 'red', r, 'green', g, 'blue', b, 'luminance', {u8(luma())}) as (channel, bin)"))
    out = long.groupBy(KEY, "channel", "bin").agg(F.count("*").alias("n"))
    if not zeros:
        return out
    grid = p.select(KEY).distinct().withColumn("channel", F.explode(F.array(*map(F.lit, (*NAMES.values(), "luminance"))))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(255))))
    return grid.join(out, [KEY, "channel", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def luminance_histogram(p: DataFrame) -> DataFrame:
    """(image_id, bin, n) of luminance."""
    return p.groupBy(KEY, F.expr(u8(luma())).alias("bin")).agg(F.count("*").alias("n"))


def clipping(p: DataFrame) -> DataFrame:
    """Pixels with a channel at 0, with one at 255, and all pixels."""
    return p.groupBy(KEY).agg(
        F.count_if((F.col("r") == 0) | (F.col("g") == 0) | (F.col("b") == 0)).alias("shadow_clipping"),
        F.count_if((F.col("r") == 255) | (F.col("g") == 255) | (F.col("b") == 255)).alias("highlight_clipping"),
        F.count("*").alias("pixel_count"),
    )


def _visible_histogram(p: DataFrame, lum: bool = False) -> DataFrame:
    expr = f"stack(1, 'luminance', {u8(luma())}) as (channel, bin)" if lum else "stack(3, 'r', r, 'g', g, 'b', b) as (channel, bin)"
    return p.filter("a != 0").select(KEY, F.expr(expr)).groupBy(KEY, "channel", "bin").agg(F.count("*").alias("n"))


def trimmed_means(p: DataFrame) -> DataFrame:
    """(image_id, channel, mean): visible pixels without the twentieth part at either end, bins cut where it falls."""
    w = Window.partitionBy(KEY, "channel").orderBy("bin")
    h = _visible_histogram(p).withColumns({"end": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(KEY, "channel"))})
    h = h.withColumn("trim", F.expr("total div 20"))
    h = h.withColumn("kept", F.greatest(F.lit(0), F.least("end", F.col("total") - F.col("trim")) - F.greatest(F.col("end") - F.col("n"), F.col("trim"))))
    return h.groupBy(KEY, "channel").agg(F.expr(f"case when sum(kept) = 0 then {f32(0.0)} else {div(f32('sum(kept * bin)'), f32('sum(kept)'))} end").alias("mean"))


def white_balance_gains(p: DataFrame) -> DataFrame:
    """(image_id, gain_r, gain_g, gain_b); pictures without visible pixels or light have no row."""
    m = trimmed_means(p).groupBy(KEY).pivot("channel", list(CHANNELS)).agg(F.first("mean"))
    weigh = lambda names: " + ".join(f"{f32(w)} * {n}" for w, n in zip(LUMA, names, strict=True))
    m = m.withColumn("target", F.expr(weigh(CHANNELS))).filter(f"target > {f32(1.1920928955078125e-07)}")
    low, high = f32(0.67), f32(1.5)
    m = m.withColumns({f"_{c}": F.expr(f"case when {c} <= {f32(1.0)} then {f32(1.0)} else greatest({low}, least({high}, {div("target", c)})) end") for c in CHANNELS})
    m = m.withColumn("_all", F.expr(weigh([f"_{c}" for c in CHANNELS])))
    return m.select(KEY, *[F.expr(f"case when _all > {f32(1.1920928955078125e-07)} then greatest({low}, least({high}, {div(f"_{c}", "_all")})) else _{c} end").alias(f"gain_{c}") for c in CHANNELS])


def auto_white_balance(p: DataFrame, strength: float) -> DataFrame:
    """Channels by gains that bring their trimmed means together. Gains are one row a picture."""
    if strength == 0:
        return p
    out = p.join(white_balance_gains(p), KEY, "left")
    new = lambda c: u8(f"{f32(c)} * ({f32(1.0)} + (gain_{c} - {f32(1.0)}) * {f32(float(strength))})")
    return out.withColumns({c: F.expr(f"case when a = 0 or gain_r is null then {c} else {new(c)} end") for c in CHANNELS}).drop(*[f"gain_{c}" for c in CHANNELS])


def percentiles(p: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(image_id, low, high, spread): the first luminance whose cumulative count reaches round(n * share), at least 1."""
    w = Window.partitionBy(KEY).orderBy("bin")
    h = _visible_histogram(p, lum=True).withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy(KEY))})
    first = lambda q: F.expr(f"min(case when upto >= greatest(1, cast(floor(cast({f32('total')} * {f32(q)} as double) + 0.5D) as bigint)) then bin end)")
    return h.groupBy(KEY).agg(first(low).alias("low"), first(high).alias("high")).withColumn("spread", F.expr(div(f32("greatest(0, high - low)"), f32(255.0))))


def colour_cast(p: DataFrame) -> DataFrame:
    """(image_id, average_luminance, red_bias, green_bias, blue_bias, dominant) of visible pixels."""
    v = p.filter("a != 0").groupBy(KEY).agg(F.expr(f"avg(cast({luma()} as double)) / 255").alias("mean"), *[F.expr(f"avg({c}) / 255").alias(f"m{c}") for c in CHANNELS])
    v = v.withColumns({f"m{c}": F.expr(f32(f"m{c}")) for c in CHANNELS})
    v = v.withColumn("neutral", F.expr(" + ".join(f"{f32(w)} * m{c}" for w, c in zip(LUMA, CHANNELS, strict=True))))
    v = v.withColumns({f"{NAMES[c]}_bias": F.expr(f"m{c} - neutral") for c in CHANNELS})
    top, low = "greatest(red_bias, green_bias, blue_bias)", "least(red_bias, green_bias, blue_bias)"
    name = (
        f"case when {top} - {low} < {f32(0.035)} then 'neutral' when red_bias = {top} and blue_bias = {low} then 'warm' "
        f"when blue_bias = {top} and red_bias = {low} then 'cool' when green_bias = {top} then 'green' else 'mixed' end"
    )
    return v.select(KEY, F.col("mean").alias("average_luminance"), *[f"{n}_bias" for n in NAMES.values()], F.expr(name).alias("dominant"))


def spatial(p: DataFrame) -> DataFrame:
    """(image_id, noise, sharpness, local_contrast, edge_density) from the four neighbours of visible inner pixels."""
    x, y = Window.partitionBy(KEY, "y").orderBy("x"), Window.partitionBy(KEY, "x").orderBy("y")
    q = p.select(KEY, "y", "x", "a", F.expr(luma()).alias("l"))
    q = q.withColumns({"w": F.lag("l").over(x), "e": F.lead("l").over(x)}).withColumns({"n": F.lag("l").over(y), "s": F.lead("l").over(y)})
    q = q.filter("a != 0 and w is not null and e is not null and n is not null and s is not null")
    q = q.withColumn("around", F.expr(f"{f32(0.0)} + w + e + n + s")).withColumn("away", F.expr(f"abs(l - {div("around", f32(4.0))})")).withColumn("lap", F.expr(f"{f32(4.0)} * l - around"))
    calm = f"away <= {f32(20.0)}"
    return q.groupBy(KEY).agg(
        F.expr(f"coalesce(least(1D, avg(case when {calm} then cast(away as double) end) / 32), 0D)").alias("noise"),
        F.expr("least(1D, sqrt(avg(cast(lap * lap as double)) / (255D * 255 * 4)))").alias("sharpness"),
        F.expr(f"least(1D, avg(cast({div("away", f32(255.0))} as double)))").alias("local_contrast"),
        F.expr(f"count_if(not ({calm})) / cast(count(*) as double)").alias("edge_density"),
    )


def analysis(p: DataFrame) -> DataFrame:
    """One row a picture: light, spread, cast, noise, sharpness, contrast, edges, white background, document or not."""
    white = p.filter("a != 0").groupBy(KEY).agg(F.expr(f"count_if({luma()} >= {f32(210.0)} and greatest(r, g, b) - least(r, g, b) <= 28) / cast(count(*) as double)").alias("white_background_ratio"))
    out = p.select(KEY).distinct()
    for part in (colour_cast(p), percentiles(p).select(KEY, F.col("spread").alias("luminance_spread")), spatial(p), white):
        out = out.join(part, KEY, "left")
    zero = ["average_luminance", "red_bias", "green_bias", "blue_bias", "luminance_spread", "noise", "sharpness", "local_contrast", "edge_density", "white_background_ratio"]
    out = out.fillna(0.0, zero).fillna("neutral", ["dominant"])
    return out.withColumn("likely_document", F.expr("white_background_ratio >= 0.30 and edge_density >= 0.015 and luminance_spread >= 0.20"))


def mask_diagnostics(m: DataFrame) -> DataFrame:
    """(mask_id, selected, fully_selected, average_coverage, left, top, right, bottom): bounds are half open, null if empty."""
    some = F.col("cov") > 0
    return m.groupBy("mask_id").agg(
        F.count_if(some).alias("selected"), F.count_if(F.col("cov") == 255).alias("fully_selected"), (F.avg("cov") / 255).alias("average_coverage"),
        F.min(F.when(some, F.col("x"))).alias("left"), F.min(F.when(some, F.col("y"))).alias("top"),
        (F.max(F.when(some, F.col("x"))) + 1).alias("right"), (F.max(F.when(some, F.col("y"))) + 1).alias("bottom"),
    )


def area_thumbnail(m: DataFrame, width: int, height: int, new_width: int, new_height: int) -> DataFrame:
    """(mask_id, y, x, cov): means over each target cell, source pixels weighing by how much of them lies in it."""
    sx, sy = width / new_width, height / new_height
    cells = lambda v, s, n: F.explode(F.expr(f"sequence(cast(floor({v} / {s!r}D) as int), cast(least({n - 1}D, ceil(({v} + 1) / {s!r}D) - 1) as int))"))
    q = m.withColumn("cx", cells("x", sx, new_width)).withColumn("cy", cells("y", sy, new_height))
    part = lambda v, c, s: f"(least({v} + 1D, ({c} + 1) * {s!r}D) - greatest(cast({v} as double), {c} * {s!r}D))"
    q = q.withColumn("w", F.expr(f"{part('x', 'cx', sx)} * {part('y', 'cy', sy)}")).filter("w > 0")
    return q.groupBy("mask_id", F.col("cy").alias("y"), F.col("cx").alias("x")).agg(F.expr("cast(floor(round(sum(w * cov) / sum(w), 6) + 0.5D) as int)").alias("cov"))
