"""From plan to DataFrame: rewriting, then one transformation for each remaining step.

Rewrites: operations that do nothing go; neighbouring channel-wise operations become one table of bytes per
channel; neighbouring exact moves stay projections. Catalyst then fuses the projections.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import aggregate, geometry, mask, point, window
from .ops import GEOMETRY, Op, Plan


@dataclass(frozen=True)
class Tables:
    """A fused run of channel-wise operations."""

    red: tuple[int, ...]
    green: tuple[int, ...]
    blue: tuple[int, ...]

    @property
    def type(self) -> str:
        return "tables"


def rewrite(p: Plan) -> list:
    """Steps of a plan: operations, and Tables in place of runs of channel-wise ones."""
    steps: list = []
    for o in p.ops:
        if o.is_identity:
            continue
        t = point.channel_tables(o)
        if t is None:
            steps.append(o)
            continue
        if steps and isinstance(steps[-1], Tables):
            last = steps.pop()
            t = [[new[v] for v in old] for old, new in zip((last.red, last.green, last.blue), t, strict=True)]
        steps.append(Tables(*map(tuple, t)))
    return steps


def geometry_only(p: Plan) -> Plan:
    """The plan's geometry without its colours: what a selection made on the original needs."""
    keep = []
    for o in p.ops:
        if o.type in GEOMETRY:
            keep.append(Op(o.type, o.params | {"vignetting": 0, "chromatic_aberration": 0}) if o.type == "lens_correction" else o)
    return Plan(tuple(keep))


def stage_sizes(p: Plan, width: int, height: int) -> list[tuple[int, int]]:
    """Width and height before each operation, and after the last."""
    out = [(width, height)]
    for o in p.ops:
        w, h = out[-1]
        if o.type == "rotate" and o.degrees % 180:
            w, h = h, w
        elif o.type == "crop":
            _, _, w, h = geometry.crop_box(o.x, o.y, o.width, o.height, w, h)
        out.append((w, h))
    return out


def document_enhance(p: DataFrame, strength: float, grayscale: bool = False, size: window.Size = None) -> DataFrame:
    """A fixed chain for pages: white balance, light, contrast, a little denoising, sharpening, and grey on demand."""
    import numpy as np

    s = lambda v: float(np.float32(strength) * np.float32(v))
    p = aggregate.auto_white_balance(p, s(0.45))
    p = window.uneven_lighting(p, s(0.78), 32.0, size)
    p = window.local_contrast(p, s(0.72), 32, 1.6, size)
    p = window.denoise(p, s(0.22), 0.85, size)
    p = window.edge_aware_sharpen(p, s(0.55), 1.0, 0.025, size)
    return point.grayscale(p) if grayscale else p


def apply_step(p: DataFrame, o, width: int, height: int, masks: dict[str, DataFrame] | None = None) -> DataFrame:
    """One step over pictures of one size. A masked operation names its mask, found in masks."""
    k = o.type
    if k == "tables":
        return point.apply_tables(p, [list(o.red), list(o.green), list(o.blue)])
    q = o.params
    tables = point.channel_tables(o)
    if tables is not None:
        return point.apply_tables(p, tables)
    if k == "masked":
        inner, m = q["operation"], (masks or {})[q["mask"]]
        if inner.type == "decontaminate_colors":
            return mask.decontaminate(p, m, inner.strength, int(inner.radius), q.get("invert", False), inner.params.get("enabled", True))
        kept = p.withColumn("_src", F.struct("r", "g", "b", "a"))
        changed = apply_step(kept, inner, width, height, masks)
        both = changed.withColumns({f"_{c}": F.col(c) for c in "rgb"} | {c: F.col(f"_src.{c}") for c in "rgba"}).drop("_src")
        return mask.blend_columns(both, m, q.get("invert", False))
    simple = {
        "saturation": lambda: point.saturation(p, q["amount"]),
        "grayscale": lambda: point.grayscale(p),
        "sepia": lambda: point.sepia(p),
        "temperature_tint": lambda: point.temperature_tint(p, q["temperature"], q["tint"]),
        "hsl": lambda: point.hsl(p, **q),
        "selective_color": lambda: point.selective_color(p, **q),
        "reflect_horizontal": lambda: geometry.reflect_horizontal(p, width),
        "rotate": lambda: geometry.rotate(p, q["degrees"], width, height),
        "crop": lambda: geometry.crop(p, q["x"], q["y"], q["width"], q["height"], width, height),
        "straighten": lambda: geometry.straighten(p, q["degrees"], width, height),
        "perspective": lambda: geometry.perspective(p, q["corners"], width, height),
        "lens_correction": lambda: geometry.lens_correction(p, q["distortion"], q["vignetting"], q["chromatic_aberration"], width, height),
        "gaussian_blur": lambda: window.gaussian_blur(p, q["radius"], (width, height)),
        "sharpen": lambda: window.sharpen(p, q["strength"], (width, height)),
        "auto_white_balance": lambda: aggregate.auto_white_balance(p, q["strength"]),
        "local_contrast": lambda: window.local_contrast(p, q["strength"], int(q["tile_size"]), q["clip_limit"], (width, height)),
        "denoise": lambda: window.denoise(p, q["strength"], q["preserve_edges"], (width, height)),
        "deblock": lambda: window.deblock(p, q["strength"]),
        "edge_aware_sharpen": lambda: window.edge_aware_sharpen(p, q["strength"], q["radius"], q["threshold"], (width, height)),
        "mild_deblur": lambda: window.mild_deblur(p, q["strength"], q["radius"], (width, height)),
        "uneven_lighting_correction": lambda: window.uneven_lighting(p, q["strength"], q["radius"], (width, height)),
        "document_enhance": lambda: document_enhance(p, q["strength"], q.get("grayscale", False), (width, height)),
    }
    return simple[k]()


#: Steps that look at other pixels of the same picture by windows.
WINDOWED = {"local_contrast", "denoise", "deblock", "edge_aware_sharpen", "mild_deblur", "uneven_lighting_correction", "document_enhance", "gaussian_blur", "sharpen"}


def apply_plan(p: DataFrame, plan: Plan, width: int, height: int, masks: dict[str, DataFrame] | None = None) -> DataFrame:
    """Pixels after a plan, over any number of pictures of one size. An empty plan gives its input."""
    steps = rewrite(plan)
    if sum(s.type in WINDOWED or (s.type == "masked" and s.params["operation"].type in WINDOWED) for s in steps):
        p = window.clustered(p)
    for s in steps:
        p = apply_step(p, s, width, height, masks)
        if not isinstance(s, Tables):
            width, height = stage_sizes(Plan((s,)) if s.type != "masked" else Plan(()), width, height)[-1]
    return p
