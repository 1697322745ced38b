"""Per-pixel operations: one projection each, alpha untouched, no shuffle.

Every function takes and returns pixels (image_id, y, x, r, g, b, a, and whatever else they carry).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.color import CHANNELS, EPSILON, SEPIA, byte_table, clamp, div, f32, hue_of, lookup, luma, u8


def _set(p: DataFrame, **expressions: str) -> DataFrame:
    return p.withColumns({k: F.expr(e) for k, e in expressions.items()})


def _each(p: DataFrame, expression) -> DataFrame:
    return _set(p, **{c: expression(c, k) for k, c in enumerate(CHANNELS)})


def brightness(p: DataFrame, amount: float) -> DataFrame:
    return _each(p, lambda c, _: u8(f"{f32(c)} + {f32(amount)} * {f32(255.0)}"))


def contrast(p: DataFrame, amount: float) -> DataFrame:
    return _each(p, lambda c, _: u8(f"({f32(c)} - {f32(127.5)}) * ({f32(1.0)} + {f32(amount)}) + {f32(127.5)}"))


def saturation(p: DataFrame, amount: float) -> DataFrame:
    return _each(p, lambda c, _: u8(f"{luma()} + ({f32(c)} - {luma()}) * ({f32(1.0)} + {f32(amount)})"))


def grayscale(p: DataFrame) -> DataFrame:
    return _each(p, lambda c, _: u8(luma()))


def sepia(p: DataFrame) -> DataFrame:
    return _each(p, lambda c, k: u8(" + ".join(f"{f32(w)} * {f32(x)}" for w, x in zip(SEPIA[k], CHANNELS, strict=True))))


def gamma_table(value: float) -> list[int]:
    import numpy as np

    return byte_table(lambda x: np.float32(255) * (x / np.float32(255)) ** (np.float32(1) / np.float32(value)))


def curve_table(points) -> list[int]:
    """Piecewise linear; beyond the ends the nearest segment's end holds."""
    import numpy as np

    pts = np.asarray(points, np.float32)

    def run(x):
        at = x / np.float32(255)
        seg = np.minimum(np.searchsorted(pts[1:, 0], at, "left"), len(pts) - 2)
        (x0, y0), (x1, y1) = pts[seg].T, pts[seg + 1].T
        share = np.clip((at - x0) / np.maximum(x1 - x0, np.float32(EPSILON)), np.float32(0), np.float32(1))
        return (y0 + (y1 - y0) * share) * np.float32(255)

    return byte_table(run)


def levels_table(input_black: int, input_white: int, gamma: float, output_black: int, output_white: int) -> list[int]:
    import numpy as np

    f = np.float32
    return byte_table(lambda x: f(output_black) + np.clip((x - f(input_black)) / f(input_white - input_black), f(0), f(1)) ** (f(1) / f(gamma)) * f(output_white - output_black))


def channel_tables(o) -> list[list[int]] | None:
    """The byte tables of red, green and blue of an operation that treats channels one by one; None for others."""
    import numpy as np

    f = np.float32
    kind = o.type
    if kind == "brightness":
        return [byte_table(lambda x: x + f(o.amount) * f(255))] * 3
    if kind == "contrast":
        return [byte_table(lambda x: (x - f(127.5)) * (f(1) + f(o.amount)) + f(127.5))] * 3
    if kind == "gamma":
        return [gamma_table(o.value)] * 3
    if kind == "levels":
        return [levels_table(o.input_black, o.input_white, o.gamma, o.output_black, o.output_white)] * 3
    if kind == "white_point":
        return [byte_table(lambda x, v=v: x * f(255) / f(max(v, 1))) for v in (o.red, o.green, o.blue)]
    if kind == "black_point":
        return [byte_table(lambda x, v=v: x - f(v)) for v in (o.red, o.green, o.blue)]
    if kind == "curves":
        line = ((0, 0), (1, 1))
        base = curve_table(o.params.get("rgb", line))
        return [[t[v] for v in base] for t in (curve_table(o.params.get(n, line)) for n in ("red", "green", "blue"))]
    return None


def apply_tables(p: DataFrame, tables: list[list[int]]) -> DataFrame:
    """Channels through their tables: what any run of channel-wise operations comes to."""
    return _each(p, lambda c, k: lookup(tables[k], c))


def temperature_tint(p: DataFrame, temperature: float, tint: float) -> DataFrame:
    t, i, one = f32(temperature), f32(tint), f32(1.0)
    warm, tinge = f"{t} * {f32(0.25)}", f"{i} * {f32(0.05)}"
    gains = (f"({one} + {warm} + {tinge})", f"({one} - {i} * {f32(0.18)})", f"({one} - {warm} + {tinge})")
    return _each(p, lambda c, k: u8(f"{f32(c)} * {gains[k]}"))


def _unit(p: DataFrame) -> DataFrame:
    p = _set(p, **{f"_{c}": div(c, f32(255.0)) for c in CHANNELS})
    p = _set(p, _hi="greatest(_r, _g, _b)", _lo="least(_r, _g, _b)")
    return _set(p, _d="_hi - _lo")


_SCRATCH = ("_r", "_g", "_b", "_hi", "_lo", "_d")


def with_hsl(p: DataFrame) -> DataFrame:
    """Adds hue (degrees), sat and light."""
    p = _set(_unit(p), light=f"(_hi + _lo) * {f32(0.5)}", hue=hue_of("_hi", "_d", "_r", "_g", "_b", f32(60.0)))
    full = f"greatest({f32(1.0)} - abs({f32(2.0)} * light - {f32(1.0)}), {f32(EPSILON)})"
    return _set(p, sat=f"case when _d <= {f32(EPSILON)} then {f32(0.0)} else {div("_d", full)} end").drop(*_SCRATCH)


def with_hsv(p: DataFrame) -> DataFrame:
    """Adds hue (degrees), sat and val."""
    p = _set(_unit(p), hue=hue_of("_hi", "_d", "_r", "_g", "_b", f32(60.0)), val="_hi")
    return _set(p, sat=f"case when _hi <= {f32(EPSILON)} then {f32(0.0)} else {div("_d", "_hi")} end").drop(*_SCRATCH)


def _hue_distance(hue: str, centre: float) -> str:
    away = f"abs({hue} - {f32(float(centre))})"
    return f"least({away}, {f32(360.0)} - {away})"


#: Centres of the hue bands, in the order that breaks ties; fixed values.
BANDS = {"red": 0, "yellow": 60, "green": 120, "cyan": 180, "blue": 240, "magenta": 300}


def hsl(p: DataFrame, **settings) -> DataFrame:
    """settings: master and BANDS, each (hue, saturation, lightness); what is not given is zero."""
    base = settings.get("master", (0, 0, 0))
    p = with_hsl(p)
    near = ", ".join(_hue_distance("hue", c) for c in BANDS.values())
    p = _set(p, _near=f"array_position(array({near}), least({near})) - 1", _away=f"least({near})")
    p = _set(p, _w=clamp(f"{f32(1.0)} - {div("_away", f32(60.0))}", f32(0.0), f32(1.0)))
    of = lambda k: "element_at(array(" + ", ".join(f32(float(settings.get(n, (0, 0, 0))[k])) for n in BANDS) + "), cast(_near as int) + 1) * _w"
    turned = f"(hue + {f32(float(base[0]))} + {of(0)})"
    p = _set(p, _h=f"case when {turned} < 0 then {turned} + {f32(360.0)} when {turned} >= {f32(360.0)} then {turned} - {f32(360.0)} else {turned} end")
    p = _set(
        p,
        _s=clamp(f"sat * ({f32(1.0)} + {f32(float(base[1]))} + {of(1)})", f32(0.0), f32(1.0)),
        _l=clamp(f"light + {f32(float(base[2]))} * {f32(0.5)} + {of(2)} * {f32(0.5)}", f32(0.0), f32(1.0)),
    )
    p = _set(p, _c=f"({f32(1.0)} - abs({f32(2.0)} * _l - {f32(1.0)})) * _s", _sec=div("_h", f32(60.0)))
    p = _set(p, _k=f"_c * ({f32(1.0)} - abs((_sec - {f32(2.0)} * {f32('floor(_sec / ' + f32(2.0) + ')')}) - {f32(1.0)}))", _o=f"_l - _c * {f32(0.5)}", _i="cast(floor(_sec) as int)")
    zero = f32(0.0)
    parts = {"r": ("_c", "_k", zero, zero, "_k", "_c"), "g": ("_k", "_c", "_c", "_k", zero, zero), "b": (zero, zero, "_k", "_c", "_c", "_k")}
    pick = lambda v: "case _i " + " ".join(f"when {k} then {e}" for k, e in enumerate(v[:5])) + f" else {v[5]} end"
    p = _set(p, **{c: u8(f"(({pick(v)}) + _o) * {f32(255.0)}") for c, v in parts.items()})
    return p.drop("hue", "sat", "light", "_near", "_away", "_w", "_h", "_s", "_l", "_c", "_sec", "_k", "_o", "_i")


def selective_color(p: DataFrame, target_hue: float, width: float, cyan: float, magenta: float, yellow: float, black: float) -> DataFrame:
    p = with_hsl(p)
    p = _set(p, _w=clamp(f"{f32(1.0)} - {div(_hue_distance('hue', target_hue), f32(float(width)))}", f32(0.0), f32(1.0)))
    one = f32(1.0)
    p = _each(p, lambda c, k: u8(f"{f32(c)} * ({one} - {f32(float((cyan, magenta, yellow)[k]))} * _w) * ({one} - {f32(float(black))} * _w)"))
    return p.drop("hue", "sat", "light", "_w")


def flatten_on_white(p: DataFrame) -> DataFrame:
    """Colours over white by alpha, in integers; the result is opaque."""
    return _set(p, **{c: f"({c} * a + 255 * (255 - a) + 127) div 255" for c in CHANNELS}).withColumn("a", F.lit(255))
