"""Colour arithmetic as SQL expressions over 8-bit channels.

The engine's numeric contract is single precision with explicit casts, and rounding half up into 0..255; every
function here returns SQL text so that one projection stays one compiled expression.
"""

from __future__ import annotations

import numpy as np

#: Luminance weights of red, green and blue (BT.709); fixed values.
LUMA = (0.2126, 0.7152, 0.0722)
#: Rows of the sepia matrix; fixed values.
SEPIA = ((0.393, 0.769, 0.189), (0.349, 0.686, 0.168), (0.272, 0.534, 0.131))
#: Least single-precision step at 1.
EPSILON = 1.1920928955078125e-07
CHANNELS = ("r", "g", "b")


def f32(value) -> str:
    """A literal or an expression in single precision."""
    return f"cast({value!r}D as float)" if isinstance(value, (int, float)) else f"cast({value} as float)"


def div(a: str, b: str) -> str:
    """A quotient in single precision; SQL divides in double, and rounding that gives the same."""
    return f"cast(({a}) / ({b}) as float)"


def u8(expression: str) -> str:
    """Rounded to the nearest integer, halves up, and clamped to a byte."""
    return f"cast(greatest(0D, least(255D, floor(cast({expression} as double) + 0.5D))) as int)"


def luma(r: str = "r", g: str = "g", b: str = "b") -> str:
    terms = [f"{f32(w)} * {f32(c)}" for w, c in zip(LUMA, (r, g, b), strict=True)]
    return f"({' + '.join(terms)})"


def clamp(expression: str, low, high) -> str:
    return f"greatest({low}, least({high}, {expression}))"


def wrap(expression: str, turn: float) -> str:
    """Remainder in [0, turn) of a value in (-turn, 2 turn)."""
    t = f32(float(turn))
    return f"(case when {expression} < 0 then {expression} + {t} when {expression} >= {t} then {expression} - {t} else {expression} end)"


def hue_of(high: str, delta: str, r: str, g: str, b: str, unit: str) -> str:
    """Hue by the channel that is the largest, red before green before blue; ``unit`` is the length of a sixth."""
    ratio = div(f"{g} - {b}", delta)
    return (
        f"case when {delta} <= {f32(EPSILON)} then {f32(0.0)} when {high} = {r} then {unit} * {wrap(ratio, 6.0)} "
        f"when {high} = {g} then {unit} * ({div(f'{b} - {r}', delta)} + {f32(2.0)}) else {unit} * ({div(f'{r} - {g}', delta)} + {f32(4.0)}) end"
    )


def byte_table(function) -> list[int]:
    """function, applied to all byte values in single precision, as rounded and clamped bytes."""
    x = np.arange(256, dtype=np.float32)
    out = np.asarray(function(x), np.float32).astype(np.float64)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(int).tolist()


def lookup(table: list[int], channel: str) -> str:
    """Entry of a table of bytes for a channel."""
    return f"element_at(array({', '.join(map(str, table))}), {channel} + 1)"
