"""The logical plan: an ordered list of typed operations, validated on the driver, with a JSON form."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

MOST_OPERATIONS = 200


class InvalidOperation(ValueError):
    """A parameter out of its range, or an operation where it cannot stand."""


def _within(name: str, value, low, high, open_low: bool = False) -> None:
    if not isinstance(value, (int, float)) or isinstance(value, bool) or not math.isfinite(value) or value > high or value < low or (open_low and value == low):
        raise InvalidOperation(f"{name} must lie in {low}..{high}")


#: Range of each numeric parameter by operation: name -> {parameter: (low, high)}; fixed values.
RANGES = {
    "brightness": {"amount": (-1, 1)},
    "contrast": {"amount": (-1, 1)},
    "saturation": {"amount": (-1, 1)},
    "gamma": {"value": (0.2, 3)},
    "gaussian_blur": {"radius": (0, 20)},
    "sharpen": {"strength": (0, 2)},
    "auto_white_balance": {"strength": (0, 1)},
    "local_contrast": {"strength": (0, 1), "tile_size": (8, 128), "clip_limit": (0.5, 4)},
    "denoise": {"strength": (0, 1), "preserve_edges": (0, 1)},
    "deblock": {"strength": (0, 1)},
    "edge_aware_sharpen": {"strength": (0, 2), "radius": (0.5, 4), "threshold": (0, 0.25)},
    "mild_deblur": {"strength": (0, 1), "radius": (0.5, 4)},
    "document_enhance": {"strength": (0, 1)},
    "uneven_lighting_correction": {"strength": (0, 1), "radius": (4, 96)},
    "levels": {"input_black": (0, 255), "input_white": (0, 255), "gamma": (0.1, 10), "output_black": (0, 255), "output_white": (0, 255)},
    "white_point": {"red": (1, 255), "green": (1, 255), "blue": (1, 255)},
    "black_point": {"red": (0, 254), "green": (0, 254), "blue": (0, 254)},
    "crop": {"x": (0, 1), "y": (0, 1), "width": (0, 1), "height": (0, 1)},
    "straighten": {"degrees": (-45, 45)},
    "lens_correction": {"distortion": (-0.16, 1), "vignetting": (-1, 1), "chromatic_aberration": (-0.1, 0.1)},
    "temperature_tint": {"temperature": (-1, 1), "tint": (-1, 1)},
    "selective_color": {"target_hue": (0, 360), "width": (1, 180), "cyan": (-1, 1), "magenta": (-1, 1), "yellow": (-1, 1), "black": (-1, 1)},
    "decontaminate_colors": {"strength": (0, 1), "radius": (1, 64)},
}
#: Operations without numeric parameters of their own.
PLAIN = ("grayscale", "sepia", "reflect_horizontal", "rotate", "curves", "hsl", "perspective", "masked")
#: What hsl settings apply to; fixed values.
HSL_BANDS = ("master", "red", "yellow", "green", "cyan", "blue", "magenta")
GEOMETRY = ("reflect_horizontal", "rotate", "crop", "straighten", "perspective", "lens_correction")
#: A parameter at this value makes the operation do nothing.
IDENTITY = {
    "brightness": ("amount", 0), "contrast": ("amount", 0), "saturation": ("amount", 0), "gamma": ("value", 1), "gaussian_blur": ("radius", 0), "sharpen": ("strength", 0),
    "auto_white_balance": ("strength", 0), "local_contrast": ("strength", 0), "denoise": ("strength", 0), "deblock": ("strength", 0), "edge_aware_sharpen": ("strength", 0),
    "mild_deblur": ("strength", 0), "document_enhance": ("strength", 0), "uneven_lighting_correction": ("strength", 0), "straighten": ("degrees", 0), "decontaminate_colors": ("strength", 0),
}


@dataclass(frozen=True)
class Op:
    """One operation: its type in snake case and its parameters."""

    type: str
    params: dict = field(default_factory=dict)

    def __getattr__(self, name):
        try:
            return self.__dict__["params"][name]
        except KeyError:
            raise AttributeError(name) from None

    def __hash__(self):
        return hash(self.to_json())

    def to_json(self) -> str:
        plain = {k: json.loads(v.to_json()) if isinstance(v, Op) else v for k, v in self.params.items()}
        return json.dumps({"type": self.type} | plain, sort_keys=True)

    @property
    def is_identity(self) -> bool:
        if self.type == "masked":
            return self.params["operation"].is_identity
        if self.type == "rotate":
            return self.params["degrees"] % 360 == 0
        if self.type == "decontaminate_colors" and not self.params.get("enabled", True):
            return True
        if self.type in IDENTITY:
            name, value = IDENTITY[self.type]
            return self.params[name] == value
        return self.type == "crop" and [self.params[k] for k in ("x", "y", "width", "height")] == [0, 0, 1, 1]


def op(type_: str, /, **params) -> Op:
    made = Op(type_, params)
    validate(made)
    return made


def validate(o: Op, inside_mask: bool = False) -> None:
    """Raises InvalidOperation for parameters out of range, unknown ones, and what a mask cannot hold."""
    if o.type in RANGES:
        known = RANGES[o.type]
        for name, (low, high) in known.items():
            if name not in o.params:
                raise InvalidOperation(f"{o.type} needs {name}")
            _within(f"{o.type}.{name}", o.params[name], low, high)
        extra = set(o.params) - set(known) - {"grayscale", "enabled"}
        if extra:
            raise InvalidOperation(f"{o.type} has no {sorted(extra)[0]}")
    elif o.type not in PLAIN:
        raise InvalidOperation(f"unknown operation {o.type}")
    if o.type == "levels" and not (o.input_black < o.input_white and o.output_black < o.output_white):
        raise InvalidOperation("levels: black must lie below white")
    if o.type == "crop" and (o.width <= 0 or o.height <= 0 or o.x + o.width > 1.000001 or o.y + o.height > 1.000001):
        raise InvalidOperation("crop must lie within the image")
    if o.type == "rotate" and (not isinstance(o.params.get("degrees"), int) or o.degrees % 90):
        raise InvalidOperation("rotation must be a multiple of 90 degrees")
    if o.type == "curves":
        for name in ("rgb", "red", "green", "blue"):
            curve(o.params.get(name, ((0, 0), (1, 1))))
    if o.type == "hsl":
        for name, setting in o.params.items():
            if name not in HSL_BANDS or not isinstance(setting, (list, tuple)) or len(setting) != 3:
                raise InvalidOperation(f"hsl takes three values for each of {', '.join(HSL_BANDS)}")
            for part, value, (low, high) in zip(("hue", "saturation", "lightness"), setting, ((-180, 180), (-1, 1), (-1, 1)), strict=True):
                _within(f"hsl.{name}.{part}", value, low, high)
    if o.type == "perspective":
        corners = o.params.get("corners", ())
        if len(corners) != 4 or any(len(c) != 2 for c in corners):
            raise InvalidOperation("perspective needs four corners")
        for corner in corners:
            for v in corner:
                _within("perspective corner", v, 0, 1)
        (ax, ay), (bx, by), (cx, cy), (dx, dy) = corners
        if ax >= bx or dx >= cx or ay >= dy or by >= cy:
            raise InvalidOperation("perspective corners must go around the picture from the top left")
    if o.type == "masked":
        inner = o.params.get("operation")
        if inside_mask or not isinstance(inner, Op) or inner.type == "masked" or inner.type in GEOMETRY:
            raise InvalidOperation("a mask holds one operation that keeps the geometry")
        validate(inner, True)



def curve(points) -> None:
    if not 2 <= len(points) <= 32:
        raise InvalidOperation("a curve has 2 to 32 points")
    for x, y in points:
        _within("curve input", x, 0, 1)
        _within("curve output", y, 0, 1)
    if any(b[0] <= a[0] for a, b in zip(points, points[1:], strict=False)):
        raise InvalidOperation("curve inputs must rise")
    if points[0][0] != 0 or points[-1][0] != 1:
        raise InvalidOperation("a curve goes from input 0 to input 1")


def from_json(text: str) -> Op:
    raw = json.loads(text)
    if not isinstance(raw, dict) or not isinstance(raw.get("type"), str):
        raise InvalidOperation("an operation is an object with a type")
    params = {k: v for k, v in raw.items() if k != "type"}
    if isinstance(params.get("operation"), dict):
        params["operation"] = from_json(json.dumps(params["operation"]))
    made = Op(raw["type"], params)
    validate(made)
    return made


@dataclass(frozen=True)
class Plan:
    """Operations in the order in which they are applied."""

    ops: tuple[Op, ...]

    def __post_init__(self):
        if len(self.ops) > MOST_OPERATIONS:
            raise InvalidOperation(f"a plan has at most {MOST_OPERATIONS} operations")
        for o in self.ops:
            validate(o)
            if o.type == "decontaminate_colors":
                raise InvalidOperation("decontaminate_colors needs a mask")

    def to_json(self) -> str:
        return "[" + ", ".join(o.to_json() for o in self.ops) + "]"


def plan(*ops: Op) -> Plan:
    return Plan(tuple(ops))


def plan_from_json(text: str) -> Plan:
    return Plan(tuple(from_json(json.dumps(x)) for x in json.loads(text)))


def replaced(p: Plan, o: Op) -> Plan:
    """o instead of the plan's operation of its type, at its place, or at the end."""
    at = next((k for k, x in enumerate(p.ops) if x.type == o.type), None)
    return Plan((*p.ops, o)) if at is None else Plan((*p.ops[:at], o, *p.ops[at + 1 :]))


def moved(p: Plan, at: int, to: int) -> Plan:
    rest = [*p.ops[:at], *p.ops[at + 1 :]]
    rest.insert(to, p.ops[at])
    return Plan(tuple(rest))


def duplicated(p: Plan, at: int) -> Plan:
    return Plan((*p.ops[: at + 1], p.ops[at], *p.ops[at + 1 :]))


def removed(p: Plan, at: int) -> Plan:
    return Plan((*p.ops[:at], *p.ops[at + 1 :]))


class History:
    """Bounded undo and redo over immutable plans."""

    def __init__(self, first: Plan, most: int = 200):
        self.now, self.past, self.future, self.most = first, [], [], most

    def commit(self, p: Plan) -> None:
        if p != self.now:
            self.past, self.future, self.now = [*self.past, self.now][-self.most :], [], p

    def undo(self) -> Plan:
        if self.past:
            self.future.append(self.now)
            self.now = self.past.pop()
        return self.now

    def redo(self) -> Plan:
        if self.future:
            self.past.append(self.now)
            self.now = self.future.pop()
        return self.now
