"""Plans that come from elsewhere as JSON: what is wrong with each, which fields are unknown, and the plan if nothing is."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

from pyspark.sql import DataFrame

from ..operators.planner import MOST_OPERATIONS, MOST_WARNINGS, STAGES
from .ops import InvalidOperation, from_json

MOST_BYTES, MOST_TEXT = 2 << 20, 240
ROOT = ("summary", "confidence", "warnings", "operations")
#: Fields of each operation that a plan may hold, beside its type, and the stages of the two that no rule emits; fixed values.
FIELDS = {
    "brightness": ("amount",), "contrast": ("amount",), "saturation": ("amount",), "grayscale": (), "auto_white_balance": ("strength",), "deblock": ("strength",),
    "local_contrast": ("strength", "tile_size", "clip_limit"), "denoise": ("strength", "preserve_edges"), "edge_aware_sharpen": ("strength", "radius", "threshold"),
    "mild_deblur": ("strength", "radius"), "uneven_lighting_correction": ("strength", "radius"), "document_enhance": ("strength", "grayscale"),
}
LAST_STAGES = {"saturation": 70, "grayscale": 75}


def unknown_fields(value) -> list[str]:
    if not isinstance(value, dict):
        return []
    found = [k for k in value if k not in ROOT]
    steps = value.get("operations")
    for k, o in enumerate(steps if isinstance(steps, list) else []):
        if isinstance(o, dict) and isinstance(o.get("type"), str):
            found += [f"operations[{k}].{name}" for name in o if name != "type" and name not in FIELDS.get(o["type"], ())]
    return found


def _text(v) -> bool:
    return isinstance(v, str) and bool(v.strip()) and len(v) <= MOST_TEXT


def check(text: str, most: int = MOST_OPERATIONS) -> tuple[list[str], list[str], str | None]:
    """Errors, unknown fields, and the plan's operations as JSON (null with errors) of a plan's text."""
    if not 1 <= most <= MOST_OPERATIONS:
        return [f"the most operations must lie in 1..{MOST_OPERATIONS}"], [], None
    if len(text.encode()) > MOST_BYTES:
        return ["larger than 2 MiB"], [], None
    try:
        value = json.loads(text)
    except ValueError:
        return ["not JSON"], [], None
    rejected = unknown_fields(value)
    errors = ["unknown fields are not allowed"] if rejected else []
    if not isinstance(value, dict) or set(ROOT) - set(value):
        return [*errors, "a plan has a summary, a confidence, warnings and operations"], rejected, None
    if not isinstance(value["operations"], list) or not isinstance(value["warnings"], list):
        return [*errors, "warnings and operations are lists"], rejected, None
    steps, confidence = value["operations"], value["confidence"]
    if not 1 <= len(steps) <= most:
        errors.append(f"a plan has 1 to {most} operations")
    if not _text(value["summary"]):
        errors.append(f"the summary has 1 to {MOST_TEXT} characters")
    if len(value["warnings"]) > MOST_WARNINGS or not all(map(_text, value["warnings"])):
        errors.append(f"there are at most {MOST_WARNINGS} warnings of 1 to {MOST_TEXT} characters")
    if isinstance(confidence, bool) or not isinstance(confidence, (int, float)) or not (math.isfinite(confidence) and 0 <= confidence <= 1):
        errors.append("the confidence lies in 0..1")
    made = []
    for k, o in enumerate(steps):
        kind = o.get("type") if isinstance(o, dict) else None
        if kind not in FIELDS:
            errors.append(f"operations[{k}] is not one that a plan may hold")
            continue
        try:
            made.append(from_json(json.dumps(o)))
        except (InvalidOperation, ValueError, TypeError, KeyError) as e:
            errors.append(f"operations[{k}]: {e}"[:MOST_TEXT])
    kinds = [o.type for o in made]
    if len(set(kinds)) < len(kinds):
        errors.append("an operation occurs twice")
    stages = [(STAGES | LAST_STAGES)[k] for k in kinds]
    if stages != sorted(stages):
        errors.append("operations are out of order")
    if any(o.type == "saturation" and o.amount for o in made) and any(o.type == "grayscale" or o.params.get("grayscale") for o in made):
        errors.append("saturation conflicts with a grey result")
    return errors, rejected, None if errors else "[" + ", ".join(o.to_json() for o in made) + "]"


def check_texts(plans: DataFrame, column: str = "value", most: int = MOST_OPERATIONS) -> DataFrame:
    """plans with ``valid``, ``errors``, ``rejected`` and ``operations``; a null text is not JSON."""
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in plans.schema.fields]

    def run(batches: Iterator):
        for b in batches:
            found = [check(v if isinstance(v, str) else "", most) for v in b[column]]
            yield b.assign(valid=[not e for e, _, _ in found], errors=[e for e, _, _ in found], rejected=[r for _, r, _ in found], operations=[o for *_, o in found])

    return plans.mapInPandas(run, ", ".join([*kept, "valid boolean", "errors array<string>", "rejected array<string>", "operations string"]))
