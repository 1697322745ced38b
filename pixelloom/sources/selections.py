"""Selections of documents as JSON sessions: two versions read as one, named masks and their edits, and what is saved."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame

from ..functions.codec import checksum, decode_text

MOST_CHARACTERS, MOST_MASKS, MOST_PIXELS = 3_500_000, 100, 100_000_000
#: Tools, modes and scopes that a session may name; fixed values.
TOOLS = ("rectangle", "ellipse", "freehand", "polygon", "brush", "wand", "color_range", "none")
MODES, SCOPES = ("replace", "add", "subtract", "intersect"), ("global", "inside", "outside")


def valid_time(v) -> bool:
    if not isinstance(v, str) or not 1 <= len(v) <= 64:
        return False
    try:
        datetime.fromisoformat(v)
    except ValueError:
        return False
    return True


def valid_snapshot(s, width: int, height: int) -> bool:
    """Whether a snapshot is of that size and its data and checksum are sound."""
    try:
        if s["version"] != 1 or (s["width"], s["height"]) != (width, height):
            return False
        return checksum(decode_text(s["encoding"], s["data"], width * height)) == s["checksum"]
    except (KeyError, TypeError, ValueError):
        return False


def _named(v, width: int, height: int) -> bool:
    return (
        isinstance(v, dict) and isinstance(v.get("id"), str) and 1 <= len(v["id"]) <= 200 and isinstance(v.get("name"), str) and len(v["name"]) <= 120
        and all(isinstance(v.get(k), bool) for k in ("visible", "locked")) and all(valid_time(v.get(k)) for k in ("createdAt", "modifiedAt"))
        and valid_snapshot(v.get("mask"), width, height) and ("sourceTool" not in v or v["sourceTool"] in TOOLS)
    )


def fresh(key: str, width: int, height: int) -> dict:
    return {
        "schemaVersion": 2, "documentKey": key, "canvasWidth": width, "canvasHeight": height, "activeMask": None, "namedMasks": [], "tool": "rectangle", "mode": "replace",
        "applyScope": "global", "panelCollapsed": False, "updatedAt": "1970-01-01T00:00:00+00:00",
    }


def parsed(text: str, key: str, width: int, height: int) -> tuple[dict, str]:
    """A session's state, and how it was come by: read (version 2), migrated (1), or fresh where the text does not do.

    Version 2 must be right in all parts; of version 1 the right parts are taken, and of its masks the first hundred.
    """
    new = fresh(key, width, height)
    try:
        if not 1 <= len(text) <= MOST_CHARACTERS or width < 1 or height < 1 or width * height > MOST_PIXELS:
            return new, "fresh"
        d = json.loads(text)
        if not isinstance(d, dict) or d.get("documentKey") != key:
            return new, "fresh"
    except (TypeError, ValueError):
        return new, "fresh"
    choices = {"tool": lambda v: v in TOOLS, "mode": lambda v: v in MODES, "applyScope": lambda v: v in SCOPES, "panelCollapsed": lambda v: isinstance(v, bool), "updatedAt": valid_time}
    masks = d.get("namedMasks")
    if d.get("schemaVersion") == 2:
        active = d.get("activeMask")
        right = (
            (d.get("canvasWidth"), d.get("canvasHeight")) == (width, height) and isinstance(masks, list) and len(masks) <= MOST_MASKS
            and all(_named(m, width, height) for m in masks) and len({m["id"] for m in masks}) == len(masks)
            and (active is None or valid_snapshot(active, width, height)) and all(k in d and ok(d[k]) for k, ok in choices.items())
        )
        return ({k: d.get(k, v) for k, v in new.items()}, "read") if right else (new, "fresh")
    if d.get("schemaVersion") == 1:
        new |= {k: d[k] for k, ok in choices.items() if k in d and ok(d[k])}
        if valid_snapshot(d.get("activeMask"), width, height):
            new["activeMask"] = d["activeMask"]
        seen: set[str] = set()
        for m in (masks if isinstance(masks, list) else [])[:MOST_MASKS]:
            if _named(m, width, height) and m["id"] not in seen:
                seen.add(m["id"])
                new["namedMasks"].append(m)
        return new, "migrated"
    return new, "fresh"


def saved(state: dict) -> str | None:
    """A state's JSON, or null if it would not be read again."""
    text = json.dumps(state)
    how = parsed(text, state["documentKey"], state["canvasWidth"], state["canvasHeight"])[1]
    return text if how == "read" else None


def read_sessions(sessions: DataFrame) -> DataFrame:
    """(key, how, n_masks, session) of sessions (key, width, height, value): the state in version 2, as JSON."""

    def run(batches: Iterator):
        import pandas as pd

        for b in batches:
            rows = []
            for k, w, h, v in zip(b["key"], b["width"], b["height"], b["value"], strict=True):
                state, how = parsed(v, k, int(w), int(h))
                rows.append((k, how, len(state["namedMasks"]), json.dumps(state)))
            yield pd.DataFrame(rows, columns=["key", "how", "n_masks", "session"])

    return sessions.select("key", "width", "height", "value").mapInPandas(run, "key string, how string, n_masks int, session string")


def _name(v: str, number: int) -> str:
    return v.strip()[:120] or f"Mask {number}"


def edited(masks: list[dict], action: str, mask_id: str = "", value=None, now: str = "1970-01-01T00:00:00+00:00", tool: str = "none") -> list[dict]:
    """Named masks after create (value: (name, snapshot)), rename, duplicate (value: the new id), delete, toggle (value: visible or
    locked), move (value: -1 or 1) or replace (value: a snapshot; not of a locked one). What does not apply changes nothing."""
    at = next((k for k, m in enumerate(masks) if m["id"] == mask_id), None)
    if action == "create":
        if value is None or value[1] is None or at is not None or len(masks) >= MOST_MASKS:
            return masks
        new = {"id": mask_id, "name": _name(value[0], len(masks) + 1), "mask": value[1], "visible": True, "locked": False, "createdAt": now, "modifiedAt": now, "sourceTool": tool}
        return [*masks, new]
    if at is None:
        return masks
    own = masks[at]
    if action == "delete":
        return masks[:at] + masks[at + 1 :]
    if action == "duplicate":
        copy = own | {"id": value, "name": f"{own['name']} Copy"[:120], "createdAt": now, "modifiedAt": now, "locked": False}
        return masks if len(masks) >= MOST_MASKS else [*masks[: at + 1], copy, *masks[at + 1 :]]
    if action == "move":
        to = at + value
        if not 0 <= to < len(masks):
            return masks
        out = list(masks)
        out[at], out[to] = out[to], out[at]
        return out
    new = {"rename": lambda: own | {"name": _name(value, 1), "modifiedAt": now}, "toggle": lambda: own | {value: not own[value]}}
    if action == "replace":
        new["replace"] = lambda: own if own["locked"] or value is None else own | {"mask": value, "modifiedAt": now, "sourceTool": tool}
    if action not in new:
        raise ValueError(f"no edit {action}")
    return [*masks[:at], new[action](), *masks[at + 1 :]]
