"""Engines and planners by name with what they can do, and runs that end with a time limit or on request."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import SparkSession

MOST_CONFIG = 32 << 10


class Unavailable(ValueError):
    """Nothing of that name, or nothing that can do what was asked."""


@dataclass(frozen=True)
class Component:
    name: str
    kind: str
    run: Callable
    capabilities: frozenset[str] = frozenset()
    timeout_s: float | None = None


@dataclass
class Registry:
    """Components of the kinds "engine" and "planner"; the chosen one of a kind is the first until another is selected."""

    components: dict[tuple[str, str], Component] = field(default_factory=dict)
    chosen: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, kind: str, run: Callable, capabilities=(), timeout_s: float | None = None) -> None:
        if kind not in ("engine", "planner") or not name.strip() or (kind, name) in self.components:
            raise ValueError(f"cannot register {kind} {name!r}")
        self.components[kind, name] = Component(name, kind, run, frozenset(capabilities), timeout_s)
        self.chosen.setdefault(kind, name)

    def select(self, kind: str, name: str, needs=()) -> Component:
        c = self.components.get((kind, name))
        if c is None or not set(needs) <= c.capabilities:
            raise Unavailable(f"no {kind} {name!r} that can {', '.join(sorted(needs)) or 'run'}")
        self.chosen[kind] = name
        return c

    def current(self, kind: str) -> Component:
        if kind not in self.chosen:
            raise Unavailable(f"no {kind} is registered")
        return self.components[kind, self.chosen[kind]]

    def snapshot(self) -> list[tuple[str, str, bool, list[str]]]:
        """(kind, name, chosen, capabilities) in order."""
        return [(c.kind, c.name, self.chosen[c.kind] == c.name, sorted(c.capabilities)) for _, c in sorted(self.components.items())]

    def to_json(self) -> str:
        return json.dumps({"schemaVersion": 1, "chosen": self.chosen}, sort_keys=True)

    def restore(self, text: str) -> None:
        """Choices from to_json(); names that are not registered leave the choice as it is."""
        if len(text.encode()) > MOST_CONFIG:
            raise ValueError("larger than 32 KiB")
        d = json.loads(text)
        if not isinstance(d, dict) or d.get("schemaVersion") != 1 or not isinstance(d.get("chosen"), dict):
            raise ValueError("not a configuration of this version")
        for kind, name in d["chosen"].items():
            if (kind, name) in self.components:
                self.chosen[kind] = name


def standard() -> Registry:
    """The deterministic engines (long pixels and packed rasters) and the planner by rules."""
    from ..operators import packed, planner
    from .compiler import apply_plan

    r = Registry()
    r.register("deterministic", "engine", apply_plan, ("geometry", "masks", "offline", "restoration"))
    r.register("packed", "engine", lambda rasters, p: packed.apply_packed(rasters, *p.ops), ("geometry", "offline", "restoration"))
    r.register("rules", "planner", planner.plans, ("offline",))
    return r


class Cancelled(RuntimeError):
    """A run that was stopped."""


class Run:
    """An action on its own thread, whose Spark jobs are one group: ``cancel`` and the time limit stop them."""

    def __init__(self, spark: SparkSession, action: Callable, timeout_s: float | None = None):
        self.spark, self.group, self._value, self._error, self._stopped = spark, f"pixelloom-{uuid.uuid4().hex}", None, None, False
        self.timeout_s, self._done = timeout_s, threading.Event()

        def work():
            try:
                spark.sparkContext.setJobGroup(self.group, "pixelloom", True)
                self._value = action()
            except Exception as e:  # noqa: BLE001  (given to whoever waits)
                self._error = e
            finally:
                self._done.set()

        self._thread = InheritableThread(target=work, daemon=True)
        self._thread.start()

    def cancel(self) -> None:
        self._stopped = True
        self.spark.sparkContext.cancelJobGroup(self.group)

    def result(self):
        """What the action returned; Cancelled if it was stopped or took longer than the limit."""
        if not self._done.wait(self.timeout_s):
            self.cancel()
            self._done.wait(30)
            raise Cancelled("the time limit is over")
        if self._stopped:
            raise Cancelled("stopped on request")
        if self._error is not None:
            raise self._error
        return self._value
