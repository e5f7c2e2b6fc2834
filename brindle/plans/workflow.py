"""Plans of several steps on the driver: order, jumps, retries, rollback; and a registry of plans."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


class WorkflowError(RuntimeError):
    """A step failed for good; `results` holds what came before it."""

    def __init__(self, step: str, results: dict[str, Any]):
        super().__init__(f"step {step} failed")
        self.step, self.results = step, results


@dataclass(frozen=True)
class Step:
    """`run` takes the results so far.  `next` names the step to jump to, or chooses it from the result."""

    name: str
    run: Callable[[dict[str, Any]], Any]
    rollback: Callable[[dict[str, Any]], None] | None = None
    retries: int = 0
    next: str | Callable[[Any], str | None] | None = None


@dataclass
class Workflow:
    """Runs steps in order; a failing one is tried again after base * 2^n seconds, then all done are rolled back, the last first."""

    name: str
    steps: list[Step]
    kind: str = "general"
    base_seconds: float = 1.0
    paused: bool = False
    log: list[tuple[str, str]] = field(default_factory=list)

    def check(self) -> None:
        names = [s.name for s in self.steps]
        if not names or len(set(names)) != len(names):
            raise ValueError("steps need names of their own")
        for s in self.steps:
            if isinstance(s.next, str) and s.next not in names:
                raise ValueError(f"{s.name} leads to {s.next}, which does not exist")

    def run(self, start: dict[str, Any] | None = None, begin: str | None = None) -> dict[str, Any]:
        self.check()
        places = {s.name: i for i, s in enumerate(self.steps)}
        results, at, done = dict(start or {}), places[begin] if begin else 0, []
        while at < len(self.steps):
            if self.paused:
                results["resume_at"] = self.steps[at].name
                return results
            step = self.steps[at]
            for attempt in range(step.retries + 1):
                try:
                    results[step.name] = step.run(results)
                    self.log.append((step.name, "done"))
                    break
                except Exception as e:
                    self.log.append((step.name, f"failed: {e}"))
                    if attempt == step.retries:
                        for back in reversed(done):
                            if back.rollback:
                                back.rollback(results)
                                self.log.append((back.name, "rolled back"))
                        raise WorkflowError(step.name, results) from e
                    time.sleep(self.base_seconds * 2**attempt)
            done.append(step)
            to = step.next(results[step.name]) if callable(step.next) else step.next
            at = places[to] if to else at + 1
        return results


class Registry:
    """Workflows by name and kind."""

    def __init__(self) -> None:
        self._made: dict[str, tuple[str, Callable[..., Workflow]]] = {}

    def register(self, name: str, kind: str, make: Callable[..., Workflow]) -> None:
        self._made[name] = (kind, make)

    def unregister(self, name: str) -> bool:
        return self._made.pop(name, None) is not None

    def exists(self, name: str) -> bool:
        return name in self._made

    def names(self, kind: str | None = None) -> list[str]:
        return sorted(n for n, (k, _) in self._made.items() if kind in (None, k))

    def make(self, name: str, **options: Any) -> Workflow:
        if name not in self._made:
            raise KeyError(name)
        return self._made[name][1](**options)
