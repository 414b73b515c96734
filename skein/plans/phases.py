"""A pipeline of named phases: each turns the outputs of those it needs into one of its own."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Phase:
    name: str
    run: Callable[[dict[str, Any]], Any]
    needs: tuple[str, ...] = ()


@dataclass
class Report:
    outputs: dict[str, Any] = field(default_factory=dict)
    seconds: dict[str, float] = field(default_factory=dict)


def ordered(phases: list[Phase]) -> list[Phase]:
    """Phases in an order that meets their needs, earlier ones first; a missing need or a cycle raises."""
    by = {p.name: p for p in phases}
    if len(by) != len(phases):
        raise ValueError("two phases have one name")
    for p in phases:
        for n in p.needs:
            if n not in by:
                raise ValueError(f"{p.name} needs {n}, which is no phase")
    done: list[Phase] = []
    names: set[str] = set()
    while len(done) < len(phases):
        ready = [p for p in phases if p.name not in names and set(p.needs) <= names]
        if not ready:
            raise ValueError("cycle: " + " -> ".join(cycle(phases)))
        done.append(ready[0])
        names.add(ready[0].name)
    return done


def cycle(phases: list[Phase]) -> list[str]:
    """The names along one cycle."""
    by = {p.name: p for p in phases}
    for start in by:
        path: list[str] = []
        stack = [(start, iter(by[start].needs))]
        path.append(start)
        while stack:
            for n in stack[-1][1]:
                if n == start:
                    return [*path, start]
                if n not in path:
                    stack.append((n, iter(by[n].needs)))
                    path.append(n)
                    break
            else:
                stack.pop()
                path.pop()
    return []


def run(phases: list[Phase], keep: set[str] | None = None) -> Report:
    """Run in order. Outputs that no later phase needs are dropped unless named in ``keep`` (default: all stay)."""
    order = ordered(phases)
    report = Report()
    for i, p in enumerate(order):
        began = time.monotonic()
        report.outputs[p.name] = p.run({n: report.outputs[n] for n in p.needs})
        report.seconds[p.name] = time.monotonic() - began
        if keep is not None:
            later = {n for q in order[i + 1 :] for n in q.needs}
            for name in [n for n in report.outputs if n not in later and n not in keep]:
                del report.outputs[name]
    return report
