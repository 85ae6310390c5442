"""Rules and what they share, as a graph anyone can add to.

A rule declares its inputs by name: tables, or shared results that other steps make. It sees these inputs and nothing else.
Shared results are worked out once, and steps that don't wait for each other run as Spark jobs side by side.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame

from ..params import Params
from ..session import cut
from .alerts import as_findings

AT_ONCE = 4  # steps whose jobs run side by side


def _stored(found: DataFrame, place: int) -> DataFrame:
    """Findings over the stored columns of a rule's result; over stored findings where the columns can't be stored as they are."""
    odd = any(x in found.schema.simpleString() for x in ("void", "interval", "variant")) or len({c.lower() for c in found.columns}) < len(found.columns)
    return cut(as_findings(found, place)) if odd else as_findings(cut(found), place)


@dataclass(frozen=True)
class Step:
    """make(t, p) over the inputs it needs: a DataFrame for a shared step, one or a list of them for a rule."""

    name: str
    make: Callable[[dict, Params], DataFrame | list[DataFrame]]
    needs: tuple[str, ...]
    maybe: tuple[str, ...]  # tables that may be missing
    rule: bool
    beside: tuple[str, ...] = ()  # rules whose runs keep this result although they don't read it


class Rulebook:
    """Steps by name. The order in which rules were added decides between rules that find the same, whenever their jobs end."""

    def __init__(self, steps: Iterable[Step] = ()):
        self.steps = {s.name: s for s in steps}

    def copy(self) -> Rulebook:
        return Rulebook(self.steps.values())

    @property
    def rules(self) -> list[str]:
        return [s.name for s in self.steps.values() if s.rule]

    def shared(self, name: str, needs: str, make: Callable | None = None, beside: str = ""):
        """Add a shared result; needs are names set apart by blanks, one with ? at its end may be missing. Without make, a decorator.

        beside: rules that don't read the result but with which it is made where run gives shared results back. If it fails, so do they.
        """
        return self._add(name, needs, make, rule=False, beside=beside)

    def rule(self, name: str, needs: str, make: Callable | None = None, before: str | None = None):
        """Add a rule, last or before another one."""
        return self._add(name, needs, make, rule=True, before=before)

    def _add(self, name: str, needs: str, make: Callable | None, rule: bool, before: str | None = None, beside: str = ""):
        if make is None:
            return lambda fn: self._add(name, needs, fn, rule, before, beside)
        if name in self.steps:
            raise ValueError(f"there is a step {name} already")
        if before is not None and before not in self.rules:
            raise ValueError(f"unknown rule: {before}")
        wanted = needs.split()
        new = Step(name, make, tuple(n for n in wanted if not n.endswith("?")), tuple(n[:-1] for n in wanted if n.endswith("?")), rule, tuple(beside.split()))
        items = list(self.steps.items())
        at = len(items) if before is None else next(i for i, (n, _) in enumerate(items) if n == before)
        self.steps = dict(items[:at] + [(name, new)] + items[at:])
        return make

    def order(self, only: Iterable[str] | None = None, keep: bool = False) -> list[str]:
        """The steps that the rules (all, or those named) take, each after what it needs; always the same. keep: and those made beside them."""
        graph = self._graph(only, keep)
        sorter = TopologicalSorter(graph)
        try:
            sorter.prepare()
        except CycleError as e:
            raise ValueError("steps need each other: " + " - ".join(e.args[1])) from None
        place, out = list(self.steps), []
        while sorter.is_active():
            ready = sorted(sorter.get_ready(), key=place.index)
            out += ready
            sorter.done(*ready)
        return out

    def _graph(self, only: Iterable[str] | None, keep: bool = False) -> dict[str, list[str]]:
        rules = list(self.rules if only is None else only)
        for name in rules:
            if name not in self.rules:
                raise ValueError(f"unknown rule: {name}")
        graph, todo = {}, rules + [s.name for s in self.steps.values() if keep and set(s.beside) & set(rules)]
        while todo:
            name = todo.pop()
            if name not in graph:
                graph[name] = [n for n in (*self.steps[name].needs, *self.steps[name].maybe) if n in self.steps and n != name]
                todo += graph[name]
        return graph

    def run(self, tables: dict, p: Params, only: Iterable[str] | None = None, at_once: int = AT_ONCE,
            shared: dict | None = None) -> tuple[DataFrame | None, list[dict]]:
        """(findings, an outcome per rule in the rules' order). A step that fails takes with it only the rules that need it.

        Findings carry the rule's place in rule_order. Outcomes: rule, status (success or failed), findings, error.
        A dict given as shared receives the shared results by name. What rules find is stored in its own columns; the
        evidence and texts of findings are made of these when they are read.
        """
        only = None if only is None else list(only)
        order = self.order(only, shared is not None)
        graph = self._graph(only, shared is not None)
        made: dict[str, DataFrame | None] = dict(tables)
        error: dict[str, str] = {}
        counts: dict[str, int] = {}

        def work(name: str) -> DataFrame | None:
            step = self.steps[name]
            missing = [n for n in step.needs if n not in made]
            if missing:
                raise KeyError(f"no table {', '.join(missing)}")
            t = {n: made[n] for n in (*step.needs, *step.maybe) if n in made}
            got = step.make(t, p)
            if not step.rule:
                return cut(got)
            parts = [_stored(d, self.rules.index(name)) for d in ([got] if isinstance(got, DataFrame) else got)]
            counts[name] = sum(d.count() for d in parts)
            return reduce(DataFrame.unionByName, parts) if parts else None

        sorter = TopologicalSorter(graph)
        sorter.prepare()
        waiting: dict[Future, str] = {}
        with ThreadPoolExecutor(max(1, at_once)) as pool:
            while sorter.is_active():
                for name in sorted(sorter.get_ready(), key=order.index):
                    lost = [n for n in graph[name] if n in error]
                    if lost:
                        error[name] = f"{lost[0]}: {error[lost[0]]}"
                        sorter.done(name)
                    else:
                        waiting[pool.submit(work, name)] = name
                for future in wait(waiting, return_when=FIRST_COMPLETED).done if waiting else ():
                    name = waiting.pop(future)
                    if future.exception() is not None:
                        error[name] = str(future.exception())
                    else:
                        made[name] = future.result()
                    sorter.done(name)
        if shared is not None:
            shared.update({n: made[n] for n in order if n in made and not self.steps[n].rule})
        ran = [n for n in self.rules if n in graph]
        for step in (s for s in self.steps.values() if s.name in graph and s.name in error):
            for name in set(step.beside) & set(ran) - set(error):
                error[name] = f"{step.name}: {error[step.name]}"
                counts.pop(name, None)
                made.pop(name, None)
        outcome = [{"rule": n, "status": "failed" if n in error else "success", "findings": counts.get(n, 0), "error": error.get(n)} for n in ran]
        found = [made[n] for n in ran if made.get(n) is not None]
        return (reduce(DataFrame.unionByName, found) if found else None), outcome
