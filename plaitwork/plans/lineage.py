"""Tracing over whole computations: from rows of a result back to named inputs, over all paths.

Nodes between the result and the names are visited in topological order; a node's tracked rows are those its consumers
trace back to it, merged by value.  With `iterate`, the traced rows are replayed through the same operations; as long as
that doesn't bring back every tracked row, rows that the replay got wrong at aggregates and cogroups are looked
up by key in the original output and traced too.  Rounds are bounded, and each is checkpointed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from plaitwork.operators.bags import anti, cut, merge, semi
from plaitwork.operators.traced import Node, TraceError, Traced


@dataclass
class TraceConfig:
    """cache_level: a StorageLevel for traced rows of each step, or None; cache_computation: one for the whole outputs of the
    nodes that are traced through, so that several traces don't compute them again; cut_rounds: checkpoint each round of an iteration."""

    cache_level: object | None = None
    cache_computation: object | None = None
    cut_rounds: bool = True
    max_rounds: int = 10
    one_by_one: bool = True  # trace what a replay lacks node by node, rather than merged


class NotReproduced(TraceError):
    pass


def topological(start: Node) -> list[Node]:
    """Nodes from the start back to the sources, consumers before producers."""
    seen: set[int] = set()
    out: list[Node] = []
    stack: list[tuple[Node, bool]] = [(start, False)]
    while stack:
        node, left = stack.pop()
        if left:
            out.append(node)
        elif node.number not in seen:
            seen.add(node.number)
            stack.append((node, True))
            stack += [(p, False) for p in node.parents]
    return out[::-1]


def between(start: Node, names: list[str]) -> list[Node]:
    """Nodes on paths from the start to named nodes, consumers first."""
    order = topological(start)
    missing = set(names) - {n.name for n in order}
    if missing:
        raise TraceError(f"no node is named {', '.join(sorted(missing))}")
    wanted: set[int] = set()
    for node in reversed(order):
        if node.name in names or any(p.number in wanted for p in node.parents):
            wanted.add(node.number)
    return [n for n in order if n.number in wanted]


def trace(start: Node, tracked: DataFrame, names: list[str], least: bool, config: TraceConfig) -> dict[str, DataFrame]:
    """Traced rows of each named node."""
    order = between(start, names)
    chosen = {n.number for n in order}
    rows: dict[int, DataFrame] = {start.number: tracked}
    out: dict[str, DataFrame] = {}
    for node in order:
        mine = rows.get(node.number)
        if mine is None:
            continue
        if config.cache_level is not None:
            mine = mine.persist(config.cache_level)
        if node.name in names:
            out[node.name] = mine
        for dep, parent in enumerate(node.parents):
            if parent.number in chosen and node.back is not None:
                found = node.back(mine, dep, least)
                rows[parent.number] = merge(rows[parent.number], found) if parent.number in rows else found
    return out


def replay(start: Node, targets: dict[str, DataFrame]) -> dict[int, DataFrame]:
    """Outputs of all nodes when the named nodes give only the traced rows; other inputs give all they have."""
    out: dict[int, DataFrame] = {}
    for node in reversed(topological(start)):
        if node.name in targets:
            out[node.number] = targets[node.name]
        elif not node.parents:
            out[node.number] = node.full
        else:
            out[node.number] = node.build(*[out[p.number] for p in node.parents])
    return out


def go_back(frame: Traced, names: list[str], condition, least: bool, iterate: bool, config: TraceConfig | None = None) -> dict[str, Traced]:
    config = config or TraceConfig()
    start = frame.node
    tracked = frame.df if condition is None else frame.df.where(condition)
    if config.cache_computation is not None:
        for node in between(start, names):
            if not node.full.is_cached:
                node.full = node.full.persist(config.cache_computation)
    found = trace(start, tracked, names, least, config)
    if iterate:
        found = until_reproduced(start, tracked, found, config)
    nodes = {n.name: n for n in topological(start)}
    return {name: Traced(df, nodes[name]) for name, df in found.items()}


def until_reproduced(start: Node, tracked: DataFrame, found: dict[str, DataFrame], config: TraceConfig) -> dict[str, DataFrame]:
    tracked = cut(tracked) if config.cut_rounds else tracked
    for _ in range(config.max_rounds):
        if config.cut_rounds:
            found = {name: cut(df) for name, df in found.items()}
        again = replay(start, found)
        if tracked.exceptAll(again[start.number].select(*tracked.columns)).isEmpty():
            return found
        extra: dict[str, DataFrame] = {}
        for node in between(start, list(found)):
            if node.keys is None or node.name in found:
                continue
            fresh = anti(again[node.number], node.full)  # what the replay made that never was
            missed = semi(node.full, fresh, node.keys)
            for name, df in trace(node, missed, [n for n in found if n in {m.name for m in topological(node)}], False, config).items():
                extra[name] = merge(extra[name], df) if name in extra else df
        if not extra:
            break
        found = {name: merge(df, extra[name]) if name in extra else df for name, df in found.items()}
    raise NotReproduced(f"the traced rows don't reproduce the result after {config.max_rounds} rounds")
