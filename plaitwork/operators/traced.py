"""Traced relations: DataFrames that remember how they were made, so that rows can be traced back to inputs.

A Traced is a subset (a DataFrame) of the output of a node of the computation.  Nodes hold a rule for each direction:
a builder that makes the output from the parents' outputs, and back rules that map tracked output rows to parent rows,
either all that contributed (`provenance`) or just enough to make the rows again (`explain`).  Rows are matched by value,
with nulls equal; everything is DataFrame algebra, so Catalyst plans forward and backward passes alike.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plaitwork.operators import annotations as A
from plaitwork.operators.bags import anti, counted, occurrence, overlap, replicate, semi

Back = Callable[[DataFrame, int, bool], DataFrame]
_NUMBER = itertools.count()


class TraceError(ValueError):
    pass


@dataclass(eq=False)
class Node:
    """One operation of a computation."""

    op: str
    full: DataFrame  # the whole output
    parents: list[Node] = field(default_factory=list)
    build: Callable[..., DataFrame] | None = None
    back: Back | None = None
    keys: list[str] | None = None  # of operations whose output for a key changes when rows of the key are left out
    name: str | None = None
    number: int = field(default_factory=lambda: next(_NUMBER))


#: Shares of the rows that make one output.
SALTS = 32


def _salt(columns: Sequence[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS))


def _need(tracked: DataFrame) -> DataFrame:
    return counted(tracked, "__need")


def _renamed(df: DataFrame, mark: str = "__t_") -> DataFrame:
    return df.select(*[F.col(c).alias(mark + c) for c in df.columns])


def _on(df: DataFrame, other: DataFrame, columns: Sequence[str], mark: str = "__t_") -> Column:
    return reduce(lambda a, b: a & b, [df[c].eqNullSafe(other[mark + c]) for c in columns])


class Traced:
    """A subset of a node's output."""

    def __init__(self, df: DataFrame, node: Node):
        self.df, self.node = df, node

    # construction -----------------------------------------------------------------------------------------------

    @classmethod
    def source(cls, df: DataFrame, name: str | None = None) -> Traced:
        return cls(df, Node("source", df, name=name))

    def _made(self, op: str, others: Sequence[Traced], build: Callable[..., DataFrame], back: Back, keys: list[str] | None = None) -> Traced:
        df = build(self.df, *[o.df for o in others])
        return Traced(df, Node(op, df, [self.node, *[o.node for o in others]], build, back, keys))

    def named(self, name: str) -> Traced:
        """Name the tracked node; operations that only move rows share the name."""
        self.node.name = name
        return self

    @property
    def name(self) -> str | None:
        return self.node.name

    def where_subset(self, condition: Column | str) -> Traced:
        """The rows to be traced: a subset of the same node."""
        return Traced(self.df.where(condition), self.node)

    # rows ---------------------------------------------------------------------------------------------------------

    def map(self, inverse: list[Column] | None = None, /, **columns: Column) -> Traced:
        """One output row per row.  inverse gives the parent's columns from the output's, and saves the way back a join."""
        parent = self.node
        build = lambda df: df.select(*[e.alias(n) for n, e in columns.items()])

        def back(tracked: DataFrame, dep: int, least: bool) -> DataFrame:
            full = parent.full
            if inverse is not None:
                return tracked.select(*[e.alias(c) for e, c in zip(inverse, full.columns, strict=True)])
            marked = full.select(*full.columns, *[e.alias(f"__o_{n}") for n, e in columns.items()])
            outs = [f"__o_{n}" for n in columns]
            if not least:
                probe = _renamed(tracked.distinct(), "__t___o_")
                return marked.join(probe, _on(marked, probe, outs), "left_semi").select(*full.columns)
            need = _need(tracked)
            probe = need.select(*[F.col(n).alias(f"__t___o_{n}") for n in columns], "__need")
            asked = marked.join(probe, _on(marked, probe, outs)).withColumn("__salt", _salt(full.columns))
            # the first rows of an output are among the first of its salted shares, so a common output is no task's alone
            for keys in ([*outs, "__salt"], outs):
                order = Window.partitionBy(*keys).orderBy(*full.columns)
                asked = asked.withColumn("__rank", F.row_number().over(order)).where("__rank <= __need")
            return asked.select(*full.columns)

        return self._made("map" if inverse is None else "map_with_inverse", [], build, back)

    def key_by(self, name: str, key: Column) -> Traced:
        old = self.df.columns
        return self.map([F.col(c) for c in old], **{name: key}, **{c: F.col(c) for c in old})

    def map_values(self, keys: list[str], /, **columns: Column) -> Traced:
        return self.map(**{k: F.col(k) for k in keys}, **columns)

    def map_values_with_inverse(self, keys: list[str], inverse: list[Column], /, **columns: Column) -> Traced:
        return self.map(inverse, **{k: F.col(k) for k in keys}, **columns)

    def keys(self, keys: list[str]) -> Traced:
        return self.map(**{k: F.col(k) for k in keys})

    def values(self, keys: list[str]) -> Traced:
        return self.map(**{c: F.col(c) for c in self.df.columns if c not in keys})

    def flat_map(self, name: str, items: Column, keep: Sequence[str] = ()) -> Traced:
        """One output row per element of an array, with the columns in keep."""
        parent = self.node
        build = lambda df: df.select(*keep, F.explode(items).alias(name))
        outs = [*keep, name]

        def back(tracked: DataFrame, dep: int, least: bool) -> DataFrame:
            full = parent.full
            marked = [f"__o_{c}" for c in outs]
            emit = lambda df, *own: df.select(*own, *[F.col(c).alias(f"__o_{c}") for c in keep], F.explode(items).alias(f"__o_{name}"))
            probe = _renamed(tracked.distinct(), "__t___o_")
            # a hash stands for the row, so that its elements are joined without it; only rows that may be meant go on
            brief = emit(full, F.xxhash64(*full.columns).alias("__hash"))
            met = brief.join(probe, _on(brief, probe, marked), "left_semi").select(F.col("__hash").alias("__of")).distinct()
            rows = full.join(met, F.xxhash64(*full.columns) == F.col("__of"), "left_semi")
            if not least:
                emitted = emit(rows, *full.columns)
                return semi(rows, emitted.join(probe, _on(emitted, probe, marked), "left_semi").select(*full.columns))
            rows = occurrence(rows)
            emitted = emit(rows, *full.columns, "__occ")
            need = _need(tracked).select(*[F.col(c).alias(f"__t___o_{c}") for c in outs], "__need")
            asked = emitted.join(need, _on(emitted, need, marked))
            taken = asked.groupBy(*full.columns, "__occ", *marked, "__need").agg(F.count(F.lit(1)).alias("__emits")).withColumn("__salt", _salt([*full.columns, "__occ"]))
            # what comes before a row in its salted share is at most what comes before it at all
            for keys in ([*marked, "__salt"], marked):
                order = Window.partitionBy(*keys).orderBy(F.desc("__emits"), *full.columns, "__occ").rowsBetween(Window.unboundedPreceding, -1)
                taken = taken.withColumn("__before", F.coalesce(F.sum("__emits").over(order), F.lit(0))).where("__before < __need")
            return taken.select(*full.columns, "__occ").distinct().select(*full.columns)

        return self._made("flat_map", [], build, back)

    def flat_map_values(self, keys: list[str], name: str, items: Column) -> Traced:
        return self.flat_map(name, items, keys)

    def filter(self, condition: Column | str) -> Traced:
        return self._made("filter", [], lambda df: df.where(condition), lambda t, dep, least: t)

    # sets and joins -----------------------------------------------------------------------------------------------

    def distinct(self) -> Traced:
        parent = self.node
        return self._made("distinct", [], lambda df: df.distinct(), lambda t, dep, least: t if least else semi(parent.full, t))

    def union(self, *others: Traced) -> Traced:
        parents = [self.node, *[o.node for o in others]]

        def back(tracked: DataFrame, dep: int, least: bool) -> DataFrame:
            columns = tracked.columns
            if not least:
                return overlap(parents[dep].full.select(*columns), tracked)
            rest = tracked
            for p in parents[:dep]:
                rest = rest.exceptAll(overlap(p.full.select(*columns), rest))
            return rest if dep == len(parents) - 1 else overlap(parents[dep].full.select(*columns), rest)

        return self._made("union", others, lambda *dfs: reduce(DataFrame.unionByName, dfs), back)

    __add__ = union

    def intersection(self, other: Traced) -> Traced:
        parents = [self.node, other.node]
        back = lambda t, dep, least: t if least else semi(parents[dep].full, t)
        return self._made("intersection", [other], lambda a, b: a.intersect(b.select(*a.columns)), back)

    def subtract(self, other: Traced) -> Traced:
        """Rows whose value the other doesn't have, with their duplicates."""
        back = lambda t, dep, least: t if dep == 0 else other.node.full.limit(0)
        return self._made("subtract", [other], lambda a, b: anti(a, b.select(*a.columns)), back)

    def subtract_by_key(self, other: Traced, on: list[str]) -> Traced:
        back = lambda t, dep, least: t if dep == 0 else other.node.full.limit(0)
        return self._made("subtract_by_key", [other], lambda a, b: anti(a, b, on), back)

    def _joined(self, op: str, other: Traced, build: Callable[..., DataFrame]) -> Traced:
        parents = [self.node, other.node]

        def back(tracked: DataFrame, dep: int, least: bool) -> DataFrame:
            sides = [p.full.columns for p in parents]
            if not least:
                return overlap(parents[dep].full, tracked)
            times = counted(tracked, "__c")
            first = times.groupBy(*sides[0]).agg(F.max("__c").alias("__k"))
            left = overlap(parents[0].full, replicate(first, "__k"))
            if dep == 0:
                return left
            have = counted(left, "__have").select(*[F.col(c).alias(f"__t_{c}") for c in sides[0]], "__have")
            met = times.join(have, _on(times, have, sides[0]))
            need = met.groupBy(*sides[1]).agg(F.max(F.ceil(F.col("__c") / F.col("__have"))).alias("__k"))
            return overlap(parents[1].full, replicate(need, "__k"))

        return self._made(op, [other], build, back)

    def join(self, other: Traced, on: list[str], partitions: int | None = None) -> Traced:
        """Inner join on equal (non-null or null) keys; columns other than the keys must have different names."""

        def build(a: DataFrame, b: DataFrame) -> DataFrame:
            if partitions:
                a, b = a.repartition(partitions, *on), b.repartition(partitions, *on)
            right = b.select(*[F.col(c).alias(f"__t_{c}") if c in on else F.col(c) for c in b.columns])
            return a.join(right, _on(a, right, on)).drop(*[f"__t_{c}" for c in on])

        return self._joined("join", other, build)

    def cartesian(self, other: Traced) -> Traced:
        return self._joined("cartesian", other, lambda a, b: a.crossJoin(b))

    def cogroup(self, *others: Traced, on: list[str], partitions: int | None = None) -> Traced:
        """One row per key with the group of each parent as arrays g0, g1, ... of structs of its other columns."""
        parents = [self.node, *[o.node for o in others]]
        rests = [[c for c in p.full.columns if c not in on] for p in parents]

        def build(*dfs: DataFrame) -> DataFrame:
            tagged = []
            for i, df in enumerate(dfs):
                kinds = [dfs[j].select(F.struct(*rests[j])).schema[0].dataType for j in range(len(dfs))]
                tagged.append(df.select(*on, F.lit(i).alias("__tag"), *[F.struct(*rests[j]).alias(f"__v{j}") if j == i else F.lit(None).cast(kinds[j]).alias(f"__v{j}") for j in range(len(dfs))]))
            both = reduce(DataFrame.unionAll, tagged)
            if partitions:
                both = both.repartition(partitions, *on)
            return both.groupBy(*on).agg(*[F.collect_list(F.when(F.col("__tag") == i, F.col(f"__v{i}"))).alias(f"g{i}") for i in range(len(dfs))])

        def back(tracked: DataFrame, dep: int, least: bool) -> DataFrame:
            return tracked.select(*on, F.explode(f"g{dep}").alias("__g")).select(*on, *[F.col("__g")[c].alias(c) for c in rests[dep]]).select(*parents[dep].full.columns)

        return self._made("cogroup", others, build, back, keys=on)

    group_with = cogroup

    # aggregation --------------------------------------------------------------------------------------------------

    def combine(self, on: list[str], notes: list | None = None, inferred: bool = True, functions: list[str] = (), value: str | None = None, /, **aggregates: Column) -> Traced:
        """Aggregate per key with map-side combining; notes say what the aggregate is like (the first that fits holds)."""
        parent = self.node
        found = [*(notes or ()), *(A.infer(list(functions)) if inferred else ())]

        def back(tracked: DataFrame, dep: int, least: bool) -> DataFrame:
            full = parent.full
            note = found[0] if least and found else None
            if isinstance(note, A.Selection) and value is not None and set(full.columns) == {*on, value}:
                (out,) = aggregates
                return tracked.select(*on, F.col(out).alias(value)).select(*full.columns)
            everything = semi(full, tracked, on)
            if isinstance(note, A.Aggregation) and value is not None:
                keep = ~F.col(value).eqNullSafe(F.lit(note.zero))
                if note.guard is not None:
                    keep &= note.guard
                telling = everything.where(keep)
                return telling.unionAll(anti(everything, telling, on))  # keys without a telling value keep all their rows
            if isinstance(note, A.RemovingDups):
                return everything.distinct()
            return everything

        return self._made("combine", [], lambda df: df.groupBy(*on).agg(*[e.alias(n) for n, e in aggregates.items()]), back, keys=on)

    def reduce_by_key(self, on: list[str], out: str, function: str, value: str) -> Traced:
        return self.combine(on, None, True, [function], value, **{out: getattr(F, function)(value)})

    def fold_by_key(self, on: list[str], out: str, zero: Column, step: Callable[[Column, Column], Column], value: str, annotations: list | None = None) -> Traced:
        """Fold the values of a key, in ascending order, from a zero; for steps that no built-in aggregate expresses."""
        return self.combine(on, annotations, False, [], value, **{out: F.reduce(F.sort_array(F.collect_list(value)), zero, step)})

    def aggregate_by_key(self, on: list[str], **aggregates: Column) -> Traced:
        return self.combine(on, None, False, [], None, **aggregates)

    def group_by_key(self, on: list[str], out: str, value: str) -> Traced:
        return self.combine(on, None, False, [], value, **{out: F.sort_array(F.collect_list(value))})

    def count_approx_distinct_by_key(self, on: list[str], out: str, value: str, rsd: float = 0.05) -> Traced:
        return self.combine(on, None, True, ["approx_count_distinct"], value, **{out: F.approx_count_distinct(value, rsd)})

    # physical operations: the tracked node stays ----------------------------------------------------------------------

    def coalesce(self, n: int, shuffle: bool = False) -> Traced:
        return Traced(self.df.repartition(n) if shuffle else self.df.coalesce(n), self.node)

    def repartition(self, n: int) -> Traced:
        return Traced(self.df.repartition(n), self.node)

    def partition_by(self, n: int, *keys: str) -> Traced:
        return Traced(self.df.repartition(n, *keys), self.node)

    def sort_by_key(self, *keys: str, ascending: bool = True) -> Traced:
        return Traced(self.df.orderBy(*keys, ascending=ascending), self.node)

    def persist(self, level=None) -> Traced:
        return Traced(self.df.persist(level) if level else self.df.persist(), self.node)

    # tracing ------------------------------------------------------------------------------------------------------

    def _step(self, condition: Column | str | None, dep: int, least: bool) -> Traced:
        if self.node.back is None:
            raise TraceError(f"{self.node.op} {self.node.name or ''} has no provenance")
        if not 0 <= dep < len(self.node.parents):
            raise TraceError(f"no dependency {dep}")
        tracked = self.df if condition is None else self.df.where(condition)
        return Traced(self.node.back(tracked, dep, least), self.node.parents[dep])

    def provenance(self, condition: Column | str | None = None, dependency: int = 0) -> Traced:
        """All rows of a parent that contributed to the rows that meet the condition."""
        return self._step(condition, dependency, False)

    def explain(self, condition: Column | str | None = None, dependency: int = 0) -> Traced:
        """Rows of a parent that are enough to make the rows that meet the condition."""
        return self._step(condition, dependency, True)

    def equivalent_records(self, rows: DataFrame) -> DataFrame:
        """Rows of this node's whole output that share a key with the given ones (only where leaving rows out matters)."""
        return semi(self.node.full, rows, self.node.keys) if self.node.keys else self.node.full.limit(0)

    def copy_with_parents(self, *parents: DataFrame) -> DataFrame:
        """The same operation over other inputs."""
        if self.node.build is None:
            raise TraceError("a source can't be built again")
        return self.node.build(*parents)

    def go_back_to(self, name: str, condition=None, iterate: bool = False, config=None) -> Traced:
        return self.go_back_to_multiple([name], condition, iterate, config)[name]

    def go_back_to_multiple(self, names: list[str], condition=None, iterate: bool = False, config=None) -> dict[str, Traced]:
        from plaitwork.plans.lineage import go_back

        return go_back(self, names, condition, False, iterate, config)

    def go_back_and_explain(self, name: str, condition=None, iterate: bool = True, config=None) -> Traced:
        return self.go_back_to_multiple_and_explain([name], condition, iterate, config)[name]

    def go_back_to_multiple_and_explain(self, names: list[str], condition=None, iterate: bool = True, config=None) -> dict[str, Traced]:
        from plaitwork.plans.lineage import go_back

        return go_back(self, names, condition, True, iterate, config)


def union(*frames: Traced) -> Traced:
    """N-ary bag union."""
    return frames[0].union(*frames[1:])
