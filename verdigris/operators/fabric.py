"""The versioned store as plain data: tables of states, versions and deltas, and the state tree on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from verdigris.operators.hierarchy import links_of
from verdigris.operators.spreadtree import BrokenLineageError, SpreadTree

#: The base state: never a member of a lineage, never collapsed into, never pruned.
ROOT = 0
#: Up to so many states the tree is held on the driver.
INDEX_NODES = 4_000_000


class NoCommonAncestorError(ValueError):
    code = "NO_COMMON_ANCESTOR"


class VersionNotFoundError(KeyError):
    code = "VERSION_NOT_FOUND"


class StateTree:
    """Parents of all states, held on the driver."""

    def __init__(self, parents: dict[int, int]):
        self.parents = parents
        self._children: dict[int, list[int]] | None = None

    @classmethod
    def of(cls, states: DataFrame, most: int | None = None) -> StateTree | SpreadTree:
        """The tree of up to `most` states (INDEX_NODES), beyond them the same as tables. It is kept with its table, which never changes."""
        most = INDEX_NODES if most is None else most
        kept = getattr(states, "tree", None)
        if kept is None or kept[0] != most:
            rows = links_of(states, "state_id", "parent_state_id").limit(most + 1).toPandas()
            states.tree = kept = (most, cls(_parents(rows)) if len(rows) <= most else SpreadTree(states, most))
        return kept[1]

    def walk(self, tip: int | None) -> list[int]:
        """The tip and its ancestors without the root, from the tip on; empty for no tip or the root. A missing state or a cycle raises."""
        chain: list[int] = []
        seen: set[int] = set()
        at = tip
        while at is not None and at != ROOT:
            if at in seen or at not in self.parents:
                raise BrokenLineageError(f"the chain of state {tip} breaks at {at}")
            seen.add(at)
            chain.append(at)
            at = self.parents[at]
        return chain

    def states_in_range(self, tip: int, ancestor: int) -> list[int]:
        """States of the walk above `ancestor` and up to `tip`, ascending."""
        return sorted(s for s in self.walk(tip) if ancestor < s <= tip)

    def common_ancestor(self, child: int, parent: int) -> int:
        """The largest state that both walks share; the root if one of them has none or both start at the root; otherwise the lineages are broken."""
        one, two = self.walk(child), self.walk(parent)
        shared = set(one) & set(two)
        if shared:
            return max(shared)
        if all(not w or self.parents[w[-1]] == ROOT for w in (one, two)):
            return ROOT
        raise BrokenLineageError(f"states {child} and {parent} share no ancestor")

    def without(self, gone: set[int]) -> StateTree:
        return StateTree({s: p for s, p in self.parents.items() if s not in gone})

    @property
    def children(self) -> dict[int, list[int]]:
        if self._children is None:
            self._children = {}
            for node, parent in self.parents.items():
                if node != ROOT:
                    self._children.setdefault(parent, []).append(node)
        return self._children

    def descendants(self, state: int) -> set[int]:
        found: set[int] = set()
        todo = [state]
        while todo:
            below = [c for c in self.children.get(todo.pop(), []) if c not in found]
            found.update(below)
            todo += below
        return found

    def reachable(self, tips: list[int]) -> set[int]:
        """All states on the walk of some tip."""
        found: set[int] = set()
        for tip in tips:
            at = tip
            while at != ROOT and at not in found and at in self.parents:
                found.add(at)
                at = self.parents[at]
        return found


def _parents(rows) -> dict[int, int]:
    return {int(n): int(p) if p == p and p is not None else ROOT for n, p in zip(rows.node, rows.parent)}


@dataclass(frozen=True)
class FeatureTable:
    """One versioned table: base rows by objectid, adds by (objectid, sde_state_id), delete markers (sde_deletes_row_id, sde_state_id, deleted_at)."""

    name: str
    base: DataFrame
    adds: DataFrame
    deletes: DataFrame
    registration_id: int | None = None
    shape_field: str | None = None

    @property
    def columns(self) -> list[str]:
        """Payload columns: those of the adds without the state."""
        return [c for c in self.adds.columns if c.lower() != "sde_state_id"]


@dataclass(frozen=True)
class Fabric:
    states: DataFrame
    lineages: DataFrame
    versions: DataFrame
    locks: DataFrame
    tables: dict[str, FeatureTable] = field(default_factory=dict)
    modified: DataFrame | None = None
    #: State ids below this one have been given out, even if their states are gone.
    next_state: int = 0

    @property
    def spark(self) -> SparkSession:
        return self.states.sparkSession

    def tree(self) -> StateTree | SpreadTree:
        return StateTree.of(self.states)

    def with_table(self, table: FeatureTable) -> Fabric:
        return replace(self, tables=self.tables | {table.name: table})

    def version_rows(self) -> list:
        """The rows of all versions, kept with their table, which never changes."""
        if getattr(self.versions, "kept_rows", None) is None:
            self.versions.kept_rows = self.versions.collect()
        return self.versions.kept_rows

    def find_version(self, name: str):
        """The row of `owner.name` or `name` (of owner sde), letter case ignored, cut at the first dot; None if there is none."""
        owner, _, rest = name.partition(".")
        owner, rest = (owner, rest) if rest else ("sde", owner)
        return next((v for v in self.version_rows() if v.owner.lower() == owner.lower() and v.name.lower() == rest.lower()), None)

    def tip(self, name: str) -> int:
        version = self.find_version(name)
        if version is None:
            raise VersionNotFoundError(name)
        return int(version.state_id or ROOT)


def append_rows(rows: DataFrame, more: DataFrame) -> DataFrame:
    """`rows` and `more`; a store that has `rows` then writes `more` only."""
    more = more.select(*rows.columns)
    joined = rows.unionByName(more)
    joined.appended = (rows, more)
    return joined


def state_set(spark: SparkSession, states) -> DataFrame:
    """State ids as a table; its size is known to the planner, which broadcasts it if it is small. A table is left as it is."""
    import pandas as pd

    if isinstance(states, DataFrame):
        return states

    return spark.createDataFrame(pd.DataFrame({"state": pd.Series(sorted(states), dtype="int64")}), "state long")
