"""Compaction: graduate, prune, collapse, with their checks. Every phase is a function from a fabric to a fabric that leaves all versions' rows as they are."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.fabric import ROOT, Fabric, FeatureTable, StateTree, state_set
from verdigris.operators.spreadtree import SpreadTree
from verdigris.operators.versioned import not_of_states, of_states, surviving_adds, version_signatures
from verdigris.session import cut_lineage


class CompactionRefused(RuntimeError):
    """A check failed; nothing was changed."""


def preconditions(states: DataFrame, lineages: DataFrame, versions: DataFrame) -> DataFrame:
    """(violation, n) of each structural fault: missing root state or root closure row, dangling or unordered parents, repeated (parent, lineage), dangling tips."""
    known = states.select(F.col("state_id").alias("known"))
    faults = {
        "missing_root_state": states.filter(F.col("state_id") == ROOT).agg((1 - F.least(F.count(F.lit(1)), F.lit(1))).alias("n")),
        "missing_root_lineage": lineages.filter((F.col("lineage_name") == ROOT) & (F.col("lineage_id") == ROOT)).agg((1 - F.least(F.count(F.lit(1)), F.lit(1))).alias("n")),
        "dangling_parent": states.filter(F.col("parent_state_id") != ROOT).join(known, F.col("parent_state_id") == F.col("known"), "left_anti").agg(F.count(F.lit(1)).alias("n")),
        "parent_not_before_child": states.filter((F.col("parent_state_id") != ROOT) & (F.col("parent_state_id") >= F.col("state_id"))).agg(F.count(F.lit(1)).alias("n")),
        "repeated_parent_lineage": states.groupBy("parent_state_id", "lineage_name").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("n")),
        "dangling_tip": versions.filter("state_id is not null").join(known, F.col("state_id") == F.col("known"), "left_anti").agg(F.count(F.lit(1)).alias("n")),
    }
    rows = [df.select(F.lit(name).alias("violation"), F.col("n").cast("long").alias("n")) for name, df in faults.items()]
    found = rows[0]
    for row in rows[1:]:
        found = found.unionByName(row)
    return found.filter("n > 0")


def missing_self_rows(states: DataFrame, lineages: DataFrame) -> DataFrame:
    """(state_id) without a closure row of its own lineage and itself."""
    own = lineages.select("lineage_name", F.col("lineage_id").alias("state_id"))
    return states.join(own, ["lineage_name", "state_id"], "left_anti").select("state_id")


def tips_of(fabric: Fabric) -> list[int]:
    return sorted({int(r.state_id) for r in fabric.versions.filter("state_id is not null").select("state_id").distinct().collect()})


def locked_branches(fabric: Fabric, tree: StateTree | SpreadTree) -> set[int] | DataFrame:
    """Locked states with all their ancestors (without the root) and descendants."""
    if isinstance(tree, SpreadTree):
        return tree.branches(fabric.locks.select(F.col("state_id").alias("state")))
    found: set[int] = set()
    for row in fabric.locks.select("state_id").distinct().collect():
        state = int(row.state_id)
        if state in tree.parents:
            found |= tree.reachable([state]) | {state} | tree.descendants(state)
    return found - {ROOT}


def graduable_prefix(tree: StateTree | SpreadTree, tips: list[int]) -> set[int] | DataFrame:
    """States on the walk of every distinct tip."""
    if isinstance(tree, SpreadTree):
        return tree.prefix(tips)
    walks = [set(tree.walk(t)) for t in tips]
    return set.intersection(*walks) if walks else set()


def prefix_pairs(pairs: DataFrame) -> DataFrame:
    """The same from (tip, state) pairs, distributed."""
    tips = pairs.select("tip").distinct().count()
    return pairs.groupBy("state").agg(F.countDistinct("tip").alias("n")).filter(F.col("n") == tips).select("state")


def unreachable_states(tree: StateTree | SpreadTree, tips: list[int]) -> set[int] | DataFrame:
    if isinstance(tree, SpreadTree):
        return tree.unreachable(tips)
    return set(tree.parents) - tree.reachable(tips) - {ROOT}


def prunable_states(fabric: Fabric, tree: StateTree | SpreadTree, tips: list[int]) -> set[int] | DataFrame:
    """The unreachable states of which no branch is locked."""
    gone, locked = unreachable_states(tree, tips), locked_branches(fabric, tree)
    return cut_lineage(gone.join(locked, "state", "left_anti")) if isinstance(gone, DataFrame) else gone - locked


@dataclass(frozen=True)
class Graduation:
    table: FeatureTable
    upserts: DataFrame
    deletes: DataFrame


def graduate_table(table: FeatureTable, prefix: DataFrame) -> Graduation:
    """Moves the deltas of the prefix states into the base.

    Surviving adds replace their base rows; other objects with a marker of the prefix (by state or deleted_at) leave the base; then the prefix's deltas go.
    """
    columns = [c for c in table.base.columns if c in table.columns]
    winners = surviving_adds(table, prefix).select(*columns)
    ids = winners.select(F.col("objectid").alias("__won"))
    marked = (
        of_states(table.deletes, "sde_state_id", prefix).select(F.col("sde_deletes_row_id").alias("__gone"))
        .union(of_states(table.deletes, "deleted_at", prefix).select("sde_deletes_row_id"))
        .distinct()
    )
    gone = marked.join(ids, F.col("__gone") == F.col("__won"), "left_anti")
    deleted = table.base.join(gone, F.col("objectid") == F.col("__gone"), "left_semi").select("objectid")
    kept = table.base.join(ids.union(gone), F.col("objectid") == F.col("__won"), "left_anti")
    base = kept.select(*columns).unionByName(winners)
    adds = not_of_states(table.adds, "sde_state_id", prefix)
    deletes = not_of_states(not_of_states(table.deletes, "sde_state_id", prefix), "deleted_at", prefix)
    return Graduation(replace(table, base=base, adds=adds, deletes=deletes), winners, deleted)


def prune(fabric: Fabric, states: set[int] | DataFrame) -> Fabric:
    """Removes states with their deltas and closure members; lineage names are left alone."""
    gone = state_set(fabric.spark, states)

    def without(rows: DataFrame, column: str) -> DataFrame:
        return not_of_states(rows, column, gone)

    tables = {n: replace(t, adds=without(t.adds, "sde_state_id"), deletes=without(without(t.deletes, "sde_state_id"), "deleted_at")) for n, t in fabric.tables.items()}
    return replace(
        fabric,
        states=without(fabric.states, "state_id"),
        lineages=without(fabric.lineages, "lineage_id"),
        modified=None if fabric.modified is None else without(fabric.modified, "state_id"),
        tables=tables,
    )


def collapse_plan(tree: StateTree | SpreadTree, tips: list[int], locked: set[int] | DataFrame) -> dict[int, int] | DataFrame:
    """Each state that goes, with the surviving ancestor that takes it in.

    The root, tips, locked states and branch points survive, and so do their children.
    """
    if isinstance(tree, SpreadTree):
        return tree.collapse_pairs(tips, locked)
    count = Counter(p for s, p in tree.parents.items() if s != ROOT)
    fixed = {ROOT, *tips, *locked, *[s for s, c in count.items() if c >= 2]}
    anchor: dict[int, int] = {}
    todo = [ROOT]
    while todo:
        parent = todo.pop()
        for state in tree.children.get(parent, []):
            if state not in fixed and parent not in fixed:
                anchor[state] = anchor.get(parent, parent)
            todo.append(state)
    return anchor


def collapse_table(table: FeatureTable, plan: DataFrame) -> FeatureTable:
    """Folds the deltas of planned states (state, anchor) into their anchors in one pass.

    Of the states that share an anchor only the latest that touches an object, by an add or a marker, keeps its rows of the object. deleted_at is mapped
    by itself; markers of the root state are no touch. Of a hot object at most one row per state is compared, all combined before the shuffle.
    """
    runs = plan.unionByName(plan.select(F.col("anchor").alias("state"), "anchor").distinct()).select(F.col("state").alias("__member"), F.col("anchor").alias("__run"))
    adds = table.adds.join(runs, F.col("sde_state_id") == F.col("__member"), "left")
    deletes = table.deletes.join(runs, (F.col("sde_state_id") == F.col("__member")) & (F.col("sde_state_id") != ROOT), "left")
    touched = adds.filter("__run is not null").select(F.col("objectid").alias("__oid"), F.col("__run").alias("__anchor"), "sde_state_id").unionByName(
        deletes.filter("__run is not null").select(F.col("sde_deletes_row_id").alias("__oid"), F.col("__run").alias("__anchor"), "sde_state_id")
    )
    last = touched.groupBy("__oid", "__anchor").agg(F.max("sde_state_id").alias("__last"))

    def latest(rows: DataFrame, key: str) -> DataFrame:
        joined = rows.join(last, (F.col(key) == F.col("__oid")) & (F.col("__run") == F.col("__anchor")), "left")
        return joined.filter("__run is null or sde_state_id = __last").withColumn("sde_state_id", F.coalesce("__run", "sde_state_id"))

    mapped = plan.select(F.col("state").alias("__from"), F.col("anchor").alias("__to"))
    deletes = latest(deletes, "sde_deletes_row_id").join(mapped, F.col("deleted_at") == F.col("__from"), "left")
    deletes = deletes.withColumn("deleted_at", F.coalesce("__to", "deleted_at")).drop("__from", "__to")
    return replace(table, adds=latest(adds, "objectid").select(*table.adds.columns), deletes=deletes.select(*table.deletes.columns))


def collapse(fabric: Fabric, plan: dict[int, int] | DataFrame) -> Fabric:
    """Folds the planned states away: deltas, closure members and modified tables move to the anchors, children of a folded state to its anchor."""
    spark = fabric.spark
    pairs = plan if isinstance(plan, DataFrame) else spark.createDataFrame(sorted(plan.items()), "state long, anchor long")
    moved = pairs.select(F.col("state").alias("__from"), F.col("anchor").alias("__to"))

    def mapped(rows: DataFrame, column: str) -> DataFrame:
        return rows.join(moved, F.col(column) == F.col("__from"), "left").withColumn(column, F.coalesce("__to", column)).select(*rows.columns)

    states = fabric.states.join(pairs.select(F.col("state").alias("__from")), F.col("state_id") == F.col("__from"), "left_anti")
    return replace(
        fabric,
        states=mapped(states, "parent_state_id"),
        lineages=mapped(fabric.lineages, "lineage_id").distinct(),
        modified=None if fabric.modified is None else mapped(fabric.modified, "state_id").distinct(),
        tables={n: collapse_table(t, pairs) for n, t in fabric.tables.items()},
    )


def closure_census(fabric: Fabric, tree: StateTree | SpreadTree) -> DataFrame:
    """(owner, name, n_over, n_under): closure members up to the tip that the walk lacks, and members of the walk that the closure lacks."""
    if isinstance(tree, SpreadTree):
        return tree.census(fabric.states, fabric.lineages, fabric.versions)
    versions = fabric.versions.filter("state_id is not null").join(fabric.states.select("state_id", "lineage_name"), "state_id").select("owner", "name", F.col("state_id").alias("tip"), "lineage_name")
    rows = versions.collect()
    walks = [(r.owner, r.name, s) for r in rows for s in tree.walk(int(r.tip))]
    spark = fabric.spark
    walk = spark.createDataFrame(walks, "owner string, name string, member long") if walks else spark.createDataFrame([], "owner string, name string, member long")
    stored = versions.join(fabric.lineages, "lineage_name").filter((F.col("lineage_id") <= F.col("tip")) & (F.col("lineage_id") != ROOT))
    stored = stored.select("owner", "name", F.col("lineage_id").alias("member"), F.lit(1).alias("in_closure")).distinct()
    both = walk.withColumn("in_walk", F.lit(1)).join(stored, ["owner", "name", "member"], "full")
    return both.groupBy("owner", "name").agg(F.count_if(F.col("in_walk").isNull()).alias("n_over"), F.count_if(F.col("in_closure").isNull()).alias("n_under"))


def closure_faults(fabric: Fabric, tree: StateTree | SpreadTree) -> list[str]:
    """Why graduating or collapsing would be unsafe for readers of the closure: tips of one lineage that are not on one chain, members not in the walk."""
    named = fabric.versions.filter("state_id is not null").join(fabric.states.select("state_id", "lineage_name"), "state_id").collect()
    faults = []
    groups: dict[int, list] = {}
    for v in named:
        groups.setdefault(int(v.lineage_name), []).append(v)
    for lineage, members in sorted(groups.items()):
        top = max(int(m.state_id) for m in members)
        walk = tree.walk(top)
        on = {r.state for r in state_set(fabric.spark, walk).join(state_set(fabric.spark, {int(m.state_id) for m in members}), "state", "left_semi").collect()} if isinstance(walk, DataFrame) else {*walk}
        stray = [f"{m.owner}.{m.name}" for m in members if int(m.state_id) not in {*on, top}]
        if stray:
            faults.append(f"lineage {lineage}: {', '.join(sorted(stray))} off the chain of {top}")
    faults += [f"{r.owner}.{r.name}: {r.n_over} members that are no ancestors" for r in closure_census(fabric, tree).filter("n_over > 0").collect()]
    return faults


@dataclass
class CompactionResult:
    phases: tuple[str, ...]
    adds_removed: int = 0
    deletes_removed: int = 0
    states_removed: int = 0
    graduated_upserts: int = 0
    graduated_deletes: int = 0
    by_table: dict[str, tuple[int, int]] = field(default_factory=dict)
    lineages_collapsed: int = 0
    skipped: str | None = None
    deferred: str | None = None
    self_check: bool | None = None


def compact(
    fabric: Fabric,
    acknowledge_experimental_unsafe: bool = False,
    graduate: bool = False,
    prune_states: bool = True,
    collapse_lineages: bool = False,
    tables: list[str] | None = None,
    verify: bool = False,
    bypass_closure_gate: bool = False,
    on_progress: Callable[[str, CompactionResult], None] | None = None,
) -> tuple[Fabric, CompactionResult]:
    """Runs the chosen phases in the order graduate, prune, collapse; `tables` limits graduation only.

    The default prunes only. Refuses without the acknowledgement, without a phase, on failed preconditions, and, for the two other phases, on closure faults.
    Pruned adds and markers both count as adds_removed. `on_progress` is told of each phase when it is done, with the result so far.
    """
    if not acknowledge_experimental_unsafe:
        raise CompactionRefused("compaction must be acknowledged as experimental and unsafe")
    phases = tuple(n for n, on in (("graduate", graduate), ("prune", prune_states), ("collapse", collapse_lineages)) if on)
    if not phases:
        raise CompactionRefused("no phase chosen")
    if violations := preconditions(fabric.states, fabric.lineages, fabric.versions).collect():
        raise CompactionRefused("; ".join(f"{v.violation}: {v.n}" for v in violations))
    result, start, tell = CompactionResult(phases), fabric, on_progress or (lambda *_: None)
    tree, tips = fabric.tree(), tips_of(fabric)
    if (graduate or collapse_lineages) and not bypass_closure_gate and (faults := closure_faults(fabric, tree)):
        raise CompactionRefused("; ".join(faults))
    if graduate:
        prefix = graduable_prefix(tree, tips)
        if prefix.isEmpty() if isinstance(prefix, DataFrame) else not prefix:
            result.skipped = "no-graduable-rows"
        else:
            for name in tables or sorted(fabric.tables):
                done = graduate_table(fabric.tables[name], state_set(fabric.spark, prefix))
                result.by_table[name] = (done.upserts.count(), done.deletes.count())
                fabric = fabric.with_table(done.table)
            result.graduated_upserts, result.graduated_deletes = (sum(c[i] for c in result.by_table.values()) for i in (0, 1))
        tell("graduate", result)
    if prune_states:
        gone = prunable_states(fabric, tree, tips)
        before = _delta_rows(fabric)
        fabric = prune(fabric, gone)
        result.adds_removed, result.states_removed = before - _delta_rows(fabric), gone.count() if isinstance(gone, DataFrame) else len(gone)
        tree = tree.without(gone)
        tell("prune", result)
    if collapse_lineages:
        plan = collapse_plan(tree, tips, locked_branches(fabric, tree))
        fabric = collapse(fabric, plan)
        result.lineages_collapsed = plan.count() if isinstance(plan, DataFrame) else len(plan)
        tell("collapse", result)
    if verify:
        result.self_check = same_visible_rows(start, fabric)
        tell("verify", result)
    return fabric, result


def _delta_rows(fabric: Fabric) -> int:
    return sum(t.adds.count() + t.deletes.count() for t in fabric.tables.values())


def visible_snapshot(fabric: Fabric) -> dict[tuple[str, str, str], tuple[int, int]]:
    """For each table and version the number and the order-free hash of its visible rows."""
    return {(name, r.owner, r["name"]): (int(r.n_rows), int(r.signature)) for name in fabric.tables for r in version_signatures(fabric, name).collect()}


def same_visible_rows(before: Fabric, after: Fabric) -> bool:
    return visible_snapshot(before) == visible_snapshot(after)


