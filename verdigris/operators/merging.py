"""Moving changes between versions: reconcile, post, rebase, revert, as functions from a fabric to a fabric."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.changes import all_changes, count_changes, table_changes
from verdigris.operators.conflicts import classify_changes, conflicts, detailed_conflicts
from verdigris.operators.fabric import ROOT, Fabric, FeatureTable, StateTree, append_rows, state_set
from verdigris.operators.versioned import newest_adds, of_states
from verdigris.session import cut_lineage


class StateSharedError(RuntimeError):
    code = "STATE_SHARED"


class NotReconciledError(RuntimeError):
    code = "NOT_RECONCILED"


class ConcurrentChangeError(RuntimeError):
    code = "CONCURRENT_CHANGE"


@dataclass(frozen=True)
class ReconcileOptions:
    conflict_resolution: str = "favor_edit"
    abort_on_conflict: bool = False
    detect_only: bool = False
    auto_merge: bool = True
    resolve_conflict: Callable | None = None
    get_merged_values: Callable | None = None
    resolve_conflict_authoritative: bool = False


@dataclass
class ReconcileResult:
    conflict_count: int
    common_ancestor_state_id: int
    applied: bool = False
    parent_changes_applied: int = 0
    merged_count: int = 0

    @property
    def has_conflicts(self) -> bool:
        return self.conflict_count > 0


def tip_rows(table: FeatureTable, states: DataFrame, objects: DataFrame, target: int) -> DataFrame:
    """The newest add of each object within the states, moved to the state `target`."""
    rows = newest_adds(table, states).join(objects.select("objectid"), "objectid", "left_semi")
    return rows.withColumn("sde_state_id", F.lit(target).cast("long")).select(*table.adds.columns)


def delete_markers(table: FeatureTable, objects: DataFrame, target: int) -> DataFrame:
    """A marker of the state `target` for each object."""
    at = F.lit(target).cast("long")
    values = {"sde_deletes_row_id": F.col("objectid"), "sde_state_id": at, "deleted_at": at}
    return objects.select(*[values[c.lower()].alias(c) if c.lower() in values else F.lit(None).alias(c) for c in table.deletes.columns])


def without_rows(table: FeatureTable, objects: DataFrame, state: int) -> FeatureTable:
    """The table without the deltas of these objects at one state."""
    ids = objects.select(F.col("objectid").alias("__oid"))
    at = F.col("sde_state_id") == state
    adds = table.adds.join(ids, at & (F.col("objectid") == F.col("__oid")), "left_anti")
    deletes = table.deletes.join(ids, at & (F.col("sde_deletes_row_id") == F.col("__oid")), "left_anti")
    return replace(table, adds=adds, deletes=deletes)


def apply_changes(table: FeatureTable, changes: DataFrame, target: int) -> FeatureTable:
    """Changes without conflict, copied to the child's state: inserts and updates as adds, updates also as markers, deletes as markers.

    An update of an object that the child has itself added at the state is left as the child has it. A change whose row is not there fails when the rows
    are written, since its marker alone would make the object vanish.
    """
    mine = table.adds.filter(F.col("sde_state_id") == target).select("objectid")
    updates = changes.filter("change_type = 'update'").join(mine, "objectid", "left_anti")
    copied = changes.filter("change_type = 'insert'").unionByName(updates)
    source = copied.select(F.col("objectid").alias("__oid"), F.col("state_id").alias("__from"))
    rows = source.join(table.adds, (F.col("objectid") == F.col("__oid")) & (F.col("sde_state_id") == F.col("__from")), "left")
    missing = F.raise_error(F.concat(F.lit(f"{table.name}: no row to copy of object "), F.col("__oid").cast("string"))).cast("long")
    rows = rows.withColumn("objectid", F.when(F.col("objectid").isNull(), missing).otherwise(F.col("objectid"))).withColumn("sde_state_id", F.lit(target).cast("long")).select(*table.adds.columns)
    marked = updates.select("objectid").unionByName(changes.filter("change_type = 'delete'").select("objectid"))
    return replace(table, adds=append_rows(table.adds, rows), deletes=append_rows(table.deletes, delete_markers(table, marked, target)))


def parent_of(fabric: Fabric, version) -> str:
    return version.parent_name or "sde.DEFAULT"


def ranges(fabric: Fabric, name: str) -> tuple[StateTree, int, int, int]:
    """(tree, child tip, parent tip, common ancestor) of a version and its parent."""
    version = fabric.find_version(name)
    child, parent = fabric.tip(name), fabric.tip(parent_of(fabric, version))
    tree = fabric.tree()
    return tree, child, parent, tree.common_ancestor(child, parent)


def reconcile(fabric: Fabric, name: str, options: ReconcileOptions = ReconcileOptions()) -> tuple[Fabric, ReconcileResult]:
    """Brings the parent's changes since the common ancestor into the version's existing tip.

    Conflicts are resolved, in this order, by the authoritative callback, an automatic merge, the callback, the default. The callbacks get the collected
    row of a conflict; conflicts settled by rule alone stay distributed. Afterwards the parent's states are members of the version's closure.
    """
    tree, child, parent, ancestor = ranges(fabric, name)
    spark = fabric.spark
    ours, theirs = (state_set(spark, tree.states_in_range(t, ancestor)) for t in (child, parent))
    # What is read again and again is computed once.
    parent_changes = cut_lineage(all_changes(fabric, theirs))
    found = cut_lineage(conflicts(all_changes(fabric, ours), parent_changes))
    clashes = {r.table_name: r["count"] for r in found.groupBy("table_name").count().collect()}
    result = ReconcileResult(sum(clashes.values()), ancestor)
    if options.detect_only or (options.abort_on_conflict and result.has_conflicts):
        return fabric, result
    if options.resolve_conflict_authoritative and not options.resolve_conflict:
        raise ValueError("an authoritative resolution needs a resolve_conflict callback")
    total = {r.table_name: r["count"] for r in parent_changes.groupBy("table_name").count().collect()}
    for table in list(fabric.tables.values()):
        changes = parent_changes.filter(F.col("table_name") == table.name)
        applied, counts = changes, {}
        if clashes.get(table.name):
            clashing = found.filter(F.col("table_name") == table.name)
            resolved = cut_lineage(_resolve(detailed_conflicts(table, clashing), options))
            counts = {r.resolution: r["count"] for r in resolved.groupBy("resolution").count().collect()}
            kept = resolved.filter("resolution <> 'favor_target'").select("objectid")
            applied = changes.join(kept, "objectid", "left_anti")
        if counts.get("favor_target"):
            table = without_rows(table, resolved.filter("resolution = 'favor_target'").select("objectid"), child)
        result.parent_changes_applied += total.get(table.name, 0) - sum(n for k, n in counts.items() if k != "favor_target")
        result.merged_count += counts.get("merge", 0)
        table = apply_changes(table, applied, child)
        if counts.get("merge"):
            table = _merge_rows(table, resolved.filter("resolution = 'merge'"), child, options)
        fabric = fabric.with_table(table)
    members = state_set(spark, tree.states_in_range(parent, ancestor))
    fabric = add_to_lineage(fabric, child, members)
    result.applied = True
    return fabric, result


def _resolve(detailed: DataFrame, options: ReconcileOptions) -> DataFrame:
    if options.resolve_conflict:
        asked = detailed if options.resolve_conflict_authoritative or not options.auto_merge else detailed.filter("not auto_mergeable")
        answers = [(r.objectid, options.resolve_conflict(r)) for r in asked.collect()]
        spark = detailed.sparkSession
        answered = spark.createDataFrame(answers, "objectid long, answer string") if answers else spark.createDataFrame([], "objectid long, answer string")
        return detailed.join(answered, "objectid", "left").withColumn("resolution", F.coalesce("answer", F.lit("merge"))).drop("answer")
    default = F.lit(options.conflict_resolution)
    return detailed.withColumn("resolution", F.when(F.col("auto_mergeable"), F.lit("merge")).otherwise(default) if options.auto_merge else default)


def _merge_rows(table: FeatureTable, merged: DataFrame, child: int, options: ReconcileOptions) -> FeatureTable:
    """Sets the merged values in the child's adds of the state."""
    compared = merged.schema["suggested_merge"].dataType.names
    if options.get_merged_values:
        kind = merged.schema["suggested_merge"].dataType
        own = merged if options.resolve_conflict_authoritative else merged.filter("suggested_merge is null")
        answers = [(r.objectid, tuple(options.get_merged_values(r).get(c) for c in compared)) for r in own.collect()]
        if answers:
            given = merged.sparkSession.createDataFrame(answers, f"objectid long, given {kind.simpleString()}")
            merged = merged.join(given, "objectid", "left").withColumn("suggested_merge", F.coalesce("given", "suggested_merge")).drop("given")
    if not merged.filter("suggested_merge is null").isEmpty():
        raise ValueError("a conflict is to be merged but has no merged values")
    values = merged.select(F.col("objectid").alias("__oid"), F.col("suggested_merge").alias("__m"))
    joined = table.adds.join(values, (F.col("objectid") == F.col("__oid")) & (F.col("sde_state_id") == child), "left")
    set_ = [F.when(F.col("__m").isNotNull(), F.col(f"__m.`{c}`")).otherwise(F.col(c)).alias(c) if c in compared else F.col(c) for c in table.adds.columns]
    return replace(table, adds=joined.select(*set_))


def add_to_lineage(fabric: Fabric, state: int, members: DataFrame) -> Fabric:
    """Adds members to the closure of the lineage of a state; those that it has are left."""
    row = fabric.states.filter(F.col("state_id") == state).select("lineage_name").first()
    if row is None:
        return fabric
    new = members.select(F.lit(row.lineage_name).cast("long").alias("lineage_name"), F.col("state").alias("lineage_id"))
    new = new.join(fabric.lineages, ["lineage_name", "lineage_id"], "left_anti")
    return replace(fabric, lineages=append_rows(fabric.lineages, new))


def is_reconciled(fabric: Fabric, child: int, parent: int) -> bool:
    """Whether the closure of the child's lineage has the parent's tip."""
    name = fabric.states.filter(F.col("state_id") == child).select("lineage_name")
    return not fabric.lineages.filter(F.col("lineage_id") == parent).join(name, "lineage_name", "left_semi").isEmpty()


def shadow_markers(fabric: Fabric, table: FeatureTable, tip: int, since: int) -> DataFrame:
    """Markers (objectid, 0, edit state) for base rows that edits of the tip's closure after `since` replace or delete, where there are none yet."""
    name = fabric.states.filter(F.col("state_id") == tip).select("lineage_name")
    closure = fabric.lineages.join(name, "lineage_name", "left_semi").filter(F.col("lineage_id") <= tip).select(F.col("lineage_id").alias("state")).distinct()
    recent = closure.filter(F.col("state") > since)
    added = of_states(table.adds, "sde_state_id", recent).groupBy("objectid").agg(F.max("sde_state_id").alias("at"))
    marked = of_states(table.deletes, "sde_state_id", recent).groupBy(F.col("sde_deletes_row_id").alias("objectid")).agg(F.max("sde_state_id").alias("at"))
    edits = added.unionByName(marked.join(added.select("objectid"), "objectid", "left_anti"))
    shadowed = of_states(table.deletes.filter(F.col("sde_state_id") == ROOT), "deleted_at", closure).select(F.col("sde_deletes_row_id").alias("objectid"))
    edits = edits.join(table.base.select("objectid"), "objectid", "left_semi").join(shadowed, "objectid", "left_anti")
    return edits.select(F.col("objectid").alias("sde_deletes_row_id"), F.lit(ROOT).cast("long").alias("sde_state_id"), F.col("at").alias("deleted_at"))


@dataclass
class PostResult:
    changes_posted: int
    new_parent_state_id: int


def _set_tip(fabric: Fabric, name: str, state: int) -> Fabric:
    version = fabric.find_version(name)
    same = (F.col("owner") == version.owner) & (F.col("name") == version["name"])
    return replace(fabric, versions=fabric.versions.withColumn("state_id", F.when(same, F.lit(state).cast("long")).otherwise(F.col("state_id"))))


def child_state(fabric: Fabric, parent: int, new_id: int, own_lineage: DataFrame | None = None) -> Fabric:
    """A new state below `parent`. The first child of a state that is its lineage's last continues the lineage, another one copies its closure.

    With `own_lineage` (state) the state begins a lineage of its own, whose closure has these states, the root and itself.
    """
    row = fabric.states.filter(F.col("state_id") == parent).select("lineage_name").first()
    lineage = int(row.lineage_name) if row is not None else ROOT
    has_child = own_lineage is not None or parent == ROOT or not fabric.states.filter((F.col("parent_state_id") == parent) & (F.col("state_id") != ROOT)).isEmpty()
    name, spark = new_id if has_child else lineage, fabric.spark
    values = {"state_id": new_id, "parent_state_id": parent, "lineage_name": name}
    state = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in fabric.states.schema.fields])
    members = spark.range(1).select(F.lit(new_id).cast("long").alias("lineage_id"))
    if own_lineage is not None:
        members = members.union(spark.range(1).select(F.lit(ROOT).cast("long"))).union(own_lineage.select("state"))
    elif has_child:
        members = members.union(fabric.lineages.filter((F.col("lineage_name") == lineage) & (F.col("lineage_id") <= parent)).select("lineage_id"))
    closure = members.distinct().select(F.lit(name).cast("long").alias("lineage_name"), "lineage_id")
    return replace(fabric, states=append_rows(fabric.states, state), lineages=append_rows(fabric.lineages, closure), next_state=max(fabric.next_state, new_id + 1))


def delete_child_state(fabric: Fabric, state: int) -> Fabric:
    """Takes away a state without children: its locks, deltas, closure rows and itself; one with children is refused."""
    if not fabric.states.filter((F.col("parent_state_id") == state) & (F.col("state_id") != state)).isEmpty():
        raise ValueError(f"state {state} has children")

    def without(rows: DataFrame, column: str) -> DataFrame:
        return rows.filter(F.coalesce(F.col(column) != state, F.lit(True)))

    tables = {n: t if t.adds.filter(F.col("sde_state_id") == state).isEmpty() and t.deletes.filter(F.col("sde_state_id") == state).isEmpty() else replace(t, adds=without(t.adds, "sde_state_id"), deletes=without(t.deletes, "sde_state_id")) for n, t in fabric.tables.items()}
    lineages = without(fabric.lineages, "lineage_id").filter(F.coalesce(F.col("lineage_name") != state, F.lit(True)))
    return replace(fabric, states=without(fabric.states, "state_id"), locks=without(fabric.locks, "state_id"), lineages=lineages, tables=tables)


def next_state_id(fabric: Fabric) -> int:
    """A state id that has never been given out: neither a state has it nor, of states that are gone, the closure."""
    of_states = fabric.states.agg(F.max("state_id")).first()[0] or 0
    closure = fabric.lineages.agg(F.max("lineage_name").alias("a"), F.max("lineage_id").alias("b")).first()
    return max(fabric.next_state, int(max(of_states, closure.a or 0, closure.b or 0)) + 1)


def post(fabric: Fabric, name: str, trim: bool = False, delete_version: bool = False) -> tuple[Fabric, PostResult]:
    """Makes the version's changes the parent's.

    The version must be reconciled with the parent's tip. The parent moves to the version's tip; with `trim` to a new state below its own, into which the
    net changes are copied (an update as its add only). Shadow markers of the base rows follow.
    """
    tree, child, parent, ancestor = ranges(fabric, name)
    version = fabric.find_version(name)
    if not is_reconciled(fabric, child, parent):
        raise NotReconciledError(name)
    own = state_set(fabric.spark, tree.states_in_range(child, ancestor))
    posted = int(count_changes(fabric, own).first()[0])
    tip = child
    if trim:
        tip = next_state_id(fabric)
        fabric = child_state(fabric, parent, tip)
        for table in list(fabric.tables.values()):
            changes = table_changes(table, own)
            added = tip_rows(table, own, changes.filter("change_type <> 'delete'"), tip)
            markers = delete_markers(table, changes.filter("change_type = 'delete'").select("objectid"), tip)
            fabric = fabric.with_table(replace(table, adds=append_rows(table.adds, added), deletes=append_rows(table.deletes, markers)))
    fabric = _set_tip(fabric, parent_of(fabric, version), tip)
    for table in list(fabric.tables.values()):
        markers = shadow_markers(fabric, table, tip, parent)
        fabric = fabric.with_table(replace(table, deletes=append_rows(table.deletes, markers)))
    if delete_version:
        fabric = replace(fabric, versions=fabric.versions.filter(~((F.col("owner") == version.owner) & (F.col("name") == version["name"]))))
    return fabric, PostResult(posted, tip)


def external_references(fabric: Fabric, owner: str, name: str, states: list[int] | DataFrame) -> DataFrame:
    """(state) of the states that other versions hold by closure or tip, or that have a child outside of them."""
    wanted = state_set(fabric.spark, states)
    others = fabric.versions.filter(~((F.lower("owner") == owner.lower()) & (F.lower("name") == name.lower()))).filter("state_id is not null")
    named = others.join(fabric.states.select("state_id", "lineage_name"), "state_id")
    by_closure = named.join(fabric.lineages, "lineage_name").filter(F.col("lineage_id") <= F.col("state_id")).select(F.col("lineage_id").alias("state"))
    by_tip = others.select(F.col("state_id").alias("state"))
    inside = wanted.select(F.col("state").alias("inside"))
    by_child = fabric.states.join(inside, F.col("state_id") == F.col("inside"), "left_anti").select(F.col("parent_state_id").alias("state"))
    return by_closure.unionByName(by_tip).unionByName(by_child).join(wanted, "state", "left_semi").distinct()


def _without_own(rows: DataFrame, key: str, ids: DataFrame, states: DataFrame) -> DataFrame:
    """The rows that are not both of the objects (__oid) and of the states."""
    own = states.select(F.col("state").alias("__member"))
    marked = rows.join(ids, F.col(key) == F.col("__oid"), "left").join(own, F.col("sde_state_id") == F.col("__member"), "left")
    return marked.filter("__oid is null or __member is null").select(*rows.columns)


def revert(fabric: Fabric, name: str, features: list[tuple[str, int]]) -> tuple[Fabric, int]:
    """Removes the version's own deltas of the given (table, objectid); refused if others hold its states. Counts the features given."""
    tree, child, _, ancestor = ranges(fabric, name)
    version, own = fabric.find_version(name), state_set(fabric.spark, tree.states_in_range(child, ancestor))
    if own.isEmpty():
        return fabric, 0
    if not external_references(fabric, version.owner, version["name"], own).isEmpty():
        raise StateSharedError(name)
    spark = fabric.spark
    for table in {t for t, _ in features}:
        ids = spark.createDataFrame([(int(o),) for t, o in features if t == table], "__oid long").distinct()
        source = fabric.tables[table]
        adds, deletes = (_without_own(rows, key, ids, own) for rows, key in ((source.adds, "objectid"), (source.deletes, "sde_deletes_row_id")))
        fabric = fabric.with_table(replace(source, adds=adds, deletes=deletes))
    return fabric, len(features)


@dataclass
class RebaseResult:
    outcomes: dict[str, int]
    new_state_id: int | None = None
    already_current: bool = False


class OpenSessionError(RuntimeError):
    code = "OPEN_SESSION"


def has_open_session(fabric: Fabric, tip: int) -> bool:
    """Whether a locked state branches off the tip."""
    below = fabric.states.filter((F.col("parent_state_id") == tip) & (F.col("state_id") != tip)).select("state_id")
    return not fabric.locks.join(below, fabric.locks["state_id"] == below["state_id"], "left_semi").isEmpty()


def rebase(fabric: Fabric, name: str, dry_run: bool = False, unsafe_experimental: bool = False, accept_conflicts: bool = False) -> tuple[Fabric, RebaseResult]:
    """Puts the version's net changes on a new state below the parent's present tip. Writes only with `unsafe_experimental`, and over conflicts only if accepted.

    Kept rows become adds of the new state, which need no markers, since the newest add shows; only deletes become markers. The state has a lineage of its
    own, whose closure is the parent's whole walk, so that the version counts as reconciled. With an edit session open on the version it is refused.
    """
    tree, child, parent, ancestor = ranges(fabric, name)
    if child == parent or (ancestor == parent and is_reconciled(fabric, child, parent)):
        return fabric, RebaseResult({}, already_current=True)
    above = state_set(fabric.spark, tree.walk(parent))
    sets = [*[state_set(fabric.spark, s) for s in (tree.states_in_range(child, ancestor), tree.walk(child), tree.walk(ancestor))], above]
    classified = {n: classify_changes(t, *sets) for n, t in fabric.tables.items()}
    outcomes: dict[str, int] = {}
    for found in classified.values():
        for row in found.groupBy("outcome").count().collect():
            outcomes[row.outcome] = outcomes.get(row.outcome, 0) + row["count"]
    result = RebaseResult(outcomes)
    if dry_run:
        return fabric, result
    if not unsafe_experimental:
        raise PermissionError("a rebase that writes must be asked for as unsafe and experimental")
    if not accept_conflicts and any(k.startswith("conflict") for k in outcomes):
        raise RuntimeError("the rebase has conflicts")
    if has_open_session(fabric, child):
        raise OpenSessionError(name)
    tip = next_state_id(fabric)
    fabric = child_state(fabric, parent, tip, above)
    for n, found in classified.items():
        table = fabric.tables[n]
        kept = found.filter("outcome in ('replay', 'conflict_add')").select("objectid")
        gone = found.filter("outcome in ('delete', 'conflict_delete')").select("objectid")
        added, markers = tip_rows(table, sets[1], kept, tip), delete_markers(table, gone, tip)
        fabric = fabric.with_table(replace(table, adds=append_rows(table.adds, added), deletes=append_rows(table.deletes, markers)))
    result.new_state_id = tip
    return _set_tip(fabric, name, tip), result
