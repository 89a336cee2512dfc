"""Queries of the versioned store over the derived fabric."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import changes, compaction, conflicts, merging, versioned
from verdigris.operators.fabric import Fabric, FeatureTable, state_set
from verdigris.plans.fabric_data import TABLE, load_fabric
from verdigris.sources.catalog import list_versions

V_A, V_B, V_ORPHAN = "editor.V_A", "editor.V_B", "editor.V_ORPHAN"


def _states(fabric: Fabric, states) -> DataFrame:
    return state_set(fabric.spark, states)


def _range(fabric: Fabric, name: str) -> tuple[DataFrame, DataFrame, int]:
    """The states of a version and of its parent above their common ancestor."""
    tree, child, parent, ancestor = merging.ranges(fabric, name)
    return _states(fabric, tree.states_in_range(child, ancestor)), _states(fabric, tree.states_in_range(parent, ancestor)), ancestor


def _read(name: str, **options):
    return lambda fabric: versioned.read_options(versioned.read_version(fabric, TABLE, name), **options)


def _signatures(fabric: Fabric) -> DataFrame:
    measures = {"sum_objectid": F.col("objectid"), "sum_cents": F.round(F.col("c_acctbal") * 100).cast("long")}
    return versioned.version_signatures(fabric, TABLE, measures)


def _walks(fabric: Fabric) -> DataFrame:
    tree = fabric.tree()
    rows = [(v.owner, v["name"], s) for v in fabric.version_rows() for s in tree.walk(int(v.state_id))]
    return fabric.spark.createDataFrame(rows, "owner string, name string, state_id long")


def _ancestors(fabric: Fabric) -> DataFrame:
    tree, versions = fabric.tree(), fabric.version_rows()
    rows = [(a["name"], b["name"], tree.common_ancestor(int(a.state_id), int(b.state_id))) for a in versions for b in versions]
    return fabric.spark.createDataFrame(rows, "child string, parent string, ancestor long")


def _conflicts(fabric: Fabric) -> DataFrame:
    ours, theirs, _ = _range(fabric, V_A)
    return conflicts.conflicts(changes.all_changes(fabric, ours), changes.all_changes(fabric, theirs))


def _detailed(fabric: Fabric) -> DataFrame:
    return conflicts.detailed_conflicts(fabric.tables[TABLE], _conflicts(fabric))


def _fields(fabric: Fabric) -> DataFrame:
    rows = conflicts.field_conflict_rows(_detailed(fabric))
    numeric = F.col("field").isin("c_acctbal", "c_nationkey")
    return rows.select("objectid", "field", *[F.when(numeric, F.round(F.col(c).cast("double"), 2).cast("decimal(18,2)").cast("string")).otherwise(F.col(c)).alias(f"{c}_value") for c in ("child", "parent", "base")])


def _merges(fabric: Fabric) -> DataFrame:
    return _detailed(fabric).filter("suggested_merge is not null").select("objectid", *[F.col(f"suggested_merge.{c}").alias(c) for c in ("c_name", "c_nationkey", "c_mktsegment", "c_acctbal")])


def _classified(fabric: Fabric) -> DataFrame:
    tree, child, parent, ancestor = merging.ranges(fabric, V_A)
    return conflicts.classify_changes(fabric.tables[TABLE], *[_states(fabric, s) for s in (tree.states_in_range(child, ancestor), tree.walk(child), tree.walk(ancestor), tree.walk(parent))])


def _without_orphan(fabric: Fabric) -> Fabric:
    """Without the version on its own root branch some states are on every version's walk."""
    return replace(fabric, versions=fabric.versions.filter("name <> 'V_ORPHAN'"))


def _prefix(fabric: Fabric) -> set[int]:
    return compaction.graduable_prefix(fabric.tree(), compaction.tips_of(fabric))


def _graduated(fabric: Fabric) -> FeatureTable:
    fabric = _without_orphan(fabric)
    return compaction.graduate_table(fabric.tables[TABLE], _states(fabric, _prefix(fabric))).table


def _pruned(fabric: Fabric) -> Fabric:
    fabric, tree = _without_orphan(fabric), fabric.tree()
    return compaction.prune(fabric, compaction.unreachable_states(tree, compaction.tips_of(fabric)) - compaction.locked_branches(fabric, tree))


def _plan(fabric: Fabric) -> dict[int, int]:
    tree = fabric.tree()
    return compaction.collapse_plan(tree, compaction.tips_of(fabric), compaction.locked_branches(fabric, tree))


def _ids(fabric: Fabric, states, column: str = "state_id") -> DataFrame:
    return _states(fabric, states).withColumnRenamed("state", column)


def _reconciled(fabric: Fabric, conflict_resolution: str = "favor_target", **options) -> Fabric:
    return merging.reconcile(fabric, V_A, merging.ReconcileOptions(conflict_resolution=conflict_resolution, **{"auto_merge": False} | options))[0]


def _merged_values(_) -> dict:
    """Given where both sides changed the same fields to the same values, so that there is nothing to suggest."""
    return {"c_name": "merged", "c_nationkey": 0, "c_mktsegment": "none", "c_acctbal": 0.0}


def _posted(fabric: Fabric, trim: bool = True) -> Fabric:
    ready = merging.add_to_lineage(fabric, 15, _states(fabric, fabric.tree().walk(10)))
    return merging.post(ready, V_A, trim=trim)[0]


def _rebased(fabric: Fabric) -> Fabric:
    return merging.rebase(fabric, V_A, unsafe_experimental=True, accept_conflicts=True)[0]


def _reverted(fabric: Fabric) -> FeatureTable:
    return merging.revert(fabric, V_A, [(TABLE, i) for i in range(1, 200)])[0].tables[TABLE]


def _changed_features(fabric: Fabric) -> DataFrame:
    ours, _, _ = _range(fabric, V_A)
    return changes.changed_features(fabric.tables[TABLE], changes.all_changes(fabric, ours), versioned.read_version(fabric, TABLE, V_A))


_PLANS = {
    "versioned_read_default": _read("sde.DEFAULT"),
    "versioned_read_v_a": _read(V_A),
    "versioned_read_v_b": _read(V_B),
    "versioned_read_v_orphan": _read(V_ORPHAN),
    "versioned_read_filtered": _read(V_A, where="c_acctbal > 5000 and c_mktsegment = 'BUILDING'"),
    "versioned_read_projected": _read(V_B, out_fields=["objectid", "c_name"]),
    "versioned_read_topk": _read(V_A, order_by=["c_acctbal desc", "objectid"], limit=25, offset=5),
    "versioned_read_default_order": _read(V_A, limit=20, offset=3),
    "base_read": lambda f: versioned.read_options(f.tables[TABLE].base, where="c_nationkey < 5"),
    "base_get_features": lambda f: versioned.get_features(f.tables[TABLE], [1, 5, 700, 10**9]),
    "base_count": lambda f: f.tables[TABLE].base.agg(F.count(F.lit(1)).alias("n_rows")),
    "all_versions_visible_signature": _signatures,
    "closure_read_v_a": lambda f: versioned.read_closure(f, TABLE, V_A),
    "closure_read_v_b": lambda f: versioned.read_closure(f, TABLE, V_B),
    "rows_at_state": lambda f: versioned.rows_at_state(f.tables[TABLE], 6, _states(f, f.tree().walk(15))),
    "feature_at_state": lambda f: versioned.feature_at_state(f.tables[TABLE], 7, 6, _states(f, f.tree().walk(15))),
    "list_versions": lambda f: list_versions(f.versions).select("owner", "name", "parent_name", "state_id"),
    "state_walks": _walks,
    "common_ancestors": _ancestors,
    "states_in_range": lambda f: _ids(f, f.tree().states_in_range(15, 6)),
    "external_references": lambda f: merging.external_references(f, "editor", "V_A", list(range(1, 16))),
    "changes_v_a": lambda f: changes.all_changes(f, _range(f, V_A)[0]),
    "changes_parent": lambda f: changes.all_changes(f, _range(f, V_A)[1]),
    "changes_summary": lambda f: changes.changes_summary(changes.all_changes(f, _range(f, V_A)[0])),
    "changed_features": _changed_features,
    "version_stats": lambda f: changes.version_stats(f, _states(f, f.tree().walk(15))),
    "count_changes": lambda f: changes.count_changes(f, _range(f, V_A)[0]),
    "conflicts_rowlevel": _conflicts,
    "conflicts_fieldlevel": _fields,
    "conflict_summary": lambda f: conflicts.conflict_summary(_conflicts(f)),
    "suggested_merges": _merges,
    "changed_objectids_except": lambda f: conflicts.changed_object_ids(f.tables[TABLE], *_range(f, V_A)[:2]),
    "deleted_objectids": lambda f: conflicts.deleted_object_ids(f.tables[TABLE], _range(f, V_A)[0]),
    "objectids_with_adds": lambda f: conflicts.object_ids_with_adds(f.tables[TABLE], _range(f, V_A)[0]),
    "objectids_present_in_parent": lambda f: conflicts.object_ids_present(f.tables[TABLE], _states(f, f.tree().walk(10))),
    "classify_rebase": _classified,
    "graduable_prefix": lambda f: _ids(f, _prefix(_without_orphan(f))),
    "graduable_prefix_pairs": lambda f: compaction.prefix_pairs(versioned.lineage_pairs(f.spark, f.tree(), compaction.tips_of(_without_orphan(f)))).withColumnRenamed("state", "state_id"),
    "unreachable_states": lambda f: _ids(f, compaction.unreachable_states(f.tree(), compaction.tips_of(_without_orphan(f)))),
    "locked_branches": lambda f: _ids(f, compaction.locked_branches(f, f.tree())),
    "collapse_plan": lambda f: f.spark.createDataFrame(sorted(_plan(f).items()), "child long, anchor long"),
    "closure_census": lambda f: compaction.closure_census(f, f.tree()),
    "preconditions": lambda f: compaction.preconditions(f.states, f.lineages, f.versions),
    "missing_self_rows": lambda f: compaction.missing_self_rows(f.states, f.lineages),
    "graduate_base": lambda f: _graduated(f).base,
    "graduate_adds": lambda f: _graduated(f).adds,
    "graduate_deletes": lambda f: _graduated(f).deletes,
    "prune_adds": lambda f: _pruned(f).tables[TABLE].adds,
    "prune_deletes": lambda f: _pruned(f).tables[TABLE].deletes,
    "prune_lineages": lambda f: _pruned(f).lineages,
    "collapse_adds": lambda f: compaction.collapse(f, _plan(f)).tables[TABLE].adds,
    "collapse_deletes": lambda f: compaction.collapse(f, _plan(f)).tables[TABLE].deletes,
    "collapse_states": lambda f: compaction.collapse(f, _plan(f)).states,
    "collapse_lineages": lambda f: compaction.collapse(f, _plan(f)).lineages,
    "reconcile_adds": lambda f: _reconciled(f).tables[TABLE].adds,
    "reconcile_deletes": lambda f: _reconciled(f).tables[TABLE].deletes,
    "reconcile_lineages": lambda f: _reconciled(f).lineages,
    "post_trim_visible": lambda f: versioned.read_version(_posted(f), TABLE, "sde.DEFAULT"),
    "rebase_visible": lambda f: versioned.read_version(_rebased(f), TABLE, V_A),
    "rebase_adds": lambda f: _rebased(f).tables[TABLE].adds,
    "rebase_deletes": lambda f: _rebased(f).tables[TABLE].deletes,
    "rebase_lineages": lambda f: _rebased(f).lineages,
    "reconcile_merge_adds": lambda f: _reconciled(f, "favor_edit", auto_merge=True, get_merged_values=_merged_values).tables[TABLE].adds,
    "reconcile_favor_edit_adds": lambda f: _reconciled(f, "favor_edit").tables[TABLE].adds,
    "reconcile_favor_edit_deletes": lambda f: _reconciled(f, "favor_edit").tables[TABLE].deletes,
    "post_visible": lambda f: versioned.read_version(_posted(f, False), TABLE, "sde.DEFAULT"),
    "post_deletes": lambda f: _posted(f, False).tables[TABLE].deletes,
    "shadow_markers": lambda f: merging.shadow_markers(f, f.tables[TABLE], 15, 6),
    "revert_adds": lambda f: _reverted(f).adds,
    "revert_deletes": lambda f: _reverted(f).deletes,
}


def _query(plan):
    return lambda spark, sf_dir: plan(load_fabric(spark, sf_dir))


QUERIES = {name: _query(plan) for name, plan in _PLANS.items()}
