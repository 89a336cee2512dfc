import pytest

from tests.model import random_model
from verdigris.operators import compaction
from verdigris.operators import fabric as fabric_module
from verdigris.operators.compaction import CompactionRefused
from verdigris.operators.spreadtree import SpreadTree
from verdigris.operators.fabric import BrokenLineageError, Fabric, FeatureTable, StateTree, state_set
from verdigris.operators.versioned import read_states, read_version


def to_fabric(spark, m):
    states = [(s, p, s) for s, p in m.parents.items()]
    lineages = {(0, 0)} | {(s, x) for s in m.parents for x in m.walk(s) | {0}}
    versions = [("sde", n, None if n == "DEFAULT" else "sde.DEFAULT", t) for n, t in m.tips.items()]
    table = FeatureTable(
        "t",
        spark.createDataFrame(sorted(m.base.items()), "objectid long, val string"),
        spark.createDataFrame([(o, s, v) for (o, s), v in sorted(m.adds.items())], "objectid long, sde_state_id long, val string"),
        spark.createDataFrame(m.deletes, "sde_deletes_row_id long, sde_state_id long, deleted_at long"),
    )
    return Fabric(
        spark.createDataFrame(states, "state_id long, parent_state_id long, lineage_name long"),
        spark.createDataFrame(sorted(lineages), "lineage_name long, lineage_id long"),
        spark.createDataFrame(versions, "owner string, name string, parent_name string, state_id long"),
        spark.createDataFrame([(i, s) for i, s in enumerate(m.locked)], "sde_id int, state_id long"),
        {"t": table},
    )


def seen(fabric, tip):
    tree = fabric.tree()
    return {r.objectid: r.val for r in read_states(fabric.tables["t"], state_set(fabric.spark, tree.walk(tip))).collect()}


def test_one_pass_collapse_equals_pair_by_pair():
    """The plan and the per-anchor rule against folding one state after another, in plain Python."""
    folded = 0
    for seed in range(400):
        m = random_model(seed, 24)
        tree, tips = StateTree(dict(m.parents)), sorted(set(m.tips.values()))
        locked = set().union(*[m.walk(s) | tree.descendants(s) for s in m.locked]) if m.locked else set()
        m.locked = locked
        plan = compaction.collapse_plan(tree, tips, locked)
        before = {t: m.visible(t) for t in tips}
        runs = plan | {a: a for a in plan.values()}
        last = {}
        for o, s in [*m.adds, *[(d, s) for d, s, _ in m.deletes if s]]:
            if s in runs:
                last[o, runs[s]] = max(s, last.get((o, runs[s]), 0))
        adds = {(o, runs.get(s, s)): v for (o, s), v in m.adds.items() if s not in runs or last[o, runs[s]] == s}
        deletes = sorted((d, runs.get(s, s), plan.get(at, at)) for d, s, at in m.deletes if s not in runs or last[d, runs[s]] == s)
        m.collapse_pairwise()
        assert (adds, deletes) == (m.adds, sorted(m.deletes)), seed
        assert {s: p for s, p in m.parents.items()} == {s: plan.get(p, p) for s, p in tree.parents.items() if s not in plan}
        assert {t: m.visible(t) for t in tips} == before
        folded += bool(plan)
    assert folded > 100


@pytest.mark.parametrize("seed", [3, 11])
def test_compaction_keeps_what_versions_see(spark, seed):
    m = random_model(seed, 24)
    fabric = to_fabric(spark, m)
    want = {n: m.visible(t) for n, t in m.tips.items()}
    after, result = compaction.compact(fabric, True, graduate=True, collapse_lineages=True)
    assert {n: seen(after, t) for n, t in m.tips.items()} == want
    left = {r.state_id for r in after.states.collect()}
    assert 0 in left and {r.parent_state_id for r in after.states.collect()} <= left and set(m.tips.values()) <= left
    assert {r.sde_state_id for r in after.tables["t"].adds.collect()} <= left
    assert result.phases == ("graduate", "prune", "collapse")


def test_refusals(spark):
    fabric = to_fabric(spark, random_model(3))
    for options in ({}, {"acknowledge_experimental_unsafe": True, "prune_states": False}):
        with pytest.raises(CompactionRefused):
            compaction.compact(fabric, **options)
    broken = Fabric(fabric.states.filter("state_id <> 0"), fabric.lineages, fabric.versions, fabric.locks, fabric.tables)
    with pytest.raises(CompactionRefused, match="missing_root_state"):
        compaction.compact(broken, True)


def test_tree():
    tree = StateTree({0: 0, 1: 0, 2: 1, 3: 2, 4: 1, 9: 0, 20: 21, 21: 20, 30: 99})
    assert tree.walk(3) == [3, 2, 1] and tree.walk(0) == [] and tree.walk(None) == []
    assert tree.states_in_range(3, 1) == [2, 3] and tree.common_ancestor(3, 4) == 1 and tree.common_ancestor(3, 9) == 0 and tree.common_ancestor(0, 3) == 0
    assert tree.descendants(1) == {2, 3, 4} and tree.reachable([3]) == {1, 2, 3}
    for tip in (20, 30, 77):
        with pytest.raises(BrokenLineageError):
            tree.walk(tip)


def test_trees_beyond_the_bound(spark, monkeypatch):
    """With the bound at 5 all sets are tables, and everything gives the same as with the tree on the driver."""
    m = random_model(3)
    fabric = to_fabric(spark, m)
    tree, tips = fabric.tree(), compaction.tips_of(fabric)
    locked = compaction.locked_branches(fabric, tree)
    want = (
        [set(tree.walk(t)) for t in tips], tree.common_ancestor(tips[0], tips[-1]), compaction.graduable_prefix(tree, tips), compaction.unreachable_states(tree, tips), locked,
        compaction.collapse_plan(tree, tips, locked), sorted(map(tuple, compaction.closure_census(fabric, tree).collect())), sorted(map(tuple, read_version(fabric, "t", sorted(m.tips)[0]).collect())),
    )
    done, result = compaction.compact(to_fabric(spark, m), True, graduate=True, collapse_lineages=True)
    monkeypatch.setattr(fabric_module, "INDEX_NODES", 5)
    spread = fabric.tree()
    assert isinstance(spread, SpreadTree)
    ids = lambda rows: {r.state for r in rows.collect()}
    gave = (
        [ids(spread.walk(t)) for t in tips], spread.common_ancestor(tips[0], tips[-1]), ids(compaction.graduable_prefix(spread, tips)), ids(compaction.unreachable_states(spread, tips)),
        ids(compaction.locked_branches(fabric, spread)), {r.state: r.anchor for r in compaction.collapse_plan(spread, tips, compaction.locked_branches(fabric, spread)).collect()},
        sorted(map(tuple, compaction.closure_census(fabric, spread).collect())), sorted(map(tuple, read_version(fabric, "t", sorted(m.tips)[0]).collect())),
    )
    assert gave == want
    again, same = compaction.compact(to_fabric(spark, m), True, graduate=True, collapse_lineages=True)
    assert same == result and sorted(map(tuple, again.states.collect())) == sorted(map(tuple, done.states.collect()))


def test_broken_chains_beyond_the_bound(spark):
    broken = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (20, 21), (21, 20), (30, 99), (5, None)], "state_id long, parent_state_id long")
    tree = StateTree.of(broken, 3)
    for tip in (20, 30, 77):
        with pytest.raises(BrokenLineageError):
            tree.walk(tip)
    assert tree.common_ancestor(2, 5) == 0 and tree.walk(0).isEmpty() and tree.walk(None).isEmpty()
