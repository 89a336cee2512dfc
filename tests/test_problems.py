import datetime as dt
import random

import pytest

from verdigris.operators.changefeed import current_rows, version_outcomes
from verdigris.operators.datadiff import record_differences
from verdigris.operators.hierarchy import all_descendants, ancestors_of, full_hierarchy, hierarchy_faults, join_block, links_of, resolve
from verdigris.operators.hotkeys import dense_counts, heavy_key_counts, key_counts
from verdigris.operators.orphans import orphan_counts, orphan_references, state_references

T = dt.datetime
STATES = "state_id long, parent_state_id long, lineage_name long, removed_at timestamp, loaded_at timestamp, key string"


def states(spark, rows):
    return spark.createDataFrame([(s, p, l, r, t, "k") for s, p, l, r, t in rows], STATES)


# --- references ---


def orphans(spark, locks=(), versions=(), lineages=(), parents=()):
    frames = (
        spark.createDataFrame(list(locks), "sde_id int, state_id long, lock_time timestamp, key string"),
        spark.createDataFrame(list(versions), "name string, owner string, state_id long, creation_time timestamp, period string"),
        spark.createDataFrame(list(lineages), "lineage_name long, lineage_id long, added_at timestamp, ref_key string"),
    )
    return orphan_references(state_references(*frames), states(spark, parents))


def test_orphans(spark):
    may, june = T(2024, 5, 3), T(2024, 6, 3)
    parents = [(1, 0, 1, None, may), (2, 0, 1, None, may), (2, 0, 1, june, june), (3, 0, 1, june, may), (3, 0, 1, None, june), (4, 0, 1, june, may), (4, 0, 1, None, may), (5, 0, 1, june, None), (None, 0, 1, None, may)]
    found = orphans(
        spark,
        locks=[(1, 1, may, ""), (2, 2, may, ""), (2, 2, may, ""), (3, 3, may, ""), (4, 99, None, ""), (5, None, may, "")],
        versions=[("A", "sde", 4, may, ""), (None, None, 5, None, ""), ("B", "x", None, may, "")],
        lineages=[(7, 99, june, ""), (None, 99, june, "")],
        parents=parents,
    )
    got = {tuple(r) for r in found.collect()}
    assert got == {
        ("sde_state_locks", "2", 2, "2024-05", 2),
        ("sde_state_locks", "4", 99, "unknown", 1),
        ("sde_versions", "sde.A", 4, "2024-05", 1),
        ("sde_versions", ".", 5, "unknown", 1),
        ("sde_state_lineages", "7", 99, "2024-06", 1),
        ("sde_state_lineages", None, 99, "2024-06", 1),
    }
    assert {tuple(r) for r in orphan_counts(found).collect()} >= {("sde_state_lineages", "2024-06", 2, 1)}
    assert orphans(spark).collect() == []


# --- change feed ---

ADDS = "objectid long, sde_state_id long, val string, edit_seq long, state long"
DELETES = "sde_deletes_row_id long, sde_state_id long, deleted_at long, edit_seq long, image long"
VERSIONS = "name string, owner string, state_id long, loaded_at timestamp"


def expected(adds, deletes, lineage):
    """The stated rule, object by object."""
    rows, outcomes = {}, {}
    for o in {a[0] for a in adds if a[0] is not None}:
        own = [a for a in adds if a[0] == o and a[1] in lineage]
        base = [a for a in adds if a[0] == o and a[1] == 0]
        shown = None
        if own:
            top = max(a[1] for a in own)
            if not any(d[0] == o and d[1] in lineage and d[1] > top for d in deletes):
                shown = (top, max(a[3] for a in own if a[1] == top))
        elif base and not any(d[0] == o and d[2] in lineage for d in deletes):
            shown = (0, max(a[3] for a in base))
        if shown:
            rows[o] = shown
        if shown and shown[0]:
            outcomes[o] = ("update" if base else "insert", shown[1])
        elif base and not shown:
            outcomes[o] = ("delete", 0)
    return rows, outcomes


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("block_nodes", [10_000, 5])
def test_feed_against_the_rule(spark, seed, block_nodes):
    if block_nodes == 5 and seed > 0:
        pytest.skip("one seed of the distributed walk is enough")
    rng = random.Random(seed)
    tree = [(0, 0, 0, None, None)] + [(s, rng.choice([0, *range(1, s)]) if s % 3 else s - 1, 1, None, None) for s in range(1, 15)]
    parents = {s: p for s, p, *_ in tree}
    adds = [(rng.randrange(1, 9), rng.randrange(0, 16), "v", i, 5) for i in range(60)]
    deletes = [(rng.randrange(1, 9), rng.randrange(0, 16), rng.randrange(0, 16), 100 + i, 5) for i in range(20)]
    adds += [adds[0], (None, 3, "v", 1, 1), (3, None, "v", 1, 1)]
    deletes += [deletes[0], (None, 3, 3, 1, 1), (2, None, None, 1, 1)]
    lineage, at = set(), 14
    while at:
        lineage.add(at)
        at = parents[at]
    a, d, s = spark.createDataFrame(adds, ADDS), spark.createDataFrame(deletes, DELETES), states(spark, tree * 2)
    v = spark.createDataFrame([("DEFAULT", "sde", 3, T(2024, 1, 1)), ("DEFAULT", "sde", 14, T(2024, 2, 1)), ("DEFAULT", "x", 2, T(2025, 1, 1))], VERSIONS)
    rows, outcomes = expected([x for x in adds if x[1] is not None], deletes, lineage)
    got = current_rows(a, d, s, 14, block_nodes=block_nodes).collect()
    assert {r.objectid: (r.state, r.image) for r in got} == rows and len(got) == len(rows)
    assert {r.objectid: (r.outcome, r.edit_seq) for r in version_outcomes(a, d, s, v, block_nodes=block_nodes).collect()} == outcomes


def test_feed_of_nothing(spark):
    empty = [spark.createDataFrame([], k) for k in (ADDS, DELETES, STATES, VERSIONS)]
    assert version_outcomes(*empty).collect() == []
    base = spark.createDataFrame([(1, 0, "v", 9, 0)], ADDS)
    assert [tuple(r) for r in current_rows(base, empty[1], empty[2], None).collect()] == [(1, 0, 9)]
    dangling = current_rows(spark.createDataFrame([(1, 77, "v", 9, 0)], ADDS), empty[1], empty[2], 77)
    assert [tuple(r) for r in dangling.collect()] == [(1, 77, 9)]


# --- hot keys ---


@pytest.mark.parametrize("most", [1000, 3])
def test_key_counts(spark, most):
    sizes = {"block_keys": most, "split_keys": most}
    rows = [(7, i % 10, 1) for i in range(900)] + [(i, i, 1) for i in range(20)] + [(None, 1, 1), (None, 2, 1), (-5, None, 1), (-5, None, 1), (1 << 40, 3, 1)]
    df = spark.createDataFrame(rows, "k long, v long, key long").repartition(5)
    want = {}
    for k, v, _ in rows:
        if k is not None:
            n, seen = want.setdefault(k, [0, set()])
            want[k][0] += 1
            if v is not None:
                seen.add(v)
    want = {k: (n, len(s)) for k, (n, s) in want.items()}
    assert {r.key_id: (r.n_rows, r.n_distinct) for r in key_counts(df, "k", "v", **sizes).collect()} == want
    assert {r.key_id: (r.n_rows, r.n_distinct) for r in heavy_key_counts(df, "k", "v", 200, **sizes).collect()} == {k: n for k, n in want.items() if n[0] * 200 >= len(rows)}


def test_key_counts_of_nothing(spark):
    df = spark.createDataFrame([], "k long, v long")
    assert key_counts(df, "k", "v").collect() == [] and heavy_key_counts(df, "k", "v").collect() == []
    nulls = spark.createDataFrame([(None, 1)], "k long, v long")
    assert dense_counts(nulls, "k", 0).collect() == [] and heavy_key_counts(nulls, "k", "v").collect() == []


# --- hierarchies ---


def chain_end(parents, node, root=0):
    """kind, end, depth by walking."""
    seen, at = [], node
    while True:
        if at == root or parents.get(at, 0) is None:
            return "root", at, len(seen)
        if at not in parents:
            return "detached", at, len(seen)
        if at in seen:
            loop = seen[seen.index(at) :]
            first = seen.index(at)
            return ("cycle", min(loop), len(loop)) if first == 0 else ("below", min(loop), first)
        seen.append(at)
        at = parents[at]


def random_forest(seed, n=120):
    rng = random.Random(seed)
    ids = rng.sample(range(1, 5 * n), n)
    parents = {0: 0} | {s: rng.choice([0, *ids]) if rng.random() < 0.5 else ids[max(0, i - rng.randrange(1, 4))] for i, s in enumerate(ids)}
    for s in rng.sample(ids, 6):
        parents[s] = rng.choice([99_999, s, None, rng.choice(ids)])
    return parents


@pytest.mark.parametrize(("seed", "n", "block"), [(1, 120, 1000), (2, 60, 40), (3, 40, 5)])
def test_resolve(spark, seed, n, block):
    parents = random_forest(seed, n)
    links = spark.createDataFrame(list(parents.items()), "node long, parent long")
    got = resolve(links, block_nodes=block).collect()
    assert {r.node: (r.kind, r.end_id, r.depth) for r in got} == {n: chain_end(parents, n) for n in parents} and len(got) == len(parents)


@pytest.mark.parametrize("block_nodes", [1000, 5])
def test_paths_and_descendants(spark, block_nodes):
    parents = random_forest(7, min(40, 3 * block_nodes))
    rows = spark.createDataFrame([(n, p, "x") for n, p in parents.items()] * 2 + [(None, 3, "x")], "state_id long, parent_state_id long, node string")
    got = {r.node_id: r for r in full_hierarchy(rows, "state_id", "parent_state_id", block_nodes=block_nodes).collect()}
    assert set(got) == set(parents)
    rooted = {n: chain_end(parents, n)[2] for n in parents if chain_end(parents, n)[:2] == ("root", 0)}
    walks = {}
    for n in rooted:
        path = [n]
        while path[-1] != 0:
            path.append(parents[path[-1]])
        walks[n] = path[::-1]
    for n, r in got.items():
        assert r.path == walks.get(n)
        assert r.n_descendants == (sum(n in w[:-1] for w in walks.values()) if n in walks else None)


@pytest.mark.parametrize("block_nodes", [1000, 5])
def test_unrooted_paths_and_descendants(spark, block_nodes):
    parents = random_forest(7, min(40, 2 * block_nodes)) | {9001: 9003, 9002: 9001, 9003: 9002, 9004: 9002, 9005: 9004, 9006: 9005, 9007: 9007, 9008: 9007, 9010: 99_999, 9011: 9010, 9020: None, 9021: 9020, 9022: 9021}
    rows = spark.createDataFrame([(n, p) for n, p in parents.items()] * 2, "state_id long, parent_state_id long")
    got = {r.node_id: r for r in full_hierarchy(rows, "state_id", "parent_state_id", block_nodes=block_nodes, unrooted=True).collect()}
    assert set(got) == set(parents)
    above = {}
    for n in parents:
        kind, end, depth = chain_end(parents, n)
        chain = [n]
        while chain[-1] != 0 and parents.get(parents[chain[-1]], -1) != -1 and parents[chain[-1]] not in chain:
            chain.append(parents[chain[-1]])
        above[n] = set(chain[1:])
        shown = chain[: depth + 1] if kind == "below" else chain
        assert (got[n].kind, got[n].root_id, got[n].depth, got[n].path) == (kind, end, depth, shown[::-1])
    pairs = {(a, n) for n in above for a in above[n]}
    found = all_descendants(rows, "state_id", "parent_state_id", block_nodes=block_nodes).collect()
    assert {tuple(r) for r in found} == pairs and len(found) == len(pairs)
    assert {n: r.n_descendants for n, r in got.items()} == {n: sum(a == n for a, _ in pairs) for n in parents}


@pytest.mark.parametrize("block_nodes", [1000, 5])
def test_faults(spark, block_nodes):
    tree = [(0, 0, 0), (1, 0, 1), (2, 1, 1), (3, 2, 1), (4, 1, 4), (5, 4, 4), (10, 11, 7), (11, 10, 7), (12, 10, 7), (20, 98, 8), (21, 20, 8), (30, 30, 9)]
    s = states(spark, [(a, b, c, None, None) for a, b, c in tree] * 2)
    closure = spark.createDataFrame([(1, 3), (1, 2), (1, 0), (1, 5), (1, 5), (4, 1), (4, 2), (4, 77), (7, 1), (55, 1), (1, 10), (None, 1), (1, None)], "lineage_name long, lineage_id long")
    got = hierarchy_faults(s, closure, block_nodes=block_nodes)
    assert {tuple(r) for r in got.collect()} == {
        ("cycle", 10, 10, 2), ("cycle", 11, 10, 2), ("below_cycle", 12, 10, 1), ("detached", 20, 98, 1), ("detached", 21, 98, 2), ("cycle", 30, 30, 1),
        ("foreign_lineage", 1, 5, 3), ("foreign_lineage", 4, 2, 2),
    }
    assert got.count() == 8


def test_links_without_locality(spark):
    """One chain through shuffled ids: no block holds two neighbours, and still every level shrinks."""
    ids = random.Random(5).sample(range(1, 10_000), 60)
    parents = dict(zip(ids, [0, *ids]))
    links = spark.createDataFrame([(0, 0), *parents.items()], "node long, parent long")
    got = {r.node: (r.kind, r.end_id, r.depth) for r in resolve(links, block_nodes=16).collect()}
    assert got == {0: ("root", 0, 0)} | {n: ("root", 0, i + 1) for i, n in enumerate(ids)}


def test_blocks_join_links():
    """The disjoint-set forest of one block against walking."""
    import numpy as np

    for seed in range(5):
        parents = random_forest(seed, 200)
        node = np.array(list(parents), dtype=np.int64)
        known = np.array([p is not None and n != 0 for n, p in parents.items()])
        parent = np.array([p or 0 for p in parents.values()], dtype=np.int64)
        order, _, top, steps, tangled, knot = join_block(node, parent, np.ones(len(node), dtype=np.int64), known)
        ids = node[order]
        for i, n in enumerate(ids.tolist()):
            kind, end, depth = chain_end(parents, n)
            assert tangled[i] == (kind in ("cycle", "below"))
            if kind in ("root", "detached"):
                assert steps[i] == depth - (kind == "detached") and (kind == "detached" or ids[top[i]] == end)
        loops = {chain_end(parents, n)[1] for n in parents if chain_end(parents, n)[0] == "cycle"}
        assert {chain_end(parents, n)[1] for n in ids[knot].tolist()} == loops and knot.sum() == len(loops)


def test_hierarchy_of_nothing(spark):
    empty, closure = states(spark, []), spark.createDataFrame([], "lineage_name long, lineage_id long")
    assert hierarchy_faults(empty, closure).collect() == [] and full_hierarchy(empty, "state_id", "parent_state_id").collect() == []


def test_ancestors(spark):
    rows = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 2), (8, 9), (9, 8), (5, 66)], "s long, p long")
    links = links_of(rows, "s", "p")
    for bound in (100, 3):
        walk = lambda tip: sorted(r.state for r in ancestors_of(links, tip, 0, bound).collect())  # noqa: B023, E731
        assert [walk(t) for t in (3, 0, None, 9, 5, 777)] == [[1, 2, 3], [], [], [8, 9], [5], [777]]


# --- differences ---

FEATURES = "side string, table_name string, registration_id int, objectid long, state_id long, change_type string, feature string, exported_at timestamp, field string"


def test_differences(spark):
    def row(side, key, change, feature, minute=0):
        return (side, "t", 19, key, 1, change, feature, T(2025, 1, 1, 0, minute), "f")

    base = '{"id":1,"attributes":{"A":1.5,"B":"x","EDITED_ON":"2025-01-01T10:00:00Z","N":null},"geometry":{"type":"Point","coordinates":[1,2]}}'
    pairs = {
        1: (base, '{ "id":1.0, "geometry":{"coordinates":[1.0,2.0000000001],"type":"point"}, "attributes":{"b":"x","a":1.50000000005e0,"edited_on":"2025-01-01T12:00:00.000+02:00","M":null}}'),
        2: (base, base.replace('"x"', '"X"').replace("1.5", "1.6")),
        3: (base, None),
        4: (base, base.replace("[1,2]", "[1,3]").replace("10:00", "11:00")),
        5: (base, base.replace('"N":null', '"N":""')),
        6: (base, base.replace('"B":"x"', '"B":5')),
        7: ("{broken", "{broken"),
        8: ("{broken", base),
        9: (base, base.replace('{"type":"Point","coordinates":[1,2]}', "null")),
        10: (None, None),
        11: (base, '{"attributes":{"A":1.5,"B":"x","EDITED_ON":"2025-01-01T10:00:00Z"},"geometry":{"type":"Point","coordinates":[1,2,3]}}'),
    }
    rows = [row(s, k, "update" if s == "origin" else "UPDATE", f) for k, both in pairs.items() for s, f in zip(("origin", "replica"), both)]
    rows += [row("origin", 20, "insert", base), row("replica", 21, "delete", None), row("origin", 22, "insert", base), row("replica", 22, "delete", base), row("other", 23, "x", base)]
    rows += [row("replica", 22, "update", base, 5), row("origin", None, None, None), row("replica", None, "insert", None), rows[0]]
    got = record_differences(spark.createDataFrame(rows, FEATURES), ["registration_id", "objectid", "state_id"])
    assert got.columns == ["registration_id", "objectid", "state_id", "diff_kind", "field"]
    assert sorted((r.objectid or -1, r.diff_kind, r.field) for r in got.collect()) == sorted(
        [
            (2, "value", "A"), (2, "value", "B"), (3, "value", "FEATURE"), (4, "value", "GEOMETRY"), (4, "value", "EDITED_ON"), (5, "value", "N"), (6, "value", "B"),
            (8, "value", "FEATURE"), (9, "value", "GEOMETRY"), (11, "value", "GEOMETRY"), (20, "only_origin", ""), (21, "only_replica", ""), (22, "value", "CHANGE_TYPE"),
            (-1, "value", "CHANGE_TYPE"),
        ]
    )
    assert record_differences(spark.createDataFrame([], FEATURES), ["registration_id", "objectid", "state_id"]).collect() == []


def test_whole_geometries_differ(spark):
    def row(side, key, geometry):
        return (side, "t", 19, key, 1, "update", '{"id":1,"attributes":{"A":1},"geometry":%s}' % geometry, T(2025, 1, 1), "f")

    bag = '{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[1,2]},{"type":"GeometryCollection","geometries":[{"type":"Point","coordinates":[3,4]}]}]}'
    pairs = {
        1: (bag, '{ "geometries":[{"coordinates":[1.0,2.0000000001],"type":"point"},{"geometries":[{"type":"POINT","coordinates":[3,4e0]}],"type":"geometrycollection"}],"type":"GEOMETRYCOLLECTION"}'),
        2: (bag, bag.replace("[3,4]", "[3,5]")),
        3: (bag, bag.replace('"Point","coordinates":[1,2]', '"LineString","coordinates":[[1,2],[1,3]]')),
        4: (bag, bag.replace('{"type":"Point","coordinates":[1,2]},', "")),
        5: ('"POINT(1 2)"', '"POINT(1 3)"'),
        6: ('"POINT(1 2)"', '"POINT(1 2)"'),
        7: ('"POINT(1 2)"', '{"type":"Point","coordinates":[1,2]}'),
        8: ('{"type":"Point","coordinates":[1,2],"crs":"EPSG:1"}', '{"type":"Point","coordinates":[1,2],"crs":"EPSG:2"}'),
        9: ('{"type":"Point","coordinates":[1,2]}', '{"coordinates":[1,2.0],"type":"Point"}'),
        10: ('{"type":"Point"}', '{"type":"Line"}'),
        11: ("[1,2]", "[1,3]"),
        12: ('{"wkt":"POINT(1 2)"}', '{"wkt":"POINT(1 3)"}'),
        13: ("5", "6"),
    }
    rows = [row(s, k, g) for k, both in pairs.items() for s, g in zip(("origin", "replica"), both)]
    got = record_differences(spark.createDataFrame(rows, FEATURES), ["registration_id", "objectid", "state_id"]).collect()
    assert sorted((r.objectid, r.diff_kind, r.field) for r in got) == [(k, "value", "GEOMETRY") for k in (2, 3, 4, 5, 7, 8, 10, 11, 12, 13)]
