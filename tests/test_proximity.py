import struct

import numpy as np
import pytest

from verdigris.functions.kdtree import Splits, chord, close_pairs, degree_boxes, plane_vectors, unit_vectors
from verdigris.operators.proximity import _blocks, near_and_inside, near_operations

OPS = "op_id long, op_type string, table_name string, object_id long, previous_attributes string, new_attributes string, new_geometry string, srid int, extra string, site long"
TABLES = "name string, physical_name string, schema_name string, shape_field_name string, registration_id int, srid int, x double"
ZONES = "zone_id long, srid int, boundary string, op_id long"


@pytest.fixture
def tables(spark):
    return spark.createDataFrame(
        [("Marks", "cad.dbo.MARKS", "dbo", "SHAPE", 21, 1, 0.0), ("Notes", "cad.dbo.NOTES", "dbo", None, 22, 1, 0.0), ("Wells", "env.dbo.WELLS", "dbo", "Geom", 23, 2, 0.0)], TABLES
    )


def op(op_id, table, obj, geometry=None, attributes=None, srid=None):
    return (op_id, "insert", table, obj, None, attributes, geometry, srid, "x", 7)


def run(spark, tables, ops, zones=(), **options):
    found = near_operations(spark.createDataFrame(ops, OPS), tables, spark.createDataFrame(list(zones), ZONES), **options)
    assert found.columns == ["kind", "key_a", "key_b"]
    return {tuple(r) for r in found.collect()}


def test_located_forms_and_pairs(spark, tables):
    ops = [
        op(1, "marks", 1, "POINT (10 10)"),
        op(1, "marks", 1, "POINT (10 10)"),  # a repeat
        op(2, "CAD.DBO.marks", 2, '{"type":"Point","coordinates":[13,14,9]}'),  # exactly 5 away
        op(3, "Marks", 1, "POINT (10 11)"),  # the same object as 1
        op(4, "Marks", 4, None, '{"shape":{"type":"Point","coordinates":[10,9]}}'),
        op(5, "Wells", 1, "POINT (10 10)"),  # another srid
        op(6, "Wells", 9, struct.pack("<BIdd", 1, 1, 10.0, 10.0).hex(), srid=1),
        op(7, "Notes", 1, "POINT (10 10)"),
        op(8, None, 1, "POINT (10 10)"),
        op(9, "Marks", None, "POINT (10 10)"),
        op(10, "Marks", None, "POINT (10 10)"),
        op(11, "Marks", 11, ""),
        op(12, "Marks", 12, "POINT (0 0)"),
        op(None, "Marks", 13, "POINT (10 10)"),
        op(14, "Marks", 14, "POINT (18.01 10)"),
    ]
    zones = [(1, 1, "POLYGON((0 0, 20 0, 20 20, 0 20, 0 0), (9 8, 11 8, 11 9.5, 9 9.5, 9 8))", 0), (2, 2, "POLYGON((0 0, 20 0, 20 20, 0 0))", 0), (3, 1, "nonsense", 0), (4, 1, None, 0), (None, 1, "POLYGON((0 0, 20 0, 20 20, 0 0))", 0)]
    got = run(spark, tables, ops, zones)
    near = {(1, 2), (1, 4), (1, 6), (1, 9), (1, 10), (2, 3), (2, 6), (2, 9), (2, 10), (3, 4), (3, 6), (3, 9), (3, 10), (4, 6), (4, 9), (4, 10), (6, 9), (6, 10), (9, 10)}
    assert {k for k in got if k[0] == "near"} == {("near", *p) for p in near} - {("near", 2, 4)}
    assert {k for k in got if k[0] == "inside"} == {("inside", 1, o) for o in (1, 2, 3, 6, 9, 10, 14)}


def test_empty_tables(spark, tables):
    assert run(spark, tables, []) == set()
    assert run(spark, tables.limit(0), [op(1, "marks", 1, "POINT (1 1)")], [(1, 1, "POLYGON((0 0, 2 0, 2 2, 0 0))", 0)]) == set()


@pytest.mark.parametrize(("leaf_points", "seed", "task_pairs"), [(40, 1, 10**9), (7, 2, 10**9), (400, 3, 2000)])
def test_small_leaves_and_blocks_equal_brute_force(spark, leaf_points, seed, task_pairs):
    rng = np.random.default_rng(seed)
    n = 400
    x = np.concatenate([rng.uniform(0, 200, n), rng.normal(50, 1, 150)])  # a dense heap that cannot be cut
    y = np.concatenate([rng.uniform(0, 200, n), rng.normal(50, 1, 150)])
    sites = spark.createDataFrame([(i, 1, float(a), float(b), i // 2) for i, (a, b) in enumerate(zip(x, y))], "site long, space int, x double, y double, party long")
    shape = "POLYGON((20 20, 120 30, 150 150, 40 120, 20 20))"
    regions = spark.createDataFrame([(1, 77, shape)], "space int, region long, boundary string")
    got = near_and_inside(sites, regions, 5.0, leaf_points=leaf_points, task_pairs=task_pairs).collect()
    assert len(got) == len(set(map(tuple, got)))
    gap = np.hypot(x[:, None] - x, y[:, None] - y)
    want = {(int(i), int(j)) for i, j in zip(*np.where(gap <= 5)) if i < j and i // 2 != j // 2}
    assert {(r.a, r.b) for r in got if r.kind == "near"} == want
    from verdigris.functions.geometry import read_wkt
    from verdigris.functions.relate import Located, relate_points

    assert {r.b for r in got if r.kind == "inside"} == set(np.flatnonzero(relate_points(x, y, Located(read_wkt(shape)), "within")).tolist())


def test_sphere(spark):
    rows = [(1, 0, 179.9999, 0.0, 1), (2, 0, -179.9999, 0.0, 2), (3, 0, 0.0, 89.9999, 3), (4, 0, 180.0, 89.9999, 4), (5, 0, 10.0, 10.0, 5)]
    sites = spark.createDataFrame(rows, "site long, space int, x double, y double, party long")
    regions = spark.createDataFrame([], "space int, region long, boundary string")
    got = near_and_inside(sites, regions, 50.0, metric="sphere").collect()
    assert {(r.a, r.b) for r in got} == {(1, 2), (3, 4)}


def test_sphere_with_regions_in_small_leaves(spark):
    rng = np.random.default_rng(9)
    lon, lat = rng.uniform(-180, 180, 500), rng.uniform(-85, 85, 500)
    sites = spark.createDataFrame([(i, 0, float(a), float(b), i) for i, (a, b) in enumerate(zip(lon, lat))], "site long, space int, x double, y double, party long")
    boxes = [(1, -30, -20, 40, 35), (2, 100, 10, 179, 80), (3, -170, -80, -100, -10)]
    regions = spark.createDataFrame([(0, r, f"POLYGON(({a} {b}, {c} {b}, {c} {d}, {a} {d}, {a} {b}))") for r, a, b, c, d in boxes], "space int, region long, boundary string")
    got = near_and_inside(sites, regions, 300_000.0, metric="sphere", leaf_points=40).collect()
    vectors = unit_vectors(lon, lat)
    gap = np.linalg.norm(vectors[:, None] - vectors, axis=2)
    assert {(r.a, r.b) for r in got if r.kind == "near"} == {(int(i), int(j)) for i, j in zip(*np.where(gap <= chord(300_000.0, 6_371_008.8))) if i < j}
    assert {(r.a, r.b) for r in got if r.kind == "inside"} == {(r, int(i)) for r, a, b, c, d in boxes for i in np.flatnonzero((lon > a) & (lon < c) & (lat > b) & (lat < d))}


def test_boxes_of_degrees_hold_their_vectors():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = np.sort(rng.uniform(-180, 180, 2)), np.sort(rng.uniform(-90, 90, 2))
        low, high = degree_boxes(a[0], b[0], a[1], b[1])
        inside = unit_vectors(rng.uniform(*a, 100), rng.uniform(*b, 100))
        assert (inside >= low).all() and (inside <= high).all()


def test_a_dense_leaf_is_given_out_in_pieces():
    """All sites within one radius: no piece holds more than a bounded number of pairs."""
    points = plane_vectors(np.zeros(3000), np.linspace(0, 1, 3000))
    sizes = [len(i) for i, _ in close_pairs(points, 2.0)]
    assert sum(sizes) == 3000 * 2999 // 2 and max(sizes) <= 501_000
    splits = Splits(points, 0.1, 4.0)
    assert splits.near == [pytest.approx(1.0)]
    assert _blocks(splits, 40_000, 20_000, 50_000_000) == [6]


def test_kernels():
    rng = np.random.default_rng(5)
    points = plane_vectors(rng.uniform(0, 50, 700), rng.uniform(0, 50, 700))
    pairs = [(min(a, b), max(a, b)) for i, j in close_pairs(points, 2.0, chunk=500) for a, b in zip(i.tolist(), j.tolist())]
    gap = np.hypot(points[:, None, 0] - points[:, 0], points[:, None, 1] - points[:, 1])
    assert sorted(pairs) == sorted((int(a), int(b)) for a, b in zip(*np.where(gap <= 2)) if a < b)
    splits = Splits(points[:100], 0.1, 4.0)
    rows, leaves = splits.leaves(points, points)
    assert sorted(rows.tolist()) == list(range(700)) and len(set(leaves.tolist())) > 5
    a, b = unit_vectors([0, 1], [0, 0])
    assert np.linalg.norm(a - b) == pytest.approx(chord(np.radians(1), 1.0))
