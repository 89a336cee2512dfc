import math
import struct

import numpy as np
import pytest

from verdigris.functions.curves import ARC, BEZIER, Curve, Densify, circle_center, densify_arc, densify_bezier, densify_rings
from verdigris.functions.geometry import Geometry, checked_wkt, is_valid, read_geojson, read_query_geometry, read_wkb, read_wkt, to_geojson, write_wkb, write_wkt
from verdigris.functions.pointtext import read_attribute_point, read_point
from verdigris.functions.relate import Located, distance, relate_points, relation
from verdigris.functions.rings import SweptPoints, read_edges
from verdigris.functions.shapebinary import Grid, absolute, difference, find_plain_shape, read_shape, read_shape_geometry, read_varints

SAMPLES = [
    "POINT(1 2)",
    "LINESTRING(0 0, 1 1.5)",
    "POLYGON((0 0, 4 0, 4 4, 0 0), (1 1, 2 1, 2 2, 1 1))",
    "MULTIPOINT(1 2, 3 4)",
    "MULTILINESTRING((0 0, 1 1), (2 2, 3 3))",
    "MULTIPOLYGON(((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))",
    "GEOMETRYCOLLECTION(POINT(1 2), LINESTRING(0 0, 1 1))",
    "POINT EMPTY",
    "GEOMETRYCOLLECTION EMPTY",
]


@pytest.mark.parametrize("text", SAMPLES)
def test_wkt_wkb_geojson_round_trips(text):
    g = read_wkt(text)
    assert write_wkt(g) == text
    assert write_wkt(read_wkb(write_wkb(g))) == text
    if "EMPTY" not in text:
        assert write_wkt(read_geojson(to_geojson(g))) == text


def test_wkb_dialects():
    ewkb = struct.pack("<BIidd", 1, 1 | 0x20000000, 4326, 3.0, 4.0)
    assert read_wkb(ewkb) == Geometry("Point", (3.0, 4.0), srid=4326)
    assert read_wkb(ewkb, 7301).srid == 7301
    assert read_wkb(struct.pack(">BIddd", 0, 1001, 3.0, 4.0, 9.0)).coordinates == (3.0, 4.0)
    assert read_wkb(struct.pack("<BIdddd", 1, 3001, 3.0, 4.0, 9.0, 8.0)).coordinates == (3.0, 4.0)
    assert read_wkb(struct.pack("<BIddd", 1, 1 | 0x80000000, 3.0, 4.0, 9.0)).coordinates == (3.0, 4.0)
    for broken in (None, b"", b"\x01\x01", struct.pack("<BId", 1, 1, 3.0), struct.pack("<BI", 1, 99), struct.pack("<BII", 1, 2, 1 << 30)):
        assert read_wkb(broken) is None


@pytest.mark.parametrize("text", ["POINT(1)", "POINT(1 2", "CIRCLE(1 2)", "", "POINT(1 2) x", "POLYGON(1 2)"])
def test_broken_wkt(text):
    assert read_wkt(text) is None
    with pytest.raises(ValueError):
        checked_wkt(text)


def test_wkt_variants():
    assert read_wkt("srid=7301; point z ( 1 2 3 )") == Geometry("Point", (1.0, 2.0), srid=7301)
    assert read_wkt("MULTIPOINT((1 2),(3 4))").coordinates == [(1.0, 2.0), (3.0, 4.0)]
    assert read_wkt("POINT M (1 2 3)").coordinates == (1.0, 2.0)
    with pytest.raises(ValueError):
        checked_wkt("POINT(1 2); DROP TABLE x")
    with pytest.raises(ValueError):
        write_wkt(Geometry("Circle"))


def test_validity():
    assert is_valid(read_wkt("POLYGON((0 0, 1 0, 1 1, 0 1))"))
    assert not is_valid(read_wkt("POLYGON((0 0, 1 0, 0 0))"))
    assert not is_valid(Geometry("LineString", [(0, 0)]))
    assert not is_valid(Geometry("Point", (math.nan, 1)))
    assert not is_valid(None)


def test_query_geometry():
    assert read_query_geometry({"envelope": [0, 0, 2, 1]}).envelope() == (0, 0, 2, 1)
    assert read_query_geometry({"wkt": "POINT(1 2)"}).srid == 0
    assert read_query_geometry({"wkb": write_wkb(read_wkt("POINT(1 2)")).hex()}).coordinates == (1.0, 2.0)
    assert read_query_geometry({"nothing": 1}) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("POINT (1.5 -2)", (1.5, -2.0)),
        ("point(1   2)", (1.0, 2.0)),
        ("POINT Z (1 2 3)", (1.0, 2.0)),
        ("SRID=7301;POINT(1 2)", (1.0, 2.0)),
        ('{"type":"Point","coordinates":[1,2,3]}', (1.0, 2.0)),
        (struct.pack("<BIdd", 1, 1, 1.0, 2.0).hex().upper(), (1.0, 2.0)),
        (struct.pack(">BIidd", 0, 1 | 0x20000000, 1, 1.0, 2.0).hex(), (1.0, 2.0)),
        ("POINT (0 0)", None),
        ("POINT EMPTY", None),
        ("POINT (12.5)", None),
        ("LINESTRING (0 0, 1 1)", None),
        ('{"type":"Point","coordinates":[null,null]}', None),
        ('{"type":"Point","coordinates":[1e999,2]}', None),
        ("0101000000", None),
        ("", None),
        ("{", None),
        (None, None),
    ],
)
def test_point_text(text, want):
    assert read_point(text) == want


def test_attribute_point():
    assert read_attribute_point('{"shape":{"type":"Point","coordinates":[1,2]}}', "SHAPE") == (1.0, 2.0)
    assert read_attribute_point('{"Shape":null,"SHAPE":"POINT(3 4)"}', "shape") == (3.0, 4.0)
    for broken in (None, "", "[]", "{", '{"x":1}'):
        assert read_attribute_point(broken, "shape") is None


def test_sweep_equals_single_tests():
    rng = np.random.default_rng(3)
    shape = "MULTIPOLYGON(((0 0, 10 0, 10 10, 5 4, 0 10, 0 0), (2 1, 4 1, 3 3, 2 1)), ((20 20, 30 20, 25 30, 20 20)))"
    edges = read_edges(shape)
    x, y = rng.uniform(-5, 35, 4000), rng.uniform(-5, 35, 4000)
    x[:3], y[:3] = [5, 10, 3], [0, 10, 3]  # on an edge, on a corner, on the hole's corner
    located = Located(read_wkt(shape))
    want = np.flatnonzero(relate_points(x, y, located, "within"))
    assert sorted(SweptPoints(x, y).inside(edges)) == want.tolist()
    assert not set(SweptPoints(x, y).inside(edges)) & {0, 1, 2}
    assert read_edges("POINT(1 2)") is None and read_edges(None) is None


SQUARE = "POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))"
CASES = [
    (SQUARE, "POLYGON((1 1, 2 1, 2 2, 1 2, 1 1))", {"intersects", "contains"}),
    (SQUARE, "POLYGON((2 2, 6 2, 6 6, 2 6, 2 2))", {"intersects", "overlaps"}),
    (SQUARE, "POLYGON((4 0, 8 0, 8 4, 4 4, 4 0))", {"intersects", "touches"}),
    (SQUARE, "POLYGON((5 5, 6 5, 6 6, 5 5))", {"disjoint"}),
    (SQUARE, SQUARE, {"intersects", "contains", "within"}),
    ("POLYGON((0 0, 9 0, 9 9, 0 9, 0 0), (1 1, 8 1, 8 8, 1 8, 1 1))", "POLYGON((2 2, 3 2, 3 3, 2 2))", {"disjoint"}),
    ("LINESTRING(-1 2, 5 2)", SQUARE, {"intersects", "crosses"}),
    ("LINESTRING(0 0, 4 0)", SQUARE, {"intersects", "touches"}),
    ("LINESTRING(1 1, 2 2)", SQUARE, {"intersects", "within"}),
    ("LINESTRING(0 0, 2 2)", "LINESTRING(0 2, 2 0)", {"intersects", "crosses"}),
    ("LINESTRING(0 0, 2 0)", "LINESTRING(1 0, 3 0)", {"intersects", "overlaps"}),
    ("LINESTRING(0 0, 2 0)", "LINESTRING(2 0, 3 5)", {"intersects", "touches"}),
    ("POINT(2 2)", SQUARE, {"intersects", "within"}),
    ("POINT(4 2)", SQUARE, {"intersects", "touches"}),
    ("POINT(0 0)", "LINESTRING(0 0, 2 0)", {"intersects", "touches"}),
    ("POINT(1 0)", "LINESTRING(0 0, 2 0)", {"intersects", "within"}),
    ("MULTIPOINT(1 1, 9 9)", SQUARE, {"intersects", "crosses"}),
    ("POINT(1 1)", "POINT(1 1)", {"intersects", "contains", "within"}),
]


@pytest.mark.parametrize(("a", "b", "true"), CASES)
def test_relations(a, b, true):
    one, two = Located(read_wkt(a)), Located(read_wkt(b))
    got = {n for n in ("intersects", "contains", "within", "touches", "overlaps", "crosses", "disjoint") if relation(one, two, n)}
    assert got == true


def test_distances():
    def gap(a, b):
        return distance(Located(read_wkt(a)), Located(read_wkt(b)))

    assert gap("POINT(0 0)", "POINT(3 4)") == 5
    assert gap("POINT(2 2)", SQUARE) == 0
    assert gap("LINESTRING(6 0, 6 9)", SQUARE) == 2
    assert gap("LINESTRING(-1 2, 5 2)", SQUARE) == 0
    assert gap("POINT EMPTY", SQUARE) == math.inf


def write_varints(values) -> bytes:
    """The inverse of read_varints."""
    out = bytearray()
    for v in values:
        while True:
            out.append((v & 0x7F) | (0x80 if v > 0x7F else 0))
            v >>= 7
            if not v:
                break
    return bytes(out)


def encode(pairs, restart=()):
    """Coordinate stream of grid steps: absolute at the start and at `restart`, else differences."""
    out, last = [], None
    for i, pair in enumerate(pairs):
        out += [_stored(v) for v in pair] if last is None or i in restart else [_delta(v - w) for v, w in zip(pair, last)]
        last = pair
    return bytes(8) + write_varints(out)


def _stored(v):
    """A raw number whose stored value is v."""
    return next(r for r in ((v >> 5 << 6) | (v & 31), (v >> 5 << 6) | (v & 63)) if ((r >> 6) << 5 | (r & 63)) == v)


def _delta(v):
    for raw in range(0, 1 << 16):
        if int(difference(np.array([raw]))[0]) == v:
            return raw
    raise ValueError(v)


def test_varints_and_differences():
    numbers = [0, 1, 127, 128, 300, 1 << 40]
    assert read_varints(bytes(8) + write_varints(numbers)).tolist() == numbers
    raw = np.array([0b1000001, 0b1100001, 0b0000101])
    assert absolute(raw).tolist() == [33, 33, 5] or absolute(raw).tolist() == [33, 65, 5]
    assert difference(np.array([0b1000001])).tolist() == [1]
    assert difference(np.array([0b0000101])).tolist() == [-5]


def test_shape_rings():
    grid = Grid(100.0, 200.0, 10.0, 7301)
    ring = [(10, 10), (30, 10), (30, 25), (10, 10)]
    data = encode(ring)
    shape = read_shape_geometry(data, 4, 8, grid)
    assert shape.type == "Polygon" and shape.srid == 7301
    assert np.allclose(shape.coordinates[0], [(100 + x / 10, 200 + y / 10) for x, y in ring])
    assert read_shape_geometry(data, 4, 2, grid).type == "LineString"
    assert read_shape_geometry(data, 1, 1, grid).type == "Point"
    assert read_shape_geometry(b"\x00", 4, 8, grid) is None
    assert read_shape(data, 0, grid).error


def test_multipart_rings():
    grid = Grid(0.0, 0.0, 1.0)
    rings = [[(1000, 1000), (1031, 1000), (1031, 1020), (1000, 1000)], [(1040, 1040), (1050, 1040), (1050, 1050), (1040, 1040)], [(1060, 1060)]]
    flat = [p for r in rings for p in r]
    shape = read_shape(encode(flat, {4, 8}), len(flat), grid, (1000, 1000, 1060, 1060), 264)
    assert shape.rings == [[(float(x), float(y)) for x, y in r] for r in rings[:2]]
    assert read_shape_geometry(encode(flat, {4, 8}), len(flat), 264, grid, (1000, 1000, 1060, 1060)).type == "MultiPolygon"


def test_curved_shape():
    points = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 0.0)]
    plain = struct.pack("<I4d2i", 51, 0, 0, 10, 10, 1, 4) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)
    plain += struct.pack("<i", 2) + struct.pack("<2i2di", 0, ARC, 5.0, -5.0, 0) + struct.pack("<2i4d", 1, BEZIER, 12, 2, 12, 8)
    data = bytes([0, 0, 0, 0, 0, 8, 0, 0]) + b"\x07\x07" + plain
    assert find_plain_shape(data, (0, 0, 10, 10)) == 10
    shape = read_shape(data, 4, Grid(0, 0, 1), (0, 0, 10, 10), 8)
    assert shape.has_curves and shape.rings == [points]
    assert [c.kind for c in shape.curves] == [ARC, BEZIER]
    assert read_shape(data, 4, Grid(0, 0, 1)).error
    assert read_shape(data, 4, Grid(0, 0, 1), (50, 50, 60, 60)).error
    dense = densify_rings(shape.rings, list(shape.curves))[0]
    assert len(dense) > 12
    assert min(y for _, y in dense) == pytest.approx(-5, abs=0.02)


def test_arcs_and_beziers():
    half = densify_arc((1, 0), (-1, 0), (0, 0), True)
    assert np.allclose(np.hypot(*half.T), 1) and (half[:, 1] >= -1e-12).all()
    assert (densify_arc((1, 0), (-1, 0), (0, 0), False)[:, 1] <= 1e-12).all()
    assert len(densify_arc((1, 0), (1, 0), (0, 0), True, Densify(segments=8))) == 9
    assert circle_center((0, 0), (1, 1), (2, 2)) is None
    assert np.allclose(circle_center((1, 0), (0, 1), (-1, 0)), 0)
    straight = densify_bezier((0, 0), (1, 0), (2, 0), (3, 0))
    assert len(straight) == 5
    bent = densify_bezier((0, 0), (0, 10), (10, 10), (10, 0))
    assert len(bent) > 9 and np.allclose(bent[[0, -1]], [(0, 0), (10, 0)])
    assert densify_rings([[(0, 0), (1, 0)]], [Curve(0, 3)]) == [[(0, 0), (1, 0)]]
