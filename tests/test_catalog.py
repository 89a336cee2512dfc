import struct

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from verdigris.operators.spatial import geometry_column, read_geometry_text, spatial_filter
from verdigris.functions.geometry import read_wkt, write_wkb
from verdigris.plans.spatial_queries import QUERIES as SPATIAL
from verdigris.sources import catalog
from verdigris.sources.catalog import Field
from verdigris.streaming.deltas import apply_feed, changes_per_window, follow, visible_rows, without_repeats

DOCUMENT = """
<DEFeatureClassInfo><Name>Parcels</Name><ShapeType>xGeometryPolygon</ShapeType><SpatialReference><WKID>7301</WKID><LatestWKID>7302</LatestWKID></SpatialReference>
<GPFieldInfoExs>
<GPFieldInfoEx xsi:type="a"><Name>OBJECTID</Name><FieldType>xFieldTypeOID</FieldType><IsNullable>false</IsNullable></GPFieldInfoEx>
<GPFieldInfoEx><Name>Val</Name><AliasName>Value</AliasName><FieldType>xFieldTypeString</FieldType><Length>64</Length></GPFieldInfoEx>
<GPFieldInfoEx><Name>Odd</Name><FieldType>xFieldTypeQuux</FieldType><Length>many</Length></GPFieldInfoEx>
<GPFieldInfoEx><FieldType>xFieldTypeDouble</FieldType></GPFieldInfoEx>
</GPFieldInfoExs></DEFeatureClassInfo>"""


def test_definition():
    found = catalog.parse_definition(DOCUMENT)
    assert [(f.name, f.type, f.alias, f.nullable, f.length) for f in found.fields] == [("OBJECTID", "OID", None, False, None), ("Val", "STRING", "Value", True, 64), ("Odd", "STRING", None, True, None)]
    assert (found.srid, found.shape_type) == (7302, "Polygon")
    key = found.schema()["OBJECTID"]
    assert (key.dataType, key.nullable, found.schema()["Val"].metadata["alias"]) == (T.LongType(), False, "Value")
    plain = catalog.parse_definition("<Field><Name>A</Name><Type>xFieldTypeDate</Type></Field>")
    assert [(f.name, f.type) for f in plain.fields] == [("A", "DATE")]
    assert catalog.parse_definition(None).fields == catalog.parse_definition("<x/>").fields == ()


def test_types_and_names():
    assert [catalog.sql_type(t) for t in ("decimal(8,2)", "BIGINT", "uniqueidentifier", "hierarchyid")] == ["DOUBLE", "INT64", "GUID", "STRING"]
    assert [catalog.shape_kind(t) for t in ("xGeometryPolyline", "xGeometryMultipoint", "xGeometryNull", None)] == ["LineString", "MultiPoint", None, None]
    assert [catalog.split_physical_name(n) for n in ("db.own.T", "own.T", "T")] == [("own", "T"), ("own", "T"), ("dbo", "T")]


def test_merge_and_projection(spark):
    merged = catalog.merge_fields([Field("A", "STRING"), Field("Shape", "GEOMETRY")], [Field("a", "INTEGER"), Field("SDE_STATE_ID", "INT64"), Field("B", "DOUBLE")], "SHAPE")
    assert [(f.name, f.type) for f in merged] == [("A", "STRING"), ("B", "DOUBLE")]
    assert catalog.projected_fields(["OBJECTID", "Shape", "Shape.STArea()", "sde_state_id", "B"], "shape") == ["OBJECTID", "B"]
    assert catalog.to_feature(Row(OBJECTID=3, Val="x", Shape=b"g", Shape_Length=4.0), "SHAPE") == {"id": 3, "attributes": {"OBJECTID": 3, "Val": "x"}, "geometry": b"g"}
    rows = spark.createDataFrame([], "objectid long, b double")
    assert [f.type for f in catalog.live_fields(rows)] == ["INT64", "DOUBLE"]
    document = catalog.Definition((Field("A", "STRING"),))
    assert [[f.name for f in catalog.with_live(document, rows, None, v, w).fields] for v, w in ((True, False), (False, False), (False, True))] == [["A"], ["A", "objectid", "b"], ["objectid", "b"]]


def test_spatial_struct_columns(spark):
    texts = ["POLYGON((0 0, 4 0, 4 4, 0 4, 0 0))", "POLYGON((20 20, 24 20, 24 24, 20 20))", "LINESTRING(-5 2, 9 2)", None]
    rows = spark.createDataFrame([(i, write_wkb(read_wkt(t)) if t else None) for i, t in enumerate(texts)], "objectid long, data binary").withColumn("shape", geometry_column("data"))
    def ids(*args, **options):
        return sorted(r.objectid for r in spatial_filter(rows, *args, **options).collect())

    square = {"wkt": "POLYGON((1 1, 3 1, 3 3, 1 3, 1 1))"}
    assert ids(square) == [0, 2] and ids(square, "contains") == [0] and ids(square, "crosses") == [2] and ids(square, "disjoint") == [1]
    assert ids({"wkt": "POINT(24 26)"}, within_distance=2.0) == [1] and ids({"wkt": "POINT EMPTY"}) == []
    near = spatial_filter(rows, {"wkt": "POINT(24 26)"}, within_distance=2.5, return_distance=True).first()
    assert near["_distance"] == 2.0
    for wrong in ({"wkt": "x"}, {}):
        with pytest.raises(ValueError):
            ids(wrong)
    with pytest.raises(ValueError):
        ids(square, "beside")
    assert read_geometry_text("") is None and read_geometry_text("zz") is None


def test_streams(spark, tmp_path):
    source, schema = str(tmp_path / "in"), "objectid long, state long, image long, hides_base boolean, at timestamp"
    first = [(1, 0, 10, False), (2, 0, 20, False), (1, 5, 50, True), (3, 6, 60, True)]
    second = [(1, 4, 40, True), (1, 5, 50, True), (3, 7, None, True), (2, None, None, True)]
    for batch in (first, second):
        spark.createDataFrame([(*r, None) for r in batch], schema).coalesce(1).write.mode("append").parquet(source)
    target, seen = str(tmp_path / "out"), []
    feed = follow(spark, source, schema, 1).select("objectid", "state", "image", "hides_base")
    apply_feed(feed, target, str(tmp_path / "checkpoint"), lambda df, n: seen.append((n, {r.objectid: r.image for r in df.collect()}))).awaitTermination(120)
    assert len(seen) == 2 and {r.objectid: r.image for r in visible_rows(spark, target).collect()} == {1: 50}
    timed = follow(spark, source, schema)
    assert timed.isStreaming and without_repeats(timed, ["objectid", "state"], "at", "1 hour").isStreaming
    assert changes_per_window(timed.withColumnRenamed("state", "sde_state_id"), "at", "1 hour", "1 day").columns == ["window_start", "sde_state_id", "n_changes"]


def test_geometries_of_every_spelling(spark, tmp_path):
    little, big = struct.pack("<BIdd", 1, 1, 3, 4).hex(), struct.pack(">BIdd", 0, 1, 3, 4).hex().upper()
    point, line = ("Point", 3.0, 4.0, 3.0, 4.0, True), ("LineString", 1.0, 2.0, 5.0, 40000.0, True)
    texts = {
        "POINT (3 4)": point, "point(3   4)": point, "POINT Z (3 4 85)": point, "SRID=7301;POINT(3 4)": point, " Point M ( 3 4 9 ) ": point, little: point, big: point,
        f"0x{little}": point, f"\\x{little}": point, struct.pack("<BIidd", 1, 0x20000001, 7301, 3, 4).hex(): point, struct.pack("<BIddd", 1, 1001, 3, 4, 5).hex(): point,
        '{"type":"Point","coordinates":[3,4]}': point, '{ "coordinates": [3.0, 4, 7], "type": "Point" }': point, '{"wkt":"POINT(3 4)"}': point, f'{{"wkb":"{little}"}}': point,
        "LINESTRING (1 2, 5 40000)": line, "linestring z(1 2 0, 5 40000 0)": line, '{"coordinates":[[1,2],[5,40000]],"type":"LineString"}': line,
        struct.pack("<BIIdddd", 1, 2, 2, 1, 2, 5, 40000).hex(): line, '{"type":"LineString","coordinates":[[1,2],[5,6]]}': ("LineString", 1.0, 2.0, 5.0, 6.0, True),
        "POLYGON((0 0, 1 0, 0 0))": ("Polygon", 0.0, 0.0, 1.0, 0.0, False),
        "GEOMETRYCOLLECTION(POINT(3 4), LINESTRING(1 2, 3 3))": ("GeometryCollection", 1.0, 2.0, 3.0, 4.0, True),
        "": (None,) * 5 + (False,), "POINT (12.5)": (None,) * 5 + (False,), "0101000000": (None,) * 5 + (False,), '{"type":"Point","coordinates":[null,null]}': (None,) * 5 + (False,),
    }
    rows = list(enumerate([*texts, None]))
    spark.createDataFrame(rows * 2, "op_id long, new_geometry string").write.parquet(str(tmp_path / "edit_operations.parquet"))
    got = SPATIAL["geometries_converted"](spark, str(tmp_path)).collect()
    assert {r.op_id: tuple(r)[1:] for r in got} == {i: texts[t] for i, t in rows if t is not None} and len(got) == len(texts)
    inside = {(i, texts[t][0]) for i, t in rows if t is not None and texts[t][5] and max(texts[t][1:5]) <= 30000 and min(texts[t][1:5]) >= 0}
    assert {tuple(r) for r in SPATIAL["geometries_within"](spark, str(tmp_path)).collect()} >= inside
    assert {r.op_id for r in SPATIAL["geometries_within"](spark, str(tmp_path)).collect()}.isdisjoint(i for i, t in rows if t is None or texts[t][3] is None or texts[t][4] > 30000)
