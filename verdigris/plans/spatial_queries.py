"""Queries of spatial filters, geometry conversion and the catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.shapebinary import Grid
from verdigris.operators.spatial import converted_geometry, geometry_column, shape_wkb, spatial_filter
from verdigris.session import table
from verdigris.sources.catalog import list_tables

_POINTS = "SELECT c_custkey AS objectid, CAST(c_custkey % 100 AS DOUBLE) AS x, CAST(c_custkey % 37 AS DOUBLE) AS y FROM customer"
_TRIANGLE = "POLYGON((10 2, 70 5, 40 33, 10 2))"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("objectid"), (F.col("c_custkey") % 100).cast("double").alias("x"), (F.col("c_custkey") % 37).cast("double").alias("y"))


def _filtered(geometry, **options):
    return lambda spark, sf_dir: spatial_filter(_points(spark, sf_dir), geometry, xy=("x", "y"), **options)


def _distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _filtered({"wkt": "POINT(50 18)"}, within_distance=5.0, return_distance=True)(spark, sf_dir)
    return found.select("objectid", "x", "y", F.round("_distance", 6).alias("distance"))


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "edit_operations").select("op_id", "new_geometry").distinct()
    return rows.withColumn("g", converted_geometry("new_geometry"))


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark, sf_dir).withColumn("shape", geometry_column(F.col("g.wkb")))


def _geometries_converted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every geometry text, however it is spelled: type and envelope (null if it cannot be read or is empty), and whether it is a valid geometry."""
    box = [F.col(f"shape.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    return _shapes(spark, sf_dir).filter("new_geometry is not null").select("op_id", F.col("g.type").alias("type"), *box, F.coalesce("g.valid", F.lit(False)).alias("valid"))


def _geometries_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometries of every type and spelling within the box of spatial_line_within."""
    return spatial_filter(_shapes(spark, sf_dir), {"envelope": [0, 0, 30000, 30000]}, "within").select("op_id", F.col("g.type").alias("type"))


# The next three are compared with SQL twins, which can parse one spelling each; geometries_converted and geometries_within have no such filter.


def _geojson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).filter("new_geometry like '{\"type\":\"Point\",\"coordinates\":[%,%]}' and g.valid")
    shape = geometry_column(F.col("g.wkb"))
    return rows.withColumn("shape", shape).select("op_id", F.col("shape.xmin").alias("x"), F.col("shape.ymin").alias("y"))


def _wkt_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _texts(spark, sf_dir).filter("new_geometry rlike '^POINT [(]' and g.valid")
    return rows.withColumn("shape", geometry_column(F.col("g.wkb"))).select("op_id", F.col("shape.xmin").alias("x"), F.col("shape.ymin").alias("y"))


def _polygon_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes of the lines, by the struct column."""
    rows = _texts(spark, sf_dir).filter("new_geometry like 'LINESTRING%'").withColumn("shape", geometry_column(F.col("g.wkb")))
    box = {"envelope": [0, 0, 30000, 30000]}
    return spatial_filter(rows, box, "within").select("op_id")


_SQUARE = "concat('POLYGON((', x, ' ', y, ', ', x + 6, ' ', y, ', ', x + 6, ' ', y + 6, ', ', x, ' ', y + 6, ', ', x, ' ', y, '))')"
_SEGMENT = "concat('LINESTRING(', x, ' ', y, ', ', x + 6, ' ', y, ')')"


def _related(text: str, geometry, relationship: str):
    """Squares or segments at the points, by their relation to a geometry."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _points(spark, sf_dir).withColumn("g", converted_geometry(F.expr(text)))
        rows = rows.withColumn("shape", geometry_column(F.col("g.wkb")))
        return spatial_filter(rows, geometry, relationship).select("objectid", "x", "y")

    return run


def _varint(value: Column) -> Column:
    """A number below two to the 21st in the shape's variable length, as hex."""
    parts = [F.shiftrightunsigned(value, 7 * i).bitwiseAND(F.lit(127)) for i in range(3)]
    more = [value >= (1 << 7), value >= (1 << 14)]
    first, second = (F.lpad(F.hex(p + F.when(m, 128).otherwise(0)), 2, "0") for p, m in zip(parts, more))
    return F.concat(first, F.when(more[0], second).otherwise(F.lit("")), F.when(more[1], F.lpad(F.hex(parts[2]), 2, "0")).otherwise(F.lit("")))


def _placed(value: Column) -> Column:
    """A grid coordinate as it is stored: bit 5 and all above are moved up by one."""
    return F.shiftleft(F.shiftright(value, 5), 6).bitwiseOR(value.bitwiseAND(F.lit(31)))


def _shape_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two points, written as compressed shapes from the customers' keys and read again."""
    key = F.col("c_custkey").cast("int")
    start, step = [key * 7 % 100_000, key % 1000], [key % 32, key % 31]
    stream = F.concat(*[_varint(_placed(v)) for v in start], *[_varint(v + 64) for v in step])
    none = F.lit(None).cast("double")
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("objectid"), F.unhex(F.concat(F.lit("00" * 8), stream)).alias("data"))
    wkb = shape_wkb(Grid(1000.0, 2000.0, 10.0))("data", F.lit(2), F.lit(2), none, none, none, none)
    shaped = rows.withColumn("shape", geometry_column(wkb))
    return shaped.select("objectid", *[F.round(F.col(f"shape.{c}"), 6).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalog, from items, types and registry cut out of table_info."""
    info = table(spark, sf_dir, "table_info")
    kinds = spark.createDataFrame([("t", "Table"), ("f", "Feature Class"), ("d", "Domain")], "UUID string, Name string")
    # The view is given as a multipatch, which counts as points.
    codes = F.when(F.col("registration_id").isNull(), 9).when(F.col("geometry_type") == "Point", 1).when(F.col("geometry_type") == "LineString", 3).when(F.col("geometry_type") == "Polygon", 4)
    items = info.select(F.when(F.col("is_feature_class"), "f").otherwise("t").alias("Type"), F.col("name").alias("Name"), F.col("physical_name").alias("PhysicalName"), codes.alias("DatasetSubtype1"), F.lit(0).alias("DatasetSubtype2"))
    parts = F.split("physical_name", r"\.")
    registry = info.filter("registration_id is not null").select("registration_id", F.element_at(parts, 2).alias("owner"), F.element_at(parts, 3).alias("table_name"), F.when(F.col("is_versioned"), 9).otherwise(1).alias("object_flags"))
    return list_tables(items, kinds, registry)


QUERIES = {
    "spatial_envelope": _filtered({"envelope": [10, 5, 40, 20]}),
    "spatial_envelope_touches": _filtered({"envelope": [10, 5, 40, 20]}, relationship="touches"),
    "spatial_envelope_disjoint": _filtered({"envelope": [10, 5, 40, 20]}, relationship="disjoint"),
    "spatial_within_polygon": _filtered({"wkt": _TRIANGLE}, relationship="within"),
    "spatial_distance": _distance,
    "spatial_contains": _related(_SQUARE, {"wkt": "POINT(50 18)"}, "contains"),
    "spatial_overlaps": _related(_SQUARE, {"envelope": [10, 5, 40, 20]}, "overlaps"),
    "spatial_crosses": _related(_SEGMENT, {"envelope": [10, 5, 40, 20]}, "crosses"),
    "spatial_touches_squares": _related(_SQUARE, {"envelope": [10, 5, 40, 20]}, "touches"),
    "spatial_within_squares": _related(_SQUARE, {"envelope": [10, 5, 40, 20]}, "within"),
    "spatial_intersects_squares": _related(_SQUARE, {"envelope": [10, 5, 40, 20]}, "intersects"),
    "shape_lines": _shape_lines,
    "spatial_line_within": _polygon_texts,
    "geojson_points": _geojson_points,
    "wkt_points": _wkt_points,
    "geometries_converted": _geometries_converted,
    "geometries_within": _geometries_within,
    "catalog_tables": _tables,
}

_SIDES = ("(70 - 10) * (y - 2) - (x - 10) * (5 - 2) > 0", "(40 - 70) * (y - 5) - (x - 70) * (33 - 5) > 0", "(10 - 40) * (y - 33) - (x - 40) * (2 - 33) > 0")
# A square of side 6 and the box 10 5 40 20.
_INNER, _MEETS = "x < 40 AND x + 6 > 10 AND y < 20 AND y + 6 > 5", "x <= 40 AND x + 6 >= 10 AND y <= 20 AND y + 6 >= 5"
_WITHIN = "x >= 10 AND x + 6 <= 40 AND y >= 5 AND y + 6 <= 20"
_OPS = "(SELECT DISTINCT op_id, new_geometry AS g FROM edit_operations)"
SQL = {
    "spatial_envelope": f"SELECT * FROM ({_POINTS}) WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 20",
    "spatial_envelope_touches": f"SELECT * FROM ({_POINTS}) WHERE x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 20 AND (x IN (10, 40) OR y IN (5, 20))",
    "spatial_envelope_disjoint": f"SELECT * FROM ({_POINTS}) WHERE NOT (x BETWEEN 10 AND 40 AND y BETWEEN 5 AND 20)",
    "spatial_within_polygon": f"SELECT * FROM ({_POINTS}) WHERE {' AND '.join(_SIDES)}",
    "spatial_distance": f"SELECT objectid, x, y, round(sqrt((x - 50) * (x - 50) + (y - 18) * (y - 18)), 6) AS distance FROM ({_POINTS}) WHERE (x - 50) * (x - 50) + (y - 18) * (y - 18) <= 25",
    "spatial_contains": f"SELECT * FROM ({_POINTS}) WHERE x < 50 AND x + 6 > 50 AND y < 18 AND y + 6 > 18",
    "spatial_overlaps": f"SELECT * FROM ({_POINTS}) WHERE {_INNER} AND NOT ({_WITHIN})",
    "spatial_crosses": f"SELECT * FROM ({_POINTS}) WHERE y > 5 AND y < 20 AND x < 40 AND x + 6 > 10 AND NOT (x >= 10 AND x + 6 <= 40)",
    "spatial_touches_squares": f"SELECT * FROM ({_POINTS}) WHERE {_MEETS} AND NOT ({_INNER})",
    "spatial_within_squares": f"SELECT * FROM ({_POINTS}) WHERE {_WITHIN}",
    "spatial_intersects_squares": f"SELECT * FROM ({_POINTS}) WHERE {_MEETS}",
    "shape_lines": """SELECT c_custkey AS objectid, round(x / 10 + 1000, 6) AS xmin, round(y / 10 + 2000, 6) AS ymin, round((x + c_custkey % 32) / 10 + 1000, 6) AS xmax,
  round((y + c_custkey % 31) / 10 + 2000, 6) AS ymax FROM (SELECT *, c_custkey * 7 % 100000 AS x, c_custkey % 1000 AS y FROM customer)""",
    "spatial_line_within": rf"""WITH l AS (SELECT op_id, list_transform(regexp_extract_all(g, '-?[0-9.]+'), lambda v: CAST(v AS DOUBLE)) AS n FROM {_OPS} WHERE g LIKE 'LINESTRING%')
SELECT op_id FROM l WHERE list_min(n) >= 0 AND list_max(n) <= 30000""",
    "geojson_points": rf"""SELECT op_id, CAST(g ->> '$.coordinates[0]' AS DOUBLE) AS x, CAST(g ->> '$.coordinates[1]' AS DOUBLE) AS y FROM {_OPS}
WHERE g LIKE '{{"type":"Point","coordinates":[%,%]}}' AND (g ->> '$.coordinates[0]') IS NOT NULL""",
    "wkt_points": rf"""SELECT op_id, CAST(regexp_extract(g, '^POINT [(](\S+) (\S+)[)]$', 1) AS DOUBLE) AS x, CAST(regexp_extract(g, '^POINT [(](\S+) (\S+)[)]$', 2) AS DOUBLE) AS y
FROM {_OPS} WHERE regexp_matches(g, '^POINT [(](\S+) (\S+)[)]$')""",
    "catalog_tables": """SELECT string_split(physical_name, '.')[-1] AS name, physical_name, schema_name,
  CASE WHEN is_feature_class AND registration_id IS NULL THEN 'MultiPoint' WHEN is_feature_class THEN geometry_type END AS geometry_type, registration_id,
  is_versioned AND registration_id IS NOT NULL AS is_versioned FROM table_info ORDER BY name""",
}
