"""Spatial filters on features: an envelope test in built-in expressions first, then the exact relation in Arrow batches."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.curves import Densify
from verdigris.functions.geometry import Geometry, is_valid, read_geojson, read_query_geometry, read_wkb, read_wkt, to_geojson, write_wkb, write_wkt
from verdigris.functions.relate import RELATIONS, Located, distance, relate_points, relation
from verdigris.functions.shapebinary import Grid, read_shape_geometry


def geometry_column(wkb: Column, srid: Column | None = None) -> Column:
    """struct<wkb, srid, xmin, ymin, xmax, ymax> of a WKB column; null for null and unreadable ones. Written once, its envelope can be pushed down."""
    return _with_envelope(wkb, srid if srid is not None else F.lit(None).cast("int"))


_GEOMETRY = T.StructType(
    [T.StructField("wkb", T.BinaryType()), T.StructField("srid", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]]
)


@F.pandas_udf(_GEOMETRY)
def _with_envelope(wkb: pd.Series, srid: pd.Series) -> pd.DataFrame:
    rows = []
    for data, own in zip(wkb, srid):
        g = read_wkb(data)
        box = g.envelope() if g is not None else None
        code = None if own is None or own != own else int(own)
        rows.append((bytes(data), code if code is not None else g.srid, *box) if box else (None,) * 6)
    frame = pd.DataFrame(rows, columns=_GEOMETRY.names)
    return frame.astype({"srid": "Int32", "xmin": float, "ymin": float, "xmax": float, "ymax": float})


def spatial_filter(
    rows: DataFrame,
    geometry,
    relationship: str = "intersects",
    within_distance: float | None = None,
    column: str = "shape",
    xy: tuple[str, str] | None = None,
    return_distance: bool = False,
) -> DataFrame:
    """The rows whose geometry stands in a relation to a query geometry (GeoJSON, wkt, wkb or envelope).

    Geometry is a struct column of geometry_column, or two number columns `xy` of points. A distance overrides the relationship. Null geometries match
    nothing, `disjoint` included. With return_distance the column _distance is added.
    """
    query = read_query_geometry(geometry)
    if query is None:
        raise ValueError("the query geometry cannot be read")
    if relationship not in RELATIONS:
        raise ValueError(f"unknown relationship {relationship}")
    box = query.envelope()
    if box is None:
        return rows.limit(0)
    parts = [F.col(c) for c in xy] * 2 if xy else [F.col(f"{column}.{c}") for c in ("xmin", "ymin", "xmax", "ymax")]
    present = parts[0].isNotNull() & parts[1].isNotNull()
    reach = within_distance or 0.0
    if within_distance is not None or relationship != "disjoint":
        near = (parts[0] <= box[2] + reach) & (parts[2] >= box[0] - reach) & (parts[1] <= box[3] + reach) & (parts[3] >= box[1] - reach)
        rows = rows.filter(present & near)
    else:
        rows = rows.filter(present)
    source = [F.col(c) for c in xy] if xy else [F.col(f"{column}.wkb")]
    if within_distance is not None:
        matched = rows.withColumn("_distance", _distances(query, bool(xy))(*source)).filter(F.col("_distance") <= within_distance)
        return matched if return_distance else matched.drop("_distance")
    matched = rows.filter(_relations(query, relationship, bool(xy))(*source))
    return matched.withColumn("_distance", _distances(query, bool(xy))(*source)) if return_distance else matched


def _relations(query: Geometry, name: str, points: bool):
    data = write_wkb(query)
    if points:

        @F.pandas_udf(T.BooleanType())
        def test(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series(relate_points(x.to_numpy(float), y.to_numpy(float), Located(read_wkb(data)), name))

    else:

        @F.pandas_udf(T.BooleanType())
        def test(wkb: pd.Series) -> pd.Series:
            other = Located(read_wkb(data))
            return pd.Series([bool(g is not None and relation(Located(g), other, name)) for g in map(read_wkb, wkb)], dtype=bool)

    return test


def _distances(query: Geometry, points: bool):
    data = write_wkb(query)
    if points:

        @F.pandas_udf(T.DoubleType())
        def measure(x: pd.Series, y: pd.Series) -> pd.Series:
            other = Located(read_wkb(data))
            return pd.Series([distance(Located(Geometry("Point", p)), other) for p in zip(x, y)], dtype=float)

    else:

        @F.pandas_udf(T.DoubleType())
        def measure(wkb: pd.Series) -> pd.Series:
            other = Located(read_wkb(data))
            return pd.Series([distance(Located(g), other) if g is not None else np.inf for g in map(read_wkb, wkb)], dtype=float)

    return measure


_TEXT_GEOMETRY = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("wkt", T.StringType()),
        T.StructField("geojson", T.StringType()),
        T.StructField("wkb", T.BinaryType()),
        T.StructField("valid", T.BooleanType()),
    ]
)


def read_geometry_text(text: str | None) -> Geometry | None:
    """A geometry written as WKT, EWKT, GeoJSON, hex WKB (0x or \\x before it or not), or an object with such a wkt or wkb; None for anything else."""
    if not text:
        return None
    stripped = text.strip()
    if stripped.startswith("{"):
        try:
            value = json.loads(stripped)
        except (ValueError, RecursionError):
            return None
        inner = value.get("wkt") or value.get("wkb")
        return read_geometry_text(inner) if isinstance(inner, str) else read_geojson(value)
    if stripped[:2] in ("0x", "\\x"):
        stripped = stripped[2:]
    if len(stripped) % 2 == 0 and all(c in "0123456789abcdefABCDEF" for c in stripped):
        return read_wkb(bytes.fromhex(stripped))
    return read_wkt(stripped)


@F.pandas_udf(_TEXT_GEOMETRY)
def converted_geometry(text: pd.Series) -> pd.DataFrame:
    """The type and every written form of a geometry text, and whether it is valid; nulls where it cannot be read."""
    rows = []
    for value in text:
        g = read_geometry_text(value)
        rows.append((None,) * 5 if g is None else (g.type, write_wkt(g), json.dumps(to_geojson(g)), write_wkb(g), is_valid(g)))
    return pd.DataFrame(rows, columns=_TEXT_GEOMETRY.names)


def shape_wkb(grid: Grid, densify: Densify = Densify()):
    """A function of columns (compressed shape, number of points, entity, xmin, ymin, xmax, ymax) to WKB; null for shapes that cannot be read. Curved
    shapes need their envelope, and their segments become points.
    """

    @F.pandas_udf(T.BinaryType())
    def decode(data: pd.Series, n_points: pd.Series, entity: pd.Series, xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
        out = []
        for d, n, e, *box in zip(data, n_points.fillna(0), entity.fillna(0), xmin, ymin, xmax, ymax):
            envelope = tuple(box) if all(v is not None and v == v for v in box) else None
            g = read_shape_geometry(d, int(n), int(e), grid, envelope, densify)
            out.append(write_wkb(g) if g is not None else None)
        return pd.Series(out, dtype=object)

    return decode
