"""Points near other points and in regions.

Points become three-dimensional vectors (unit vectors of geographic degrees, or the plane z = 0 of projected coordinates, for which a chord is the
planar distance). A k-d split of space cuts them into leaves; a point is copied to each leaf within the radius of it. Every leaf then finds its
pairs in a local k-d tree by chord radius, and sweeps the edges of the regions that reach it over its points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigris.functions.kdtree import Splits, chord, close_pairs, degree_boxes, plane_vectors, unit_vectors
from verdigris.functions.pointtext import read_attribute_point, read_point
from verdigris.functions.rings import SweptPoints, read_edges
from verdigris.session import cut_lineage

#: Least and most sampled points that fit the splits; between, LEAF_SAMPLE for each leaf. They decide only where space is cut; every point is searched.
SPLIT_SAMPLE, MOST_SAMPLE = 20_000, 2_000_000
LEAF_SAMPLE = 16
#: Points that a leaf should hold, and close pairs that a task should find.
LEAF_POINTS = 20_000
TASK_PAIRS = 50_000_000
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


@F.pandas_udf(_POINT)
def located_point(geometry: pd.Series, attributes: pd.Series, field: pd.Series) -> pd.DataFrame:
    """The point of `geometry`, or where that is null the one under `field` of the JSON `attributes`."""
    found = [read_point(g) if g is not None else read_attribute_point(a, f) for g, a, f in zip(geometry, attributes, field)]
    return pd.DataFrame([p or (None, None) for p in found], columns=["x", "y"], dtype="float64")


def located_operations(operations: DataFrame, tables: DataFrame) -> DataFrame:
    """(op_id, table_key, object_id, srid, x, y) of the operations that have a table with a shape field and a readable point.

    Repeats of an operation count once. Null table names, null srids on both sides, broken, empty or null geometry: not located.
    """
    known = tables.filter(F.col("shape_field_name").isNotNull()).select(
        F.concat_ws("\u0001", F.col("schema_name"), F.col("physical_name"), F.col("name")).alias("table_key"),
        F.col("shape_field_name").alias("field"),
        F.col("srid").alias("table_srid"),
        F.explode(F.array_distinct(F.array(F.lower("name"), F.lower("physical_name")))).alias("spelling"),
    )
    operations = operations.select(
        "op_id", "object_id", F.col("srid").alias("own_srid"), "new_geometry", "new_attributes", F.lower("table_name").alias("spelling")
    )
    joined = operations.join(known, "spelling").withColumn("point", located_point("new_geometry", "new_attributes", "field"))
    return (
        joined.select("op_id", "table_key", "object_id", F.coalesce("own_srid", "table_srid").alias("srid"), "point.x", "point.y")
        .filter(F.col("op_id").isNotNull() & F.col("srid").isNotNull() & F.col("x").isNotNull())
        .distinct()
    )


def fit_splits(sites: DataFrame, columns: tuple[str, str], reach: float, metric: str, sample: int, leaf_points: int) -> tuple[Splits, int]:
    """Splits fitted on the sites of lowest hash, at least `sample`, and the number of all sites."""
    total = sites.count()
    sample = max(sample, min(MOST_SAMPLE, LEAF_SAMPLE * total // leaf_points))
    rows = sites.select(*columns).orderBy(F.xxhash64("site")).limit(sample).toPandas()
    vectors = to_vectors(rows[columns[0]], rows[columns[1]], metric)
    return Splits(vectors, leaf_points / max(1, total), 2.0 * reach), total


def to_vectors(x, y, metric: str) -> np.ndarray:
    return unit_vectors(x, y) if metric == "sphere" else plane_vectors(x, y)


_ROUTED = "space int, leaf int, block_a int, block_b int, site long, x double, y double, party long, home boolean, part int, region long, boundary string"


def _route_sites(splits: Splits, blocks: list[int], reach: float, metric: str):
    """Copies of each site for the leaves within `reach`. A leaf too dense to be cut is processed as pairs of blocks of its sites."""
    count = np.array(blocks)

    def route(batches):
        for batch in batches:
            vectors = to_vectors(batch.x, batch.y, metric)
            row, leaf = splits.leaves(vectors - reach, vectors + reach)
            _, home = splits.leaves(vectors, vectors)
            own = np.empty(len(batch), dtype=np.int64)
            own[_] = home
            part = (pd.util.hash_array(batch.site.to_numpy()) % np.uint64(1 << 31)).astype(np.int64)[row] % count[leaf]
            copies = count[leaf]
            rank = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            row, leaf, part = np.repeat(row, copies), np.repeat(leaf, copies), np.repeat(part, copies)
            out = batch.iloc[row].reset_index(drop=True)
            out["leaf"], out["part"] = leaf.astype("int32"), part.astype("int32")
            out["block_a"], out["block_b"] = np.minimum(part, rank).astype("int32"), np.maximum(part, rank).astype("int32")
            out["home"] = own[row] == leaf
            out["region"], out["boundary"] = None, None
            yield out[["space", "leaf", "block_a", "block_b", "site", "x", "y", "party", "home", "part", "region", "boundary"]]

    return route


def _route_regions(splits: Splits, blocks: list[int], metric: str):
    """Copies of each region for the leaves that its bounding box meets."""

    def route(batches):
        for batch in batches:
            out = []
            for space, region, boundary in zip(batch.space, batch.region, batch.boundary):
                edges = read_edges(boundary)
                if edges is None:
                    continue
                if metric == "sphere":
                    # Edges are straight in degrees; the box of the region's degrees bounds its unit vectors.
                    _, leaves = splits.leaves(*degree_boxes(*edges[:, :2].min(axis=0), *edges[:, :2].max(axis=0)))
                else:
                    low, high = edges[:, :2].min(axis=0), edges[:, :2].max(axis=0)
                    _, leaves = splits.leaves(plane_vectors(low[:1], low[1:]), plane_vectors(high[:1], high[1:]))
                out += [(space, leaf, b, b, None, None, None, None, None, None, region, boundary) for leaf in leaves for b in range(blocks[leaf])]
            frame = pd.DataFrame(out, columns=["space", "leaf", "block_a", "block_b", "site", "x", "y", "party", "home", "part", "region", "boundary"])
            yield frame.astype({"site": "Int64", "x": "float64", "y": "float64", "party": "Int64", "home": "boolean", "part": "Int32", "region": "Int64"})

    return route


def _search_leaf(reach: float, metric: str):
    # Arrow data, since pandas would turn the ids of a column with nulls into floats. Pairs leave as they are found, so a task never holds all of them.
    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block_a, block_b = key[2].as_py(), key[3].as_py()
        rows = pa.Table.from_batches(list(batches))
        is_region = pc.is_valid(rows.column("region"))
        sites, regions = rows.filter(pc.invert(is_region)), rows.filter(is_region)

        def found(kind: str, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([kind] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["kind", "a", "b"])

        if not len(sites):
            return
        site, party, home, part, x, y = (sites.column(c).to_numpy() for c in ("site", "party", "home", "part", "x", "y"))
        for i, j in close_pairs(to_vectors(x, y, metric), reach):
            keep = home[np.where(site[i] < site[j], i, j)] & (party[i] != party[j])
            if block_a != block_b:
                keep &= part[i] != part[j]
            i, j = i[keep], j[keep]
            if len(i):
                yield found("near", np.minimum(site[i], site[j]), np.maximum(site[i], site[j]))
        if block_a == block_b and len(regions):
            at_home = np.flatnonzero(home)
            swept = SweptPoints(x[at_home], y[at_home])
            for region, boundary in zip(regions.column("region").to_pylist(), regions.column("boundary").to_pylist()):
                within = site[at_home[swept.inside(read_edges(boundary))]]
                if len(within):
                    yield found("inside", np.full(len(within), region), within)

    return search


def _blocks(splits: Splits, total: int, leaf_points: int, task_pairs: int) -> list[int]:
    """Blocks of sites of each leaf: so many that no pair of blocks holds far more sites, or finds far more pairs, than a task should."""
    by_sites = [share * total / (2 * leaf_points) for share in splits.shares]
    by_pairs = [math.sqrt(near / task_pairs) * share * total for share, near in zip(splits.shares, splits.near)]
    return [max(1, math.ceil(max(a, b)) if max(a, b) > 1 else 1) for a, b in zip(by_sites, by_pairs)]


def near_and_inside(
    sites: DataFrame,
    regions: DataFrame,
    radius: float,
    metric: str = "plane",
    sphere_radius: float = 6_371_008.8,
    sample: int = SPLIT_SAMPLE,
    leaf_points: int = LEAF_POINTS,
    task_pairs: int = TASK_PAIRS,
) -> DataFrame:
    """(kind, a, b): `near` pairs of sites a < b at most `radius` apart, of different parties; `inside` region a and site b.

    `sites` has site (unique long), space (int; sites of different spaces never meet), x, y and party (long; equal parties never pair), none null.
    `regions` has space, region and boundary (WKT). Unreadable boundaries contain nothing; a point on a boundary or in a hole is not inside.
    With metric `sphere`, x and y are degrees and `radius` is in the unit of `sphere_radius`. Empty inputs give no rows.
    """
    reach = chord(radius, sphere_radius) if metric == "sphere" else float(radius)
    sites = sites.select("site", "space", "x", "y", "party")
    splits, total = fit_splits(sites, ("x", "y"), reach, metric, sample, leaf_points)
    blocks = _blocks(splits, total, leaf_points, task_pairs)
    routed = sites.mapInPandas(_route_sites(splits, blocks, reach, metric), _ROUTED).unionByName(
        regions.select("space", "region", "boundary")
        .filter("space is not null and region is not null and boundary is not null")
        .mapInPandas(_route_regions(splits, blocks, metric), _ROUTED)
    )
    return routed.groupBy("space", "leaf", "block_a", "block_b").applyInArrow(_search_leaf(reach, metric), "kind string, a long, b long")


def near_operations(operations: DataFrame, tables: DataFrame, zones: DataFrame, radius: float = 5.0, **options) -> DataFrame:
    """Distinct (kind, key_a, key_b): located operations at most `radius` apart that concern different objects, and the zones that contain them.

    Operations of one object at one place are one site, so a place or an object with very many operations adds work only where it adds results.
    An operation without object_id shares no object with any other.
    """
    located = located_operations(operations, tables).withColumn(
        "party", F.when(F.col("object_id").isNull(), F.xxhash64(F.lit("operation"), "op_id")).otherwise(F.xxhash64("table_key", "object_id"))
    )
    place = ["srid", "x", "y", "party"]
    located = cut_lineage(located.withColumn("site", F.xxhash64(*place)).select("op_id", "site", *place))
    sites = located.groupBy("site").agg(F.first("srid").alias("space"), F.first("x").alias("x"), F.first("y").alias("y"), F.first("party").alias("party"))
    found = near_and_inside(sites, zones.select(F.col("srid").alias("space"), F.col("zone_id").alias("region"), "boundary"), radius, **options)
    members = located.select("site", "op_id")
    right = found.join(members.select(F.col("site").alias("b"), F.col("op_id").alias("op_b")), "b")
    # One pass for both kinds, so that no leaf is searched twice: what is inside a region meets no first site, and is spread by its own.
    near = F.col("kind") == "near"
    first = right.withColumn("first", F.when(near, F.col("a")).otherwise(F.xxhash64("b", F.lit("inside"))))
    both = first.join(members.select(F.col("site").alias("first"), F.col("op_id").alias("op_a")), "first", "left")
    pairs = both.filter(~near | (F.col("op_a") != F.col("op_b")))
    low, high = F.least("op_a", "op_b"), F.greatest("op_a", "op_b")
    return pairs.select("kind", F.when(near, low).otherwise(F.col("a")).alias("key_a"), F.when(near, high).otherwise(F.col("op_b")).alias("key_b")).distinct()
