"""Reading a table as a version sees it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.fabric import ROOT, Fabric, FeatureTable, StateTree, state_set
from verdigris.operators.hierarchy import paths
from verdigris.operators.spreadtree import SpreadTree


def of_states(rows: DataFrame, column: str, states: DataFrame) -> DataFrame:
    """The rows whose `column` is among `states` (state)."""
    return rows.join(states.select(F.col("state").alias("__member")), F.col(column) == F.col("__member"), "left_semi")


def not_of_states(rows: DataFrame, column: str, states: DataFrame) -> DataFrame:
    """The other rows, those with a null among them."""
    return rows.join(states.select(F.col("state").alias("__member")), F.col(column) == F.col("__member"), "left_anti")


def newest_adds(table: FeatureTable, states: DataFrame) -> DataFrame:
    """The add of the largest state of each object, of all payload columns and sde_state_id; combined before the shuffle."""
    row = F.struct(*[F.col(c) for c in table.columns])
    newest = of_states(table.adds, "sde_state_id", states).groupBy("objectid").agg(F.max("sde_state_id").alias("__state"), F.max_by(row, "sde_state_id").alias("__row"))
    return newest.select(*[F.col(f"__row.`{c}`").alias(c) for c in table.columns], F.col("__state").alias("sde_state_id"))


def surviving_adds(table: FeatureTable, states: DataFrame) -> DataFrame:
    """The newest adds that no later delete marker of the states takes away; a marker of the same state does not."""
    last = of_states(table.deletes, "sde_state_id", states).groupBy(F.col("sde_deletes_row_id").alias("__oid")).agg(F.max("sde_state_id").alias("__gone"))
    joined = newest_adds(table, states).join(last, F.col("objectid") == F.col("__oid"), "left")
    return joined.filter("__gone is null or __gone <= sde_state_id").drop("__oid", "__gone")


def hidden_objects(table: FeatureTable, states: DataFrame) -> DataFrame:
    """(__oid) of the objects whose base row the states hide: by any add, or by a marker whose deleted_at is among them."""
    by_add = of_states(table.adds, "sde_state_id", states).select(F.col("objectid").alias("__oid"))
    by_marker = of_states(table.deletes, "deleted_at", states).select(F.col("sde_deletes_row_id").alias("__oid"))
    return by_add.unionByName(by_marker).distinct()


def read_states(table: FeatureTable, states: DataFrame) -> DataFrame:
    """The rows visible under a set of states."""
    columns = [c for c in table.base.columns if c in table.columns]
    base = table.base.join(hidden_objects(table, states), F.col("objectid") == F.col("__oid"), "left_anti")
    return base.select(*columns).unionByName(surviving_adds(table, states).select(*columns))


def read_version(fabric: Fabric, table: str, version: str) -> DataFrame:
    """The table as the version sees it; a version at the root state sees the base rows."""
    tip = fabric.tip(version)
    return read_states(fabric.tables[table], state_set(fabric.spark, fabric.tree().walk(tip)))


def read_options(
    rows: DataFrame,
    where: str | Column | None = None,
    out_fields: list[str] | None = None,
    order_by: list[str] | None = None,
    limit: int | None = None,
    offset: int | None = None,
) -> DataFrame:
    """Filter, order, offset and limit, projection. A limit without order goes by objectid; an offset without limit and a limit of 0 are ignored."""
    if where is not None:
        rows = rows.filter(where)
    if order_by:
        rows = rows.orderBy(*[F.expr(o.rsplit(" ", 1)[0]).desc() if o.lower().endswith(" desc") else F.expr(o.removesuffix(" asc")) for o in order_by])
    elif limit:
        rows = rows.orderBy("objectid")
    if limit:
        rows = rows.offset(offset or 0).limit(limit)
    return rows.select(*out_fields) if out_fields else rows


def get_features(table: FeatureTable, ids: list[int]) -> DataFrame:
    """Base rows of these object ids."""
    return table.base.filter(F.col("objectid").isin([int(i) for i in ids])) if ids else table.base.limit(0)


def count_rows(table: FeatureTable, where: str | None = None) -> int:
    """Number of base rows."""
    return (table.base.filter(where) if where else table.base).count()


def rows_at_state(table: FeatureTable, ancestor: int, states: DataFrame) -> DataFrame:
    """For every object its newest add of a state up to `ancestor`, else its base row. Delete markers are ignored, as a row image is asked for."""
    columns = [c for c in table.base.columns if c in table.columns]
    newest = newest_adds(table, states.filter(F.col("state") <= ancestor)).select(*columns)
    return table.base.join(newest.select(F.col("objectid").alias("__oid")), F.col("objectid") == F.col("__oid"), "left_anti").select(*columns).unionByName(newest)


def feature_at_state(table: FeatureTable, objectid: int, ancestor: int, states: DataFrame) -> DataFrame:
    """The row image of one object; the filter on objectid reaches all scans."""
    return rows_at_state(table, ancestor, states).filter(F.col("objectid") == objectid)


def closure_states(fabric: Fabric, version: str) -> DataFrame:
    """The states that the stored closure gives for a version: members of its lineage_name up to its tip."""
    tip = fabric.tip(version)
    name = fabric.states.filter(F.col("state_id") == tip).select("lineage_name")
    members = fabric.lineages.join(name, "lineage_name", "left_semi").filter((F.col("lineage_id") <= tip) & (F.col("lineage_id") != ROOT))
    return members.select(F.col("lineage_id").alias("state")).distinct()


def read_closure(fabric: Fabric, table: str, version: str) -> DataFrame:
    """The table by the stored closure; its base rows are hidden by markers of state 0 and by adds only."""
    source, states = fabric.tables[table], closure_states(fabric, version)
    columns = [c for c in source.base.columns if c in source.columns]
    by_add = of_states(source.adds, "sde_state_id", states).select(F.col("objectid").alias("__oid"))
    by_marker = of_states(source.deletes.filter(F.col("sde_state_id") == ROOT), "deleted_at", states).select(F.col("sde_deletes_row_id").alias("__oid"))
    base = source.base.join(by_add.unionByName(by_marker).distinct(), F.col("objectid") == F.col("__oid"), "left_anti")
    return base.select(*columns).unionByName(surviving_adds(source, states).select(*columns))


def lineage_pairs(spark: SparkSession, tree: StateTree | SpreadTree, tips: list[int]) -> DataFrame:
    """(tip, state) for every distinct tip and each state of its walk."""
    import pandas as pd

    if isinstance(tree, SpreadTree):
        wanted = tree.rooted.join(spark.createDataFrame([(int(t),) for t in {*tips}], "node long"), "node", "left_semi").select("node")
        return paths(tree.solved, (ROOT,)).join(wanted, "node").select(F.col("node").alias("tip"), F.explode("path").alias("state")).filter(F.col("state") != ROOT)
    pairs = [(t, s) for t in sorted(set(tips)) for s in tree.walk(t)]
    return spark.createDataFrame(pd.DataFrame(pairs, columns=["tip", "state"], dtype="int64"), "tip long, state long")


def all_version_deltas(table: FeatureTable, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For all tips in one job: the surviving adds with their __tip, and (__tip, objectid) of the hidden base rows."""
    pairs = pairs.select(F.col("tip").alias("__tip"), F.col("state").alias("__member"))
    added = table.adds.join(pairs, F.col("sde_state_id") == F.col("__member"))
    row = F.struct(*[F.col(c) for c in table.columns])
    newest = added.groupBy("__tip", "objectid").agg(F.max("sde_state_id").alias("__state"), F.max_by(row, "sde_state_id").alias("__row"))
    gone = table.deletes.join(pairs, F.col("sde_state_id") == F.col("__member")).groupBy("__tip", F.col("sde_deletes_row_id").alias("objectid")).agg(F.max("sde_state_id").alias("__gone"))
    kept = newest.join(gone, ["__tip", "objectid"], "left").filter("__gone is null or __gone <= __state")
    shown = kept.select("__tip", *[F.col(f"__row.`{c}`").alias(c) for c in table.columns])
    marked = table.deletes.join(pairs, F.col("deleted_at") == F.col("__member")).select("__tip", F.col("sde_deletes_row_id").alias("objectid"))
    return shown, added.select("__tip", "objectid").unionByName(marked).distinct()


def row_signature(columns: list[str]) -> Column:
    """A hash of a row for sums that do not depend on order."""
    return F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)")


def version_signatures(fabric: Fabric, table: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """(owner, name, n_rows and measures) of what each version sees; measures are summed, default an order-free hash of the rows.

    The base is added up once: a version has the sum of the base, less its hidden base rows, plus its adds. So the base is read once for any
    number of versions.
    """
    source = fabric.tables[table]
    columns = [c for c in source.base.columns if c in source.columns]
    measures = measures or {"signature": row_signature(columns)}
    versions = fabric.versions.select("owner", "name", F.coalesce("state_id", F.lit(ROOT)).alias("tip"))
    tips = [r.tip for r in versions.select("tip").distinct().collect()]
    pairs = lineage_pairs(fabric.spark, fabric.tree(), tips)
    shown, hidden = all_version_deltas(source, pairs)

    def sums(rows: DataFrame, keys: list[str], sign: int) -> DataFrame:
        parts = [F.lit(sign).cast("long").alias("n_rows"), *[(sign * m).alias(k) for k, m in measures.items()]]
        return rows.select(*keys, *parts).groupBy(*keys).agg(*[F.sum(k).alias(k) for k in ("n_rows", *measures)])

    plus = sums(shown, ["__tip"], 1)
    minus = sums(hidden.join(source.base, "objectid"), ["__tip"], -1)
    base = sums(source.base, [], 1)
    deltas = plus.unionByName(minus).groupBy(F.col("__tip").alias("tip")).agg(*[F.sum(k).alias(f"d_{k}") for k in ("n_rows", *measures)])
    total = base.first()
    kinds = dict(base.dtypes)
    joined = versions.join(deltas, "tip", "left")
    return joined.select("owner", "name", *[(F.lit(total[k] or 0).cast(kinds[k]) + F.coalesce(f"d_{k}", F.lit(0))).alias(k) for k in ("n_rows", *measures)])

