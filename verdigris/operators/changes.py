"""Change sets of a range of states."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.fabric import Fabric, FeatureTable
from verdigris.operators.versioned import of_states


def table_changes(table: FeatureTable, states: DataFrame) -> DataFrame:
    """(table_name, objectid, state_id, change_type): adds alone are inserts, adds and markers updates, markers alone deletes, whatever their order."""
    added = of_states(table.adds, "sde_state_id", states).select("objectid", F.lit(1).alias("a"), F.col("sde_state_id").alias("s"))
    marked = of_states(table.deletes, "sde_state_id", states).select(F.col("sde_deletes_row_id").alias("objectid"), F.lit(0).alias("a"), F.col("sde_state_id").alias("s"))
    by_object = added.unionByName(marked).groupBy("objectid").agg(
        F.max(F.when(F.col("a") == 1, F.col("s"))).alias("add_state"), F.max(F.when(F.col("a") == 0, F.col("s"))).alias("delete_state")
    )
    kind = F.when(F.col("delete_state").isNull(), F.lit("insert")).when(F.col("add_state").isNull(), F.lit("delete")).otherwise(F.lit("update"))
    return by_object.select(F.lit(table.name).alias("table_name"), "objectid", F.coalesce("add_state", "delete_state").alias("state_id"), kind.alias("change_type"))


def all_changes(fabric: Fabric, states: DataFrame, tables: list[str] | None = None) -> DataFrame:
    return reduce(DataFrame.unionByName, [table_changes(fabric.tables[t], states) for t in tables or sorted(fabric.tables)])


def changed_features(table: FeatureTable, changes: DataFrame, version_rows: DataFrame) -> DataFrame:
    """The changes with the version's row; null for deletes and rows that the version no longer sees."""
    rows = version_rows.select(*[F.col(c).alias(c if c == "objectid" else f"row_{c}") for c in version_rows.columns])
    joined = changes.join(rows, "objectid", "left")
    hidden = F.col("change_type") == "delete"
    return joined.select("table_name", "objectid", "state_id", "change_type", *[F.when(~hidden, F.col(c)).alias(c.removeprefix("row_")) for c in rows.columns if c != "objectid"])


def changes_summary(changes: DataFrame) -> DataFrame:
    """(change_type, n_changes, n_tables)."""
    return changes.groupBy("change_type").agg(F.count(F.lit(1)).alias("n_changes"), F.countDistinct("table_name").alias("n_tables"))


def version_stats(fabric: Fabric, states: DataFrame) -> DataFrame:
    """(table_name, n_adds, n_deletes) of delta rows, tables without any left out."""

    def one(table: FeatureTable) -> DataFrame:
        rows = of_states(table.adds, "sde_state_id", states).select(F.lit(1).alias("a")).unionByName(of_states(table.deletes, "sde_state_id", states).select(F.lit(0).alias("a")))
        return rows.groupBy(F.lit(table.name).alias("table_name")).agg(F.sum("a").alias("n_adds"), F.sum(1 - F.col("a")).alias("n_deletes"))

    return reduce(DataFrame.unionByName, [one(t) for t in fabric.tables.values()])


def count_changes(fabric: Fabric, states: DataFrame) -> DataFrame:
    """(n_changes): rows of adds and markers in the states, not distinct objects."""
    return version_stats(fabric, states).agg(F.coalesce(F.sum(F.col("n_adds") + F.col("n_deletes")), F.lit(0)).alias("n_changes"))
