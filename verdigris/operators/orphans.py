"""References to records that do not exist."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def living_keys(parents: DataFrame, key: str, order: str, removed: str) -> DataFrame:
    """Distinct `key` whose copy with the latest `order` has no `removed`.

    A null `order` is the earliest. Of copies that tie for the latest, one that is removed decides.
    """
    latest = F.max(F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"), F.col(removed).isNotNull().alias("gone")))
    return parents.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(latest.alias("last")).filter("not last.gone").select("key")


def reference(rows: DataFrame, name: str, label: Column, key: str, period: str) -> DataFrame:
    """One referring table as (ref_table, ref_key, state_id, period); null references are left out, a null time has the period `unknown`."""
    return rows.filter(F.col(key).isNotNull()).select(
        F.lit(name).alias("ref_table"),
        label.alias("ref_key"),
        F.col(key).cast("long").alias("state_id"),
        F.coalesce(F.date_format(period, "yyyy-MM"), F.lit("unknown")).alias("period"),
    )


def orphan_references(references: list[DataFrame], parents: DataFrame, key: str = "state_id", order: str = "loaded_at", removed: str = "removed_at") -> DataFrame:
    """(ref_table, ref_key, state_id, period, n_rows) of the references to keys that no living parent has.

    Rows are first combined to distinct references with their counts, so that a key that many rows name travels once per map task. The anti-join
    sees each distinct foreign key once; its result, the missing keys, is joined back. A reference whose parent arrives in any later load is none.
    Empty tables give no rows.
    """
    rows = reduce(DataFrame.unionByName, references)
    grouped = rows.groupBy("ref_table", "ref_key", "state_id", "period").agg(F.count(F.lit(1)).alias("n_rows"))
    missing = rows.select("state_id").distinct().join(living_keys(parents, key, order, removed), F.col("state_id") == F.col("key"), "left_anti")
    return grouped.join(missing, "state_id", "left_semi").select("ref_table", "ref_key", "state_id", "period", "n_rows")


def state_references(locks: DataFrame, versions: DataFrame, lineages: DataFrame) -> list[DataFrame]:
    """The three tables that name states. A null owner or name counts as empty in the label."""
    return [
        reference(locks, "sde_state_locks", F.col("sde_id").cast("string"), "state_id", "lock_time"),
        reference(versions, "sde_versions", F.concat(F.coalesce("owner", F.lit("")), F.lit("."), F.coalesce("name", F.lit(""))), "state_id", "creation_time"),
        reference(lineages, "sde_state_lineages", F.col("lineage_name").cast("string"), "lineage_id", "added_at"),
    ]


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """(ref_table, period, n_rows, n_states): orphan rows and missing states per table and period."""
    return orphans.groupBy("ref_table", "period").agg(F.sum("n_rows").alias("n_rows"), F.countDistinct("state_id").alias("n_states"))
