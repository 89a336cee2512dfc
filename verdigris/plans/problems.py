"""The queries of the general data problems, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators.changefeed import current_rows, version_outcomes, version_tip
from verdigris.operators.datadiff import record_differences
from verdigris.operators.hierarchy import all_descendants, full_hierarchy, hierarchy_faults
from verdigris.operators.hotkeys import heavy_key_counts, key_counts
from verdigris.operators.orphans import orphan_counts, orphan_references, state_references
from verdigris.operators.proximity import near_operations
from verdigris.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_operations(table(spark, sf_dir, "edit_operations"), table(spark, sf_dir, "table_info"), table(spark, sf_dir, "zones"))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = [table(spark, sf_dir, t) for t in ("sde_state_locks", "sde_versions", "sde_state_lineages")]
    return orphan_references(state_references(*named), table(spark, sf_dir, "sde_states"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir).select("ref_table", "ref_key", "state_id", "period")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_counts(_orphans(spark, sf_dir))


def _feed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    return tuple(table(spark, sf_dir, t) for t in ("a19", "d19", "sde_states", "sde_versions"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return version_outcomes(*_feed(spark, sf_dir))


def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that sde.DEFAULT shows, whole: each object with the state and all values of its visible row."""
    adds, deletes, states, versions = _feed(spark, sf_dir)
    shown = current_rows(adds, deletes, states, version_tip(versions, "sde", "DEFAULT"), ("val", "parcel_class", "area_m2"))
    return shown.select("objectid", F.col("state").alias("sde_state_id"), "image.*")


_KEYED = (("a19", "sde_state_id", "objectid"), ("sde_state_lineages", "lineage_name", "lineage_id"))


def _keyed(spark: SparkSession, sf_dir: str, count) -> DataFrame:
    parts = [count(table(spark, sf_dir, t), key, value).select(F.lit(t).alias("src_table"), "key_id", "n_rows", "n_distinct") for t, key, value in _KEYED]
    return parts[0].unionByName(parts[1])


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, heavy_key_counts)


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir, key_counts)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy_faults(table(spark, sf_dir, "sde_states"), table(spark, sf_dir, "sde_state_lineages"))


def p5_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every state with its end, depth, number of descendants and whole path, written as a/b/c."""
    found = full_hierarchy(table(spark, sf_dir, "sde_states"), "state_id", "parent_state_id", unrooted=True)
    return found.withColumn("path", F.array_join(F.col("path").cast("array<string>"), "/"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_descendants(table(spark, sf_dir, "sde_states"), "state_id", "parent_state_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_differences(table(spark, sf_dir, "changed_features"), ["registration_id", "objectid", "state_id"])


QUERIES = {f.__name__: f for f in (p1_found, p2_found, p2_counts, p3_found, p3_rows, p4_found, p4_counts, p5_found, p5_hierarchy, p5_descendants, p6_found)}
