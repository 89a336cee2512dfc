"""Conflicts between two change sets, field by field, and classification for a rebase."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.values import compared_columns, row_hash, values_equal
from verdigris.operators.fabric import FeatureTable
from verdigris.operators.versioned import newest_adds, of_states


def conflicts(child: DataFrame, parent: DataFrame) -> DataFrame:
    """(table_name, objectid, child_change, child_state, parent_change, parent_state) of the objects that both sides changed."""
    ours = child.select("table_name", "objectid", F.col("change_type").alias("child_change"), F.col("state_id").alias("child_state"))
    theirs = parent.select("table_name", "objectid", F.col("change_type").alias("parent_change"), F.col("state_id").alias("parent_state"))
    return ours.join(theirs, ["table_name", "objectid"])


def _image(table: FeatureTable, prefix: str) -> DataFrame:
    return table.adds.select(
        F.col("objectid"), F.col("sde_state_id").alias(f"{prefix}_state"), F.struct(*[F.col(c) for c in table.columns]).alias(prefix)
    )


def detailed_conflicts(table: FeatureTable, found: DataFrame) -> DataFrame:
    """The conflicts of one table with their fields.

    An update of both sides is compared with the base row: field_conflicts (field, child, parent, base), child_only and parent_only name the changed
    fields. It is auto_mergeable without field conflicts, and has a suggested_merge if the parent changed any field. Where an image is missing, and for
    all other pairs, the conflict is of the row: row_level.
    """
    kinds = {f.name: f.dataType for f in table.adds.schema.fields}
    base = table.base.select("objectid", F.struct(*[F.col(c) for c in table.columns if c in table.base.columns]).alias("base"))
    both = (F.col("child_change") == "update") & (F.col("parent_change") == "update")
    joined = found.join(_image(table, "child"), ["objectid", "child_state"], "left").join(_image(table, "parent"), ["objectid", "parent_state"], "left").join(base, "objectid", "left")
    compared = [c for c in compared_columns(table.columns) if c in table.base.columns]

    def changed(side: str, name: str) -> Column:
        return ~values_equal(F.col(f"{side}.`{name}`"), F.col(f"base.`{name}`"), kinds[name])

    def agree(name: str) -> Column:
        return values_equal(F.col(f"child.`{name}`"), F.col(f"parent.`{name}`"), kinds[name])

    def text(side: str, name: str) -> Column:
        return F.col(f"{side}.`{name}`").cast("string").alias(side)

    def named(test) -> Column:
        return F.filter(F.array(*[F.when(test(c), F.lit(c)) for c in compared]), lambda n: n.isNotNull())

    fields = F.filter(
        F.array(*[F.when(changed("child", c) & changed("parent", c) & ~agree(c), F.struct(F.lit(c).alias("field"), text("child", c), text("parent", c), text("base", c))) for c in compared]),
        lambda f: f.isNotNull(),
    )
    whole = both & F.col("child").isNotNull() & F.col("parent").isNotNull() & F.col("base").isNotNull()
    detailed = joined.select(
        *found.columns,
        (~whole).alias("row_level"),
        F.when(whole, fields).alias("field_conflicts"),
        F.when(whole, named(lambda c: changed("child", c) & ~changed("parent", c))).alias("child_only"),
        F.when(whole, named(lambda c: changed("parent", c) & ~changed("child", c))).alias("parent_only"),
        F.struct(*[F.when(changed("parent", c) & ~changed("child", c), F.col(f"parent.`{c}`")).otherwise(F.col(f"child.`{c}`")).alias(c) for c in compared]).alias("merged"),
    )
    mergeable = ~F.col("row_level") & (F.size("field_conflicts") == 0)
    return detailed.select(*found.columns, "row_level", "field_conflicts", "child_only", "parent_only", F.coalesce(mergeable, F.lit(False)).alias("auto_mergeable"), F.when(mergeable & (F.size("parent_only") > 0), F.col("merged")).alias("suggested_merge"))


def field_conflict_rows(detailed: DataFrame) -> DataFrame:
    """One row for each conflicting field."""
    return detailed.select("table_name", "objectid", F.explode("field_conflicts").alias("f")).select("table_name", "objectid", "f.field", "f.child", "f.parent", "f.base")


def conflict_summary(found: DataFrame) -> DataFrame:
    """(conflict_type child-parent, n_conflicts, n_tables)."""
    kind = F.concat_ws("-", "child_change", "parent_change").alias("conflict_type")
    return found.groupBy(kind).agg(F.count(F.lit(1)).alias("n_conflicts"), F.countDistinct("table_name").alias("n_tables"))


def changed_object_ids(table: FeatureTable, child_states: DataFrame, parent_states: DataFrame) -> DataFrame:
    """(objectid) of the child's newest adds that differ from the parent's newest add of the object."""
    columns = table.columns
    return newest_adds(table, child_states).select(*columns).subtract(newest_adds(table, parent_states).select(*columns)).select("objectid").distinct()


def deleted_object_ids(table: FeatureTable, states: DataFrame) -> DataFrame:
    """(objectid) with a marker and no add in the states."""
    marked = of_states(table.deletes, "sde_state_id", states).select(F.col("sde_deletes_row_id").alias("objectid")).distinct()
    return marked.join(of_states(table.adds, "sde_state_id", states).select("objectid"), "objectid", "left_anti")


def object_ids_with_adds(table: FeatureTable, states: DataFrame) -> DataFrame:
    return of_states(table.adds, "sde_state_id", states).select("objectid").distinct()


def object_ids_present(table: FeatureTable, states: DataFrame) -> DataFrame:
    """(objectid) that has a base row or an add in the states."""
    return table.base.select("objectid").union(of_states(table.adds, "sde_state_id", states).select("objectid")).distinct()


def touched_objects(table: FeatureTable, states: DataFrame) -> DataFrame:
    """(objectid) with an add in the states, or a marker whose state or deleted_at is among them."""
    return (
        of_states(table.adds, "sde_state_id", states).select("objectid")
        .union(of_states(table.deletes, "sde_state_id", states).select("sde_deletes_row_id"))
        .union(of_states(table.deletes, "deleted_at", states).select("sde_deletes_row_id"))
        .distinct()
    )


def classify_changes(table: FeatureTable, child_range: DataFrame, child: DataFrame, ancestor: DataFrame, parent: DataFrame) -> DataFrame:
    """(objectid, outcome) of the objects touched in the child's own states, from how child, ancestor and parent resolve them.

    child equal to ancestor: `drop`; parent equal to ancestor: `replay`, or `delete` where the child has none; child equal to parent: `drop`; else
    `conflict_add` or `conflict_delete`. Each argument after the table is a set of states: the child's own range, and the three lineages.

    Every delta is read once, with marks of the sets that its state is in; one aggregate by object resolves it for all three lineages, and only the
    touched objects meet the base.
    """
    columns = [c for c in table.columns if c in table.base.columns]
    sets = {"r": child_range, "c": child, "a": ancestor, "p": parent}
    rows = [s.select("state", *[F.lit(k == name).alias(k) for k in sets]) for name, s in sets.items()]
    marks = reduce(DataFrame.unionByName, rows).groupBy("state").agg(*[F.max(k).alias(k) for k in sets])

    def marked(prefix: str) -> DataFrame:
        return marks.select(F.col("state").alias(f"__{prefix}"), *[F.col(k).alias(f"__{prefix}_{k}") for k in sets])

    nothing = F.lit(None)
    # Both kinds of rows are hashed as values of one type.
    kinds = {f.name: f.dataType for f in table.base.select(*columns).unionByName(table.adds.select(*columns)).schema.fields}

    def hashed(rows: DataFrame) -> Column:
        return row_hash(rows, columns, kinds)

    adds = table.adds.join(marked("s"), F.col("sde_state_id") == F.col("__s")).select(
        F.col("objectid").alias("__oid"),
        F.col("sde_state_id").alias("__add"),
        hashed(table.adds).alias("__hash"),
        nothing.cast("long").alias("__gone"),
        *[F.col(f"__s_{k}").alias(f"__at_{k}") for k in sets],
        *[F.col(f"__s_{k}").alias(f"__hides_{k}") for k in sets],
    )
    known = table.deletes.join(marked("s"), F.col("sde_state_id") == F.col("__s"), "left").join(marked("d"), F.col("deleted_at") == F.col("__d"), "left")
    deletes = known.filter("__s is not null or __d is not null").select(
        F.col("sde_deletes_row_id").alias("__oid"),
        nothing.cast("long").alias("__add"),
        nothing.cast("string").alias("__hash"),
        F.col("sde_state_id").alias("__gone"),
        *[F.coalesce(f"__s_{k}", F.lit(False)).alias(f"__at_{k}") for k in sets],
        *[F.coalesce(f"__d_{k}", F.lit(False)).alias(f"__hides_{k}") for k in sets],
    )
    found = [F.max(F.col("__at_r") | F.col("__hides_r")).alias("__touched")]
    for k in ("c", "a", "p"):
        newest = F.when(F.col(f"__at_{k}"), F.col("__add"))
        found += [F.max(newest).alias(f"__add_{k}"), F.max_by("__hash", newest).alias(f"__hash_{k}"), F.max(F.when(F.col(f"__at_{k}"), F.col("__gone"))).alias(f"__gone_{k}"), F.max(f"__hides_{k}").alias(f"__hidden_{k}")]
    touched = adds.unionByName(deletes).groupBy("__oid").agg(*found).filter("__touched")
    base = table.base.select("objectid", hashed(table.base).alias("__base"))
    joined = touched.join(base, F.col("__oid") == F.col("objectid"), "left")

    def resolved(k: str) -> Column:
        shown = F.col(f"__gone_{k}").isNull() | (F.col(f"__gone_{k}") <= F.col(f"__add_{k}"))
        return F.when(F.col(f"__add_{k}").isNotNull(), F.when(shown, F.col(f"__hash_{k}"))).when(~F.col(f"__hidden_{k}"), F.col("__base"))

    values = joined.select(F.col("__oid").alias("objectid"), *[resolved(k).alias(k) for k in ("c", "a", "p")])
    present = F.col("c").isNotNull()
    outcome = (
        F.when(F.col("c").eqNullSafe(F.col("a")), F.lit("drop"))
        .when(F.col("p").eqNullSafe(F.col("a")), F.when(present, F.lit("replay")).otherwise(F.lit("delete")))
        .when(F.col("c").eqNullSafe(F.col("p")), F.lit("drop"))
        .otherwise(F.when(present, F.lit("conflict_add")).otherwise(F.lit("conflict_delete")))
    )
    return values.select("objectid", outcome.alias("outcome"))
