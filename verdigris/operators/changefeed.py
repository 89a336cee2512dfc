"""Applying a feed of inserts, updates and deletes as a signed multiset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.hierarchy import BLOCK_NODES, ancestors_of, links_of


def signed_images(changes: DataFrame) -> DataFrame:
    """(objectid, state, image, multiplicity) of deduplicated `changes` (objectid, state, image, hides_base).

    A row with an image is an insert or the new side of an update and counts +1 for it; a base row has state 0. A row without image is a delete. Each
    change counts -1 for its before-image, the image of the largest earlier state, which later changes cancel again and again; the base row is cancelled
    only by rows with hides_base. A delete whose state is null only hides the base row. `changes` has at most one image and one delete for an object
    and state, so the rows of one object are no more than twice the states.
    """
    by_object = Window.partitionBy("objectid")
    in_order = by_object.orderBy(F.coalesce("state", F.lit((1 << 63) - 1)), F.col("image").isNotNull())
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    own = F.when(F.col("image").isNotNull(), F.struct("state", "image"))
    traced = changes.select(
        "objectid",
        "state",
        own.alias("own"),
        F.last(F.when(F.col("state") > 0, own), ignorenulls=True).over(earlier).alias("before"),
        F.when(F.col("hides_base"), F.first(F.when(F.col("state") == 0, own), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))).alias("base"),
    )
    # A delete and an add of one state are an update: the delete comes first in the order and so never cancels that add.
    signed = F.array(
        F.struct(F.lit(1).alias("sign"), F.col("own").alias("row")),
        F.struct(F.lit(-1).alias("sign"), F.when(F.col("state") > F.col("before.state"), F.col("before")).alias("row")),
        F.struct(F.lit(-1).alias("sign"), F.col("base").alias("row")),
    )
    terms = traced.select("objectid", F.explode(F.filter(signed, lambda t: t["row"].isNotNull())).alias("t"))
    return terms.groupBy("objectid", F.col("t.row.state").alias("state"), F.col("t.row.image").alias("image")).agg(F.sum("t.sign").alias("multiplicity"))


def deduplicated_changes(adds: DataFrame, deletes: DataFrame, lineage: DataFrame, payload: tuple[str, ...] = ()) -> DataFrame:
    """The changes of `lineage` (state), for signed_images, from repeated and unordered deliveries; the image is the largest edit_seq of a delivery, with
    `payload` a row of edit_seq and these columns of that delivery, of several with the same edit_seq the largest.

    adds(objectid, sde_state_id, edit_seq), deletes(sde_deletes_row_id, sde_state_id, deleted_at). Rows of state 0 among the adds are the base.
    Null object ids and states name nothing and are left out; a null edit_seq counts as 0.
    """
    adds, deletes = adds.select("objectid", "sde_state_id", F.coalesce("edit_seq", F.lit(0)).alias("edit_seq"), *payload), deletes.select("sde_deletes_row_id", "sde_state_id", "deleted_at")
    within = F.col("state") == F.col("sde_state_id")
    marked = lineage.select("state")
    images = (
        adds.filter("objectid is not null and sde_state_id is not null")
        .join(marked.unionByName(marked.sparkSession.createDataFrame([(0,)], "state long")), within, "left_semi")
        .groupBy("objectid", F.col("sde_state_id").alias("state"))
        .agg(F.max(F.struct("edit_seq", *payload) if payload else F.col("edit_seq")).alias("image"))
        .withColumn("hides_base", F.col("state") != 0)
    )
    gone = (
        deletes.filter("sde_deletes_row_id is not null")
        .join(marked.select(F.col("state").alias("own")), F.col("own") == F.col("sde_state_id"), "left")
        .join(marked.select(F.col("state").alias("from_base")), F.col("from_base") == F.col("deleted_at"), "left")
        .filter("own is not null or from_base is not null")
        .groupBy(F.col("sde_deletes_row_id").alias("objectid"), F.col("own").alias("state"))
        .agg(F.max(F.col("from_base").isNotNull()).alias("hides_base"))
        .withColumn("image", F.lit(None).cast(images.schema["image"].dataType))
    )
    return images.unionByName(gone)


def version_tip(versions: DataFrame, owner: str, name: str) -> int | None:
    """The state_id of the latest loaded row of a version; ties take the larger state."""
    row = versions.filter((F.col("owner") == owner) & (F.col("name") == name)).agg(F.max_by("state_id", F.struct(F.col("loaded_at"), F.col("state_id")))).first()
    return row[0]


def current_rows(adds: DataFrame, deletes: DataFrame, states: DataFrame, tip: int | None, payload: tuple[str, ...] = (), block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(objectid, state, image) that the version with `tip` shows: the images of positive multiplicity, with `payload` whole rows."""
    lineage = ancestors_of(links_of(states, "state_id", "parent_state_id"), tip, 0, block_nodes)
    return signed_images(deduplicated_changes(adds, deletes, lineage, payload)).filter("multiplicity > 0").select("objectid", "state", "image")


def version_outcomes(adds: DataFrame, deletes: DataFrame, states: DataFrame, versions: DataFrame, owner: str = "sde", name: str = "DEFAULT", block_nodes: int = BLOCK_NODES) -> DataFrame:
    """(objectid, outcome, edit_seq): how the version differs from the base rows.

    `insert`: an added row shows and there is no base row; `update`: it shows in place of a base row; `delete`: a base row exists and nothing shows,
    edit_seq 0. All from the signed multiset of the objects, grouped once more by object without another shuffle. No tip: no rows but none hidden.
    """
    lineage = ancestors_of(links_of(states, "state_id", "parent_state_id"), version_tip(versions, owner, name), 0, block_nodes)
    signed = signed_images(deduplicated_changes(adds, deletes, lineage))
    shown = F.col("multiplicity") > 0
    objects = signed.groupBy("objectid").agg(
        F.max(F.col("state") == 0).alias("has_base"), F.max(shown).alias("visible"), F.max(F.when(shown & (F.col("state") > 0), F.col("image"))).alias("image")
    )
    outcome = F.when(F.col("image").isNotNull(), F.when(F.col("has_base"), F.lit("update")).otherwise(F.lit("insert"))).when(F.col("has_base") & ~F.col("visible"), F.lit("delete"))
    return objects.select("objectid", outcome.alias("outcome"), F.coalesce("image", F.lit(0)).alias("edit_seq")).filter("outcome is not null")
