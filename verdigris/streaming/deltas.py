"""Following a growing folder of deltas, and keeping a version's rows current."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators.changefeed import signed_images


def follow(spark: SparkSession, folder: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def without_repeats(feed: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """A feed without repeated deliveries, as long as a repeat comes within `late`; the state of older keys is dropped."""
    return feed.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def changes_per_window(feed: DataFrame, time: str, late: str, width: str) -> DataFrame:
    """(window_start, sde_state_id, n_changes) of a feed, each window once it is complete."""
    counted = feed.withWatermark(time, late).groupBy(F.window(time, width), "sde_state_id").agg(F.count(F.lit(1)).alias("n_changes"))
    return counted.select(F.col("window.start").alias("window_start"), "sde_state_id", "n_changes")


def apply_feed(feed: DataFrame, multiset: str, checkpoint: str, publish: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Adds every batch of changes (objectid, state, image, hides_base) to the folder `multiset`, by batch number, so that a batch that is repeated after
    a failure replaces itself; then hands the visible rows to `publish`.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{multiset}/batch={number}")
        if publish is not None:
            publish(visible_rows(rows.sparkSession, multiset), number)

    return feed.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def visible_rows(spark: SparkSession, multiset: str) -> DataFrame:
    """(objectid, state, image) of positive multiplicity after all batches so far, in whatever order the changes came."""
    changes = spark.read.parquet(multiset)
    latest = changes.groupBy("objectid", "state", F.col("image").isNotNull().alias("is_image")).agg(F.max("image").alias("image"), F.max("hides_base").alias("hides_base"))
    return signed_images(latest.select("objectid", "state", "image", "hides_base")).filter("multiplicity > 0").select("objectid", "state", "image")
