"""Dense numbering of ids without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from starfold.session import new_folder


def dense_index(ids: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Number the distinct ids of a numeric key 0, 1, 2, … in ascending order.

    The ids are dealt to value ranges of about equal population, sorted in their range and
    written with their place in it. Only one row per range, its size, meets in a single task.
    """
    spark = ids.sparkSession
    path = new_folder(spark, "ranges")
    ranged = ids.select(key).distinct().repartitionByRange(key).sortWithinPartitions(key)
    # the number of the range above bit 33, the place in it below
    ranged.withColumn("_place", F.monotonically_increasing_id()).write.parquet(path)
    placed = spark.read.parquet(path).select(
        key, F.shiftright("_place", 33).alias("_range"), F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)).alias("_pos"))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    return placed.join(starts, "_range").select(key, (F.col("_start") + F.col("_pos")).cast("long").alias(name))
