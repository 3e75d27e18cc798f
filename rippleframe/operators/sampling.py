"""Name lists, batches, random crops and block order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def split_by_list(clips: DataFrame, names: DataFrame | None, pattern: str = "%frame_mask%") -> DataFrame:
    """clips whose name is in the list; without a list, those whose name fits the pattern."""
    return clips.filter(F.col("name").like(pattern)) if names is None else clips.join(names.select("name").distinct(), "name", "left_semi")


def batches(clips: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """clips with batch and place, shuffled by a hash of key and seed.

    Places come from counts of hash ranges and a rank inside each range, so no
    task ranks the whole table.
    """
    rows = clips.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed))).withColumn("_r", F.expr("shiftright(_h, 54)"))
    counts = rows.groupBy("_r").agg(F.count("*").alias("_n"))
    ahead = counts.withColumn("_a", F.coalesce(F.sum("_n").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_r", "_a")  # at most 1024 rows
    place = F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)) + F.col("_a") - 1
    return rows.join(F.broadcast(ahead), "_r").withColumn("place", place).withColumn("batch", F.expr(f"place div {size}")).drop("_h", "_r", "_a")


def random_crop(samples: DataFrame, keys: list[str], size: int, seed: int, height: int, width: int) -> DataFrame:
    """One size x size window for each key, shifted to its origin; tables with the same keys and seed get the same windows."""
    y0 = F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(height - size + 1)).cast("int")
    x0 = F.pmod(F.xxhash64(*keys, F.lit(seed + 1)), F.lit(width - size + 1)).cast("int")
    out = samples.withColumn("_y", F.col("y") - y0).withColumn("_x", F.col("x") - x0)
    return out.filter(F.col("_y").between(0, size - 1) & F.col("_x").between(0, size - 1)).withColumn("y", F.col("_y")).withColumn("x", F.col("_x")).drop("_y", "_x")


def quadtree_order(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """blocks in pre-order with their place: a parent's path sorts before its children's."""
    return blocks.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("path")) - 1).orderBy(*keys, "place")
