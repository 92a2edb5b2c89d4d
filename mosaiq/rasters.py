"""Rasters and logs derived from the driver's tables.

A pixel relation (PX) has one row per pixel: y, x and channels as DOUBLE. Keys of the source
tables are dense, so a row of 50 pixels is 50 consecutive keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def q(value: Column) -> Column:
    """Quantise to a millionth, half up, the same in every engine."""
    return F.floor(value * 1e6 + 0.5) / 1e6


def _grid(key: str) -> list[Column]:
    return [F.floor(F.col(key) / WIDTH).cast("int").alias("y"), (F.col(key) % WIDTH).cast("int").alias("x")]


def raster_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense bottom layer, from orders."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").select(
        *_grid("o_orderkey"),
        (F.col("o_totalprice") / 524287.0).alias("r"),
        ((F.col("o_custkey") % 256) / 255.0).alias("g"),
        (F.substring("o_orderpriority", 1, 1).cast("double") / 5.0).alias("b"),
        F.when(status == "F", 1.0).when(status == "O", 0.5).otherwise(0.0).alias("a"),
    )


def raster_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shorter top layer, from events."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        *_grid("event_id"),
        F.least(F.col("value") / 613.0, F.lit(1.0)).alias("r"),
        ((F.col("user_id") % 256) / 255.0).alias("g"),
        (F.length("event_type") / 8.0).alias("b"),
        F.when(kind == "view", 1.0).when(kind == "click", 0.75).when(kind == "error", 0.0).otherwise(0.5).alias("a"),
    )


def raster_a8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole samples 0 to 255."""
    return table(spark, sf_dir, "orders").select(*_grid("o_orderkey"), (F.col("o_custkey") % 256).cast("int").alias("v"))


def raster_e(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 64 pixel wide raster with negative values, from embeddings."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("y"), F.posexplode("embedding").alias("x", "v")).withColumn("v", F.col("v").cast("double"))


def tile_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile writes, some of which arrive late."""
    kind = F.col("event_type")
    late = F.when(kind == "error", 40).when(kind == "signup", 12).otherwise(0)
    return table(spark, sf_dir, "events").select((F.col("user_id") % 8).cast("int").alias("tx"), (F.col("event_id") % 4).cast("int").alias("ty"), F.col("event_id").alias("arrival"), (F.col("event_id") - late).alias("version"), F.col("value").alias("payload"))


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations of documents, with undo and redo."""
    names = {"click": "SetLayerOpacity", "view": "SetLayerVisible", "purchase": "SetLayerBlend", "signup": "Redo"}
    action = F.lit("Undo")
    for kind, name in names.items():
        action = F.when(F.col("event_type") == kind, name).otherwise(action)
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), action.alias("action"), (F.col("user_id") % 3).cast("int").alias("layer_id"), F.least(F.col("value") / 613.0, F.lit(1.0)).alias("arg"))
