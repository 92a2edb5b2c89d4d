"""Layout of pixel relations: tiles, scan-lines, neighbourhoods, grids, extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tile_of(coordinate: Column, tile: int) -> Column:
    return F.floor(coordinate / tile).cast("int")


def to_tiles(px: DataFrame, tile: int, value: str = "v") -> DataFrame:
    """(ty, tx, px, py, width, height, samples): each tile's values in row order. One shuffle on the tile."""
    keyed = px.select(tile_of(F.col("y"), tile).alias("ty"), tile_of(F.col("x"), tile).alias("tx"), F.struct("y", "x", F.col(value).alias("v")).alias("s"))
    grouped = keyed.groupBy("ty", "tx").agg(F.array_sort(F.collect_list("s")).alias("s"))
    side = lambda axis: (F.array_max(F.transform("s", lambda e: e[axis])) - F.array_min(F.transform("s", lambda e: e[axis])) + 1).cast("int")
    return grouped.select("ty", "tx", (F.col("tx") * tile).alias("px"), (F.col("ty") * tile).alias("py"), side("x").alias("width"), side("y").alias("height"), F.transform("s", lambda e: e["v"]).alias("samples"))


def from_tiles(tiles: DataFrame, value: str = "v") -> DataFrame:
    """The pixels of to_tiles()."""
    long = tiles.select("px", "py", "width", F.posexplode("samples").alias("at", value))
    return long.select((F.col("py") + F.floor(F.col("at") / F.col("width"))).cast("int").alias("y"), (F.col("px") + F.col("at") % F.col("width")).cast("int").alias("x"), value)


def to_scanlines(px: DataFrame, width: int, value: str = "v") -> DataFrame:
    """(y, samples): one row per line, in order of x; pixels that are missing are 0."""
    rows = px.groupBy("y").agg(F.map_from_entries(F.collect_list(F.struct("x", value))).alias("m"))
    return rows.select("y", F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda x: F.coalesce(F.element_at("m", x), F.lit(0).cast(px.schema[value].dataType))).alias("samples"))


def tile_coords(grid: DataFrame, width: int, height: int, tile: int) -> DataFrame:
    """A grid of (mip, tx, ty) with each tile's place and size; tiles off the image have size 0."""
    mip_w, mip_h = (F.greatest(F.floor(F.lit(float(n)) / F.pow(F.lit(2.0), F.col("mip"))).cast("int"), F.lit(1)) for n in (width, height))
    size = lambda whole, at: F.greatest(F.least(whole - at * tile, F.lit(tile)), F.lit(0))
    return grid.select("mip", "tx", "ty", (F.col("tx") * tile).alias("px"), (F.col("ty") * tile).alias("py"), size(mip_w, F.col("tx")).alias("width"), size(mip_h, F.col("ty")).alias("height"))


def tile_grid(spark: SparkSession, width: int, height: int, tile: int, mip: int = 0) -> DataFrame:
    """All (mip, tx, ty) of one level."""
    across, down = (-(-max(n >> mip, 1) // tile) for n in (width, height))
    return spark.range(across * down).select(F.lit(mip).alias("mip"), (F.col("id") % across).cast("int").alias("tx"), F.floor(F.col("id") / across).cast("int").alias("ty"))


def halo(tiles: DataFrame, radius: int, tile: int, across: Column, down: Column) -> DataFrame:
    """For each tile (ty, tx), the tiles around it within radius pixels; coordinates beyond the grid are clamped.

    (ty, tx, dy, dx, from_ty, from_tx). An explode of fixed size, to be joined on (from_ty, from_tx).
    """
    reach = -(-radius // tile)
    steps = F.sequence(F.lit(-reach), F.lit(reach))
    out = tiles.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    clamp = lambda at, count: F.greatest(F.lit(0), F.least(at, count - 1)).cast("int")
    return out.withColumn("from_ty", clamp(F.col("ty") + F.col("dy"), down)).withColumn("from_tx", clamp(F.col("tx") + F.col("dx"), across))


def extent(px: DataFrame) -> DataFrame:
    """(width, height) of a raster."""
    return px.agg((F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height"))


def assemble(px: DataFrame, width: int, value: str = "v") -> DataFrame:
    """(y, line): the packed bytes of 8-bit lines in hexadecimal, as an encoder takes them."""
    lines = to_scanlines(px, width, value)
    return lines.select("y", F.array_join(F.transform("samples", lambda v: F.lpad(F.hex(v), 2, "0")), "").alias("line"))
