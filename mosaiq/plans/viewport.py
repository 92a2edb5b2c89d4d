"""What a view needs: the level for a zoom and the tiles of a camera's rectangle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def visible_mip(zoom: Column, deepest: Column | int = 8) -> Column:
    """Level 0 from half size up; below, one level for each halving."""
    deepest = F.lit(deepest) if isinstance(deepest, int) else deepest
    return F.when(zoom >= 0.5, 0).otherwise(F.least(-F.floor(F.log2(zoom)) - 1, deepest)).cast("int")


def floor_mip(longest: Column, texture: int, deepest: Column | int = 8) -> Column:
    """The first level whose longer side fits a texture."""
    deepest = F.lit(deepest) if isinstance(deepest, int) else deepest
    return F.when(longest <= texture, 0).otherwise(F.least(F.ceil(F.log2(longest / texture)), deepest)).cast("int")


# Seconds that an interaction counts for, speed above which a view is ahead of itself, and by how many seconds.
RECENT, FAST, AHEAD = 0.5, 50.0, 0.25


def prefetch(cameras: DataFrame, tile: int) -> DataFrame:
    """cameras with reason, level and tile range of what is worth reading before it is asked for; none, one or two rows of each.

    "pan": where a fast view will be, at its own level; "zoom": around the view at the next level in the direction of
    the last zoom. Both only shortly after an interaction. Columns used beside those of tile_range: idle (seconds),
    zoom_direction (above, below or 0), deepest.
    """
    recent = cameras.where(F.col("idle") < RECENT)
    fast = recent.where(F.sqrt(F.col("vel_x") ** 2 + F.col("vel_y") ** 2) > FAST).withColumn("reason", F.lit("pan"))
    closer, farther = F.greatest(F.col("mip") - 1, F.lit(0)), F.least(F.col("mip") + 1, F.col("deepest"))
    next_level = recent.where("zoom_direction <> 0").withColumn("next", F.when(F.col("zoom_direction") > 0, closer).otherwise(farther).cast("int")).where("next <> mip")
    zooming = next_level.withColumn("mip", F.col("next")).drop("next").withColumn("reason", F.lit("zoom"))
    return tile_range(fast, tile, 2, AHEAD).unionByName(tile_range(zooming, tile, 4))


def tile_range(cameras: DataFrame, tile: int, padding: int, lookahead: float = 0.0) -> DataFrame:
    """cameras with tx0, tx1, ty0, ty1: the half-open tile range in view, padded and clipped to the grid.

    Columns used: pan_x, pan_y, zoom, vp_w, vp_h, img_w, img_h, mip, and vel_x, vel_y with a lookahead
    in seconds, by which the view moves against the velocity.
    """
    out = cameras
    for axis, side in (("x", "w"), ("y", "h")):
        pan = F.col(f"pan_{axis}") - (F.col(f"vel_{axis}") * lookahead if lookahead else F.lit(0.0))
        scale = F.pow(F.lit(2.0), F.col("mip"))
        whole = F.col(f"img_{side}").cast("double")
        low = F.greatest(pan, F.lit(0.0))
        high = F.greatest(F.least(pan + F.col(f"vp_{side}") / F.col("zoom"), whole), F.lit(0.0))
        count = F.ceil(F.greatest(F.floor(whole / scale), F.lit(1)) / tile)
        out = out.withColumn(f"t{axis}0", F.greatest(F.floor(low / scale / tile) - padding, F.lit(0)).cast("int"))
        out = out.withColumn(f"t{axis}1", F.least(F.ceil(high / scale / tile) + padding, count).cast("int"))
    return out


def least_zoom() -> Column:
    """A fifth of the zoom that fits the image, 1/512 at least."""
    return F.greatest(F.least(F.col("vp_w") / F.col("img_w"), F.col("vp_h") / F.col("img_h")) * 0.2, F.lit(1 / 512))


def fitted(cameras: DataFrame) -> DataFrame:
    """cameras that show the whole image, centred, with a margin of five percent."""
    out = cameras.withColumn("zoom", F.least(F.col("vp_w") / F.col("img_w"), F.col("vp_h") / F.col("img_h")) * 0.95)
    return out.withColumns({f"pan_{a}": (F.col(f"img_{s}") - F.col(f"vp_{s}") / F.col("zoom")) / 2 for a, s in (("x", "w"), ("y", "h"))})


def panned(cameras: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """cameras moved by screen pixels."""
    return cameras.withColumns({"pan_x": F.col("pan_x") - dx / F.col("zoom"), "pan_y": F.col("pan_y") - dy / F.col("zoom")})


def zoomed(cameras: DataFrame, factor: Column, x: Column, y: Column) -> DataFrame:
    """cameras zoomed by factor, between least_zoom and 64, with the image point under screen place (x, y) staying there."""
    zoom = F.greatest(F.least(F.col("zoom") * factor, F.lit(64.0)), least_zoom())
    return cameras.withColumns({"pan_x": F.col("pan_x") + x / F.col("zoom") - x / zoom, "pan_y": F.col("pan_y") + y / F.col("zoom") - y / zoom, "zoom": zoom})
