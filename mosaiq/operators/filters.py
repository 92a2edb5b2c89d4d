"""Box blur and multi-resolution pyramids over pixel relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Windows side by side in a block of a line.
SPAN = 16


def _means_along(px: DataFrame, axis: str, other: str, radius: int, channels: tuple[str, ...], keys: tuple[str, ...]) -> DataFrame:
    """The mean of each channel over the 2r+1 pixels around each one along an axis.

    Lines are cut into blocks of SPAN windows, each with the r pixels beyond its ends, so that a line
    of any length is split over tasks.
    """
    span = SPAN * (2 * radius + 1)
    block = lambda at: F.floor(at / span).cast("int")
    spread = px.withColumn("block", F.explode(F.sequence(block(F.col(axis) - radius), block(F.col(axis) + radius))))
    near = Window.partitionBy(*keys, other, "block").orderBy(axis).rangeBetween(-radius, radius)
    rest = [c for c in px.columns if c not in channels]
    means = spread.select(*rest, "block", *(F.avg(c).over(near).alias(c) for c in channels))
    return means.where(F.col("block") == block(F.col(axis))).drop("block")


def box_blur(px: DataFrame, radius: int, channels: tuple[str, ...] = ("r", "g", "b", "a"), mip: int = 0, keys: tuple[str, ...] = ()) -> DataFrame:
    """The mean of the (2r+1) x (2r+1) window clipped to the image, as two passes of range frames.

    The number of samples along x is the same for every line, so the mean of line means is the
    mean of the rectangle. keys name columns that tell images apart.
    """
    radius >>= mip
    if radius == 0:
        return px
    once = _means_along(px, "x", "y", radius, channels, keys)
    return _means_along(once, "y", "x", radius, channels, keys).select(*(c for c in px.columns if c not in channels), *channels)


def halve(px: DataFrame, width: int, height: int, channels: tuple[str, ...] = ("r", "g", "b", "a"), truncate: bool = False, keys: tuple[str, ...] = ()) -> DataFrame:
    """The next level of a pyramid: means of 2 x 2 pixels. width and height are of the level that px is.

    An odd last line or column has no pixel at the next level. With truncate, means are whole
    numbers rounded down, as for 8-bit samples.
    """
    down = lambda c: F.floor(F.col(c) / 2).cast("int").alias(c)
    mean = lambda c: F.floor(F.avg(c)).cast("int") if truncate else F.avg(c)
    out = px.groupBy(*keys, down("y"), down("x")).agg(*(mean(c).alias(c) for c in channels))
    return out.where((F.col("x") < max(width >> 1, 1)) & (F.col("y") < max(height >> 1, 1)))


def pyramid(px: DataFrame, width: int, height: int, tile: int, channels: tuple[str, ...] = ("r", "g", "b", "a")) -> DataFrame:
    """All levels, with their number as mip: level 0 and each next one until it fits one tile, one at least."""
    out, level = px.withColumn("mip", F.lit(0)), px
    mip = 0
    while True:
        level = halve(level, max(width >> mip, 1), max(height >> mip, 1), channels)
        mip += 1
        out = out.unionByName(level.withColumn("mip", F.lit(mip)))
        if max(width >> mip, 1) <= tile and max(height >> mip, 1) <= tile:
            return out


def max_mip(width: Column, height: Column) -> Column:
    longest = F.greatest(width, height)
    return F.when(longest <= 256, 0).otherwise(F.least(F.floor(F.log2(longest / 256.0)), F.lit(8))).cast("int")


def thumbnail_mip(width: Column, height: Column, target: int) -> Column:
    """The first level whose longer side is at most twice the target."""
    fits = F.filter(F.sequence(F.lit(0), F.lit(31)), lambda m: F.floor(F.greatest(width, height) / F.pow(F.lit(2.0), m)) <= 2 * target)
    return F.array_min(fits).cast("int")


def histogram(px: DataFrame, channel: str, bins: int = 256) -> DataFrame:
    """(bin, n): values of 0 to 1 counted by equal steps; values beyond count at the ends."""
    at = F.least(F.greatest(F.floor(F.col(channel) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    return px.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
