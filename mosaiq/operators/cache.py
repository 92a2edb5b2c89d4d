"""Tile stores: versions, overlays, missing tiles, eviction, range scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(writes: DataFrame, keys: tuple[str, ...] = ("tx", "ty")) -> DataFrame:
    """Per tile the write that stays: the highest version, of equal ones the last to arrive.

    The same as replaying the log and rejecting versions older than the stored one. A hash
    aggregate with partial results, so a hot tile costs no more than others.
    """
    rest = [c for c in writes.columns if c not in (*keys, "version", "arrival")]
    best = writes.groupBy(*keys).agg(F.max(F.struct("version", "arrival", *rest)).alias("w"))
    return best.select(*keys, "w.*")


def overlay_over_base(base: DataFrame, overlay: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """Every tile of either, the overlay's where it has one."""
    b, o = base.select(*keys, F.col(value).alias("base_value")), overlay.select(*keys, F.col(value).alias("overlay_value"))
    return b.join(o, list(keys), "full_outer").select(*keys, F.coalesce("overlay_value", "base_value").alias(value))


def missing(grid: DataFrame, stored: DataFrame, keys: tuple[str, ...] = ("tx", "ty")) -> DataFrame:
    return grid.join(stored.select(*keys).distinct(), list(keys), "left_anti")


#: Equal ranges of the time of use that a pool is cut into.
AGES = 1024


def survivors(entries: DataFrame, budget: int, pool: str, size: str = "size", used: str = "last_access", key: str = "key") -> DataFrame:
    """Entries that an LRU of the given budget still holds: the last used whose running size fits. Per pool.

    Two levels of prefix sums: over the sizes of AGES ranges of a pool, then inside each range. Ranges that begin
    beyond the budget are left out before their entries are sorted.
    """
    ends = entries.groupBy(F.col(pool).alias("of")).agg(F.max(used).cast("double").alias("newest"), F.min(used).cast("double").alias("oldest"))
    age = F.floor((F.col("newest") - F.col(used).cast("double")) * AGES / (F.col("newest") - F.col("oldest") + 1)).cast("int")
    aged = entries.join(ends, entries[pool].eqNullSafe(ends["of"])).withColumn("age", age).drop("of", "newest", "oldest")
    newer = Window.partitionBy("of").orderBy("of age").rowsBetween(Window.unboundedPreceding, -1)
    ages = aged.groupBy(F.col(pool).alias("of"), F.col("age").alias("of age")).agg(F.sum(size).alias("age size")).withColumn("before", F.coalesce(F.sum("age size").over(newer), F.lit(0)))
    near = aged.join(ages.where(F.col("before") <= budget), aged[pool].eqNullSafe(ages["of"]) & (aged["age"] == ages["of age"]))
    running = Window.partitionBy(pool, "age").orderBy(F.col(used).desc(), F.col(key)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = near.withColumn("held", F.col("before") + F.sum(size).over(running)).where(F.col("held") <= budget)
    return held.select(*entries.columns, "held")


def in_range(tiles: DataFrame, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """Tiles of a half-open range; a predicate that reaches the scan of a stored relation."""
    return tiles.where((F.col("tx") >= x0) & (F.col("tx") < x1) & (F.col("ty") >= y0) & (F.col("ty") < y1))


def store(tiles: DataFrame, path: str) -> None:
    """Write tiles in order of their place, so that a range lies in few files and few row groups of those."""
    tiles.repartitionByRange("ty", "tx").sortWithinPartitions("ty", "tx").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, x0: int, x1: int, y0: int, y1: int) -> DataFrame:
    """The tiles of a store in a half-open range; files and row groups beyond it are not read."""
    return in_range(spark.read.parquet(path), x0, x1, y0, y1)


def display(writes: DataFrame, active: int) -> DataFrame:
    """(mip, tx, ty, payload): the tiles to show of a log of writes.

    Generation 0 is the base, where the highest version stays; of previews only those of the active
    generation count, the last to arrive, over the base. Without an active generation (0) the base is shown.
    """
    keys = ("mip", "tx", "ty")
    base = latest(writes.where("generation = 0"), keys)
    if not active:
        return base.select(*keys, "payload")
    preview = writes.where(F.col("generation") == active).groupBy(*keys).agg(F.max(F.struct("arrival", "payload")).alias("w")).select(*keys, "w.payload")
    return overlay_over_base(base, preview, keys, "payload")


def pending(accepted: DataFrame, mip: int, since: int) -> DataFrame:
    """(tx, ty): places of a level with a write accepted after the one of arrival since. Whoever takes them goes on from the last arrival."""
    return accepted.where((F.col("mip") == mip) & (F.col("arrival") > since)).select("tx", "ty").distinct()


def checked(tiles: DataFrame, bytes_per_pixel: int, data: str = "samples") -> DataFrame:
    """tiles with ok: whether the data has the tile's length; empty tiles are left out."""
    return tiles.where((F.col("width") > 0) & (F.col("height") > 0)).withColumn("ok", F.size(data) == F.col("width") * F.col("height") * bytes_per_pixel)


def palette_lookup(px: DataFrame, palette: DataFrame, entries: int) -> DataFrame:
    """Indexed pixels (y, x, v) with the palette's colours; indices are clamped. The palette is a file's, 65,536 entries at most."""
    if not 0 < entries <= 65_536:
        raise ValueError("a palette has 1 to 65,536 entries")
    return px.withColumn("index", F.least(F.greatest(F.col("v"), F.lit(0)), F.lit(entries - 1))).join(F.broadcast(palette), "index").drop("index", "v")
