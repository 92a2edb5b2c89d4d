import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import compose, filters, tiles
from mosaiq.rasters import raster_a, raster_b


def pixels(spark, array):
    rows = [(y, x, *(float(v) for v in array[y, x])) for y in range(array.shape[0]) for x in range(array.shape[1])]
    return spark.createDataFrame(rows, "y int, x int, r double, g double, b double, a double")


def test_blur_of_constant_is_constant(spark):
    px = pixels(spark, np.full((9, 11, 4), 0.25))
    assert {tuple(round(v, 12) for v in r[2:]) for r in filters.box_blur(px, 3).collect()} == {(0.25,) * 4}


def test_blur_wider_than_the_image_is_the_mean(spark):
    array = np.random.default_rng(1).random((6, 7, 4))
    for r in filters.box_blur(pixels(spark, array), 50).collect():
        assert list(r[2:]) == pytest.approx(array.mean(axis=(0, 1)))


def test_packed_tiles_round_trip_and_blur(spark, sf_dir):
    px = raster_a(spark, sf_dir)
    packed = tiles.pack(px, 16)
    key = lambda df: sorted((r["y"], r["x"], *(round(r[c], 9) for c in "rgba")) for r in df.collect())
    assert key(tiles.unpack(packed)) == key(px)
    assert key(tiles.unpack(tiles.blur(packed, 5, 16))) == key(filters.box_blur(px, 5))
    assert key(tiles.unpack(tiles.on_tiles(packed, lambda a: a * 0.5))) == key(px.select("y", "x", *((F.col(c) * 0.5).alias(c) for c in "rgba")))


def test_opacity_zero_leaves_the_bottom(spark, sf_dir):
    a, b = raster_a(spark, sf_dir), raster_b(spark, sf_dir)
    made = compose.compose([a, b], ["Normal", "Normal"], [1.0, 0.0]).where("a > 0")
    bottom = a.join(b.select("y", "x"), ["y", "x"]).where("a > 0")
    key = lambda df: sorted((r["y"], r["x"], *(round(r[c], 9) for c in "rgba")) for r in df.collect())
    assert key(made) == key(bottom.select("y", "x", "r", "g", "b", "a"))


def test_pyramid_stops_at_one_tile(spark, sf_dir):
    levels = filters.pyramid(raster_a(spark, sf_dir), 50, 30, 16)
    assert {(r["mip"], r["w"], r["h"]) for r in levels.groupBy("mip").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h")).collect()} == {(0, 50, 30), (1, 25, 15), (2, 12, 7)}
