import pytest
from pyspark.sql import functions as F

from mosaiq.plans import viewport


def test_camera_geometry(spark):
    start = spark.createDataFrame([(0.0, 0.0, 1.0, 800.0, 600.0, 4000, 3000)], "pan_x double, pan_y double, zoom double, vp_w double, vp_h double, img_w int, img_h int")
    fit = viewport.fitted(start).first()
    assert fit.zoom == pytest.approx(0.19) and fit.pan_x == pytest.approx((4000 - 800 / 0.19) / 2)
    near = viewport.zoomed(start, F.lit(2.0), F.lit(400.0), F.lit(300.0)).first()
    assert (near.zoom, near.pan_x, near.pan_y) == (2.0, 200.0, 150.0)
    far = viewport.zoomed(start, F.lit(1e-9), F.lit(0.0), F.lit(0.0)).first()
    assert far.zoom == pytest.approx(0.04) and (far.pan_x, far.pan_y) == (0.0, 0.0)
    assert viewport.zoomed(start, F.lit(1e9), F.lit(0.0), F.lit(0.0)).first().zoom == 64.0
    moved = viewport.panned(viewport.zoomed(start, F.lit(2.0), F.lit(0.0), F.lit(0.0)), F.lit(10.0), F.lit(-4.0)).first()
    assert (moved.pan_x, moved.pan_y) == (-5.0, 2.0)


def test_prefetch_reasons(spark):
    shape = "name string, pan_x double, pan_y double, zoom double, vp_w double, vp_h double, img_w int, img_h int, mip int, vel_x double, vel_y double, idle double, zoom_direction int, deepest int"
    still = (0.0, 0.0, 1.0, 800.0, 600.0, 4000, 3000)
    rows = [
        ("slow", *still, 1, 30.0, 40.0, 0.1, 0, 3), ("fast", *still, 1, 31.0, 40.0, 0.1, 0, 3), ("late", *still, 1, 300.0, 0.0, 0.5, 1, 3),
        ("closer", *still, 1, 0.0, 0.0, 0.0, 2, 3), ("closest", *still, 0, 0.0, 0.0, 0.0, 1, 3), ("farther", *still, 2, 90.0, 0.0, 0.4, -1, 3), ("farthest", *still, 3, 0.0, 0.0, 0.0, -1, 3),
    ]
    made = {(r["name"], r["reason"], r["mip"]) for r in viewport.prefetch(spark.createDataFrame(rows, shape), 256).collect()}
    assert made == {("fast", "pan", 1), ("closer", "zoom", 0), ("farther", "pan", 2), ("farther", "zoom", 3)}
