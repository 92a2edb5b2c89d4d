import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.functions import color, pixels, spaces

CURVES = ["srgb", "rec709", "gamma22", "gamma24", "gamma26", "prophoto", "pq", "hlg"]
#: Where each curve changes its formula, as an encoded and as a linear value.
KNEES = {"srgb": (0.04045, 0.0031308), "rec709": (0.081, 0.018), "prophoto": (1 / 32, 1 / 512), "hlg": (0.5, 1 / 12)}


@pytest.mark.parametrize("curve", CURVES)
def test_curves_are_inverse(spark, curve):
    points = sorted({0.0, 0.003, 0.07, 1 / 3, 0.62, 0.98, 1.0, *(k * by for k in KNEES.get(curve, ()) for by in (0.9, 1.1))})
    p = F.col("p")
    for r in spark.createDataFrame([(x,) for x in points], "p double").select("p", color.encode(curve, color.decode(curve, p)).alias("there"), color.decode(curve, color.encode(curve, p)).alias("back")).collect():
        assert r["there"] == pytest.approx(r["p"], abs=1e-4)
        assert r["back"] == pytest.approx(r["p"], abs=1e-4)


@pytest.mark.parametrize("model", sorted(pixels.MODELS))
@pytest.mark.parametrize("bits", [8, 16])
def test_samples_survive_unpacking_and_packing(spark, model, bits):
    top = 2**bits - 1
    steps = [0, 1, top // 3, top // 2, top // 2 + 1, top - 1, top]
    samples = [F.element_at(F.array(*map(F.lit, steps)), ((F.col("id") * (i + 1) + i) % len(steps) + 1).cast("int")).cast("double") for i in range(pixels.MODELS[model])]
    channels = pixels.unpack(model, bits, samples)
    if model == "cmyk":  # whose samples are packed as they are
        channels = [c * top for c in channels]
    for r in spark.range(30).select(F.array(*samples).alias("a"), F.array(*pixels.pack(model, bits, channels)).alias("b")).collect():
        want = [int(x) for x in r["a"]]
        assert r["b"] == ([*want[:4], top] if model == "cmyka" else want)
    with pytest.raises(ValueError):
        pixels.unpack(model, 12, samples)


def test_white_is_kept():
    for name in ("Bt709", "P3", "Ap1"):
        assert spaces.rgb_to_xyz(name, "D65") @ np.ones(3) == pytest.approx(spaces.xyz_of(spaces.WHITES["D65"]), abs=1e-9)
    there = spaces.rgb_to_rgb("linear_srgb", "acescg")
    assert there @ np.ones(3) == pytest.approx(np.ones(3), abs=1e-6)
    assert spaces.rgb_to_rgb("acescg", "linear_srgb") @ there == pytest.approx(np.eye(3), abs=1e-9)


def test_models(spark):
    one = spark.range(1)
    lit = lambda *v: [F.lit(float(x)) for x in v]
    get = lambda made: list(one.select(*made).first())
    assert get(color.lab_to_rgb(*lit(1, 0, 0))) == pytest.approx([1, 1, 1], abs=1e-4)
    assert get(color.lab_to_rgb(*lit(0, 0, 0))) == pytest.approx([0, 0, 0], abs=1e-6)
    assert get(color.cmyk_to_rgb(*lit(0, 0, 0, 1))) == pytest.approx([0, 0, 0])
    assert get(color.ycbcr_to_rgb(*lit(0.5, 0.5, 0.5))) == pytest.approx([0.5, 0.5, 0.5])
    assert get([color.quantize(F.lit(0.5), 255), color.quantize(F.lit(0.5), 65535)]) == [128, 32768]


def test_conversion_round_trip(spark):
    rows = [(i, 0, r, g, b, 1.0) for i, (r, g, b) in enumerate([(1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1), (0.5, 0.5, 0.5), (0.2, 0.7, 0.4), (0.0, 0.0, 0.0)])]
    px = spark.createDataFrame([(y, x, float(r), float(g), float(b), a) for y, x, r, g, b, a in rows], "y int, x int, r double, g double, b double, a double")
    back = color.convert(color.convert(px, "srgb", "acescg"), "acescg", "srgb")
    for r in back.collect():
        assert [r["r"], r["g"], r["b"]] == pytest.approx(rows[r["y"]][2:5], abs=2 / 255)
    assert color.convert(px, "srgb", "srgb") is px


def test_unknown_curve():
    with pytest.raises(ValueError):
        color.decode("nothing", F.lit(1.0))
