"""Colour arithmetic as Column expressions; everything here stays inside code generation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spaces import WHITES, lab_to_srgb_matrix, parts_of, rgb_to_rgb, xyz_of

# Constants of the published curves.
PQ_M1, PQ_M2 = 2610 / 16384, 2523 / 4096 * 128
PQ_C1, PQ_C2, PQ_C3 = 3424 / 4096, 2413 / 4096 * 32, 2392 / 4096 * 32
HLG_A, HLG_B, HLG_C = 0.17883277, 0.28466892, 0.5599107
LUMA = (0.2126, 0.7152, 0.0722)


def _positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def decode(curve: str, x: Column) -> Column:
    """From an encoded sample to linear light."""
    match curve:
        case "linear":
            return x
        case "srgb":
            return F.when(x <= 0.04045, x / 12.92).otherwise(F.pow((x + 0.055) / 1.055, F.lit(2.4)))
        case "rec709":
            return F.when(x < 0.081, x / 4.5).otherwise(F.pow((x + 0.099) / 1.099, F.lit(1 / 0.45)))
        case "gamma22" | "gamma24" | "gamma26":
            return F.pow(_positive(x), F.lit(int(curve[-2:]) / 10))
        case "prophoto":
            return F.when(x <= 1 / 32, x / 16.0).otherwise(F.pow(x, F.lit(1.8)))
        case "pq":
            p = F.pow(_positive(x), F.lit(1 / PQ_M2))
            return F.pow(_positive(p - PQ_C1) / (PQ_C2 - PQ_C3 * p), F.lit(1 / PQ_M1))
        case "hlg":
            return F.when(x <= 0.5, x * x / 3.0).otherwise((F.exp((x - HLG_C) / HLG_A) + HLG_B) / 12.0)
    raise ValueError(f"unknown transfer curve {curve}")


def encode(curve: str, y: Column) -> Column:
    """From linear light to an encoded sample."""
    match curve:
        case "linear":
            return y
        case "srgb":
            return F.when(y <= 0.0031308, 12.92 * y).otherwise(1.055 * F.pow(_positive(y), F.lit(1 / 2.4)) - 0.055)
        case "rec709":
            return F.when(y < 0.018, 4.5 * y).otherwise(1.099 * F.pow(_positive(y), F.lit(0.45)) - 0.099)
        case "gamma22" | "gamma24" | "gamma26":
            return F.pow(_positive(y), F.lit(10 / int(curve[-2:])))
        case "prophoto":
            return F.when(y <= 0.001953125, 16.0 * y).otherwise(F.pow(_positive(y), F.lit(1 / 1.8)))
        case "pq":
            p = F.pow(_positive(y), F.lit(PQ_M1))
            return F.pow((PQ_C1 + PQ_C2 * p) / (1.0 + PQ_C3 * p), F.lit(PQ_M2))
        case "hlg":
            low = _positive(y)
            return F.when(low <= 1 / 12, F.sqrt(3.0 * low)).otherwise(HLG_A * F.log(F.greatest(12.0 * low - HLG_B, F.lit(1e-12))) + HLG_C)
    raise ValueError(f"unknown transfer curve {curve}")


def curve_of_gamma(gamma: Column) -> Column:
    """The known curve nearest to a file's gamma value, or null."""
    close = lambda target, by: F.abs(gamma - target) < by
    return F.when(close(1 / 2.2, 0.01), "gamma22").when(close(1 / 2.4, 0.01), "gamma24").when(close(1 / 2.2, 0.05), "gamma22").when(close(1.0, 0.01), "linear")


def apply_matrix(matrix: np.ndarray, r: Column, g: Column, b: Column) -> list[Column]:
    return [float(m[0]) * r + float(m[1]) * g + float(m[2]) * b for m in matrix]


def premultiply(c: Column, a: Column) -> Column:
    return c * a


def unpremultiply(c: Column, a: Column) -> Column:
    return c / F.greatest(a, F.lit(1e-8))


def quantize(value: Column, top: int) -> Column:
    """A sample of 0 to top, clamped, half up."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * float(top) + 0.5).cast("int")


def convert(px: DataFrame, source: str, target: str, source_alpha: str = "straight", target_alpha: str = "straight", channels: tuple[str, str, str] = ("r", "g", "b"), alpha: str = "a") -> DataFrame:
    """Pixels of one colour space in another: un-premultiply, decode, matrix, premultiply, encode.

    Premultiplied results hold premultiplied linear light, encoded. Equal spaces and policies
    leave the pixels as they are.
    """
    if source == target and source_alpha == target_alpha:
        return px
    a, values = F.col(alpha), [F.col(c) for c in channels]
    if source_alpha == "premultiplied":
        values = [unpremultiply(v, a) for v in values]
    values = [decode(parts_of(source)[2], v) for v in values]
    values = apply_matrix(rgb_to_rgb(source, target), *values)
    if target_alpha == "premultiplied":
        values = [premultiply(v, a) for v in values]
    values = [encode(parts_of(target)[2], v) for v in values]
    return px.select(*(c for c in px.columns if c not in channels), *(v.alias(c) for v, c in zip(values, channels, strict=True)))


def encode_by_table(curve: str, y: Column, size: int = 4096) -> Column:
    """encode() by linear interpolation between size samples of the curve on 0 to 1, the input clamped."""
    at = F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)) * float(size - 1)
    low = F.floor(at).cast("double")
    high = F.least(low + 1.0, F.lit(float(size - 1)))
    a, b = encode(curve, low / float(size - 1)), encode(curve, high / float(size - 1))
    return a + (b - a) * (at - low)


def decode_u8(curve: str, v: Column) -> Column:
    return decode(curve, v / 255.0)


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    return [(1.0 - v) * (1.0 - k) for v in (c, m, y)]


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> list[Column]:
    return [y + 1.402 * (cr - 0.5), y - 0.344136 * (cb - 0.5) - 0.714136 * (cr - 0.5), y + 1.772 * (cb - 0.5)]


def lab_to_rgb(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    """Linear sRGB, not clamped, of L in 0 to 1 and a, b in -1 to 1 (hundredths and 128ths)."""
    fy = (l * 100.0 + 16.0) / 116.0
    cube = lambda f: F.when(f > 6 / 29, f * f * f).otherwise(3 * (6 / 29) ** 2 * (f - 4 / 29))
    white = xyz_of(WHITES["D50"])
    xyz = [cube(f) * float(w) for f, w in zip((fy + a * 128.0 / 500.0, fy, fy - b * 128.0 / 200.0), white, strict=True)]
    return apply_matrix(lab_to_srgb_matrix(), *xyz)


def lab_unpack_u8(l: Column, a: Column, b: Column) -> list[Column]:  # noqa: E741
    return [l / 255.0, (a - 128) / 128.0, (b - 128) / 128.0]


def luma(r: Column, g: Column, b: Column) -> Column:
    return LUMA[0] * r + LUMA[1] * g + LUMA[2] * b


def xyz_to_xyy(x: Column, y: Column, z: Column) -> list[Column]:
    total = x + y + z
    share = lambda v: F.when(total == 0, F.lit(0.0)).otherwise(v / total)
    return [share(x), share(y), y]


def xyy_to_xyz(x: Column, y: Column, big_y: Column) -> list[Column]:
    safe: Callable[[Column], Column] = lambda v: F.when(y == 0, F.lit(0.0)).otherwise(v * big_y / y)
    return [safe(x), F.when(y == 0, F.lit(0.0)).otherwise(big_y), safe(1.0 - x - y)]


def normalize_int(v: Column, kind: str) -> Column:
    """Samples of wide or signed integer files as 0 to 1."""
    match kind:
        case "u8" | "u16" | "u32":
            return v / float(2 ** int(kind[1:]) - 1)
        case "i8" | "i16":
            bits = int(kind[1:])
            return (v + float(2 ** (bits - 1))) / float(2**bits - 1)
        case "i32" | "i64":
            return v / float(2 ** (int(kind[1:]) - 1) - 1) * 0.5 + 0.5
    raise ValueError(f"unknown sample kind {kind}")


def exposure(v: Column, stops: float) -> Column:
    """Linear light brightened by whole or part stops."""
    return v * float(2.0**stops)


def nearly_equal(a: Column, b: Column, by: float) -> Column:
    return F.abs(a - b) <= by
