"""Pixel formats: stored samples to channels of 0 to 1, and back.

A format is a model and a number of bits. Channels are the model's own, in order: gray has one and
spreads it over red, green and blue; ycbcr, lab, cmyk hold theirs in place of those, which the
colour functions turn into others. Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .color import luma

BITS = (8, 16, 32)
# Formats that store floating point hold colours multiplied by alpha, and below this alpha none.
LEAST_ALPHA = {"float": 1e-6, "half": 0.0}
MODELS = {"gray": 1, "graya": 2, "rgb": 3, "rgba": 4, "ycbcr": 3, "lab": 3, "cmyk": 4, "cmyka": 5}


def _rounded(value: Column, top: float) -> Column:
    """The nearest whole number, half up, of a value that is not negative."""
    return F.floor(value * top + 0.5).cast("long")


def _clamped(value: Column, low: float = 0.0) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(1.0))


def _check(model: str, bits: int) -> float:
    if model not in MODELS or bits not in BITS:
        raise ValueError(f"unknown pixel format {model} of {bits} bits")
    return float(2**bits - 1)


def unpack(model: str, bits: int, samples: list[Column]) -> list[Column]:
    """Four channels of a pixel's samples. Lab's a and b run from -1 to 1; the alpha of cmyka is not kept."""
    top = _check(model, bits)
    if len(samples) != MODELS[model]:
        raise ValueError(f"{model} has {MODELS[model]} samples")
    whole = [s / top for s in samples]
    match model:
        case "gray" | "graya":
            return [whole[0]] * 3 + [whole[1] if model == "graya" else F.lit(1.0)]
        case "lab":
            half = float(2 ** (bits - 1))
            return [whole[0], (samples[1] - half) / half, (samples[2] - half) / half, F.lit(1.0)]
        case "cmyk" | "cmyka" | "rgba":
            return whole[:4]
    return [*whole, F.lit(1.0)]


def unpack_float(samples: list[Column], kind: str = "float") -> list[Column]:
    """Red, green, blue, alpha of floating-point pixels: colours divided by alpha; without alpha all are 0."""
    r, g, b, a = samples
    there = a > LEAST_ALPHA[kind]
    return [F.when(there, c / a).otherwise(F.lit(0.0)) for c in (r, g, b)] + [F.when(there, a).otherwise(F.lit(0.0))]


def pack(model: str, bits: int, channels: list[Column]) -> list[Column]:
    """Samples of a pixel's four channels, clamped and rounded half up. Gray takes the luma; cmyka is opaque.

    Lab's a and b of 1 do not fit and stay at the top. Samples of cmyk are channels as they are, not scaled.
    """
    top = _check(model, bits)
    r, g, b, a = channels
    scaled = [_rounded(_clamped(c), top) for c in channels]
    match model:
        case "gray" | "graya":
            return [_rounded(_clamped(luma(r, g, b)), top), *([scaled[3]] if model == "graya" else [])]
        case "lab":
            half = float(2 ** (bits - 1))
            return [scaled[0], *(F.least(F.floor(_clamped(c, -1.0) * half + half + 0.5), F.lit(top)).cast("long") for c in (g, b))]
        case "cmyk":
            return [F.floor(F.least(F.greatest(c, F.lit(0.0)), F.lit(top)) + 0.5).cast("long") for c in channels]
        case "cmyka":
            return [*scaled, F.lit(int(top)).cast("long")]
        case "rgba":
            return scaled
    return scaled[:3]
