"""Layer compositing: one shuffle on the pixel for any number of layers, then an ordered fold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHANNELS = ("r", "g", "b")


def separable(mode: str, a: Column, b: Column) -> Column:
    """One channel of the bottom (a) and the top (b) blended, both straight and 0 to 1."""
    hard = lambda p, s: F.when(p < 0.5, 2.0 * p * s).otherwise(1.0 - 2.0 * (1.0 - p) * (1.0 - s))
    match mode:
        case "Normal" | "Over" | "Source":
            return b
        case "Multiply":
            return a * b
        case "Screen":
            return 1.0 - (1.0 - a) * (1.0 - b)
        case "Overlay":
            return hard(a, b)
        case "HardLight":
            return hard(b, a)
        case "SoftLight":
            return (1.0 - 2.0 * b) * a * a + 2.0 * b * a
        case "ColorDodge":
            return F.when(b >= 1.0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), a / F.greatest(1.0 - b, F.lit(1e-12))))
        case "ColorBurn":
            return F.when(b <= 0.0, F.lit(0.0)).otherwise(1.0 - F.least(F.lit(1.0), (1.0 - a) / F.greatest(b, F.lit(1e-12))))
        case "Difference":
            return F.abs(a - b)
        case "Exclusion":
            return a + b - 2.0 * a * b
    raise ValueError(f"unknown blend mode {mode}")


MODES = ("Normal", "Multiply", "Screen", "Overlay", "HardLight", "SoftLight", "ColorDodge", "ColorBurn", "Difference", "Exclusion")


def blend(mode: str, bottom: Column, top: Column, opacity: Column | float = 1.0) -> Column:
    """Two pixels (structs of r, g, b, a, straight alpha) as one."""
    if mode == "Source":
        return top
    at, ab = top["a"] * opacity, bottom["a"]
    out = at + ab * (1.0 - at)
    if mode in ("Normal", "Over"):
        mixed = lambda c: top[c] * at + bottom[c] * ab * (1.0 - at)
    else:
        mixed = lambda c: (1.0 - ab) * top[c] * at + (1.0 - at) * bottom[c] * ab + at * ab * separable(mode, bottom[c], top[c])
    channel = lambda c: F.when(out <= 0, F.lit(0.0)).otherwise(mixed(c) / out).alias(c)
    return F.struct(*(channel(c) for c in CHANNELS), out.alias("a"))


def stack(layers: list[DataFrame]) -> DataFrame:
    """All layers in one relation with their number, the bottom one 0, as port."""
    out = layers[0].withColumn("port", F.lit(0))
    for i, layer in enumerate(layers[1:], 1):
        out = out.unionByName(layer.withColumn("port", F.lit(i)))
    return out


def complete(stacked: DataFrame, count: int, keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """(keys, layers): the pixels of places that all layers have, bottom first."""
    grouped = stacked.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("port", "r", "g", "b", "a"))).alias("layers"))
    return grouped.where(F.size(F.array_distinct(F.transform("layers", lambda p: p["port"]))) == count)


def compose(layers: list[DataFrame], modes: list[str], opacities: list[float], keys: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """Layers from the bottom up, each blended onto what is below; the bottom one is taken as it is.

    Places that a layer lacks are dropped. A mode and an opacity per layer; the bottom one's are not used.
    """
    joined = complete(stack(layers), len(layers), keys)
    pixel = lambda p: F.struct(*(p[c].alias(c) for c in (*CHANNELS, "a")))
    result = pixel(F.get("layers", F.lit(0)))
    out = joined.withColumn("p", result)
    for i in range(1, len(layers)):
        out = out.withColumn("p", blend(modes[i], F.col("p"), pixel(F.get("layers", F.lit(i))), opacities[i]))
    return out.select(*keys, "p.r", "p.g", "p.b", "p.a")
