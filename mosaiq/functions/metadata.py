"""Metadata of image files: names, rationals and the choice of a colour space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spaces import KNOWN_CHROMATICITIES

#: PNG text keys that have a field of their own.
TEXT_FIELDS = {"author": "Artist", "artist": "Artist", "description": "Description", "title": "Description", "copyright": "Copyright", "software": "Software"}


def text_field(key: Column) -> Column:
    out = F.lit("Custom")
    for name, field in TEXT_FIELDS.items():
        out = F.when(F.lower(key) == name, field).otherwise(out)
    return out


def rational(num: Column, den: Column) -> Column:
    return F.concat_ws("/", num.cast("string"), den.cast("string"))


def rational_float(num: Column, den: Column) -> Column:
    """Six decimals; null for a zero denominator."""
    return F.when(den != 0, F.format_string("%.6f", num / den))


def profile_name(name: Column) -> Column:
    """A colour profile's name in lower case, every run of other signs as one space."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def choose_space(cicp: Column, icc: Column, srgb: Column, gamma_chroma: Column, gamma: Column) -> Column:
    """The first that a file states, else sRGB."""
    return F.coalesce(cicp, icc, srgb, gamma_chroma, gamma, F.lit("srgb"))


def match_chromaticities(files: DataFrame, tolerance: float, columns: tuple[str, ...] = ("wx", "wy", "rx", "ry", "gx", "gy", "bx", "by")) -> DataFrame:
    """files with the primaries and white of the first known space within tolerance of all eight numbers, else null.

    Seven fixed boxes are tested in order, as one expression: no join is needed.
    """
    found = F.lit(None).cast("struct<primaries:string,white:string>")
    for primaries, white, values in reversed(KNOWN_CHROMATICITIES):
        inside = F.lit(True)
        for c, v in zip(columns, values, strict=True):
            inside = inside & (F.abs(F.col(c) - v) < tolerance)
        found = F.when(inside, F.struct(F.lit(primaries).alias("primaries"), F.lit(white).alias("white"))).otherwise(found)
    return files.withColumn("match", found).select(*files.columns, "match.primaries", "match.white")
