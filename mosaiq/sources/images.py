"""Image files as tile relations, and back to files.

A tile relation (TL) has a row per tile with its samples packed in one binary cell: image, page,
layer of metadata, tile place and size, channels, sample type, data. Files are read by Spark's
binaryFile source, so any store that Spark reads will do; each file is decoded in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mosaiq.functions.metadata import TEXT_FIELDS
from mosaiq.session import ship_package

from . import exif, jpeg, png, tiff

TILES = "image string, page int, ty int, tx int, px int, py int, width int, height int, image_width int, image_height int, channels int, sample string, alpha string, space string, data binary"
PAGES = "image string, page int, width int, height int, channels int, sample string, alpha string, space string, dpi double, orientation int, name string, x int, y int, profile_bytes int, fields map<string,string>"
TILE = 256


def named(text: dict[str, str]) -> dict[str, str]:
    """PNG texts by the fields that their keys stand for; other keys stay. Of several texts of a field the first counts."""
    out: dict[str, str] = {}
    for key, value in text.items():
        out.setdefault(TEXT_FIELDS.get(key.lower(), key), value)
    return out


def decode_any(data: bytes) -> list[tiff.Page]:
    """The pages of a file, by its first bytes."""
    if data[:8] == png.SIGNATURE:
        p = png.decode(data)
        text = dict(exif.fields(p.exif)) if p.exif else {}
        return [tiff.Page(p.pixels, "straight" if p.pixels.shape[2] in (2, 4) else None, 2, p.dpi, p.icc, text | named(p.text), p.space, int(text.get("Orientation", 1)))]
    if data[:4] in (b"II*\0", b"MM\0*"):
        return tiff.decode(data)
    raise ValueError("unsupported image format")


def cut(name: str, number: int, page: tiff.Page, tile: int) -> Iterator[dict]:
    px = page.pixels
    height, width, channels = px.shape
    for y in range(0, height, tile):
        for x in range(0, width, tile):
            part = np.ascontiguousarray(px[y : y + tile, x : x + tile])
            yield {
                "image": name, "page": number, "ty": y // tile, "tx": x // tile, "px": x, "py": y, "width": part.shape[1], "height": part.shape[0], "image_width": width,
                "image_height": height, "channels": channels, "sample": str(px.dtype), "alpha": page.alpha, "space": page.space, "data": part.tobytes(),
            }


def _schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files under path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def decode_files(found: DataFrame, tile: int = TILE, skip_unsupported: bool = False) -> DataFrame:
    """PNG and TIFF files, as a name and a binary column in that order, as tiles. Null contents count as unsupported."""
    ship_package(found.sparkSession)
    schema = _schema(found.sparkSession, TILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    pages = decode_any(content.as_py() or b"")
                except (ValueError, zlib.error):
                    if skip_unsupported:
                        continue
                    raise
                for number, page in enumerate(pages):
                    rows = list(cut(name, number, page, tile))
                    for at in range(0, len(rows), 64):
                        yield pa.RecordBatch.from_pylist(rows[at : at + 64], schema=schema)

    return found.mapInArrow(run, TILES)


def read_images(spark: SparkSession, path: str, tile: int = TILE, skip_unsupported: bool = False) -> DataFrame:
    """All PNG and TIFF files under path as tiles; see read_jpegs for JPEG."""
    return decode_files(files(spark, path), tile, skip_unsupported)


def describe_files(found: DataFrame, skip_unsupported: bool = False) -> DataFrame:
    """(name, content) of PNG, TIFF and JPEG files -> a row per page: size, space, density, place, and the fields that it states by name."""
    ship_package(found.sparkSession)
    schema = _schema(found.sparkSession, PAGES)

    def rows_of(name: str, data: bytes) -> Iterator[dict]:
        if data[:2] == b"\xff\xd8":
            h = jpeg.header(data)
            yield {
                "image": name, "page": 0, "width": h.width, "height": h.height, "channels": h.channels, "sample": "uint8", "alpha": None, "space": h.space, "dpi": h.dpi,
                "orientation": int(h.text.get("Orientation", 1)), "name": None, "x": 0, "y": 0, "profile_bytes": len(h.icc or b""), "fields": list(h.text.items()),
            }
            return
        for number, p in enumerate(decode_any(data)):
            height, width, channels = p.pixels.shape
            yield {
                "image": name, "page": number, "width": width, "height": height, "channels": channels, "sample": str(p.pixels.dtype), "alpha": p.alpha, "space": p.space, "dpi": p.dpi,
                "orientation": p.orientation, "name": p.name, "x": p.offset[0], "y": p.offset[1], "profile_bytes": len(p.icc or b""), "fields": list(p.text.items()),
            }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = list(rows_of(name, content.as_py() or b""))
                except (ValueError, zlib.error):
                    if skip_unsupported:
                        continue
                    raise
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return found.mapInArrow(run, PAGES)


def labelled(pages: DataFrame) -> DataFrame:
    """(image, page, field, label, value): a row per field of describe_files(), with the name that it is shown by."""
    long = pages.select("image", "page", F.explode("fields").alias("field", "value"))
    label = F.col("field")
    for name, title in exif.LABELS.items():
        label = F.when(F.col("field") == name, title).otherwise(label)
    return long.select("image", "page", "field", label.alias("label"), "value")


def read_jpegs(spark: SparkSession, path: str, tile: int = TILE, skip_unsupported: bool = False) -> DataFrame:
    """All JPEG files under path as 8-bit tiles, grey or RGB, decoded by Spark's image source."""
    ship_package(spark)
    schema = _schema(spark, TILES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["nChannels"] not in (1, 3, 4):
                    if skip_unsupported:
                        continue
                    raise ValueError(f"unsupported image format: {r['origin']}")
                px = np.frombuffer(r["data"], np.uint8).reshape(r["height"], r["width"], r["nChannels"])
                rows = list(cut(r["origin"], 0, tiff.Page(px if r["nChannels"] == 1 else px[..., 2::-1]), tile))
                for at in range(0, len(rows), 64):
                    yield pa.RecordBatch.from_pylist(rows[at : at + 64], schema=schema)

    files = spark.read.format("image").option("pathGlobFilter", "*.{jpg,jpeg,JPG,JPEG}").option("recursiveFileLookup", "true").load(path)
    return files.select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInArrow(run, TILES)


def pixel_tiles(px: DataFrame, channels: tuple[str, ...], sample: str = "uint8", tile: int = TILE, alpha: str | None = None, space: str = "srgb") -> DataFrame:
    """(image, page, y, x, channels): pixels of whole images as tiles, their values as samples of the given type; gaps are zero.

    The image's size is left open, since a tile does not know it.
    """
    ship_package(px.sparkSession)
    schema = _schema(px.sparkSession, TILES)

    def run(table: pa.Table) -> pa.Table:
        y, x = table.column("y").to_numpy(), table.column("x").to_numpy()
        ty, tx = int(y[0]) // tile, int(x[0]) // tile
        width, height = int(x.max()) % tile + 1, int(y.max()) % tile + 1
        out = np.zeros((height, width, len(channels)), sample)
        for i, c in enumerate(channels):
            out[y % tile, x % tile, i] = table.column(c).to_numpy()
        row = {"image": table.column("image")[0].as_py(), "page": table.column("page")[0].as_py(), "ty": ty, "tx": tx, "px": tx * tile, "py": ty * tile, "width": width, "height": height}
        return pa.Table.from_pylist([row | {"image_width": None, "image_height": None, "channels": len(channels), "sample": sample, "alpha": alpha, "space": space, "data": out.tobytes()}], schema=schema)

    keyed = px.select("image", F.col("page").cast("int").alias("page"), "y", "x", *channels, F.floor(F.col("y") / tile).alias("gy"), F.floor(F.col("x") / tile).alias("gx"))
    return keyed.groupBy("image", "page", "gy", "gx").applyInArrow(run, TILES)


def tile_pixels(tiles: DataFrame) -> DataFrame:
    """(image, page, y, x, samples): the pixels of a tile relation, samples as doubles of 0 to 1 for whole numbers."""
    ship_package(tiles.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                px = np.frombuffer(r["data"], r["sample"]).reshape(-1, r["channels"])
                values = px.astype(np.float64) / (np.iinfo(px.dtype).max if px.dtype.kind == "u" else 1)
                n = len(px)
                at = np.arange(n)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * r["channels"], pa.int32()), pa.array(values.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([r["image"]] * n), pa.array(np.full(n, r["page"], np.int32)), pa.array((r["py"] + at // r["width"]).astype(np.int32)), pa.array((r["px"] + at % r["width"]).astype(np.int32)), lists], ["image", "page", "y", "x", "samples"])

    return tiles.mapInArrow(run, "image string, page int, y int, x int, samples array<double>")


def to_files(tiles: DataFrame, kind: str = "png", **options) -> DataFrame:
    """(image, page, content): each page assembled from its tiles and encoded, one task group a page.

    Gaps are zero. options go to the encoder: level, text, dpi, srgb, gamma, icc for PNG; deflate,
    rows_per_strip for TIFF; quality, dpi for JPEG, which drops alpha. A page must fit a worker's memory; larger ones are refused.
    """
    if kind not in ("png", "tiff", "jpeg"):
        raise ValueError(f"no encoder for {kind}")
    ship_package(tiles.sparkSession)

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        first = rows[0]
        width, height = max(r["px"] + r["width"] for r in rows), max(r["py"] + r["height"] for r in rows)
        if width * height > png.MOST_PIXELS:
            raise ValueError("the image is too large")
        px = np.zeros((height, width, first["channels"]), first["sample"])
        for r in rows:
            px[r["py"] : r["py"] + r["height"], r["px"] : r["px"] + r["width"]] = np.frombuffer(r["data"], r["sample"]).reshape(r["height"], r["width"], -1)
        if kind == "tiff":
            content = tiff.encode([tiff.Page(px, first["alpha"])], **options)
        else:
            content = (png if kind == "png" else jpeg).encode(px, **options)
        return pa.table({"image": [first["image"]], "page": pa.array([first["page"]], pa.int32()), "content": pa.array([content], pa.binary())})

    return tiles.groupBy("image", "page").applyInArrow(run, "image string, page int, content binary")


def write_store(tiles: DataFrame, path: str, partition: tuple[str, ...] = ("page",), mode: str = "overwrite") -> None:
    """A tile store in Parquet. Tiles whose data has the wrong length stop the job; empty tiles are left out."""
    size = F.when(F.col("sample") == "uint8", 1).when(F.col("sample") == "uint16", 2).when(F.col("sample") == "float32", 4).otherwise(8)
    expected = F.col("width") * F.col("height") * F.col("channels") * size
    checked = tiles.where((F.col("width") > 0) & (F.col("height") > 0)).withColumn("data", F.when(F.length("data") == expected, F.col("data")).otherwise(F.raise_error(F.lit("a tile's data has the wrong length")).cast("binary")))
    checked.write.mode(mode).partitionBy(*partition).parquet(path)


def read_store(spark: SparkSession, path: str, tx: tuple[int, int] | None = None, ty: tuple[int, int] | None = None) -> DataFrame:
    """Tiles of a store, of a half-open range if given: predicates that prune partitions and row groups."""
    out = spark.read.parquet(path)
    for name, limits in (("tx", tx), ("ty", ty)):
        if limits:
            out = out.where((F.col(name) >= limits[0]) & (F.col(name) < limits[1]))
    return out
