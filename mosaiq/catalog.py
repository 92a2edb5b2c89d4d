"""Every query of the raster engine over the driver's tables; the SQL that checks each is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .functions import color, metadata, pixels
from .functions.spaces import rgb_to_rgb
from .operators import cache, compose, filters, layout
from .plans import document, history, viewport
from .rasters import WIDTH, edit_log, q, raster_a, raster_a8, raster_b, raster_e, table, tile_versions
from .session import is_complete, shared_folder
from .sources import images, png

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TILE = 16


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def height_of(spark: SparkSession, sf_dir: str, name: str = "orders") -> int:
    """Lines of a derived raster; the key is dense, so this is a count from the file's metadata."""
    return -(-table(spark, sf_dir, name).count() // WIDTH)


def quantised(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: q(F.col(c)) for c in columns})


# --- scans, layout, predicates ----------------------------------------------------------------


@query
def scan_raster(spark, sf_dir):
    return quantised(raster_a(spark, sf_dir), "r", "g", "b", "a")


@query
def scan_signed(spark, sf_dir):
    return quantised(raster_e(spark, sf_dir), "v")


def _packed(model: str, bits: int, scale: float = 1.0):
    """Channels a little beyond 0 to 1 (times scale) in a format's samples."""

    def run(spark, sf_dir):
        wide = [(F.col(c) * 1.25 - 0.125) * scale for c in "rgba"]
        return raster_a(spark, sf_dir).select("y", "x", *(s.alias(f"s{i}") for i, s in enumerate(pixels.pack(model, bits, wide))))

    return run


def _unpacked(model: str, bits: int):
    def run(spark, sf_dir):
        v = F.col("v") * (1 if bits == 8 else 257)
        samples = [(v * (2 * i + 1) + 31 * i) % (2**bits) for i in range(pixels.MODELS[model])]
        return raster_a8(spark, sf_dir).withColumn("v", F.col("v").cast("long")).select("y", "x", *(q(c).alias(n) for n, c in zip("rgba", pixels.unpack(model, bits, samples), strict=True)))

    return run


#: Formats with a row of their own, as model and bits.
FORMATS = [("gray", 8), ("graya", 8), ("rgb", 16), ("rgba", 8), ("ycbcr", 8), ("lab", 8), ("lab", 16), ("cmyk", 8), ("cmyk", 16), ("cmyka", 8)]
for _model, _bits in FORMATS:
    QUERIES[f"pack_{_model}{_bits}"] = _packed(_model, _bits, 255.0 if _model == "cmyk" else 1.0)
    QUERIES[f"unpack_{_model}{_bits}"] = _unpacked(_model, _bits)


@query
def unpack_float(spark, sf_dir):
    return raster_a(spark, sf_dir).select("y", "x", *(q(c).alias(n) for n, c in zip("rgba", pixels.unpack_float([F.col(c) for c in "rgba"]), strict=True)))


@query
def cache_range_scan(spark, sf_dir):
    px = raster_a(spark, sf_dir)
    tiles = px.select("y", "x", layout.tile_of(F.col("x"), TILE).alias("tx"), layout.tile_of(F.col("y"), TILE).alias("ty"), q(F.col("r")).alias("r"))
    path = f"{shared_folder(spark)}/range-scan-{crc32(sf_dir.encode()):08x}"
    if not is_complete(spark, path):
        cache.store(tiles, path)
    return cache.load(spark, path, 1, 3, 0, 2)


@query
def normalize_int(spark, sf_dir):
    v = F.col("v")
    kinds = {"u8": v, "u16": v * 257, "u32": v * 16843009, "i8": v - 128, "i16": (v - 128) * 256, "i32": (v - 128) * 16777216, "i64": (v - 128) * 36028797018963968}
    px = raster_a8(spark, sf_dir).withColumn("v", F.col("v").cast("long"))
    return px.select("y", "x", *(q(color.normalize_int(c, k)).alias(k) for k, c in kinds.items()))


@query
def to_tiles(spark, sf_dir):
    tiles = layout.to_tiles(raster_a8(spark, sf_dir), TILE)
    return tiles.select("ty", "tx", "px", "py", "width", "height", F.array_join("samples", ",").alias("samples"))


@query
def to_scanlines(spark, sf_dir):
    return layout.to_scanlines(raster_a8(spark, sf_dir), WIDTH).select("y", F.array_join("samples", ",").alias("samples"))


@query
def tile_round_trip(spark, sf_dir):
    return layout.from_tiles(layout.to_tiles(raster_a8(spark, sf_dir), TILE))


@query
def tile_len_check(spark, sf_dir):
    return cache.checked(layout.to_tiles(raster_a8(spark, sf_dir), TILE), 1).select("ty", "tx", "ok")


@query
def tile_coords(spark, sf_dir):
    height = height_of(spark, sf_dir)
    grid = layout.tile_grid(spark, WIDTH, height, TILE).union(layout.tile_grid(spark, WIDTH, height, TILE, 1)).union(layout.tile_grid(spark, WIDTH, height, TILE, 2))
    return layout.tile_coords(grid, WIDTH, height, TILE)


@query
def tile_grid(spark, sf_dir):
    return layout.tile_grid(spark, WIDTH, height_of(spark, sf_dir), TILE, 1)


@query
def halo_join(spark, sf_dir):
    px = raster_a8(spark, sf_dir)
    tiles = px.groupBy(layout.tile_of(F.col("y"), TILE).alias("ty"), layout.tile_of(F.col("x"), TILE).alias("tx")).agg(F.sum("v").alias("total"))
    down = F.lit(-(-height_of(spark, sf_dir) // TILE))
    around = layout.halo(tiles.select("ty", "tx"), 3, TILE, F.lit(-(-WIDTH // TILE)), down)
    near = tiles.select(F.col("ty").alias("from_ty"), F.col("tx").alias("from_tx"), "total")
    return around.join(near, ["from_ty", "from_tx"]).groupBy("ty", "tx").agg(F.sum("total").alias("around"), F.count("*").alias("tiles"))


@query
def raster_extent(spark, sf_dir):
    return layout.extent(raster_a8(spark, sf_dir))


@query
def assemble_raster(spark, sf_dir):
    return layout.assemble(raster_a8(spark, sf_dir), WIDTH)


@query
def mip_filter(spark, sf_dir):
    levels = filters.pyramid(raster_a(spark, sf_dir), WIDTH, height_of(spark, sf_dir), TILE)
    return quantised(levels.where("mip = 1").select("y", "x", "r"), "r")


@query
def visible_layers(spark, sf_dir):
    layers = spark.createDataFrame([(i, f"layer {i}", i % 3 != 1) for i in range(8)], "layer_id int, name string, visible boolean")
    stored = tile_versions(spark, sf_dir).select(F.col("tx").alias("layer_id"))
    return layers.where("visible").join(stored, "layer_id", "left_semi").select("layer_id", "name")


# --- files ---------------------------------------------------------------------------------------

#: Lines of an image that a raster is cut into for a file.
FILE_LINES = 512


def _file_round_trip(kind: str):
    """8-bit pixels into image files, and back from those."""

    def run(spark, sf_dir):
        strip = F.format_string("strip %d", F.floor(F.col("y") / FILE_LINES))
        whole = [color.quantize(F.col(c), 255).alias(c) for c in "rgba"]
        px = raster_a(spark, sf_dir).select(strip.alias("image"), F.lit(0).alias("page"), (F.col("y") % FILE_LINES).alias("y"), "x", *whole)
        made = images.to_files(images.pixel_tiles(px, tuple("rgba"), alpha="straight", tile=32), kind)
        back = images.tile_pixels(images.decode_files(made.select("image", "content"), tile=64))
        line = F.col("y") + F.substring("image", 7, 9).cast("int") * FILE_LINES
        return back.select(line.alias("y"), "x", *(F.round(F.get("samples", F.lit(i)) * 255).cast("int").alias(c) for i, c in enumerate("rgba")))

    return run


QUERIES["png_round_trip"] = _file_round_trip("png")
QUERIES["tiff_round_trip"] = _file_round_trip("tiff")


@query
def file_space(spark, sf_dir):
    """PNG files with different statements about their colour, and the space that is taken from each."""
    one = np.zeros((1, 1, 3), np.uint8)
    kinds = [png.encode(one), png.encode(one, srgb=True, gamma=1.0), png.encode(one, gamma=1.0), png.encode(one, gamma=0.45455), png.encode(one, gamma=0.9), png.encode(one, icc=b"no profile", gamma=1.0)]
    content = F.element_at(F.array(*(F.lit(bytearray(k)) for k in kinds)), (F.col("event_id") % len(kinds) + 1).cast("int"))
    pages = images.describe_files(table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("image"), content.alias("content")))
    return pages.select(F.col("image").cast("long").alias("event_id"), "space", "width", "height", "channels")


# --- metadata ----------------------------------------------------------------------------------

KEYS = ["Author", "artist", "TITLE", "Description", "Copyright", "software", "Comment"]


@query
def png_text_map(spark, sf_dir):
    keys = F.array(*map(F.lit, KEYS))
    texts = table(spark, sf_dir, "events").select("event_id", F.element_at(keys, (F.col("event_id") % len(KEYS) + 1).cast("int")).alias("key"), F.col("event_type").alias("value"))
    return texts.select("event_id", metadata.text_field(F.col("key")).alias("field"), "key", "value")


@query
def exif_rational(spark, sf_dir):
    num, den = F.col("o_custkey"), F.col("o_orderkey") % 7
    return table(spark, sf_dir, "orders").select("o_orderkey", metadata.rational(num, den).alias("text"), metadata.rational_float(num, den).alias("value"))


@query
def detect_space(spark, sf_dir):
    k = F.col("event_id")
    some = lambda every, value: F.when(k % every == 0, F.lit(value))
    return table(spark, sf_dir, "events").select("event_id", metadata.choose_space(some(11, "rec2020"), some(7, "display_p3"), some(5, "srgb"), some(3, "adobe_rgb"), some(2, "gamma22")).alias("space"))


@query
def match_chroma(spark, sf_dir):
    from .functions.spaces import KNOWN_CHROMATICITIES

    names = ("wx", "wy", "rx", "ry", "gx", "gy", "bx", "by")
    rows = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(names, values, strict=True))) for _, _, values in KNOWN_CHROMATICITIES))
    k = F.col("event_id")
    off = (k % 5) * 0.0006
    files = table(spark, sf_dir, "events").select("event_id", F.element_at(rows, (k % 7 + 1).cast("int")).alias("c")).select("event_id", *((F.col(f"c.{n}") + off).alias(n) for n in names))
    return metadata.match_chromaticities(files, 0.002).select("event_id", "primaries", "white")


@query
def icc_name_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", metadata.profile_name(F.col("text")).alias("name"))


# --- colour ------------------------------------------------------------------------------------


def _curves(spark, sf_dir, *curves):
    px = raster_a(spark, sf_dir)
    out = []
    for c in curves:
        out += [q(color.decode(c, F.col("g"))).alias(f"{c}_decoded"), q(color.encode(c, F.col("g"))).alias(f"{c}_encoded")]
    return px.select("y", "x", *out)


for _name, _of in {"tf_srgb": ("srgb",), "tf_rec709": ("rec709",), "tf_gamma": ("gamma22", "gamma24", "gamma26"), "tf_prophoto": ("prophoto",), "tf_pq": ("pq",), "tf_hlg": ("hlg",)}.items():
    QUERIES[_name] = lambda spark, sf_dir, of=_of: _curves(spark, sf_dir, *of)


@query
def gamma_lookup(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", color.curve_of_gamma((F.col("event_id") % 120) / 100.0).alias("curve"))


@query
def color_convert(spark, sf_dir):
    return quantised(color.convert(raster_a(spark, sf_dir), "srgb", "display_p3", target_alpha="premultiplied"), "r", "g", "b", "a")


@query
def matrix_apply(spark, sf_dir):
    r, g, b = color.apply_matrix(rgb_to_rgb("linear_srgb", "acescg"), F.col("r"), F.col("g"), F.col("b"))
    return raster_a(spark, sf_dir).select("y", "x", q(r).alias("r"), q(g).alias("g"), q(b).alias("b"))


def _three(df: DataFrame, made: list[Column]) -> DataFrame:
    return df.select("y", "x", *(q(v).alias(n) for v, n in zip(made, "rgb", strict=True)))


@query
def cmyk_to_rgb(spark, sf_dir):
    return _three(raster_a(spark, sf_dir), color.cmyk_to_rgb(F.col("r"), F.col("g"), F.col("b"), F.col("a")))


@query
def ycbcr_to_rgb(spark, sf_dir):
    return _three(raster_a(spark, sf_dir), color.ycbcr_to_rgb(F.col("r"), F.col("g"), F.col("b")))


@query
def lab_to_rgb(spark, sf_dir):
    return _three(raster_a(spark, sf_dir), color.lab_to_rgb(F.col("g"), F.col("b") - 0.5, F.col("a") - 0.5))


@query
def lab_unpack(spark, sf_dir):
    v = F.col("v")
    return _three(raster_a8(spark, sf_dir), color.lab_unpack_u8(v, 255 - v, (v * 7) % 256))


@query
def premultiply(spark, sf_dir):
    px = raster_a(spark, sf_dir)
    a = F.col("a")
    return px.select("y", "x", q(color.premultiply(F.col("r"), a)).alias("pre"), q(color.unpremultiply(color.premultiply(F.col("r"), a), a)).alias("back"))


@query
def encode_lut(spark, sf_dir):
    return raster_a(spark, sf_dir).select("y", "x", q(color.encode_by_table("srgb", F.col("r"))).alias("r"))


@query
def decode_lut(spark, sf_dir):
    return raster_a8(spark, sf_dir).select("y", "x", q(color.decode_u8("srgb", F.col("v"))).alias("v"))


@query
def xyz_xyy(spark, sf_dir):
    x, y, big = color.xyz_to_xyy(F.col("r"), F.col("g"), F.col("b"))
    back = color.xyy_to_xyz(F.col("cx"), F.col("cy"), F.col("big"))
    px = raster_a(spark, sf_dir).select("y", "x", "r", "g", "b", x.alias("cx"), y.alias("cy"), big.alias("big"))
    return px.select("y", "x", q(F.col("cx")).alias("cx"), q(F.col("cy")).alias("cy"), *(q(v).alias(n) for v, n in zip(back, ("bx", "by", "bz"), strict=True)))


@query
def luma(spark, sf_dir):
    return raster_a(spark, sf_dir).select("y", "x", q(color.luma(F.col("r"), F.col("g"), F.col("b"))).alias("luma"))


@query
def quantize_u8(spark, sf_dir):
    return raster_a(spark, sf_dir).select("y", "x", *(color.quantize(F.col(c), 255).alias(c) for c in "rgba"))


@query
def quantize_u16(spark, sf_dir):
    return raster_a(spark, sf_dir).select("y", "x", *(color.quantize(F.col(c), 65535).alias(c) for c in "rgba"))


@query
def exposure(spark, sf_dir):
    return raster_a(spark, sf_dir).select("y", "x", q(color.exposure(F.col("r"), 1.5)).alias("r"))


# --- joins, aggregates, windows ----------------------------------------------------------------


@query
def compose_join(spark, sf_dir):
    both = compose.complete(compose.stack([raster_a(spark, sf_dir), raster_b(spark, sf_dir)]), 2)
    return both.select("y", "x", q(F.get("layers", F.lit(0))["r"]).alias("bottom"), q(F.get("layers", F.lit(1))["r"]).alias("top"))


@query
def compose_over(spark, sf_dir):
    layers = [raster_a(spark, sf_dir), raster_b(spark, sf_dir)]
    return quantised(compose.compose(layers, ["Normal", "Over"], [1.0, 0.7]), "r", "g", "b", "a")


@query
def compose_three(spark, sf_dir):
    a, b = raster_a(spark, sf_dir), raster_b(spark, sf_dir)
    third = a.select("y", "x", F.col("b").alias("r"), F.col("r").alias("g"), F.col("g").alias("b"), (F.col("a") * 0.5).alias("a"))
    return quantised(compose.compose([a, b, third], ["Normal", "Multiply", "Normal"], [1.0, 0.7, 0.4]), "r", "g", "b", "a")


@query
def compose_source(spark, sf_dir):
    return quantised(compose.compose([raster_a(spark, sf_dir), raster_b(spark, sf_dir)], ["Normal", "Source"], [1.0, 1.0]), "r", "g", "b", "a")


@query
def blend_modes(spark, sf_dir):
    both = compose.complete(compose.stack([raster_a(spark, sf_dir), raster_b(spark, sf_dir)]), 2)
    a, b = F.least(F.get("layers", F.lit(0))["r"], F.lit(1.0)), F.get("layers", F.lit(1))["r"]
    return both.select("y", "x", *(q(compose.separable(m, a, b)).alias(m.lower()) for m in compose.MODES[1:]))


@query
def overlay_base(spark, sf_dir):
    now = cache.latest(tile_versions(spark, sf_dir))
    base = now.where("tx < 6").select("tx", "ty", "payload")
    overlay = now.where("tx > 3").select("tx", "ty", (F.col("payload") * 2).alias("payload"))
    return quantised(cache.overlay_over_base(base, overlay, ("tx", "ty"), "payload"), "payload")


def tile_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile writes of three levels, every fourth one of a preview."""
    k = F.col("arrival")
    generation = F.when(k % 4 == 3, k % 3 + 7).otherwise(0)
    return tile_versions(spark, sf_dir).withColumns({"mip": (k % 3).cast("int"), "generation": generation.cast("long")})


@query
def overlay_generation(spark, sf_dir):
    return quantised(cache.display(tile_writes(spark, sf_dir), 8), "payload")


@query
def pending_tiles(spark, sf_dir):
    last = tile_writes(spark, sf_dir).where("generation = 0")
    return cache.pending(last.where("payload > 100"), 1, 500)


@query
def missing_tiles(spark, sf_dir):
    grid = layout.tile_grid(spark, 10 * TILE, 5 * TILE, TILE).select("tx", "ty")
    return cache.missing(grid, tile_versions(spark, sf_dir))


@query
def palette_lookup(spark, sf_dir):
    palette = spark.range(200).select(F.col("id").cast("int").alias("index"), (F.col("id") * 3 % 256).cast("int").alias("r"), (F.col("id") * 5 % 256).cast("int").alias("g"), (F.col("id") * 7 % 256).cast("int").alias("b"))
    return cache.palette_lookup(raster_a8(spark, sf_dir), palette, 200).select("y", "x", "r", "g", "b")


@query
def union_layers(spark, sf_dir):
    return quantised(compose.stack([raster_a(spark, sf_dir), raster_b(spark, sf_dir)]).groupBy("port").agg(F.count("*").alias("n"), F.max("r").alias("r")), "r")


@query
def mip_1(spark, sf_dir):
    return quantised(filters.halve(raster_a(spark, sf_dir), WIDTH, height_of(spark, sf_dir)), "r", "g", "b", "a")


@query
def mip_u8(spark, sf_dir):
    return filters.halve(raster_a8(spark, sf_dir), WIDTH, height_of(spark, sf_dir), ("v",), truncate=True)


@query
def mip_pyramid(spark, sf_dir):
    levels = filters.pyramid(raster_a(spark, sf_dir).select("y", "x", "r", "a"), WIDTH, height_of(spark, sf_dir), 128, ("r", "a"))
    return quantised(levels, "r", "a")


@query
def max_mip(spark, sf_dir):
    w, h = F.col("o_custkey") * 7 + 1, F.col("o_orderkey") + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", filters.max_mip(w, h).alias("max_mip"))


@query
def thumbnail_mip(spark, sf_dir):
    w, h = F.col("o_custkey") * 7 + 1, F.col("o_orderkey") + 1
    return table(spark, sf_dir, "orders").select("o_orderkey", filters.thumbnail_mip(w, h, 256).alias("mip"))


@query
def box_blur(spark, sf_dir):
    return quantised(filters.box_blur(raster_a(spark, sf_dir), 3), "r", "g", "b", "a")


@query
def box_blur_wide(spark, sf_dir):
    return quantised(filters.box_blur(raster_a(spark, sf_dir).select("y", "x", "r"), 32, ("r",), mip=1), "r")


@query
def histogram(spark, sf_dir):
    return filters.histogram(raster_a(spark, sf_dir), "r")


@query
def latest_version(spark, sf_dir):
    return cache.latest(tile_versions(spark, sf_dir)).select("tx", "ty", "version", "arrival", q(F.col("payload")).alias("payload"))


@query
def lru_survivors(spark, sf_dir):
    entries = table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), (F.col("event_id") * 7919 % 100003).alias("last_access"), (F.length("event_type") * 100).alias("size"), F.when(F.col("user_id") % 5 == 0, "full").otherwise("small").alias("pool"))
    return cache.survivors(entries, 100_000, "pool").select("key", "pool", "held")


# --- documents, views --------------------------------------------------------------------------


@query
def undo_redo(spark, sf_dir):
    return history.effective(edit_log(spark, sf_dir))


@query
def replay_scalar(spark, sf_dir):
    return quantised(history.replay(edit_log(spark, sf_dir)), "arg")


@query
def ema(spark, sf_dir):
    return quantised(history.ema(table(spark, sf_dir, "events"), "user_id", "event_id", "value", 0.7), "ema")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        ((k * 37 % 3000) - 500.0).alias("pan_x"),
        ((k * 53 % 2000) - 300.0).alias("pan_y"),
        F.pow(F.lit(2.0), -(k % 6).cast("double")).alias("zoom"),
        F.lit(800.0).alias("vp_w"),
        F.lit(600.0).alias("vp_h"),
        F.lit(4000).alias("img_w"),
        F.lit(3000).alias("img_h"),
        (k % 4).cast("int").alias("mip"),
        ((k % 400) - 200.0).alias("vel_x"),
        ((k % 300) - 150.0).alias("vel_y"),
    )


@query
def visible_mip(spark, sf_dir):
    zoom = (F.col("event_id") % 997 + 1) / 997.0
    return table(spark, sf_dir, "events").select("event_id", viewport.visible_mip(zoom, 4).alias("mip"))


@query
def texture_mip(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", viewport.floor_mip(F.col("o_custkey") * 7 + 1, 64, 6).alias("mip"))


@query
def prefetch_plan(spark, sf_dir):
    k = F.col("event_id")
    views = cameras(spark, sf_dir).withColumns({"idle": k % 10 / 10.0, "zoom_direction": (k % 3 - 1).cast("int"), "deepest": F.lit(3)})
    return viewport.prefetch(views, 256).select("event_id", "reason", "mip", "tx0", "tx1", "ty0", "ty1")


@query
def viewport_tiles(spark, sf_dir):
    return viewport.tile_range(cameras(spark, sf_dir), 256, 1).select("event_id", "tx0", "tx1", "ty0", "ty1")


@query
def prefetch_tiles(spark, sf_dir):
    return viewport.tile_range(cameras(spark, sf_dir), 256, 2, 0.25).select("event_id", "tx0", "tx1", "ty0", "ty1")


@query
def camera_fit(spark, sf_dir):
    return quantised(viewport.fitted(cameras(spark, sf_dir)).select("event_id", "pan_x", "pan_y", "zoom"), "pan_x", "pan_y", "zoom")


@query
def camera_pan(spark, sf_dir):
    moved = viewport.panned(cameras(spark, sf_dir), F.col("vel_x"), F.col("vel_y"))
    return quantised(moved.select("event_id", "pan_x", "pan_y"), "pan_x", "pan_y")


@query
def camera_zoom(spark, sf_dir):
    closer = viewport.zoomed(cameras(spark, sf_dir), F.pow(F.lit(2.0), (F.col("event_id") % 25 - 12).cast("double")), F.lit(400.0), F.lit(150.0))
    return quantised(closer.select("event_id", "pan_x", "pan_y", "zoom"), "pan_x", "pan_y", "zoom")


@query
def solid_colour(spark, sf_dir):
    return document.solid(raster_a8(spark, sf_dir), (0.25, 0.5, 0.75, 1.0))


@query
def empty_canvas(spark, sf_dir):
    canvas = raster_a8(spark, sf_dir).select("y", "x")
    doc = document.Document(WIDTH, height_of(spark, sf_dir), (document.Layer(1, "a", visible=False),))
    return document.render(doc, lambda name: raster_a(spark, sf_dir), canvas)


@query
def render_document(spark, sf_dir):
    """A blurred layer, a brightened one on top of it, shown as sRGB."""
    sources = {"a": raster_a(spark, sf_dir), "b": raster_b(spark, sf_dir)}
    bottom = document.Layer(1, "a", transforms=(document.Transform("blur", 3), document.Transform("blur", 9, enabled=False)))
    top = document.Layer(2, "b", opacity=0.7, transforms=(document.Transform("exposure", 0.5),))
    doc = document.Document(WIDTH, 1, (bottom, top))
    return quantised(document.render(doc, sources.__getitem__, sources["a"].select("y", "x"), "srgb"), "r", "g", "b", "a")


@query
def render_upto(spark, sf_dir):
    """The same layers before the first of their transforms."""
    sources = {"a": raster_a(spark, sf_dir), "b": raster_b(spark, sf_dir)}
    layers = (document.Layer(1, "a", transforms=(document.Transform("blur", 3),)), document.Layer(2, "b", opacity=0.7, transforms=(document.Transform("exposure", 0.5),)))
    doc = document.Document(WIDTH, 1, layers)
    return quantised(document.render(doc, sources.__getitem__, sources["a"].select("y", "x"), upto=0), "r", "g", "b", "a")


@query
def render_below(spark, sf_dir):
    """A layer that brightens what is below it, and one that takes a hidden layer's picture."""
    sources = {"a": raster_a(spark, sf_dir), "b": raster_b(spark, sf_dir)}
    layers = (
        document.Layer(1, "a"),
        document.Layer(2, "b", opacity=0.7, transforms=(document.Transform("exposure", 0.5, input="below"),)),
        document.Layer(3, "b", visible=False, transforms=(document.Transform("exposure", -1.0),)),
        document.Layer(4, "a", opacity=0.4, transforms=(document.Transform("exposure", -1.0, input=3),)),
    )
    doc = document.Document(WIDTH, 1, layers)
    return quantised(document.render(doc, sources.__getitem__, sources["a"].select("y", "x")), "r", "g", "b", "a")


ORACLES = {name: sql for name, sql in oracles.all_sql().items() if name in QUERIES}
