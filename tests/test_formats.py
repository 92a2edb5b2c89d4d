"""Codecs and metadata against files of another writer (the JVM's ImageIO) and hand-made ones."""

import struct
import zlib

import numpy as np
import pytest

from mosaiq.functions import profiles
from mosaiq.functions.color import convert
from mosaiq.sources import exif, images, jpeg, png, tiff

RNG = np.random.default_rng(11)


def tiff_of_jvm(spark, path, px, compression=None, tile=None):
    """A TIFF that ImageIO writes of 8-bit pixels, grey or RGB."""
    jvm = spark._jvm
    height, width = px.shape[:2]
    kind = jvm.java.awt.image.BufferedImage.TYPE_BYTE_GRAY if px.ndim == 2 else jvm.java.awt.image.BufferedImage.TYPE_INT_RGB
    image = jvm.java.awt.image.BufferedImage(width, height, kind)
    raster = image.getRaster()
    for y in range(height):
        for x in range(width):
            for c, v in enumerate(np.atleast_1d(px[y, x]).tolist()):
                raster.setSample(x, y, c, v)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("tiff").next()
    param = writer.getDefaultWriteParam()
    if compression:
        param.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
        param.setCompressionType(compression)
    if tile:
        param.setTilingMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
        param.setTiling(tile, tile, 0, 0)
    out = jvm.javax.imageio.ImageIO.createImageOutputStream(jvm.java.io.File(str(path)))
    writer.setOutput(out)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    out.close()
    return path.read_bytes()


@pytest.mark.parametrize(("compression", "tile"), [("LZW", None), ("LZW", 16), ("PackBits", None), ("ZLib", 16), (None, 32)])
def test_tiff_of_another_writer(spark, tmp_path, compression, tile):
    y, x = np.mgrid[:45, :70]
    soft = np.stack([(x * 3 + y) % 256, (y * 5) % 256, (x // 9 * 20) % 256], axis=2)
    px = np.where(RNG.random((45, 70, 1)) < 0.3, RNG.integers(0, 256, (45, 70, 3)), soft).astype(np.uint8)
    (page,) = tiff.decode(tiff_of_jvm(spark, tmp_path / "a.tif", px, compression, tile))
    assert np.array_equal(page.pixels, px) and page.alpha is None and page.space == "srgb"
    grey = px[..., 0]
    (page,) = tiff.decode(tiff_of_jvm(spark, tmp_path / "g.tif", grey, compression, tile))
    assert np.array_equal(page.pixels[..., 0], grey)


def test_lzw_widens_and_starts_anew(spark, tmp_path):
    px = RNG.integers(0, 256, (90, 100), dtype=np.uint8)
    (page,) = tiff.decode(tiff_of_jvm(spark, tmp_path / "n.tif", px, "LZW"))
    assert np.array_equal(page.pixels[..., 0], px)
    with pytest.raises(ValueError, match="damaged"):
        tiff.unpack_lzw(b"\xff\xff\xff\xff")


def little_tiff(fields, body):
    """A TIFF of one directory: fields are tag -> (type, values), the body's place and size are filled in."""
    entries, extra, at = [], b"", 8 + 2 + 12 * (len(fields) + 2) + 4
    codes = {2: "s", 3: "H", 4: "I", 5: "I"}
    fields = fields | {tiff.STRIPS: (4, (0,)), tiff.STRIP_BYTES: (4, (len(body),))}
    for tag, (kind, values) in sorted(fields.items()):
        data = values if kind == 2 else struct.pack(f"<{len(values)}{codes[kind]}", *values)
        n = len(values) // (2 if kind == 5 else 1)
        if tag == tiff.STRIPS:
            entries.append((tag, kind, n, None))
        elif len(data) <= 4:
            entries.append((tag, kind, n, data.ljust(4, b"\0")))
        else:
            entries.append((tag, kind, n, struct.pack("<I", at + len(extra))))
            extra += data
    place = struct.pack("<I", at + len(extra))
    rows = b"".join(struct.pack("<HHI", t, k, n) + (d or place) for t, k, n, d in entries)
    return b"II*\0\x08\0\0\0" + struct.pack("<H", len(entries)) + rows + b"\0\0\0\0" + extra + body


def page_of(bits, body, **more):
    fields = {tiff.WIDTH: (4, (5,)), tiff.HEIGHT: (4, (2,)), tiff.BITS: (3, (bits,)), tiff.COMPRESSION: (3, (1,)), tiff.PHOTOMETRIC: (3, (1,)), tiff.PER_PIXEL: (3, (1,)), tiff.ROWS: (4, (2,))}
    (page,) = tiff.decode(little_tiff(fields | {getattr(tiff, k): v for k, v in more.items()}, body))
    return page


def test_narrow_samples_and_halves():
    assert page_of(1, b"\xa8\x50").pixels[..., 0].tolist() == [[255, 0, 255, 0, 255], [0, 255, 0, 255, 0]]
    assert page_of(4, b"\x01\x23\x40\xfe\xdc\xb0").pixels[..., 0].tolist() == [[0, 17, 34, 51, 68], [255, 238, 221, 204, 187]]
    assert page_of(2, b"\x1b\x00\xe4\x40", PHOTOMETRIC=(3, (0,))).pixels[0, :4, 0].tolist() == [255, 170, 85, 0]
    half = np.array([[0, 0.5, 1, 2, 6e-8], [1, 1, 1, 1, 1]], "<f2")
    assert np.array_equal(page_of(16, half.tobytes(), FORMAT=(3, (3,))).pixels[..., 0], half.astype(np.float32))
    steps = page_of(8, bytes([250, 3, 3, 3, 3, 1, 0, 0, 255, 0]), PREDICTOR=(3, (2,)))
    assert steps.pixels[..., 0].tolist() == [[250, 253, 0, 3, 6], [1, 1, 1, 0, 0]]
    with pytest.raises(ValueError, match="not supported"):
        page_of(8, b"\0" * 10, COMPRESSION=(3, (7,)))


def test_page_fields():
    page = page_of(8, bytes(10), ORIENTATION=(3, (6,)), PAGE_NAME=(2, b"cover\0"), XPOS=(4, (3,)), YPOS=(4, (9,)), SOFTWARE=(2, b"tool\0"), PHOTOMETRIC=(3, (8,)))
    assert (page.orientation, page.name, page.offset, page.space) == (6, "cover", (3, 9), "linear_srgb")
    assert page.text["Software"] == "tool" and page.text["Orientation"] == "6" and "BitsPerSample" not in page.text
    (back,) = tiff.decode(tiff.encode([tiff.Page(page.pixels, orientation=8, name="cover")]))
    assert (back.orientation, back.name) == (8, "cover")


def test_orientations():
    px = np.arange(6).reshape(2, 3, 1)
    seen = {k: tiff.oriented(px, k)[..., 0].tolist() for k in range(1, 9)}
    assert seen[1] == [[0, 1, 2], [3, 4, 5]] and seen[2] == [[2, 1, 0], [5, 4, 3]] and seen[3] == [[5, 4, 3], [2, 1, 0]] and seen[4] == [[3, 4, 5], [0, 1, 2]]
    assert seen[5] == [[0, 3], [1, 4], [2, 5]] and seen[6] == [[3, 0], [4, 1], [5, 2]] and seen[7] == [[5, 2], [4, 1], [3, 0]] and seen[8] == [[2, 5], [1, 4], [0, 3]]


def exif_block():
    """Two directories: the main one, and one of the camera."""
    camera = struct.pack("<H", 3) + struct.pack("<HHII", 33434, 5, 1, 120) + struct.pack("<HHII", 33437, 5, 1, 128) + struct.pack("<HHII", 34855, 3, 1, 400) + b"\0\0\0\0"
    main = struct.pack("<H", 4) + struct.pack("<HHII", 271, 2, 5, 112) + struct.pack("<HHII", 274, 3, 1, 6) + struct.pack("<HHII", 34665, 4, 1, 66) + struct.pack("<HHII", 40000, 3, 1, 1) + b"\0\0\0\0"
    out = (b"II*\0\x08\0\0\0" + main).ljust(66, b"\0") + camera
    return out.ljust(112, b"\0") + b"Acme\0\0\0\0" + struct.pack("<IIII", 1, 250, 28, 10)


FIELDS = {"Make": "Acme", "Orientation": "6", "ExposureTime": "1/250", "FNumber": "2.800000", "ISOSpeedRatings": "400"}


def test_exif_fields():
    assert exif.fields(exif_block()) == exif.fields(b"Exif\0\0" + exif_block()) == FIELDS
    assert exif.fields(b"nothing") == exif.fields(exif_block()[:40]) == {}


def profile(name, translated=False, kind=b"mntrRGB "):
    if translated:
        words = name.encode("utf-16-be")
        body = b"mluc\0\0\0\0" + struct.pack(">II2s2sII", 1, 12, b"en", b"US", len(words), 28) + words
    else:
        body = b"desc\0\0\0\0" + struct.pack(">I", len(name) + 1) + name.encode() + b"\0"
    return b"\0" * 12 + kind + b"\0" * 108 + struct.pack(">I4sII", 1, b"desc", 144, len(body)) + body


def test_profiles():
    assert profiles.profile_space(profile("sRGB IEC61966-2.1")) == "srgb"
    assert profiles.profile_space(profile("Display P3", True)) == "display_p3"
    assert profiles.profile_space(profile("Adobe RGB (1998)")) == "adobe_rgb"
    assert profiles.profile_space(profile("Some printer")) is profiles.profile_space(profile("sRGB", kind=b"prtrRGB ")) is profiles.profile_space(b"short") is None


def test_spaces_of_files():
    p3 = (0.3127, 0.329, 0.68, 0.32, 0.265, 0.69, 0.15, 0.06)
    of = profiles.png_space
    assert of((9, 16, 0, 1), profile("sRGB"), True, p3, 1.0) == "Bt2020/D65/pq"
    assert of((10, 16, 0, 1), profile("Display P3"), True, p3, 1.0) == "display_p3"
    assert of(None, profile("unknown"), False, p3, 1.0) == "srgb"
    assert of(None, None, True, p3, 1.0) == "srgb"
    assert of(None, None, False, p3, 1.0) == "linear_display_p3"
    assert of(None, None, False, p3, None) == "display_p3"
    assert of(None, None, False, (0.1,) * 8, 1 / 2.2) == "Bt709/D65/gamma22"
    assert of(None, None, False, None, 0.9) == of(None, None, False, None, None) == "srgb"
    assert profiles.tiff_space(profile("ProPhoto RGB"), 8) == "prophoto"


def test_a_space_without_a_name_converts(spark):
    px = spark.createDataFrame([(0, 0, 0.5, 0.5, 0.5, 1.0)], "y int, x int, r double, g double, b double, a double")
    (row,) = convert(px, "Bt2020/D65/gamma22", "linear_srgb").collect()
    assert row.r == pytest.approx(0.5**2.2) and row.b == pytest.approx(0.5**2.2)
    with pytest.raises(ValueError, match="unknown colour space"):
        convert(px, "Bt2020/nowhere/gamma22", "srgb")


def test_metadata_of_files(spark, tmp_path):
    px = RNG.integers(0, 256, (6, 7, 3), dtype=np.uint8)
    (tmp_path / "a.png").write_bytes(png.encode(px, text={"Author": "Ána 木", "other": "x"}, exif=exif_block(), icc=profile("Display P3"), dpi=300))
    plain = jpeg.encode(px, dpi=72)
    block = b"Exif\0\0" + exif_block()
    icc = b"ICC_PROFILE\0\1\1" + profile("Adobe RGB (1998)")
    marks = b"".join(bytes([0xFF, kind]) + struct.pack(">H", len(b) + 2) + b for kind, b in ((0xE1, block), (0xE2, icc)))
    (tmp_path / "b.jpg").write_bytes(plain[:2] + marks + plain[2:])
    (tmp_path / "c.tif").write_bytes(tiff.encode([tiff.Page(px, name="one"), tiff.Page(px[:2], text={"Artist": "me"})]))
    (tmp_path / "d.txt").write_bytes(b"none")
    pages = images.describe_files(images.files(spark, str(tmp_path)), skip_unsupported=True)
    got = {(r.image.rsplit("/", 1)[1], r.page): r for r in pages.collect()}
    assert set(got) == {("a.png", 0), ("b.jpg", 0), ("c.tif", 0), ("c.tif", 1)}
    a, b, c = got["a.png", 0], got["b.jpg", 0], got["c.tif", 0]
    assert a.fields == FIELDS | {"Artist": "Ána 木", "other": "x"} and a.space == "display_p3" and a.orientation == 6 and round(a.dpi) == 300
    assert b.fields == FIELDS and b.space == "adobe_rgb" and (b.width, b.height, b.channels, b.dpi) == (7, 6, 3, 72.0)
    assert c.name == "one" and got["c.tif", 1].fields["Artist"] == "me" and got["c.tif", 1].height == 2
    labels = {(r.field, r.label) for r in images.labelled(pages).where("image like '%a.png'").collect()}
    assert labels == {("Make", "Make"), ("Orientation", "Orientation"), ("ExposureTime", "Exposure"), ("FNumber", "Aperture"), ("ISOSpeedRatings", "ISO"), ("Artist", "Artist"), ("other", "other")}
    tiles = images.read_images(spark, str(tmp_path), skip_unsupported=True)
    assert {r.space for r in tiles.where("image like '%a.png'").collect()} == {"display_p3"}
    with pytest.raises(Exception, match="unsupported image format"):
        images.describe_files(images.files(spark, str(tmp_path))).collect()


def test_packed_international_text():
    body = b"Title\0\1\0en\0Titel\0" + zlib.compress("größer".encode())
    data = png.encode(np.zeros((1, 1, 1), np.uint8))
    at = data.index(b"IDAT") - 4
    assert png.decode(data[:at] + png._chunk(b"iTXt", body) + data[at:]).text == {"Title": "größer"}
