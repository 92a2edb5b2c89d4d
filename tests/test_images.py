import zlib

import numpy as np
import pytest

from mosaiq.sources import images, jpeg, png, tiff

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_png_round_trip(channels, kind):
    px = RNG.integers(0, np.iinfo(kind).max, (13, 17, channels), dtype=kind, endpoint=True)
    back = png.decode(png.encode(px, text={"Author": "somebody"}, dpi=300, gamma=0.45455))
    assert np.array_equal(back.pixels, px) and back.pixels.dtype == kind
    assert back.text == {"Author": "somebody"} and back.dpi == pytest.approx(300, rel=1e-3) and back.gamma == pytest.approx(0.45455)


def test_png_filters():
    px = RNG.integers(0, 256, (10, 12, 3), dtype=np.uint8)
    lines = px.reshape(10, -1)
    raw = []
    for y in range(10):
        kind = y % 5
        above = lines[y - 1] if y else np.zeros_like(lines[0])
        left = np.concatenate([np.zeros(3, np.uint8), lines[y][:-3]])
        corner = np.concatenate([np.zeros(3, np.uint8), above[:-3]])
        p = left.astype(int) + above - corner
        near = np.where((abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - above) <= abs(p - corner), above, corner))
        guess = [0, left, above, (left.astype(int) + above) // 2, near][kind]
        raw.append(np.concatenate([[kind], (lines[y].astype(int) - guess) % 256]).astype(np.uint8))
    step = png.unfilter(np.array(raw), 3)
    assert np.array_equal(step, lines)


def test_png_damage():
    data = bytearray(png.encode(np.zeros((4, 4, 3), np.uint8)))
    data[-20] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        png.decode(bytes(data))
    with pytest.raises(ValueError):
        images.decode_any(b"GIF89a")


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float32])
@pytest.mark.parametrize("deflate", [True, False])
def test_tiff_round_trip(kind, deflate):
    make = lambda h, w, c: (RNG.random((h, w, c)) * (200 if kind != np.float32 else 1)).astype(kind)
    pages = [tiff.Page(make(70, 9, 3), text={"Software": "mosaiq"}, dpi=72), tiff.Page(make(5, 6, 4), alpha="straight"), tiff.Page(make(3, 3, 1))]
    back = tiff.decode(tiff.encode(pages, deflate=deflate))
    assert [p.alpha for p in back] == [None, "straight", None] and back[0].text == {"Software": "mosaiq"} and back[0].dpi == pytest.approx(72)
    for a, b in zip(pages, back, strict=True):
        assert np.array_equal(a.pixels, b.pixels)


def test_wide_samples():
    assert tiff.normalised(np.array([-128, 127], np.int8)).tolist() == [0.0, 1.0]
    assert tiff.normalised(np.array([0, 2**32 - 1], np.uint32)).tolist() == [0.0, 1.0]


def test_files_to_tiles_and_back(spark, tmp_path):
    px = RNG.integers(0, 256, (50, 70, 4), dtype=np.uint8)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(png.encode(px))
    (tmp_path / "in" / "b.tif").write_bytes(tiff.encode([tiff.Page(px[..., :3].copy()), tiff.Page(px[:9, :9, :3].copy())]))
    (tmp_path / "in" / "c.txt").write_bytes(b"no image")
    tiles = images.read_images(spark, str(tmp_path / "in"), tile=32, skip_unsupported=True)
    assert tiles.groupBy("image", "page").count().count() == 3
    images.write_store(tiles, str(tmp_path / "store"))
    stored = images.read_store(spark, str(tmp_path / "store"))
    made = {(r["image"].rsplit("/", 1)[1], r["page"]): r["content"] for r in images.to_files(stored).collect()}
    assert np.array_equal(png.decode(bytes(made["a.png", 0])).pixels, px)
    assert np.array_equal(png.decode(bytes(made["b.tif", 1])).pixels, px[:9, :9, :3])
    assert images.read_store(spark, str(tmp_path / "store"), tx=(0, 1), ty=(0, 1)).count() == 3
    assert images.tile_pixels(stored.where("page = 0")).count() == 2 * 50 * 70


def soft_image(height, width, channels):
    y, x = np.mgrid[:height, :width]
    px = np.stack([128 + 100 * np.sin(x / (7 + c) + c) * np.cos(y / (9 + c)) for c in range(channels)], axis=2)
    return np.clip(np.rint(px + RNG.normal(0, 3, px.shape)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize(("shape", "quality", "off"), [((61, 83, 3), 95, 4), ((61, 83, 1), 95, 3), ((8, 8, 4), 100, 3), ((40, 200, 3), 50, 9), ((1, 1, 3), 0, 40), ((30, 30, 2), 101, 2)])
def test_jpeg_against_another_decoder(spark, tmp_path, shape, quality, off):
    px = soft_image(*shape)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(px, quality=quality, dpi=72))
    (row,) = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    channels = 1 if shape[2] < 3 else 3
    assert (row.height, row.width, row.nChannels) == (*shape[:2], channels)
    back = np.frombuffer(bytes(row.data), np.uint8).reshape(*shape[:2], channels)[..., ::-1]
    assert np.sqrt(np.mean((back.astype(float) - px[..., :channels]) ** 2)) < off


def test_jpeg_noise_and_flat(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(RNG.integers(0, 256, (64, 64, 3), dtype=np.uint8), quality=100))
    (tmp_path / "b.jpg").write_bytes(jpeg.encode(np.full((20, 20, 1), 7, np.uint8)))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert sorted(r.height for r in rows) == [20, 64]
    with pytest.raises(ValueError, match="8-bit"):
        jpeg.encode(np.zeros((2, 2, 3), np.uint16))
    assert len(jpeg.code_lengths(np.array([0] * 256))[1]) == 0
    fibonacci = np.zeros(256, np.int64)
    fibonacci[:40] = [round(1.618**k) for k in range(40)]
    lengths, symbols = jpeg.code_lengths(fibonacci)
    assert sum(lengths) == len(symbols) == 40 and sum(n / 2**k for k, n in enumerate(lengths, 1)) < 1


def test_jpeg_files_to_tiles_and_back(spark, tmp_path):
    px = soft_image(50, 70, 3)
    (tmp_path / "a.jpg").write_bytes(jpeg.encode(px, quality=95))
    (tmp_path / "c.jpeg").write_bytes(b"no image")
    tiles = images.read_jpegs(spark, str(tmp_path), tile=32, skip_unsupported=True)
    assert tiles.count() == 6
    (made,) = images.to_files(tiles, "jpeg", quality=95).collect()
    assert made["content"][:2] == b"\xff\xd8"
    got = {(r.y, r.x): r.samples for r in images.tile_pixels(tiles).collect()}
    assert len(got) == 50 * 70 and abs(got[20, 40][0] * 255 - px[20, 40, 0]) < 16
