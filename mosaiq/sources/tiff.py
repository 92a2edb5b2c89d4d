"""TIFF files as arrays, both ways: strips and tiles, LZW, PackBits or deflate, 1 to 64 bits, several pages."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from mosaiq.functions.profiles import tiff_space

from .exif import TYPES, directory, fields_of, order_of

# Tag numbers of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, ORIENTATION, PER_PIXEL, ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 274, 277, 278, 279
XRES, YRES, PLANAR, PAGE_NAME, XPOS, YPOS, UNIT, SOFTWARE, ARTIST, PREDICTOR, COLORMAP = 282, 283, 284, 285, 286, 287, 296, 305, 315, 317, 320
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES, EXTRA, FORMAT, ICC = 322, 323, 324, 325, 338, 339, 34675
# Kinds of compression.
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Pixels of one page, at most.
MOST_PIXELS = 128 << 20


@dataclass
class Page:
    """pixels: height x width x channels; alpha: None, "straight" or "premultiplied"; orientation: 1 to 8 as stored, not applied."""

    pixels: np.ndarray
    alpha: str | None = None
    photometric: int = 1
    dpi: float | None = None
    icc: bytes | None = None
    text: dict[str, str] = field(default_factory=dict)
    space: str = "srgb"
    orientation: int = 1
    name: str | None = None
    offset: tuple[int, int] = (0, 0)


def unpack_bits(data: bytes) -> bytes:
    """PackBits: a count, then that many bytes and one more; or a negative count, then a byte to repeat."""
    out, at = bytearray(), 0
    while at < len(data):
        count = data[at]
        if count < 128:
            out += data[at + 1 : at + 2 + count]
            at += 2 + count
        else:
            if count > 128:
                out += data[at + 1 : at + 2] * (257 - count)
            at += 2 if count > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes) -> bytes:
    """LZW of TIFF: codes of 9 to 12 bits from the highest bit down, widening one code early."""
    out, words = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""]
    bits, held, width, last = 0, 0, 9, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            del words[258:]
            width, last = 9, b""
            continue
        if code > len(words) or (code == len(words) and not last):
            raise ValueError("the LZW data is damaged")
        word = words[code] if code < len(words) else last + last[:1]
        out += word
        if last:
            words.append(last + word[:1])
        last = word
        width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return bytes(out)


def _unpacked(body: bytes, kind: int) -> bytes:
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompress(body)
    return body if kind == PLAIN else unpack_lzw(body) if kind == LZW else unpack_bits(body)


def _block(body: bytes, order: str, height: int, width: int, channels: int, bits: int, kind: int, predictor: int) -> np.ndarray:
    """Samples of a strip or tile, height x width x channels; lines that are missing are zero."""
    line = -(-width * channels * bits // 8)
    raw = np.zeros(height * line, np.uint8)
    given = np.frombuffer(body, np.uint8)[: height * line]
    raw[: len(given)] = given
    if bits < 8:
        cells = np.unpackbits(raw.reshape(height, line), axis=1).reshape(height, -1, bits)
        out = (cells * (1 << np.arange(bits - 1, -1, -1))).sum(axis=2).astype(np.uint8)[:, : width * channels].reshape(height, width, channels)
    else:
        typed = raw.view(np.dtype(f"{order}{'uif'[kind - 1]}{bits // 8}"))
        out = typed.astype(typed.dtype.newbyteorder("=")).reshape(height, width, channels)
    return np.cumsum(out, axis=1, dtype=out.dtype) if predictor == 2 else out


def _samples(data: bytes, order: str, tags: dict) -> np.ndarray:
    """height x width x channels, as stored."""
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, channels, planar = one(WIDTH, 0), one(HEIGHT, 0), one(PER_PIXEL, 1), one(PLANAR, 1)
    bits, kind, packed, predictor = one(BITS, 1), one(FORMAT, 1), one(COMPRESSION, 1), one(PREDICTOR, 1)
    if packed not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS) or bits not in (1, 2, 4, 8, 16, 32, 64) or kind not in (1, 2, 3) or predictor not in (1, 2) or len(set(tags.get(BITS, (bits,)))) > 1 or (kind == 3 and (bits < 16 or predictor == 2)):
        raise ValueError(f"TIFF with compression {packed}, predictor {predictor} and {bits} bits is not supported")
    if not 0 < width * height <= MOST_PIXELS:
        raise ValueError("the page is empty or too large")
    tiled = TILE_OFFSETS in tags
    across, down = (one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0)) if tiled else (width, min(one(ROWS, height), height))
    places, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags.get(STRIPS, ()), tags.get(STRIP_BYTES, ()))
    if not across or not down:
        raise ValueError("the page has no strips or tiles")
    columns, rows = -(-width // across), -(-height // down)
    planes, deep = (channels, 1) if planar == 2 else (1, channels)
    if len(places) < planes * rows * columns or len(sizes) < planes * rows * columns:
        raise ValueError("strips or tiles are missing")
    out = None
    for number in range(planes * rows * columns):
        plane, y, x = number // (rows * columns), number // columns % rows * down, number % columns * across
        body = _unpacked(data[places[number] : places[number] + sizes[number]], packed)
        part = _block(body, order, down if tiled else min(down, height - y), across, deep, bits, kind, predictor)
        if out is None:
            out = np.zeros((height, width, channels), part.dtype)
        out[y : y + down, x : x + across, plane * deep : (plane + 1) * deep] = part[: height - y, : width - x]
    return out


def _page(data: bytes, order: str, tags: dict) -> Page:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    px, photometric, bits = _samples(data, order, tags), one(PHOTOMETRIC, 1), one(BITS, 1)
    if photometric == 3:
        if COLORMAP not in tags:
            raise ValueError("the palette is missing")
        table = (np.array(tags[COLORMAP], np.uint16).reshape(3, -1).T >> 8).astype(np.uint8)
        px = table[np.minimum(px[..., 0], len(table) - 1)]
    else:
        if bits < 8:
            px = px * np.uint8(255 // ((1 << bits) - 1))
        if photometric == 0 and px.dtype.kind == "u":
            px = np.iinfo(px.dtype).max - px
    if px.dtype.itemsize >= 4 or px.dtype.kind in "if":
        px = normalised(px)
    extra = tags.get(EXTRA)
    dpi = tags[XRES][0] / tags[XRES][1] * (2.54 if one(UNIT, 2) == 3 else 1) if XRES in tags and tags[XRES][1] else None
    icc = bytes(tags[ICC]) or None if ICC in tags else None
    name = tags[PAGE_NAME].split(b"\0")[0].decode("utf-8", "replace") if isinstance(tags.get(PAGE_NAME), bytes) else None
    offset = (one(XPOS, 0), one(YPOS, 0)) if len(tags.get(XPOS, ())) == 1 and len(tags.get(YPOS, ())) == 1 else (0, 0)
    orientation = one(ORIENTATION, 1)
    text = fields_of(data, order, {k: v for k, v in tags.items() if k not in (WIDTH, HEIGHT, BITS)})  # the page's own form says these
    return Page(px, {1: "premultiplied"}.get(extra[0], "straight") if extra else None, photometric, dpi, icc, text, tiff_space(icc, photometric), orientation if 1 <= orientation <= 8 else 1, name or None, offset)


def oriented(px: np.ndarray, orientation: int) -> np.ndarray:
    """Pixels as they are to be seen, of an image stored with an orientation of 1 to 8."""
    # Whether lines and columns change places first, then whether lines and columns are reversed.
    swap, lines, columns = {1: (0, 0, 0), 2: (0, 0, 1), 3: (0, 1, 1), 4: (0, 1, 0), 5: (1, 0, 0), 6: (1, 0, 1), 7: (1, 1, 1), 8: (1, 1, 0)}[orientation]
    px = px.swapaxes(0, 1) if swap else px
    return px[:: -1 if lines else 1, :: -1 if columns else 1]


def normalised(px: np.ndarray) -> np.ndarray:
    """Wide and signed samples as float32 of 0 to 1; floats as they are."""
    if px.dtype.kind == "f":
        return px.astype(np.float32)
    bits = px.dtype.itemsize * 8
    wide = px.astype(np.float64)
    if px.dtype.kind == "u":
        return (wide / (2.0**bits - 1)).astype(np.float32)
    if bits <= 16:
        return ((wide + 2 ** (bits - 1)) / (2**bits - 1)).astype(np.float32)
    return (wide / (2.0 ** (bits - 1) - 1) * 0.5 + 0.5).astype(np.float32)


def decode(data: bytes) -> list[Page]:
    order = order_of(data)
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    pages, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        tags, at = directory(data, order, at)
        pages.append(_page(data, order, tags))
    return pages


def encode(pages: list[Page], *, deflate: bool = True, rows_per_strip: int = 64) -> bytes:
    """A little-endian TIFF of all pages, in strips."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        px = page.pixels[..., None] if page.pixels.ndim == 2 else page.pixels
        height, width, per_pixel = px.shape
        if px.dtype not in (np.uint8, np.uint16, np.float32):
            raise ValueError(f"samples of {px.dtype} are not supported")
        strips = []
        for y in range(0, height, rows_per_strip):
            body = np.ascontiguousarray(px[y : y + rows_per_strip]).astype(px.dtype.newbyteorder("<")).tobytes()
            strips.append((len(out), len(body := zlib.compress(body) if deflate else body)))
            out += body
        colours = per_pixel - (page.alpha is not None)
        fields: dict[int, tuple[int, tuple | bytes]] = {
            WIDTH: (4, (width,)), HEIGHT: (4, (height,)), BITS: (3, (px.dtype.itemsize * 8,) * per_pixel), COMPRESSION: (3, (8 if deflate else 1,)),
            PHOTOMETRIC: (3, (page.photometric if page.photometric in (5, 6, 8) else 2 if colours >= 3 else 1,)), STRIPS: (4, tuple(a for a, _ in strips)),
            PER_PIXEL: (3, (per_pixel,)), ROWS: (4, (rows_per_strip,)), STRIP_BYTES: (4, tuple(n for _, n in strips)), PLANAR: (3, (1,)),
            FORMAT: (3, ((3 if px.dtype.kind == "f" else 1),) * per_pixel),
        }
        if page.alpha:
            fields[EXTRA] = (3, (1 if page.alpha == "premultiplied" else 2,))
        if page.dpi:
            fields |= {XRES: (5, (round(page.dpi * 10000), 10000)), YRES: (5, (round(page.dpi * 10000), 10000)), UNIT: (3, (2,))}
        if page.orientation != 1:
            fields[ORIENTATION] = (3, (page.orientation,))
        if page.name:
            fields[PAGE_NAME] = (2, page.name.encode() + b"\0")
        if page.icc:
            fields[ICC] = (7, page.icc)
        for tag, name in ((SOFTWARE, "Software"), (ARTIST, "Artist")):
            if name in page.text:
                fields[tag] = (2, page.text[name].encode("latin-1", "replace") + b"\0")
        entries = []
        for tag, (kind, value) in sorted(fields.items()):
            count = len(value) // (2 if kind == 5 else 1)
            body = value if isinstance(value, bytes) else struct.pack(f"<{len(value)}{'I' if kind == 5 else TYPES[kind]}", *value)
            if len(body) > 4:
                out += b"\0" * (len(out) % 2)
                body, place = struct.pack("<I", len(out)), body
                out += place
            entries.append(struct.pack("<HHI", tag, kind, count) + body.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
