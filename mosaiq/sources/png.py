"""PNG files as arrays, both ways, with zlib and NumPy only."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

from mosaiq.functions.profiles import png_space

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Samples per pixel by colour type: grey, RGB, palette, grey + alpha, RGB + alpha.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of one image, at most.
MOST_PIXELS = 128 << 20


@dataclass
class Png:
    """pixels: height x width x channels, uint8 or uint16, palettes and transparency expanded."""

    pixels: np.ndarray
    text: dict[str, str] = field(default_factory=dict)
    gamma: float | None = None
    srgb: bool = False
    chroma: tuple[float, ...] | None = None
    dpi: float | None = None
    icc: bytes | None = None
    cicp: tuple[int, ...] | None = None
    exif: bytes | None = None

    @property
    def space(self) -> str:
        return png_space(self.cicp, self.icc, self.srgb, self.chroma, self.gamma)


def chunks(data: bytes):
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 8 <= len(data):
        (length,), kind = struct.unpack_from(">I", data, at), data[at + 4 : at + 8]
        body = data[at + 8 : at + 8 + length]
        if len(body) != length:
            raise ValueError("the file ends inside a chunk")
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + length)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, body
        at += 12 + length


def unfilter(raw: np.ndarray, step: int) -> np.ndarray:
    """Lines with a filter byte each -> the bytes before filtering."""
    out = np.zeros((raw.shape[0] + 1, raw.shape[1] - 1 + step), np.uint8)
    for y, line in enumerate(raw):
        kind, body, above, here = line[0], line[1:], out[y], out[y + 1]
        if kind == 0:
            here[step:] = body
        elif kind == 1:
            here[step:] = np.cumsum(body.reshape(-1, step), axis=0, dtype=np.uint8).ravel() if len(body) % step == 0 else body
        elif kind == 2:
            here[step:] = body + above[step:]
        elif kind in (3, 4):
            a, b = bytes(above), bytearray(here)
            for i, v in enumerate(body.tolist(), step):
                left, up, corner = b[i - step], a[i], a[i - step]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    da, db, dc = abs(p - left), abs(p - up), abs(p - corner)
                    guess = left if da <= db and da <= dc else up if db <= dc else corner
                b[i] = (v + guess) & 255
            out[y + 1] = np.frombuffer(bytes(b), np.uint8)
        else:
            raise ValueError(f"unknown line filter {kind}")
    return out[1:, step:]


def _samples(lines: np.ndarray, depth: int, width: int, per_pixel: int) -> np.ndarray:
    height = len(lines)
    if depth == 16:
        return lines.reshape(height, -1).view(">u2").astype(np.uint16)[:, : width * per_pixel].reshape(height, width, per_pixel)
    if depth < 8:
        bits = np.unpackbits(lines, axis=1).reshape(height, -1, depth)
        lines = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return lines[:, : width * per_pixel].reshape(height, width, per_pixel)


def _image(raw: np.ndarray, width: int, height: int, depth: int, per_pixel: int, interlaced: bool) -> np.ndarray:
    step = max(1, depth * per_pixel // 8)
    if not interlaced:
        row = 1 + -(-width * depth * per_pixel // 8)
        return _samples(unfilter(raw[: row * height].reshape(height, row), step), depth, width, per_pixel)
    out = np.zeros((height, width, per_pixel), np.uint16 if depth == 16 else np.uint8)
    at = 0
    for x0, y0, dx, dy in ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)):
        w, h = -(-max(0, width - x0) // dx), -(-max(0, height - y0) // dy)
        if w and h:
            row = 1 + -(-w * depth * per_pixel // 8)
            out[y0::dy, x0::dx] = _samples(unfilter(raw[at : at + row * h].reshape(h, row), step), depth, w, per_pixel)
            at += row * h
    return out


def decode(data: bytes) -> Png:
    width = height = depth = kind = 0
    interlaced, body, out = False, [], Png(np.zeros((0, 0, 0), np.uint8))
    palette = clear = None
    for name, part in chunks(data):
        if name == b"IHDR":
            width, height, depth, kind, _, _, lace = struct.unpack(">IIBBBBB", part)
            interlaced = bool(lace)
            if width * height > MOST_PIXELS:
                raise ValueError("the image is too large")
        elif name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = part
        elif name == b"IDAT":
            body.append(part)
        elif name == b"tEXt":
            key, _, value = part.partition(b"\0")
            out.text[key.decode("latin-1")] = value.decode("latin-1")
        elif name == b"zTXt":
            key, _, value = part.partition(b"\0")
            out.text[key.decode("latin-1")] = zlib.decompress(value[1:]).decode("latin-1")
        elif name == b"iTXt":
            key, _, rest = part.partition(b"\0")
            packed, body_text = rest[:1] == b"\1", rest[2:].partition(b"\0")[2].partition(b"\0")[2]
            out.text[key.decode("latin-1")] = (zlib.decompress(body_text) if packed else body_text).decode("utf-8", "replace")
        elif name == b"eXIf":
            out.exif = part
        elif name == b"gAMA":
            out.gamma = struct.unpack(">I", part)[0] / 100000
        elif name == b"cHRM":
            out.chroma = tuple(v / 100000 for v in struct.unpack(">8I", part))
        elif name == b"sRGB":
            out.srgb = True
        elif name == b"cICP":
            out.cicp = tuple(part)
        elif name == b"iCCP":
            out.icc = zlib.decompress(part.partition(b"\0")[2][1:])
        elif name == b"pHYs":
            x, _, unit = struct.unpack(">IIB", part)
            out.dpi = x * 2.54 / 100 if unit == 1 else None
    if kind not in SAMPLES or not body:
        raise ValueError("the file has no image")
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    px = _image(raw, width, height, depth, SAMPLES[kind], interlaced)
    if kind == 3:
        if palette is None:
            raise ValueError("the palette is missing")
        index = np.minimum(px[..., 0], len(palette) - 1)
        alpha = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[: len(palette)]
        px = np.concatenate([palette[index], alpha[index][..., None]], axis=2) if clear is not None else palette[index]
    else:
        key = np.frombuffer(clear, ">u2") if clear is not None and kind in (0, 2) else None
        if key is not None:
            top = 65535 if depth == 16 else 255
            shown = np.where((px == key[: px.shape[2]]).all(axis=2), 0, top)[..., None].astype(px.dtype)
        if depth < 8:
            px = px * (255 // ((1 << depth) - 1))
        if key is not None:
            px = np.concatenate([px, shown], axis=2)
    out.pixels = px
    return out


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode(pixels: np.ndarray, *, level: int = 6, text: dict[str, str] | None = None, dpi: float | None = None, srgb: bool = False, gamma: float | None = None, icc: bytes | None = None, exif: bytes | None = None) -> bytes:
    """A PNG of height x width x 1..4 samples, uint8 or uint16; lines are filtered by the difference to the left."""
    pixels = pixels[..., None] if pixels.ndim == 2 else pixels
    height, width, per_pixel = pixels.shape
    if width * height > MOST_PIXELS or pixels.dtype not in (np.uint8, np.uint16) or not 1 <= per_pixel <= 4:
        raise ValueError("not an image that PNG can hold")
    kind = {1: 0, 2: 4, 3: 2, 4: 6}[per_pixel]
    depth = pixels.dtype.itemsize * 8
    lines = np.ascontiguousarray(pixels.astype(">u2") if depth == 16 else pixels).view(np.uint8).reshape(height, -1)
    step = per_pixel * depth // 8
    shifted = np.concatenate([np.zeros((height, step), np.uint8), lines[:, :-step]], axis=1)
    body = np.concatenate([np.ones((height, 1), np.uint8), lines - shifted], axis=1)
    out = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0))]
    if icc:
        out.append(_chunk(b"iCCP", b"profile\0\0" + zlib.compress(icc)))
    elif srgb:
        out.append(_chunk(b"sRGB", b"\0"))
    if gamma:
        out.append(_chunk(b"gAMA", struct.pack(">I", round(gamma * 100000))))
    if dpi:
        per_metre = round(dpi * 100 / 2.54)
        out.append(_chunk(b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)))
    for key, value in (text or {}).items():
        plain = value.encode("latin-1", "replace").decode("latin-1") == value
        out.append(_chunk(b"tEXt", key.encode("latin-1") + b"\0" + value.encode("latin-1")) if plain else _chunk(b"iTXt", key.encode("latin-1") + b"\0\0\0\0\0" + value.encode()))
    if exif:
        out.append(_chunk(b"eXIf", exif))
    out += [_chunk(b"IDAT", zlib.compress(body.tobytes(), level)), _chunk(b"IEND", b"")]
    return b"".join(out)
