"""A baseline JPEG writer in NumPy: full chroma resolution, codes fitted to the image.

Reading is left to Spark's image source, see images.read_jpegs.
"""

from __future__ import annotations

import heapq
import struct
from dataclasses import dataclass, field

import numpy as np

from mosaiq.functions.profiles import profile_space

from . import exif

# The example quantisation tables of ITU-T T.81, annex K, row by row.
LUMA = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMA = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]

#: Places of a block along its anti-diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_STEP = np.arange(8)
#: The orthonormal discrete cosine transform of eight samples.
COSINE = np.cos((2 * _STEP[None, :] + 1) * _STEP[:, None] * np.pi / 16) * np.where(_STEP[:, None] == 0, np.sqrt(1 / 8), 0.5)
LONGEST_SIDE = 65535
EVENTS = 1 << 18


def quantisers(quality: int) -> list[np.ndarray]:
    """Both tables at a quality of 1 to 100; others are clamped."""
    quality = min(100, max(1, quality))
    percent = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * percent + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


def code_lengths(counts: np.ndarray) -> tuple[list[int], list[int]]:
    """Canonical Huffman codes: how many of each length 1 to 16, and the symbols in order of code.

    Counts are raised to a 2000th of their sum, which keeps codes within 16 bits. A symbol that
    never occurs takes the code of ones only, which the format reserves.
    """
    used = np.flatnonzero(counts)
    least = max(1, int(counts.sum()) // 2000)
    heap = [(least - 1, -1, (-1,))] + [(max(least, int(counts[s])), int(s), (int(s),)) for s in used]
    heapq.heapify(heap)
    depth = dict.fromkeys([-1, *map(int, used)], 0)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            depth[s] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    depth[-1] = max(depth.values())
    symbols = sorted((s for s in depth if s >= 0), key=lambda s: (depth[s], s))
    return [sum(depth[s] == n for s in symbols) for n in range(1, 17)], symbols


def codes(lengths: list[int], symbols: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The code and the code length of each symbol."""
    code, bits = np.zeros(256, np.int64), np.zeros(256, np.int64)
    at = value = 0
    for n, many in enumerate(lengths, 1):
        for s in symbols[at : at + many]:
            code[s], bits[s] = value, n
            value += 1
        at += many
        value <<= 1
    return code, bits


def planes(px: np.ndarray) -> list[np.ndarray]:
    """Grey, or luma and both chroma differences, centred on zero; alpha is dropped."""
    if px.shape[2] < 3:
        return [px[..., 0] - 128.0]
    r, g, b = (px[..., i].astype(np.float64) for i in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return [y - 128, (b - y) / 1.772, (r - y) / 1.402]


def coefficients(plane: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Quantised coefficients of each 8 by 8 block, in zigzag order; the last line and column fill partial blocks."""
    height, width = plane.shape
    whole = np.pad(plane, ((0, -height % 8), (0, -width % 8)), mode="edge")
    blocks = whole.reshape(whole.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
    turned = (COSINE @ blocks @ COSINE.T).reshape(-1, 64)
    return np.rint(turned / table).astype(np.int32)[:, ZIGZAG]


def events(blocks: np.ndarray, kind: np.ndarray, components: int) -> tuple[np.ndarray, ...]:
    """What the scan codes, in order: table number, symbol, extra bits and their number.

    Table 2k codes the first coefficients of kind k (0 luma, 1 chroma), 2k + 1 the others.
    """
    first = blocks[:, 0].reshape(-1, components)
    steps = np.diff(first, axis=0, prepend=0).ravel()
    row, at = np.nonzero(blocks[:, 1:])
    at += 1
    value = blocks[row, at]
    same = np.concatenate([[False], row[1:] == row[:-1]])
    run = at - np.where(same, np.concatenate([[0], at[:-1]]), 0) - 1
    last = np.zeros(len(blocks), np.int64)
    last[row] = at
    short = np.flatnonzero(last < 63)
    skip = np.repeat(np.arange(len(row)), run // 16)

    def size(v: np.ndarray) -> np.ndarray:
        return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)

    number = np.arange(len(blocks))
    where = np.concatenate([number, row[skip], row, short])
    order = np.concatenate([np.zeros(len(blocks)), at[skip] - 0.5, at, np.full(len(short), 64)])
    table = 2 * kind[where] + np.repeat([0, 1], [len(blocks), len(where) - len(blocks)])
    symbol = np.concatenate([size(steps), np.full(len(skip), 0xF0), run % 16 * 16 + size(value), np.zeros(len(short), np.int64)])
    none = np.zeros(len(skip), np.int64)
    extra = np.concatenate([steps, none, value, np.zeros(len(short), np.int64)]).astype(np.int64)
    bits = size(extra)
    extra = np.where(extra < 0, extra + (1 << bits) - 1, extra)
    turn = np.lexsort((order, where))
    return table[turn], symbol[turn], extra[turn], bits[turn]


def packed(value: np.ndarray, length: np.ndarray) -> bytes:
    """The lowest length bits of each value one after another, ones at the end, a zero after each byte of ones."""
    out, rest = [], np.zeros(0, np.uint8)
    for at in range(0, len(value), EVENTS):
        v, n = value[at : at + EVENTS], length[at : at + EVENTS]
        ends = np.cumsum(n)
        down = np.repeat(ends, n) - 1 - np.arange(ends[-1])
        bits = np.concatenate([rest, (np.repeat(v, n) >> down & 1).astype(np.uint8)])
        whole = len(bits) // 8 * 8
        out.append(np.packbits(bits[:whole]).tobytes())
        rest = bits[whole:]
    if len(rest):
        out.append(np.packbits(np.concatenate([rest, np.ones(8 - len(rest), np.uint8)])).tobytes())
    return b"".join(out).replace(b"\xff", b"\xff\x00")


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode(px: np.ndarray, quality: int = 90, dpi: float | None = None) -> bytes:
    """A file of 8-bit pixels (height, width, channels): grey for one or two channels, colour for three or four."""
    if px.dtype != np.uint8:
        raise ValueError("JPEG takes 8-bit samples")
    height, width, _ = px.shape
    if not 0 < height <= LONGEST_SIDE or not 0 < width <= LONGEST_SIDE:
        raise ValueError("JPEG takes 1 to 65535 pixels a side")
    tables = quantisers(quality)
    made = planes(px)
    components = len(made)
    kinds = np.minimum(np.arange(components), 1)
    blocks = np.stack([coefficients(p, tables[k]) for p, k in zip(made, kinds, strict=True)], axis=1).reshape(-1, 64)
    table, symbol, extra, bits = events(blocks, np.tile(kinds, len(blocks) // components), components)
    density = struct.pack(">BHH", 1, round(dpi), round(dpi)) if dpi else struct.pack(">BHH", 0, 1, 1)
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1" + density + b"\0\0")]
    for k in sorted(set(kinds.tolist())):
        out.append(_segment(0xDB, bytes([k]) + tables[k][ZIGZAG].astype(np.uint8).tobytes()))
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, height, width, components) + b"".join(bytes([i + 1, 0x11, k]) for i, k in enumerate(kinds))))
    value, length = np.zeros(len(symbol), np.int64), np.zeros(len(symbol), np.int64)
    for t in range(2 * int(kinds[-1]) + 2):
        mine = table == t
        lengths, symbols = code_lengths(np.bincount(symbol[mine], minlength=256))
        code, wide = codes(lengths, symbols)
        value[mine], length[mine] = code[symbol[mine]] << bits[mine] | extra[mine], wide[symbol[mine]] + bits[mine]
        out.append(_segment(0xC4, bytes([t % 2 << 4 | t // 2, *lengths, *symbols])))
    out.append(_segment(0xDA, bytes([components]) + b"".join(bytes([i + 1, k << 4 | k]) for i, k in enumerate(kinds)) + b"\0\x3f\0"))
    return b"".join([*out, packed(value, length), b"\xff\xd9"])


@dataclass
class Header:
    """What a file says of its image, which is not decoded."""

    width: int = 0
    height: int = 0
    channels: int = 0
    dpi: float | None = None
    icc: bytes | None = None
    text: dict[str, str] = field(default_factory=dict)

    @property
    def space(self) -> str:
        return profile_space(self.icc) or "srgb"


def header(data: bytes) -> Header:
    """The segments before the first scan: size, density, EXIF fields, the profile joined from its numbered parts."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    out, parts, at = Header(), {}, 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a segment is damaged")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        (size,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + size]
        if kind == 0xDA or len(body) != size - 2:
            break
        if kind == 0xE0 and body[:5] == b"JFIF\0" and len(body) >= 12:
            unit, across = struct.unpack_from(">BH", body, 7)
            out.dpi = {1: float(across), 2: across * 2.54}.get(unit)
        elif kind == 0xE1 and body[:6] == b"Exif\0\0":
            out.text = exif.fields(body)
        elif kind == 0xE2 and body[:12] == b"ICC_PROFILE\0" and len(body) > 14:
            parts[body[12]] = body[14:]
        elif 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            _, out.height, out.width, out.channels = struct.unpack_from(">BHHB", body)
        at += 2 + size
    if not out.channels:
        raise ValueError("the file has no image")
    out.icc = b"".join(parts[i] for i in sorted(parts)) or None
    return out
