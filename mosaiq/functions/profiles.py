"""The colour space that a file states: code points, profiles, chromaticities, gamma.

A space is a name of SPACES, or "primaries/white/curve" where that combination has no name.
"""

from __future__ import annotations

import re
import struct

from .spaces import KNOWN_CHROMATICITIES, SPACES

# Code points of ITU-T H.273 for primaries with their white, and for curves.
CICP_PRIMARIES = {1: ("Bt709", "D65"), 9: ("Bt2020", "D65"), 11: ("P3", "P3Dci"), 12: ("P3", "D65")}
CICP_CURVES = {
    1: "rec709", 2: "gamma22", 3: "gamma22", 4: "gamma22", 5: "gamma26", 6: "rec709", 7: "srgb", 8: "linear", 11: "srgb",
    13: "srgb", 14: "rec709", 15: "rec709", 16: "pq", 17: "hlg", 18: "hlg",
}
# Parts of profile names, tested in this order.
PROFILE_NAMES = [
    ("srgb iec61966 2 1", "srgb"),
    ("srgb", "srgb"),
    ("adobe rgb 1998", "adobe_rgb"),
    ("display p3", "display_p3"),
    ("dci p3 d65", "dci_p3"),
    ("prophoto rgb", "prophoto"),
    ("rec2020", "rec2020"),
]
#: Chromaticities of a file may be off by this.
TOLERANCE = 0.002


def space_name(primaries: str, white: str, curve: str) -> str:
    return next((name for name, parts in SPACES.items() if parts == (primaries, white, curve)), f"{primaries}/{white}/{curve}")


def profile_text(profile: bytes) -> str:
    """The description of an ICC profile: its "desc" tag as ASCII text, or the first of its translations."""
    if len(profile) < 132:
        return ""
    (count,) = struct.unpack_from(">I", profile, 128)
    for i in range(min(count, (len(profile) - 132) // 12)):
        tag, at, size = struct.unpack_from(">4sII", profile, 132 + 12 * i)
        body = profile[at : at + size]
        if tag != b"desc" or len(body) != size:
            continue
        if body[:4] == b"desc" and size >= 12:
            (n,) = struct.unpack_from(">I", body, 8)
            return body[12 : 12 + n].split(b"\0")[0].decode("latin-1")
        if body[:4] == b"mluc" and size >= 28:
            n, start = struct.unpack_from(">II", body, 20)
            return body[start : start + n].decode("utf-16-be", "replace")
        return body[4:].split(b"\0")[0].decode("latin-1")
    return ""


def profile_space(profile: bytes | None) -> str | None:
    """The space of an ICC profile of an RGB display with a known name, else None."""
    if not profile or len(profile) < 128 or profile[12:20] != b"mntrRGB ":
        return None
    name = re.sub(r"[\W_]+", " ", profile_text(profile).lower()).strip()
    return next((space for part, space in PROFILE_NAMES if part in name), None)


def gamma_curve(gamma: float | None) -> str | None:
    """The known curve nearest to a file's gamma value; the rule of color.curve_of_gamma."""
    if gamma is None:
        return None
    # Exponents, and how far off each may be, tested in this order.
    steps = ((1 / 2.2, 0.01, "gamma22"), (1 / 2.4, 0.01, "gamma24"), (1 / 2.2, 0.05, "gamma22"), (1.0, 0.01, "linear"))
    return next((curve for at, off, curve in steps if abs(gamma - at) < off), None)


def png_space(cicp: tuple[int, ...] | None, icc: bytes | None, srgb: bool, chroma: tuple[float, ...] | None, gamma: float | None) -> str:
    """Code points, then the profile (sRGB if unknown), the sRGB mark, chromaticities with gamma, gamma alone, sRGB."""
    if cicp and cicp[0] in CICP_PRIMARIES and cicp[1] in CICP_CURVES:
        return space_name(*CICP_PRIMARIES[cicp[0]], CICP_CURVES[cicp[1]])
    if icc:
        return profile_space(icc) or "srgb"
    if srgb:
        return "srgb"
    curve = gamma_curve(gamma)
    for primaries, white, values in KNOWN_CHROMATICITIES if chroma else ():
        if all(abs(a - b) < TOLERANCE for a, b in zip(chroma, values, strict=True)):
            return space_name(primaries, white, curve or "srgb")
    return space_name("Bt709", "D65", curve) if curve else "srgb"


def tiff_space(icc: bytes | None, photometric: int) -> str:
    """The profile's space, else linear sRGB for Lab (whose conversion ends there) and sRGB for all others."""
    return profile_space(icc) or ("linear_srgb" if photometric == 8 else "srgb")
