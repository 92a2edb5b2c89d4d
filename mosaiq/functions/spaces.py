"""Colour spaces as numbers: chromaticities, matrices between spaces, chromatic adaptation.

Matrices are computed once on the driver; plans only see their nine numbers.
"""

from __future__ import annotations

import numpy as np

# Published chromaticities of primaries (red, green, blue) and white points.
PRIMARIES = {
    "Bt709": ((0.64, 0.33), (0.30, 0.60), (0.15, 0.06)),
    "Bt2020": ((0.708, 0.292), (0.170, 0.797), (0.131, 0.046)),
    "Ap0": ((0.7347, 0.2653), (0.0, 1.0), (0.0001, -0.0770)),
    "Ap1": ((0.713, 0.293), (0.165, 0.830), (0.128, 0.044)),
    "P3": ((0.680, 0.320), (0.265, 0.690), (0.150, 0.060)),
    "Adobe1998": ((0.64, 0.33), (0.21, 0.71), (0.15, 0.06)),
    "AdobeWide": ((0.735, 0.265), (0.115, 0.826), (0.157, 0.018)),
    "Apple": ((0.625, 0.34), (0.28, 0.595), (0.155, 0.07)),
    "ProPhoto": ((0.734699, 0.265301), (0.159597, 0.840403), (0.036598, 0.000105)),
    "CieRgb": ((0.7350, 0.2650), (0.2740, 0.7170), (0.1670, 0.0090)),
    "CieXyz": ((1.0, 0.0), (0.0, 1.0), (0.0, 0.0)),
}
# Published white points.
WHITES = {
    "A": (0.44757, 0.40745),
    "B": (0.34842, 0.35161),
    "C": (0.31006, 0.31616),
    "E": (1 / 3, 1 / 3),
    "D50": (0.3457, 0.3585),
    "D55": (0.3324, 0.3474),
    "D60": (0.32168, 0.33767),
    "D65": (0.3127, 0.3290),
    "D75": (0.2990, 0.3149),
    "P3Dci": (0.314, 0.351),
    "F2": (0.37208, 0.37529),
    "F7": (0.31285, 0.32918),
    "F11": (0.38052, 0.37713),
}
# Name -> primaries, white point, transfer curve.
SPACES = {
    "srgb": ("Bt709", "D65", "srgb"),
    "linear_srgb": ("Bt709", "D65", "linear"),
    "rec709": ("Bt709", "D65", "rec709"),
    "rec2020": ("Bt2020", "D65", "rec709"),
    "linear_rec2020": ("Bt2020", "D65", "linear"),
    "adobe_rgb": ("Adobe1998", "D65", "gamma22"),
    "display_p3": ("P3", "D65", "srgb"),
    "linear_display_p3": ("P3", "D65", "linear"),
    "dci_p3": ("P3", "P3Dci", "gamma26"),
    "prophoto": ("ProPhoto", "D50", "prophoto"),
    "aces2065_1": ("Ap0", "D60", "linear"),
    "acescg": ("Ap1", "D60", "linear"),
}
# Spaces that files are matched to, in this order: primaries, white, then wx wy rx ry gx gy bx by.
KNOWN_CHROMATICITIES = [
    ("Bt709", "D65", (0.3127, 0.3290, 0.640, 0.330, 0.300, 0.600, 0.150, 0.060)),
    ("Adobe1998", "D65", (0.3127, 0.3290, 0.640, 0.330, 0.210, 0.710, 0.150, 0.060)),
    ("P3", "D65", (0.3127, 0.3290, 0.680, 0.320, 0.265, 0.690, 0.150, 0.060)),
    ("Bt2020", "D65", (0.3127, 0.3290, 0.708, 0.292, 0.170, 0.797, 0.131, 0.046)),
    ("Ap0", "D60", (0.32168, 0.33767, 0.7347, 0.2653, 0.0, 1.0, 0.0001, -0.077)),
    ("Ap1", "D60", (0.32168, 0.33767, 0.713, 0.293, 0.165, 0.830, 0.128, 0.044)),
    ("ProPhoto", "D50", (0.3457, 0.3585, 0.7347, 0.2653, 0.1596, 0.8404, 0.0366, 0.0001)),
]
# The Bradford matrix.
BRADFORD = np.array([[0.8951, 0.2664, -0.1614], [-0.7502, 1.7135, 0.0367], [0.0389, -0.0685, 1.0296]])


def parts_of(space: str) -> tuple[str, str, str]:
    """Primaries, white point and curve of a space by name, or of "primaries/white/curve"."""
    if space in SPACES:
        return SPACES[space]
    parts = tuple(space.split("/"))
    if len(parts) != 3 or parts[0] not in PRIMARIES or parts[1] not in WHITES:
        raise ValueError(f"unknown colour space {space}")
    return parts


def xyz_of(xy: tuple[float, float]) -> np.ndarray:
    """The colour of luminance 1 at a chromaticity."""
    x, y = xy
    return np.array([x / y, 1.0, (1 - x - y) / y]) if y else np.zeros(3)


def rgb_to_xyz(primaries: str, white: str) -> np.ndarray:
    """The matrix whose columns are the primaries, scaled to add up to the white point."""
    columns = np.array([[x, y, 1 - x - y] for x, y in PRIMARIES[primaries]]).T
    if abs(np.linalg.det(columns)) <= 1e-12:
        raise ValueError(f"primaries {primaries} lie on a line")
    return columns * np.linalg.solve(columns, xyz_of(WHITES[white]))


def adaptation(source: str, target: str) -> np.ndarray:
    """Bradford chromatic adaptation between white points."""
    if source == target:
        return np.eye(3)
    gain = (BRADFORD @ xyz_of(WHITES[target])) / (BRADFORD @ xyz_of(WHITES[source]))
    return np.linalg.solve(BRADFORD, gain[:, None] * BRADFORD)


def rgb_to_rgb(source: str, target: str) -> np.ndarray:
    """The matrix from linear source to linear target values."""
    (p1, w1, _), (p2, w2, _) = parts_of(source), parts_of(target)
    if (p1, w1) == (p2, w2):
        return np.eye(3)
    return np.linalg.inv(rgb_to_xyz(p2, w2)) @ adaptation(w1, w2) @ rgb_to_xyz(p1, w1)


def lab_to_srgb_matrix() -> np.ndarray:
    """From XYZ relative to D50 to linear sRGB."""
    return np.linalg.inv(rgb_to_xyz("Bt709", "D65")) @ adaptation("D50", "D65")
