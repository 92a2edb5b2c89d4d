"""EXIF blocks as named fields: the directory of a TIFF file without its image."""

from __future__ import annotations

import struct

# Bytes of the field types 1 to 12, as codes of struct; tag numbers of the format; what each field is called where it is shown.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d"}
EXIF_DIRECTORY, GPS_DIRECTORY = 34665, 34853
FIELDS = {
    256: ("ImageWidth", "Width"),
    257: ("ImageHeight", "Height"),
    258: ("BitsPerSample", "Bits/Sample"),
    269: ("DocumentName", "Document Name"),
    270: ("Description", "Description"),
    271: ("Make", "Make"),
    272: ("Model", "Model"),
    274: ("Orientation", "Orientation"),
    305: ("Software", "Software"),
    306: ("DateTime", "Date/Time"),
    315: ("Artist", "Artist"),
    33432: ("Copyright", "Copyright"),
    33434: ("ExposureTime", "Exposure"),
    33437: ("FNumber", "Aperture"),
    34850: ("ExposureProgram", "Exposure Program"),
    34855: ("ISOSpeedRatings", "ISO"),
    36864: ("ExifVersion", "EXIF Version"),
    36867: ("DateTimeOriginal", "Original Date"),
    36868: ("DateTimeDigitized", "Digitized Date"),
    37380: ("ExposureBias", "Exposure Bias"),
    37381: ("MaxAperture", "Max Aperture"),
    37383: ("MeteringMode", "Metering"),
    37384: ("LightSource", "Light Source"),
    37385: ("Flash", "Flash"),
    37386: ("FocalLength", "Focal Length"),
    37521: ("SubSecTimeOriginal", "Sub-second Time"),
    41987: ("WhiteBalance", "White Balance"),
    41989: ("FocalLengthIn35mm", "Focal (35mm eq.)"),
    41990: ("SceneCaptureType", "Scene Type"),
    41992: ("Contrast", "Contrast"),
    41993: ("Saturation", "Saturation"),
    41994: ("Sharpness", "Sharpness"),
    42035: ("LensMake", "Lens Make"),
    42036: ("LensModel", "Lens"),
}
# Fields of the directory of places, whose tags count from 1.
GPS_FIELDS = {
    1: ("GpsLatitudeRef", "GPS Lat Ref"),
    2: ("GpsLatitude", "GPS Latitude"),
    3: ("GpsLongitudeRef", "GPS Long Ref"),
    4: ("GpsLongitude", "GPS Longitude"),
    5: ("GpsAltitudeRef", "GPS Alt. Ref"),
    6: ("GpsAltitude", "GPS Altitude"),
    29: ("GpsDateStamp", "GPS Date"),
}
#: Ratios that are shown as decimal numbers; others stay ratios.
DECIMALS = {"FNumber", "FocalLength", "MaxAperture"}
LABELS = dict([*FIELDS.values(), *GPS_FIELDS.values()])


def order_of(data: bytes) -> str:
    """The byte order of a TIFF header."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if not order or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF header")
    return order


def directory(data: bytes, order: str, at: int) -> tuple[dict[int, tuple | bytes], int]:
    """The fields of the directory at a place, and the place of the next one. Fields of unknown types are left out."""
    try:
        (count,) = struct.unpack_from(f"{order}H", data, at)
        out: dict[int, tuple | bytes] = {}
        for place in range(at + 2, at + 2 + 12 * count, 12):
            tag, kind, n = struct.unpack_from(f"{order}HHI", data, place)
            code = TYPES.get(kind)
            if code is None:
                continue
            size = struct.calcsize(f"={code}") * n
            start = place + 8 if size <= 4 else struct.unpack_from(f"{order}I", data, place + 8)[0]
            if start + size > len(data):
                raise ValueError("a field lies beyond the end")
            out[tag] = bytes(data[start : start + n]) if code == "s" else struct.unpack_from(f"{order}{n * len(code)}{code[0]}", data, start)
        (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * count) if at + 6 + 12 * count <= len(data) else (0,)
    except struct.error as e:
        raise ValueError("a directory lies beyond the end") from e
    return out, following


def _text(value: tuple | bytes) -> str | None:
    return value.split(b"\0")[0].decode("utf-8", "replace") or None if isinstance(value, bytes) else None


def shown(name: str, value: tuple | bytes) -> str | None:
    """A field's value as text; None for what cannot be told, a ratio over zero too where a number is wanted."""
    if isinstance(value, bytes):
        return _text(value)
    if name in ("GpsLatitude", "GpsLongitude"):
        parts = [a / b if b else float("nan") for a, b in zip(value[::2], value[1::2], strict=True)]
        return f"[{', '.join(map(str, parts))}]"
    if name == "GpsAltitude":
        return f"{value[0] / value[1]:.1f}m" if len(value) > 1 and value[1] else None
    if name in DECIMALS:
        return f"{value[0] / value[1]:.6f}" if len(value) > 1 and value[1] else None
    if name in ("ExposureTime", "ExposureBias"):
        return f"{value[0]}/{value[1]}" if len(value) > 1 else None
    if name == "BitsPerSample":
        return f"[{', '.join(map(str, value))}]"
    return str(value[0]) if value else None


def fields_of(data: bytes, order: str, tags: dict[int, tuple | bytes]) -> dict[str, str]:
    """The known fields of a directory and of the two that it points to, as text."""
    out: dict[str, str] = {}
    groups = [(tags, FIELDS)]
    for pointer, names in ((EXIF_DIRECTORY, FIELDS), (GPS_DIRECTORY, GPS_FIELDS)):
        place = tags.get(pointer)
        if isinstance(place, tuple) and place:
            try:
                groups.append((directory(data, order, place[0])[0], names))
            except ValueError:
                continue
    for found, names in groups:
        for tag, (name, _) in names.items():
            if tag in found and (text := shown(name, found[tag])) is not None:
                out.setdefault(name, text)
    return out


def fields(block: bytes) -> dict[str, str]:
    """The fields of an EXIF block, with or without its "Exif" mark; none of a damaged one."""
    body = block[6:] if block[:6] == b"Exif\0\0" else block
    try:
        order = order_of(body)
        return fields_of(body, order, directory(body, order, struct.unpack_from(f"{order}I", body, 4)[0])[0])
    except ValueError:
        return {}
