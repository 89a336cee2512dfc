"""Reading a point from text in any of the written forms: WKT, EWKT, GeoJSON, hex WKB or EWKB."""

from __future__ import annotations

import json
import math
import re
import struct

_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_WKT_POINT = re.compile(
    rf"^\s*(?:SRID\s*=\s*\d+\s*;)?\s*POINT\s*(?:Z|M|ZM)?\s*\(\s*({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER}){{0,2}}\s*\)\s*$",
    re.IGNORECASE,
)
_HEX = re.compile(r"^\s*(?:0x|\\x)?([0-9a-fA-F]+)\s*$")
_EWKB_Z, _EWKB_M, _EWKB_SRID = 0x80000000, 0x40000000, 0x20000000


def _finite(x, y):
    """The pair if both are finite and not the unlocated 0 0."""
    if isinstance(x, bool) or isinstance(y, bool) or not isinstance(x, (int, float)) or not isinstance(y, (int, float)):
        return None
    try:
        x, y = float(x), float(y)
    except OverflowError:
        return None
    if not (math.isfinite(x) and math.isfinite(y)) or (x == 0 and y == 0):
        return None
    return x + 0.0, y + 0.0


def _from_wkb(data: bytes):
    if len(data) < 21 or data[0] > 1:
        return None
    order = "<" if data[0] == 1 else ">"
    (code,) = struct.unpack_from(order + "I", data, 1)
    at = 5
    if code & _EWKB_SRID:
        at += 4
    base = code & 0x0FFFFFFF
    if base % 1000 != 1 or base // 1000 > 3 or len(data) < at + 16:
        return None
    return _finite(*struct.unpack_from(order + "dd", data, at))


def _from_object(value):
    if not isinstance(value, dict):
        return None
    if isinstance(value.get("wkt"), str) or isinstance(value.get("wkb"), str):
        return read_point(value.get("wkt") or value.get("wkb"))
    kind, coordinates = value.get("type"), value.get("coordinates")
    if not isinstance(kind, str) or kind.lower() != "point" or not isinstance(coordinates, list) or len(coordinates) < 2:
        return None
    return _finite(coordinates[0], coordinates[1])


def read_point(text):
    """(x, y) of a point, or None for null, empty, broken, non-point, non-finite and 0 0."""
    if text is None:
        return None
    if m := _WKT_POINT.match(text):
        return _finite(float(m[1]), float(m[2]))
    stripped = text.strip()
    if stripped.startswith("{"):
        try:
            return _from_object(json.loads(stripped))
        except (ValueError, RecursionError):
            return None
    if (m := _HEX.match(stripped)) and len(m[1]) % 2 == 0:
        return _from_wkb(bytes.fromhex(m[1]))
    return None


def read_attribute_point(attributes, field):
    """The point under `field` (letter case ignored) of a JSON object of attributes; of several such keys the first that is not null."""
    if not attributes or not field:
        return None
    try:
        parsed = json.loads(attributes)
    except (ValueError, RecursionError):
        return None
    if not isinstance(parsed, dict):
        return None
    wanted = field.lower()
    for key, value in parsed.items():
        if key.lower() == wanted and value is not None:
            return read_point(value) if isinstance(value, str) else _from_object(value)
    return None
