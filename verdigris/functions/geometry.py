"""Geometries as nested coordinates: reading WKB of all dialects, WKT and GeoJSON, writing WKT, WKB and GeoJSON, validity."""

from __future__ import annotations

import json
import math
import re
import struct
from dataclasses import dataclass, field

# Type codes of WKB.
POINT, LINE, POLYGON, MULTIPOINT, MULTILINE, MULTIPOLYGON, COLLECTION = range(1, 8)
NAMES = {
    POINT: "Point",
    LINE: "LineString",
    POLYGON: "Polygon",
    MULTIPOINT: "MultiPoint",
    MULTILINE: "MultiLineString",
    MULTIPOLYGON: "MultiPolygon",
    COLLECTION: "GeometryCollection",
}
CODES = {v: k for k, v in NAMES.items()}
# Flags of EWKB.
_HAS_Z, _HAS_M, _HAS_SRID = 0x80000000, 0x40000000, 0x20000000


@dataclass(frozen=True)
class Geometry:
    """type as in GeoJSON; coordinates nested lists of (x, y), always two-dimensional; geometries the members of a collection."""

    type: str
    coordinates: list | tuple = ()
    geometries: tuple = field(default_factory=tuple)
    srid: int | None = None

    def points(self) -> list[tuple[float, float]]:
        """All positions, in order."""
        if self.type == "GeometryCollection":
            return [p for g in self.geometries for p in g.points()]
        return list(_flat(self.coordinates))

    def envelope(self) -> tuple[float, float, float, float] | None:
        points = self.points()
        if not points:
            return None
        xs, ys = zip(*points)
        return min(xs), min(ys), max(xs), max(ys)


def _flat(nested):
    if nested and isinstance(nested[0], (int, float)):
        yield (nested[0], nested[1])
        return
    for part in nested:
        yield from _flat(part)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def header(self) -> tuple[str, int, int, int | None]:
        order = "<" if self.data[self.at] == 1 else ">"
        (code,) = struct.unpack_from(order + "I", self.data, self.at + 1)
        self.at += 5
        extra = bool(code & _HAS_Z) + bool(code & _HAS_M)
        srid = None
        if code & _HAS_SRID:
            (srid,) = struct.unpack_from(order + "i", self.data, self.at)
            self.at += 4
        base = code & 0x0FFFFFFF
        if base >= 1000:
            extra = {1: 1, 2: 1, 3: 2}.get(base // 1000, 0)
            base %= 1000
        return order, base, 2 + extra, srid

    def count(self, order: str) -> int:
        (n,) = struct.unpack_from(order + "I", self.data, self.at)
        self.at += 4
        return n

    def positions(self, order: str, dims: int, n: int) -> list[tuple[float, float]]:
        if n * dims * 8 > len(self.data) - self.at:
            raise struct.error("too short")
        values = struct.unpack_from(f"{order}{n * dims}d", self.data, self.at)
        self.at += 8 * n * dims
        return [(values[i], values[i + 1]) for i in range(0, n * dims, dims)]

    def geometry(self, depth: int = 0) -> Geometry | None:
        if depth > 32:
            raise struct.error("nested too deeply")
        order, kind, dims, srid = self.header()
        if kind == POINT:
            (point,) = self.positions(order, dims, 1)
            return Geometry("Point", () if any(math.isnan(v) for v in point) else point, srid=srid)
        if kind == LINE:
            return Geometry("LineString", self.positions(order, dims, self.count(order)), srid=srid)
        if kind == POLYGON:
            return Geometry("Polygon", [self.positions(order, dims, self.count(order)) for _ in range(self.count(order))], srid=srid)
        if kind in (MULTIPOINT, MULTILINE, MULTIPOLYGON):
            members = [self.geometry(depth + 1) for _ in range(self.count(order))]
            if any(m is None for m in members):
                return None
            return Geometry(NAMES[kind], [m.coordinates for m in members], srid=srid)
        if kind == COLLECTION:
            members = [self.geometry(depth + 1) for _ in range(self.count(order))]
            return None if any(m is None for m in members) else Geometry("GeometryCollection", geometries=tuple(members), srid=srid)
        return None


def read_wkb(data: bytes | None, srid: int | None = None) -> Geometry | None:
    """A geometry of WKB, EWKB or ISO WKB; None for null, shorter than a header, cut off or of an unknown type. `srid` goes before an embedded one."""
    if data is None or len(data) < 5:
        return None
    try:
        found = _Reader(bytes(data)).geometry()
    except struct.error:
        return None
    except IndexError:
        return None
    if found is None or srid is None:
        return found
    return Geometry(found.type, found.coordinates, found.geometries, srid)


def write_wkb(g: Geometry) -> bytes:
    """Little-endian WKB, two-dimensional, without srid."""

    def numbers(points) -> bytes:
        return b"".join(struct.pack("<dd", *p[:2]) for p in points)

    def body(kind: int, coordinates) -> bytes:
        head = struct.pack("<BI", 1, kind)
        if kind == POINT:
            return head + (numbers([coordinates]) if coordinates else struct.pack("<dd", math.nan, math.nan))
        if kind == LINE:
            return head + struct.pack("<I", len(coordinates)) + numbers(coordinates)
        if kind == POLYGON:
            return head + struct.pack("<I", len(coordinates)) + b"".join(struct.pack("<I", len(r)) + numbers(r) for r in coordinates)
        return head + struct.pack("<I", len(coordinates)) + b"".join(body(kind - 3, c) for c in coordinates)

    kind = CODES[g.type]
    if kind == COLLECTION:
        return struct.pack("<BII", 1, kind, len(g.geometries)) + b"".join(write_wkb(m) for m in g.geometries)
    return body(kind, g.coordinates)


def _number(v: float) -> str:
    return str(int(v)) if float(v).is_integer() and abs(v) < 1e16 else repr(float(v))


def write_wkt(g: Geometry) -> str:
    """WKT; a geometry without coordinates is EMPTY. An unknown type raises."""
    if g.type not in CODES:
        raise ValueError(f"unknown geometry type {g.type}")
    name = g.type.upper()
    if g.type == "GeometryCollection":
        return f"{name} EMPTY" if not g.geometries else f"{name}({', '.join(write_wkt(m) for m in g.geometries)})"
    if not g.coordinates:
        return f"{name} EMPTY"
    return f"{name}({_nested(g.coordinates)})"


def _nested(part) -> str:
    if isinstance(part[0], (int, float)):
        return " ".join(_number(v) for v in part)
    if isinstance(part[0][0], (int, float)):
        return ", ".join(_nested(p) for p in part)
    return ", ".join(f"({_nested(p)})" for p in part)


_TOKEN = re.compile(r"\s*([A-Za-z]+|[(),]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?)")


def read_wkt(text: str | None) -> Geometry | None:
    """A geometry of WKT or EWKT, third and fourth coordinates ignored; None for null and malformed text."""
    if text is None:
        return None
    srid = None
    if m := re.match(r"\s*SRID\s*=\s*(\d+)\s*;", text, re.IGNORECASE):
        srid, text = int(m[1]), text[m.end() :]
    tokens, at = [], 0
    while at < len(text.rstrip()):
        if not (m := _TOKEN.match(text, at)):
            return None
        tokens.append(m[1])
        at = m.end()
    try:
        found, rest = _parse(tokens, 0)
    except (IndexError, ValueError, KeyError, RecursionError):
        return None
    if rest != len(tokens):
        return None
    return Geometry(found.type, found.coordinates, found.geometries, srid)


def _parse(tokens: list[str], at: int) -> tuple[Geometry, int]:
    names = {n.upper(): n for n in CODES}
    kind = names[tokens[at].upper()]
    at += 1
    if tokens[at].upper() in ("Z", "M", "ZM"):
        at += 1
    if tokens[at].upper() == "EMPTY":
        return Geometry(kind), at + 1
    if kind == "GeometryCollection":
        members = []
        while tokens[at] in "(,":
            member, at = _parse(tokens, at + 1)
            members.append(member)
        if tokens[at] != ")":
            raise ValueError
        return Geometry(kind, geometries=tuple(members)), at + 1
    depth = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}[kind]
    value, at = _level(tokens, at, max(1, depth), kind == "MultiPoint")
    return Geometry(kind, value[0] if depth == 0 else value), at


def _level(tokens: list[str], at: int, depth: int, wrapped: bool) -> tuple[list, int]:
    if tokens[at] != "(":
        raise ValueError
    out = []
    while tokens[at] in "(,":
        if depth == 1:
            at += 1
            inner = wrapped and tokens[at] == "("
            at += inner
            position = []
            while tokens[at] not in "(),":
                position.append(float(tokens[at]))
                at += 1
            if not 2 <= len(position) <= 4:
                raise ValueError
            if inner:
                if tokens[at] != ")":
                    raise ValueError
                at += 1
            out.append((position[0], position[1]))
        else:
            part, at = _level(tokens, at + 1, depth - 1, wrapped)
            out.append(part)
    if tokens[at] != ")":
        raise ValueError
    return out, at + 1


def _two(nested):
    if nested and isinstance(nested[0], (int, float)):
        return tuple(float(v) for v in nested[:2])
    return [_two(p) for p in nested]


def to_geojson(g: Geometry) -> dict:
    if g.type == "GeometryCollection":
        return {"type": g.type, "geometries": [to_geojson(m) for m in g.geometries]}
    return {"type": g.type, "coordinates": json.loads(json.dumps(g.coordinates))}


def read_geojson(value: str | dict | None) -> Geometry | None:
    """A geometry of GeoJSON, text or object; None for anything else."""
    try:
        value = json.loads(value) if isinstance(value, str) else value
        kind = value["type"]
        if kind not in CODES:
            return None
        if kind == "GeometryCollection":
            members = tuple(read_geojson(m) for m in value["geometries"])
            return None if any(m is None for m in members) else Geometry(kind, geometries=members)
        return Geometry(kind, _two(value["coordinates"]))
    except (ValueError, TypeError, KeyError, IndexError, RecursionError):
        return None


def read_query_geometry(value, srid: int = 0) -> Geometry | None:
    """A query's geometry: GeoJSON, or an object with wkt, wkb (bytes or hex) or envelope (xmin, ymin, xmax, ymax); srid default 0."""
    if isinstance(value, Geometry):
        return value
    if isinstance(value, dict) and "wkt" in value:
        found = read_wkt(value["wkt"])
    elif isinstance(value, dict) and "wkb" in value:
        data = value["wkb"]
        found = read_wkb(bytes.fromhex(data) if isinstance(data, str) else data)
    elif isinstance(value, dict) and "envelope" in value:
        box = value["envelope"]
        x1, y1, x2, y2 = (float(box[k]) for k in ("xmin", "ymin", "xmax", "ymax")) if isinstance(box, dict) else map(float, box)
        found = Geometry("Polygon", [[(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]])
    else:
        found = read_geojson(value)
    if found is None:
        return None
    return Geometry(found.type, found.coordinates, found.geometries, found.srid or srid)


def is_valid(g: Geometry | None) -> bool:
    """A point has two finite numbers, a line two points, a ring four, a polygon a ring, a collection only valid members; rings need not be closed."""
    if g is None or g.type not in CODES:
        return False
    c = g.coordinates

    def point(p) -> bool:
        return len(p) >= 2 and all(isinstance(v, (int, float)) and math.isfinite(v) for v in p[:2])

    def line(p, least: int = 2) -> bool:
        return len(p) >= least and all(point(x) for x in p)

    def polygon(p) -> bool:
        return len(p) >= 1 and all(line(r, 4) for r in p)

    checks = {
        "Point": lambda: point(c),
        "LineString": lambda: line(c),
        "Polygon": lambda: polygon(c),
        "MultiPoint": lambda: all(point(p) for p in c),
        "MultiLineString": lambda: all(line(p) for p in c),
        "MultiPolygon": lambda: all(polygon(p) for p in c),
        "GeometryCollection": lambda: all(is_valid(m) for m in g.geometries),
    }
    return checks[g.type]()


_WKT_SHAPE = re.compile(r"(?:MULTI)?(?:POINT|LINESTRING|POLYGON)|GEOMETRYCOLLECTION", re.IGNORECASE)


def checked_wkt(text: str) -> str:
    """The WKT, if it is nothing but WKT; else an error. For texts that go into statements."""
    if not isinstance(text, str) or not _WKT_SHAPE.match(text.strip()) or read_wkt(text) is None or ";" in text:
        raise ValueError("not a WKT geometry")
    return text.strip()
