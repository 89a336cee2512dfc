"""The legacy compressed shape binary: variable-length differences behind an eight-byte header, curved shapes as a plain buffer at the end."""

from __future__ import annotations

import struct
from dataclasses import dataclass, replace

import numpy as np

from verdigris.functions.curves import ARC, BEZIER, ELLIPSE, Curve, Densify, densify_rings
from verdigris.functions.geometry import Geometry

# Fixed values of the format.
_HEADER = 8
_CURVED_BYTE, _CURVED_BIT = 5, 0x08
_MULTIPART = 0x100
_HAS_CURVES, _HAS_Z, _HAS_M = 0x20000000, 0x80000000, 0x40000000
_BASIC_TYPES = range(50, 55)
_PLAIN_CURVED_TYPES = (50, 51)
_SEGMENT_BYTES = {ARC: 20, BEZIER: 32, ELLIPSE: 44}
_IS_LINE, _IS_POINT = 0x20, 0x40
_POINT_ENTITY, _LINE_ENTITIES = 1, (2, 6, 7)
#: Of the plain buffer: its envelope and counts end here, and no shape has more parts, fewer or more points.
_PLAIN_HEADER, _MOST_PARTS, _LEAST_POINTS, _MOST_POINTS, _KIND_BYTES = 44, 1000, 3, 1_000_000, 0x00FFFF00
#: How far a ring's start may lie outside of the envelope.
_SLACK = 0.01


@dataclass(frozen=True)
class Grid:
    """Real coordinate = stored / units + false origin."""

    false_x: float
    false_y: float
    units: float
    srid: int | None = None


@dataclass(frozen=True)
class Shape:
    """rings of points, curved segments, or why it could not be read."""

    rings: list
    curves: tuple[Curve, ...] = ()
    has_curves: bool = False
    error: str | None = None


def read_varints(data: bytes, start: int = _HEADER, most: int | None = None) -> np.ndarray:
    """Little-endian base-128 numbers, all at once; a number cut off at the end counts with what is there."""
    raw = np.frombuffer(data, dtype=np.uint8, offset=min(start, len(data))).astype(np.int64)
    if not len(raw):
        return np.empty(0, dtype=np.int64)
    last = raw < 0x80
    last[-1] = True
    number = np.concatenate([[0], np.cumsum(last)[:-1]])
    first = np.concatenate([[0], np.flatnonzero(last)[:-1] + 1])
    shift = 7 * (np.arange(len(raw)) - first[number])
    values = np.zeros(number[-1] + 1, dtype=np.int64)
    usable = shift < 63
    np.bitwise_or.at(values, number[usable], (raw[usable] & 0x7F) << shift[usable])
    return values[:most]


def absolute(raw: np.ndarray) -> np.ndarray:
    """Stored values lack bit 6 of the number; it is taken out."""
    return ((raw >> 6) << 5) | (raw & 63)


def difference(raw: np.ndarray) -> np.ndarray:
    """Signed differences: bit 6 set is positive, and then an unset bit 5 means 32 less."""
    size, positive, low = absolute(raw), (raw >> 6) & 1 == 1, (raw >> 5) & 1 == 0
    return np.where(positive, size - np.where(low, 32, 0), -size)


def decode_rings(data: bytes, n_points: int, multipart: bool, envelope, grid: Grid) -> list[list[tuple[float, float]]]:
    """Rings of the coordinate stream. The first pair is absolute; in multipart shapes also each pair that, read so, lies in the envelope."""
    raw = read_varints(data, most=2 * n_points)
    raw = raw[: len(raw) // 2 * 2].reshape(-1, 2)
    if not len(raw):
        return []
    origin = np.array([grid.false_x, grid.false_y])
    placed = absolute(raw)
    starts = np.zeros(len(raw), dtype=bool)
    if multipart:
        real = placed / grid.units + origin
        low, high = np.array(envelope[:2]) - _SLACK, np.array(envelope[2:]) + _SLACK
        starts = ((real >= low) & (real <= high)).all(axis=1)
    starts[0] = True
    # Sums of differences run on over the rings; each ring is moved to its own start.
    steps = np.where(starts[:, None], 0, difference(raw))
    run = np.cumsum(steps, axis=0)
    first = np.flatnonzero(starts)
    ring = np.cumsum(starts) - 1
    points = (run - run[first][ring] + placed[first][ring]) / grid.units + origin
    return [[tuple(p) for p in part.tolist()] for part in np.split(points, first[1:])]


def find_plain_shape(data: bytes, envelope) -> int:
    """Offset of the plain buffer whose envelope is the row's within one unit, or -1."""
    for at in range(len(data) - _PLAIN_HEADER + 1):
        (kind,) = struct.unpack_from("<I", data, at)
        if kind & 0xFF not in _BASIC_TYPES or kind & _KIND_BYTES:
            continue
        box, (parts, points) = struct.unpack_from("<4d", data, at + 4), struct.unpack_from("<2i", data, at + 36)
        if not (np.isfinite(box).all() and box[0] <= box[2] and box[1] <= box[3] and all(abs(a - b) <= 1 for a, b in zip(box, envelope))):
            continue
        if 1 <= parts <= _MOST_PARTS and _LEAST_POINTS <= points <= _MOST_POINTS and at + _PLAIN_HEADER + 4 * parts + 16 * points <= len(data):
            return at
    return -1


def read_plain_shape(data: bytes, at: int) -> Shape:
    """Rings of source points and their curved segments. An unknown kind of segment ends the list of curves."""
    (kind,) = struct.unpack_from("<I", data, at)
    parts, points = struct.unpack_from("<2i", data, at + 36)
    at += _PLAIN_HEADER
    firsts = list(struct.unpack_from(f"<{parts}i", data, at))
    at += 4 * parts
    xy = np.frombuffer(data, dtype="<f8", count=2 * points, offset=at).reshape(-1, 2)
    at += 16 * points
    at += (bool(kind & _HAS_Z) + bool(kind & _HAS_M)) * (16 + 8 * points)
    rings = [[tuple(p) for p in xy[a:b].tolist()] for a, b in zip(firsts, [*firsts[1:], points])]
    curved = bool(kind & _HAS_CURVES) or (kind & 0xFF in _PLAIN_CURVED_TYPES and not kind & 0xFF000000)
    curves: list[Curve] = []
    if curved and at + 4 <= len(data):
        (n,) = struct.unpack_from("<i", data, at)
        at += 4
        for _ in range(n):
            if at + 8 > len(data):
                break
            start, segment = struct.unpack_from("<2i", data, at)
            size = _SEGMENT_BYTES.get(segment)
            if size is None or at + 8 + size > len(data):
                break
            curves.append(_curve(data, at + 8, start, segment))
            at += 8 + size
    return Shape(rings, tuple(curves), True)


def _curve(data: bytes, at: int, start: int, segment: int) -> Curve:
    if segment == ARC:
        x, y, bits = struct.unpack_from("<2di", data, at)
        return Curve(start, ARC, through=None if bits & _IS_POINT else (x, y), straight=bool(bits & _IS_LINE))
    if segment == BEZIER:
        x1, y1, x2, y2 = struct.unpack_from("<4d", data, at)
        return Curve(start, BEZIER, controls=((x1, y1), (x2, y2)))
    return Curve(start, segment)


def read_shape(data: bytes | None, n_points: int, grid: Grid, envelope=None, entity: int = 0) -> Shape:
    """Rings of a compressed shape. Multipart shapes drop rings of fewer than three points; curved ones need the envelope and give source points."""
    if data is None or len(data) < _HEADER or n_points < 1:
        return Shape([], error="too short or without points")
    if len(data) > _CURVED_BYTE and data[_CURVED_BYTE] & _CURVED_BIT:
        if envelope is None:
            return Shape([], has_curves=True, error="a curved shape needs its envelope")
        at = find_plain_shape(data, envelope)
        return read_plain_shape(data, at) if at >= 0 else Shape([], has_curves=True, error="no plain shape found")
    multipart = bool(entity & _MULTIPART)
    rings = decode_rings(data, n_points, multipart, envelope or (-np.inf, -np.inf, np.inf, np.inf), grid)
    if multipart:
        rings = [r for r in rings if len(r) >= 3]
    return Shape(rings, error=None if rings else "no rings")


def read_shape_geometry(data: bytes | None, n_points: int, entity: int, grid: Grid, envelope=None, densify: Densify | None = None) -> Geometry | None:
    """A compressed shape as a geometry: entity 1 a point, 2, 6 and 7 lines, others polygons, each ring of a multipart shape an own polygon.

    With `densify` the curved segments become points, else only their source points are taken.
    """
    shape = read_shape(data, n_points, grid, envelope, entity)
    if shape.error or not shape.rings:
        return None
    if densify is not None and shape.curves:
        shape = replace(shape, rings=densify_rings(shape.rings, list(shape.curves), densify))
    many = len(shape.rings) > 1 or bool(entity & _MULTIPART)
    if entity == _POINT_ENTITY:
        return Geometry("Point", shape.rings[0][0], srid=grid.srid) if shape.rings[0] else None
    if entity in _LINE_ENTITIES:
        return Geometry("MultiLineString", shape.rings, srid=grid.srid) if many else Geometry("LineString", shape.rings[0], srid=grid.srid)
    return Geometry("MultiPolygon", [[r] for r in shape.rings], srid=grid.srid) if many else Geometry("Polygon", [shape.rings[0]], srid=grid.srid)

