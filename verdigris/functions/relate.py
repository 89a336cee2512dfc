"""Topological relations and distances of planar geometries.

The line work of both geometries is cut where it meets. The middles of the pieces, the nodes between them and points just beside each piece stand for
all parts of the arrangement; where they lie in each geometry gives the matrix of interiors, boundaries and exteriors.
"""

from __future__ import annotations

from collections import Counter

import numpy as np

from verdigris.functions.geometry import Geometry

INTERIOR, BOUNDARY, EXTERIOR = 0, 1, 2
RELATIONS = ("intersects", "contains", "within", "touches", "overlaps", "crosses", "disjoint")
_EPSILON = 1e-9


class Located:
    """A geometry split into points, line segments and rings, with tests of where points lie."""

    def __init__(self, g: Geometry):
        self.points, self.lines, self.rings = [], [], []
        self._add(g)
        self.dimension = 2 if self.rings else 1 if self.lines else 0
        self.line_segments, self.ring_segments = _segments(self.lines), _segments(self.rings)
        self.segments = np.vstack([self.line_segments, self.ring_segments])
        ends = Counter(p for line in self.lines if tuple(line[0]) != tuple(line[-1]) for p in (tuple(line[0]), tuple(line[-1])))
        self.line_ends = [p for p, n in ends.items() if n % 2]
        everything = np.array([*map(tuple, self.points), *[tuple(p) for part in (*self.lines, *self.rings) for p in part]], float).reshape(-1, 2)
        self.empty = not len(everything)
        self.scale = float(np.abs(everything).max()) if not self.empty else 1.0
        self.vertices = everything

    def _add(self, g: Geometry) -> None:
        c = g.coordinates
        if g.type == "GeometryCollection":
            for member in g.geometries:
                self._add(member)
        elif not c:
            return
        elif g.type == "Point":
            self.points.append(c)
        elif g.type == "MultiPoint":
            self.points += [p for p in c if p]
        elif g.type == "LineString":
            self.lines.append(c)
        elif g.type == "MultiLineString":
            self.lines += [x for x in c if x]
        else:
            for rings in [c] if g.type == "Polygon" else c:
                self.rings += [r if tuple(r[0]) == tuple(r[-1]) else [*r, r[0]] for r in rings if r]

    def locate(self, at: np.ndarray, tolerance: float) -> np.ndarray:
        """Interior, boundary or exterior for each point."""
        out = np.full(len(at), EXTERIOR)
        if len(self.ring_segments):
            out[_inside(at, self.ring_segments)] = INTERIOR
            out[_gaps(at, self.ring_segments) <= tolerance] = BOUNDARY
        if len(self.line_segments):
            on = _gaps(at, self.line_segments) <= tolerance
            ends = np.zeros(len(at), dtype=bool)
            for p in self.line_ends:
                ends |= np.hypot(*(at - p).T) <= tolerance
            out[on & (out != INTERIOR)] = INTERIOR
            out[on & ends & (_without(self, at, tolerance))] = BOUNDARY
        for p in self.points:
            out[np.hypot(*(at - p).T) <= tolerance] = INTERIOR
        return out


def _without(g: Located, at: np.ndarray, tolerance: float) -> np.ndarray:
    """True where a point is not inside of the rings."""
    return ~_inside(at, g.ring_segments) if len(g.ring_segments) else np.ones(len(at), dtype=bool)


def _segments(parts) -> np.ndarray:
    rows = [(*a[:2], *b[:2]) for part in parts for a, b in zip(part[:-1], part[1:]) if tuple(a) != tuple(b)]
    return np.array(rows, float).reshape(-1, 4)


def _inside(at: np.ndarray, rings: np.ndarray) -> np.ndarray:
    """Even-odd rule."""
    odd = np.zeros(len(at), dtype=bool)
    for x1, y1, x2, y2 in rings:
        across = (y1 > at[:, 1]) != (y2 > at[:, 1])
        if across.any():
            odd[across] ^= at[across, 0] < (x2 - x1) * (at[across, 1] - y1) / (y2 - y1) + x1
    return odd


def _gaps(at: np.ndarray, segments: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest segment."""
    best = np.full(len(at), np.inf)
    for x1, y1, x2, y2 in segments:
        d = np.array([x2 - x1, y2 - y1])
        t = np.clip((at - (x1, y1)) @ d / (d @ d), 0, 1)
        best = np.minimum(best, np.hypot(*(at - (x1, y1) - t[:, None] * d).T))
    return best


def _cuts(segment: np.ndarray, others: np.ndarray, points: np.ndarray, tolerance: float) -> np.ndarray:
    """Positions 0..1 on a segment where others meet it."""
    a, d = segment[:2], segment[2:] - segment[:2]
    length = np.hypot(*d)
    found = [0.0, 1.0]
    if len(others):
        c, e = others[:, :2], others[:, 2:] - others[:, :2]
        cross = d[0] * e[:, 1] - d[1] * e[:, 0]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((c[:, 0] - a[0]) * e[:, 1] - (c[:, 1] - a[1]) * e[:, 0]) / cross
            u = ((c[:, 0] - a[0]) * d[1] - (c[:, 1] - a[1]) * d[0]) / cross
        slack, other_slack = tolerance / length, tolerance / np.hypot(*e.T)
        hit = np.isfinite(t) & np.isfinite(u) & (t >= -slack) & (t <= 1 + slack) & (u >= -other_slack) & (u <= 1 + other_slack)
        found += t[hit].tolist()
    if len(points):
        t = (points - a) @ d / (d @ d)
        near = np.hypot(*(points - a - t[:, None] * d).T) <= tolerance
        found += t[near].tolist()
    found = np.clip(np.unique(found), 0, 1)
    return np.concatenate([found[:1], found[1:][np.diff(found) > tolerance / length]])


def matrix(a: Located, b: Located) -> np.ndarray:
    """Dimension of each meeting of interior, boundary and exterior, -1 for none."""
    out = np.full((3, 3), -1)
    if a.empty or b.empty:
        return out
    tolerance = max(a.scale, b.scale, 1.0) * _EPSILON
    middles, nodes, beside = [], [np.vstack([a.vertices, b.vertices])], []
    for one, two in ((a, b), (b, a)):
        for segment in one.segments:
            others = np.vstack([two.segments, one.segments])
            t = _cuts(segment, others, two.vertices, tolerance)
            start, d = segment[:2], segment[2:] - segment[:2]
            nodes.append(start + t[:, None] * d)
            middle = start + ((t[:-1] + t[1:]) / 2)[:, None] * d
            middles.append(middle)
            width = np.minimum(np.diff(t) * np.hypot(*d) * 1e-3, tolerance * 1e3)
            normal = np.array([-d[1], d[0]]) / np.hypot(*d)
            beside += [middle + width[:, None] * normal, middle - width[:, None] * normal]
    for samples, dimension in ((nodes, 0), (middles, 1), (beside, 2)):
        if samples:
            at = np.vstack(samples)
            # Points beside a line lie on neither geometry's line work, so no tolerance applies to them.
            close = tolerance if dimension < 2 else 0.0
            np.maximum.at(out, (a.locate(at, close), b.locate(at, close)), dimension)
    return out


def relation(a: Located, b: Located, name: str) -> bool:
    """Whether a stands in the named relation to b. Empty geometries are in none but `disjoint`."""
    m = matrix(a, b)
    meet = bool((m[:2, :2] >= 0).any())
    if name == "intersects":
        return meet
    if name == "disjoint":
        return not meet
    interiors = m[INTERIOR, INTERIOR]
    a_outside, b_outside = m[INTERIOR, EXTERIOR] >= 0, m[EXTERIOR, INTERIOR] >= 0
    if name == "contains":
        return interiors >= 0 and bool((m[EXTERIOR, :2] < 0).all())
    if name == "within":
        return interiors >= 0 and bool((m[:2, EXTERIOR] < 0).all())
    if name == "touches":
        return meet and interiors < 0
    if name == "crosses":
        if a.dimension == b.dimension:
            return a.dimension == 1 and interiors == 0
        return interiors >= 0 and (a_outside if a.dimension < b.dimension else b_outside)
    if name == "overlaps":
        return a.dimension == b.dimension and (interiors == 1 if a.dimension == 1 else interiors >= 0) and a_outside and b_outside
    raise ValueError(f"unknown relation {name}")


def distance(a: Located, b: Located) -> float:
    """Least distance; 0 if they meet, infinite if one is empty."""
    if a.empty or b.empty:
        return float("inf")
    best = np.inf
    for one, two in ((a, b), (b, a)):
        if len(two.ring_segments) and _inside(one.vertices, two.ring_segments).any():
            return 0.0
        if len(two.segments):
            best = min(best, _gaps(one.vertices, two.segments).min())
    for p in a.points if b.points else ():
        best = min(best, np.hypot(*(np.array(b.points, float) - p).T).min())
    tolerance = max(a.scale, b.scale, 1.0) * 1e-15
    if any(len(_cuts(s, b.segments, np.empty((0, 2)), tolerance)) > 2 for s in a.segments):
        return 0.0
    return float(best)


def relate_points(x: np.ndarray, y: np.ndarray, b: Located, name: str) -> np.ndarray:
    """The relation of each of many points to one geometry."""
    at = np.column_stack([x, y])
    where = b.locate(at, max(b.scale, 1.0) * _EPSILON) if not b.empty else np.full(len(at), EXTERIOR)
    one_point = b.dimension == 0 and len({tuple(p) for p in b.points}) == 1
    answers = {"intersects": where != EXTERIOR, "disjoint": where == EXTERIOR, "within": where == INTERIOR, "touches": where == BOUNDARY}
    answers["contains"] = (where == INTERIOR) & one_point
    return answers.get(name, np.zeros(len(at), dtype=bool))
