"""Curved segments as polylines within a tolerance."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

# Kinds of curved segments.
ARC, SPIRAL, BEZIER, ELLIPSE = 1, 3, 4, 5


@dataclass(frozen=True)
class Densify:
    """tolerance: greatest distance of a chord from its curve; max_angle: greatest turn of a segment; at least and at most so many segments a curve.

    With `segments` every curve gets exactly that many.
    """

    tolerance: float = 0.01
    max_angle: float = math.pi / 16
    least: int = 4
    most: int = 256
    segments: int | None = None


@dataclass(frozen=True)
class Curve:
    """The segment after point `start` (counted over all rings) is curved. through: a point on an arc; controls: those of a Bezier curve."""

    start: int
    kind: int
    through: tuple[float, float] | None = None
    controls: tuple[tuple[float, float], tuple[float, float]] | None = None
    straight: bool = False


def arc_segments(sweep: float, radius: float, options: Densify) -> int:
    """Segments of an arc: a chord over the angle t strays r(1 - cos t/2) from it."""
    if options.segments is not None:
        return max(1, options.segments)
    ratio = options.tolerance / radius if radius > 0 else 0.0
    angle = min(options.max_angle, 2 * math.acos(1 - ratio)) if 0 < ratio < 2 else options.max_angle
    return max(1, min(options.most, max(options.least, math.ceil(abs(sweep) / angle))))


def densify_arc(start, end, center, counter_clockwise: bool, options: Densify = Densify()) -> np.ndarray:
    """Points from start to end along the arc around center."""
    start, end, center = (np.asarray(p, float) for p in (start, end, center))
    first, last = (math.atan2(*(p - center)[::-1]) for p in (start, end))
    turn = (last - first) % (2 * math.pi) or 2 * math.pi
    sweep = turn if counter_clockwise else turn - 2 * math.pi or -2 * math.pi
    if not counter_clockwise and turn == 2 * math.pi:
        sweep = -2 * math.pi
    radius = (np.hypot(*(start - center)) + np.hypot(*(end - center))) / 2
    n = arc_segments(sweep, radius, options)
    angles = first + sweep * np.arange(1, n) / n
    inner = center + radius * np.column_stack([np.cos(angles), np.sin(angles)])
    return np.vstack([start, inner, end])


def circle_center(a, b, c) -> np.ndarray | None:
    """Centre of the circle through three points, None if they are on a line."""
    a, b, c = (np.asarray(p, float) for p in (a, b, c))
    matrix = 2 * np.array([b - a, c - a])
    if not np.isfinite(matrix).all() or abs(matrix[0, 0] * matrix[1, 1] - matrix[0, 1] * matrix[1, 0]) < 2e-12:
        return None
    return a + np.linalg.solve(matrix, [(b - a) @ (b - a), (c - a) @ (c - a)])


def _bernstein(controls: np.ndarray, t: np.ndarray) -> np.ndarray:
    t = t[:, None]
    u = 1 - t
    return u**3 * controls[0] + 3 * u**2 * t * controls[1] + 3 * u * t**2 * controls[2] + t**3 * controls[3]


def densify_bezier(start, control1, control2, end, options: Densify = Densify()) -> np.ndarray:
    """Points along a cubic curve: halves are halved again, all of a depth together, until each is flat; too few, and they are evenly spaced instead."""
    controls = np.array([start, control1, control2, end], float)
    if options.segments is not None:
        return _bernstein(controls, np.linspace(0, 1, max(1, options.segments) + 1))
    pieces, starts, width, done = controls[None], np.zeros(1), 1.0, [np.ones(1)]
    for _ in range(math.ceil(math.log2(options.most)) + 1):
        p0, p1, p2, p3 = pieces[:, 0], pieces[:, 1], pieces[:, 2], pieces[:, 3]
        bend = np.maximum(((3 * p1 - 2 * p0 - p3) ** 2).sum(axis=1), ((3 * p2 - p0 - 2 * p3) ** 2).sum(axis=1))
        open_ = bend > options.tolerance**2
        done.append(starts[~open_])
        if not open_.any():
            pieces = pieces[:0]
            break
        p0, p1, p2, p3, starts = p0[open_], p1[open_], p2[open_], p3[open_], starts[open_]
        a, b, c = (p0 + p1) / 2, (p1 + p2) / 2, (p2 + p3) / 2
        d, e = (a + b) / 2, (b + c) / 2
        middle = (d + e) / 2
        width /= 2
        pieces = np.concatenate([np.stack([p0, a, d, middle], axis=1), np.stack([middle, e, c, p3], axis=1)])
        starts = np.concatenate([starts, starts + width])
    if len(pieces):
        done.append(starts)
    t = np.unique(np.concatenate(done))
    return _bernstein(controls, t if len(t) > options.least else np.linspace(0, 1, options.least + 1))


def densify_rings(rings: list[list[tuple[float, float]]], curves: list[Curve], options: Densify = Densify()) -> list[list[tuple[float, float]]]:
    """The rings with their curved segments sampled. Unknown kinds, straight segments, arcs through a point of their chord, and the last point keep the chord."""
    at = {c.start: c for c in curves}
    out, number = [], 0
    for ring in rings:
        points: list[tuple[float, float]] = []
        for i, point in enumerate(ring):
            points.append(tuple(point))
            curve = at.get(number)
            number += 1
            if curve is None or curve.straight or i + 1 == len(ring):
                continue
            sampled = None
            if curve.kind == ARC and curve.through is not None:
                center = circle_center(point, curve.through, ring[i + 1])
                if center is not None:
                    (ax, ay), (bx, by) = np.subtract(curve.through, point), np.subtract(ring[i + 1], point)
                    sampled = densify_arc(point, ring[i + 1], center, ax * by - ay * bx > 0, options)
            elif curve.kind == BEZIER and curve.controls:
                sampled = densify_bezier(point, *curve.controls, ring[i + 1], options)
            if sampled is not None:
                points += [tuple(p) for p in sampled[1:-1].tolist()]
        out.append(points)
    return out
