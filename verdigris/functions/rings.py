"""Polygons from WKT text and containment of many points by a plane sweep."""

from __future__ import annotations

import re

import numpy as np

_HEAD = re.compile(r"^\s*(?:SRID\s*=\s*\d+\s*;)?\s*(MULTIPOLYGON|POLYGON)\s*(?:Z|M|ZM)?\s*(\(.*\))\s*$", re.IGNORECASE | re.DOTALL)
_RING = re.compile(r"\(([^()]+)\)")


def read_edges(text) -> np.ndarray | None:
    """All ring edges (x1, y1, x2, y2) of a WKT polygon or multipolygon, rings closed; None if it is neither.

    Shells and holes need no telling apart: under the even-odd rule a point in a hole is crossed once more.
    """
    m = _HEAD.match(text or "")
    if not m:
        return None
    edges = []
    for ring in _RING.findall(m[2]):
        try:
            points = np.array([[float(v) for v in p.split()[:2]] for p in ring.split(",")])
        except ValueError:
            return None
        if points.ndim != 2 or points.shape[1] != 2 or len(points) < 3 or not np.isfinite(points).all():
            return None
        if (points[0] != points[-1]).any():
            points = np.vstack([points, points[:1]])
        edges.append(np.hstack([points[:-1], points[1:]]))
    return np.vstack(edges) if edges else None


class SweptPoints:
    """Points in the order of the sweep line (ascending y); one sort serves every polygon."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.order = np.argsort(y, kind="stable")
        self.x, self.y = x[self.order], y[self.order]

    def inside(self, edges: np.ndarray) -> np.ndarray:
        """Positions (in the input's order) of the points in the polygon; points on its boundary are not inside.

        Each edge is active while the line passes its y interval, so it meets one slice of the sorted points, whose crossing parity it flips.
        """
        x, y = self.x, self.y
        start, stop = np.searchsorted(y, edges[:, [1, 3]].min()), np.searchsorted(y, edges[:, [1, 3]].max(), side="right")
        if start == stop:
            return np.empty(0, dtype=np.int64)
        odd = np.zeros(stop - start, dtype=bool)
        touching = np.zeros(stop - start, dtype=bool)
        low, high = np.minimum(edges[:, 1], edges[:, 3]), np.maximum(edges[:, 1], edges[:, 3])
        first, last, top = np.searchsorted(y, low), np.searchsorted(y, high), np.searchsorted(y, high, side="right")
        for (x1, y1, x2, y2), a, b, c in zip(edges, first, last, top):
            if a == c:
                continue
            px, py = x[a:c], y[a:c]
            side = (x2 - x1) * (py - y1) - (px - x1) * (y2 - y1)
            on = (side == 0) & (px >= min(x1, x2)) & (px <= max(x1, x2))
            touching[a - start : c - start] |= on
            if b > a:
                left = side[: b - a] > 0 if y2 > y1 else side[: b - a] < 0
                odd[a - start : b - start] ^= left
        return self.order[start:stop][odd & ~touching]
