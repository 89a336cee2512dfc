"""k-d trees over points in numpy: fixed-radius pairs within a block, and splits that cut space into leaves with halo copies."""

from __future__ import annotations

import numpy as np


def unit_vectors(lon, lat) -> np.ndarray:
    """Geographic degrees as points of the unit sphere."""
    lon, lat = np.radians(np.asarray(lon, float)), np.radians(np.asarray(lat, float))
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def plane_vectors(x, y) -> np.ndarray:
    """Projected coordinates as points of the plane z = 0."""
    x = np.asarray(x, float)
    return np.column_stack([x, np.asarray(y, float), np.zeros(len(x))])


def degree_boxes(lon_low: float, lat_low: float, lon_high: float, lat_high: float) -> tuple[np.ndarray, np.ndarray]:
    """Lowest and highest coordinates of the unit vectors of a box in degrees, by interval arithmetic; never too narrow."""

    def cosines(low: float, high: float) -> tuple[float, float]:
        ends = [np.cos(np.radians(low)), np.cos(np.radians(high))]
        top = 1.0 if np.floor(high / 360) * 360 >= low else max(ends)
        bottom = -1.0 if np.floor((high - 180) / 360) * 360 + 180 >= low else min(ends)
        return bottom, top

    across = cosines(lat_low, lat_high)
    corners = [[a * b for a in across for b in cosines(lon_low - turn, lon_high - turn)] for turn in (0.0, 90.0)]
    heights = sorted(float(np.sin(np.radians(v))) for v in (lat_low, lat_high))
    low, high = np.array([[min(corners[0]), min(corners[1]), heights[0]]]), np.array([[max(corners[0]), max(corners[1]), heights[1]]])
    return low - 1e-12, high + 1e-12


def chord(radius: float, sphere_radius: float) -> float:
    """Chord of the unit sphere below a great-circle distance."""
    return 2.0 * np.sin(min(radius / sphere_radius, np.pi) / 2.0)


def close_pairs(points: np.ndarray, radius: float, bucket: int = 24, chunk: int = 500_000):
    """Yield arrays (i, j) with i != j, each unordered pair once, of points at most `radius` apart.

    A balanced tree is built level by level; pairs of nodes whose boxes are close enough are refined together, all of a level at once.
    `chunk` bounds the number of candidate pairs held at a time. Distances within a relative 1e-9 of the radius count as equal to it.
    """
    n = len(points)
    if n < 2:
        return
    limit = radius * (1 + 1e-9)
    depth = max(0, int(np.ceil(np.log2(n / bucket)))) if n > bucket else 0
    order = np.arange(n)
    bounds = np.array([0, n])
    boxes = []
    for level in range(depth + 1):
        sizes = np.diff(bounds)
        low = np.minimum.reduceat(points[order], bounds[:-1])
        high = np.maximum.reduceat(points[order], bounds[:-1])
        boxes.append((low, high))
        if level == depth:
            break
        node = np.repeat(np.arange(len(sizes)), sizes)
        along = np.argmax(high - low, axis=1)[node]
        order = order[np.lexsort((points[order, along], node))]
        middle = bounds[:-1] + sizes // 2
        bounds = np.sort(np.concatenate([bounds, middle]))
    a = b = np.zeros(1, dtype=np.int64)
    for level in range(1, depth + 1):
        low, high = boxes[level]
        same = a == b
        left, right = np.concatenate([2 * a, 2 * a + 1, 2 * a, (2 * a + 1)[~same]]), np.concatenate([2 * b, 2 * b + 1, 2 * b + 1, (2 * b)[~same]])
        gap = np.maximum(0.0, np.maximum(low[left] - high[right], low[right] - high[left]))
        keep = np.einsum("ij,ij->i", gap, gap) <= limit * limit
        a, b = left[keep], right[keep]
    sizes = np.diff(bounds)
    work = sizes[a] * sizes[b]
    cuts = np.searchsorted(np.cumsum(work), np.arange(chunk, work.sum() + chunk, chunk))
    for part in np.split(np.arange(len(a)), np.unique(cuts[:-1] + 1) if len(cuts) > 1 else []):
        if not len(part):
            continue
        na, nb, total = sizes[a[part]], sizes[b[part]], work[part]
        rank = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
        width = np.repeat(nb, total)
        i = np.repeat(bounds[a[part]], total) + rank // width
        j = np.repeat(bounds[b[part]], total) + rank % width
        keep = ~(np.repeat(a[part] == b[part], total) & (i >= j))
        i, j = order[i[keep]], order[j[keep]]
        d = points[i] - points[j]
        close = np.einsum("ij,ij->i", d, d) <= limit * limit
        yield i[close], j[close]


class Splits:
    """A k-d split of space, fitted on a sample; any point falls in exactly one leaf, whatever the sample was.

    No leaf is cut narrower than `least` (twice the search radius or more), so a point is copied to few leaves. `shares` holds the sample's share
    of each leaf, `near` the part of its sampled pairs that are within the radius, from at most PAIRED points of it.
    """

    PAIRED = 256

    def __init__(self, sample: np.ndarray, leaf_share: float, least: float):
        self.near: list[float] = []
        self.axis, self.at, self.child = [], [], []
        self.shares: list[float] = []
        if len(sample) == 0:
            sample = np.zeros((1, 3))
        self.total = len(sample)
        self.leaf_share, self.least = leaf_share, least
        self.root = self._grow(sample)

    def _grow(self, points: np.ndarray) -> int:
        """The node's number; leaves are negative: -1 - leaf."""
        share = len(points) / self.total
        if share > self.leaf_share and len(points) > 1:
            extent = points.max(axis=0) - points.min(axis=0)
            for axis in np.argsort(-extent, kind="stable"):
                at = float(np.median(points[:, axis]))
                left = points[:, axis] < at
                sides = (at - points[:, axis].min(), points[:, axis].max() - at)
                if left.any() and not left.all() and min(sides) >= self.least:
                    node = len(self.axis)
                    self.axis.append(int(axis))
                    self.at.append(at)
                    self.child.append((0, 0))
                    self.child[node] = (self._grow(points[left]), self._grow(points[~left]))
                    return node
        self.shares.append(share)
        some = points[: self.PAIRED]
        gaps = some[:, None] - some[None]
        close = np.einsum("ijk,ijk->ij", gaps, gaps) <= (self.least / 2) ** 2
        self.near.append((close.sum() - len(some)) / max(1, len(some) * (len(some) - 1)))
        return -len(self.shares)

    def leaves(self, low: np.ndarray, high: np.ndarray):
        """(row, leaf) for every leaf that the box low..high of a row meets."""
        rows, nodes = np.arange(len(low)), np.full(len(low), self.root)
        out_rows, out_leaves = [], []
        axis, at, child = np.array(self.axis, dtype=np.int64), np.array(self.at), np.array(self.child, dtype=np.int64).reshape(-1, 2)
        while len(rows):
            done = nodes < 0
            out_rows.append(rows[done])
            out_leaves.append(-1 - nodes[done])
            rows, nodes = rows[~done], nodes[~done]
            if not len(rows):
                break
            ax, cut = axis[nodes], at[nodes]
            go_left, go_right = low[rows, ax] < cut, high[rows, ax] >= cut
            rows, nodes = np.concatenate([rows[go_left], rows[go_right]]), np.concatenate([child[nodes[go_left], 0], child[nodes[go_right], 1]])
        return np.concatenate(out_rows), np.concatenate(out_leaves)
