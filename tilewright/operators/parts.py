"""Features to per-tile parts: seam split, generalisation, clipping, quantisation.

Geometry kernels run over Arrow batches; classification, attributes and eligibility are expressions applied before them, so
nothing that a level does not admit reaches Python.  Lines are simplified before clipping, rings after.  Units are tiles of the
level.  Output order inside a feature is by tile row, tile column, then along the geometry; `ordinal` carries it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grid, style, tags

# Fixed values.
EXACT_LEVEL, SNAP_LEVEL, SNAP_STEP, SNAP_TRIES, EPS, SCALE = 16, 7, 1.0 / 1024.0, 4, 2.220446049250313e-16, 65535
AREAS = {n for _, n, _, _, a, _ in style.CLASSES if a}
ROADS = {n for _, n, _, r, _, _ in style.CLASSES if r >= 0}
Point = tuple[float, float]


def project(lonlat: list[Point], level: int) -> list[Point]:
    n = float(1 << level)
    out = []
    for lon, lat in lonlat:
        phi = math.radians(min(max(lat, -grid.MAX_LATITUDE), grid.MAX_LATITUDE))
        out.append(((lon + 180.0) / 360.0 * n, (1.0 - math.log(math.tan(phi) + 1.0 / math.cos(phi)) / math.pi) / 2.0 * n))
    return out


def seam_lines(line: list[Point]) -> list[list[Point]]:
    """A line cut where it crosses the antimeridian, both sides ending on the seam."""
    parts: list[list[Point]] = [line[:1]] if line else []
    for (lon0, lat0), (lon1, lat1) in zip(line, line[1:], strict=False):
        if abs(lon1 - lon0) > 180.0:
            here = math.copysign(180.0, lon0 - lon1)
            t = (here - lon0) / (lon1 + 2 * here - lon0)
            lat = lat0 + t * (lat1 - lat0)
            parts[-1].append((here, lat))
            parts.append([(-here, lat)])
        parts[-1].append((lon1, lat1))
    return parts


def _half_plane(ring: list[Point], inside, cross) -> list[Point]:
    """One side of Sutherland-Hodgman."""
    out: list[Point] = []
    for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True):
        if inside(a) != inside(b):
            out.append(cross(a, b))
        if inside(b):
            out.append(b)
    return out


def _cut(axis: int, at: float):
    def cross(a: Point, b: Point) -> Point:
        t = (at - a[axis]) / (b[axis] - a[axis])
        other = a[1 - axis] + (b[1 - axis] - a[1 - axis]) * t
        met = a[axis] + (b[axis] - a[axis]) * t
        return (met, other) if axis == 0 else (other, met)

    return cross


def seam_rings(ring: list[Point]) -> list[list[Point]]:
    """A ring cut at the antimeridian: unwrapped, clipped on either side of the seam it spans, and shifted back."""
    if not ring:
        return []
    flat = [ring[0]]
    for lon, lat in ring[1:]:
        lon += 360.0 * -round((lon - flat[-1][0]) / 360.0) if abs(lon - flat[-1][0]) > 180.0 else 0.0
        flat.append((lon, lat))
    low, high = min(p[0] for p in flat), max(p[0] for p in flat)
    seam = 180.0 + 360.0 * math.floor((low + 180.0) / 360.0)

    def back(points: list[Point], probe: float) -> list[Point]:
        by = -360.0 if probe > 180.0 else 360.0 if probe < -180.0 else 0.0
        return [(x + by, y) for x, y in points]

    if high <= seam:
        return [back(flat, seam - 0.1)]
    west = _half_plane(flat, lambda p: p[0] <= seam, _cut(0, seam))
    east = _half_plane(flat, lambda p: p[0] > seam, _cut(0, seam))
    return [p for p in (back(west, seam - 0.1), back(east, seam + 0.1)) if len(p) >= 4]


def covered(points: list[Point], level: int) -> list[tuple[int, int]]:
    """Tiles of the bounding box, row by row."""
    if not points:
        return []
    top = (1 << level) - 1
    edge = lambda v: min(max(math.floor(v), 0), top)
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    return [(x, y) for y in range(edge(min(ys)), edge(max(ys)) + 1) for x in range(edge(min(xs)), edge(max(xs)) + 1)]


def clip_line(points: list[Point], x: int, y: int) -> list[list[Point]]:
    """The stretches of a line inside a tile, by parametric clipping of each segment."""
    parts: list[list[Point]] = []
    for (ax, ay), (bx, by) in zip(points, points[1:], strict=False):
        dx, dy, t0, t1 = bx - ax, by - ay, 0.0, 1.0
        for d, low, high in ((dx, x - ax, x + 1.0 - ax), (dy, y - ay, y + 1.0 - ay)):
            if abs(d) < EPS:
                if low > 0.0 or high < 0.0:
                    t0, t1 = 1.0, 0.0
                continue
            near, far = sorted((low / d, high / d))
            t0, t1 = max(t0, near), min(t1, far)
        if t0 > t1:
            continue
        a, b = (ax + dx * t0, ay + dy * t0), (ax + dx * t1, ay + dy * t1)
        if _same(a, b):
            continue
        if parts and _same(parts[-1][-1], a):
            parts[-1].append(b)
        else:
            parts.append([a, b])
    return parts


def _same(a: Point, b: Point) -> bool:
    return abs(a[0] - b[0]) < EPS and abs(a[1] - b[1]) < EPS


def clip_ring(ring: list[Point], x: int, y: int) -> list[Point]:
    for axis, at, sign in ((0, x, 1), (0, x + 1.0, -1), (1, y, 1), (1, y + 1.0, -1)):
        if not ring:
            break
        ring = _half_plane(ring, lambda p, axis=axis, at=at, sign=sign: (p[axis] - at) * sign >= 0, _cut(axis, at))
    return ring


def tolerance(level: int) -> float:
    return 2.0 ** max(16 - level, 0) * 2.0 / SCALE


def _distance(p: Point, a: Point, b: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = 0.0 if n <= EPS else min(max(((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n, 0.0), 1.0)
    return math.hypot(p[0] - a[0] - t * dx, p[1] - a[1] - t * dy)


def simplify_line(points: list[Point], cls: str, level: int) -> list[Point]:
    """Douglas-Peucker with an explicit stack; only roads below the exact level."""
    if cls not in ROADS or level >= EXACT_LEVEL or len(points) < 3:
        return points
    limit, keep, stack = tolerance(level), {0, len(points) - 1}, [(0, len(points) - 1)]
    while stack:
        lo, hi = stack.pop()
        far, at = max(((_distance(points[i], points[lo], points[hi]), -i) for i in range(lo + 1, hi)), default=(0.0, 0))
        if far > limit:
            keep.add(-at)
            stack += [(lo, -at), (-at, hi)]
    return [points[i] for i in sorted(keep)]


def simplify_ring(ring: list[Point], cls: str, level: int, x: int, y: int) -> list[Point]:
    """Drop ring vertices near the chord of their neighbours; vertices on the tile's edge stay, shallow water is snapped instead."""
    if cls == "Water" and level <= SNAP_LEVEL:
        return snapped(ring)
    if cls == "Building" or level >= EXACT_LEVEL or len(ring) < 4:
        return ring
    limit = tolerance(level)
    on_edge = lambda p: min(abs(p[0] - x), abs(p[0] - x - 1.0), abs(p[1] - y), abs(p[1] - y - 1.0)) < EPS
    left = [p for i, p in enumerate(ring) if on_edge(p) or _distance(p, ring[i - 1], ring[(i + 1) % len(ring)]) > limit]
    return left if len(left) >= 3 else ring


def snapped(ring: list[Point], step: float = SNAP_STEP) -> list[Point]:
    """A ring on a lattice, without creases.  A lattice that makes the ring visit a point twice is halved, a few times; after
    that the ring stays as it was.  A ring that folds away is empty."""
    for k in range(SNAP_TRIES):
        s = step / 2**k
        out: list[Point] = []
        for p in ((math.floor(px / s + 0.5) * s, math.floor(py / s + 0.5) * s) for px, py in ring):
            if out and out[-1] == p:
                continue
            if len(out) > 1 and out[-2] == p:
                out.pop()
            else:
                out.append(p)
        while len(out) >= 3 and (out[0] == out[-1] or out[1] == out[-1] or out[0] == out[-2]):
            if out[0] != out[-1] and out[1] == out[-1]:
                del out[0]
            else:
                out.pop()
        if len(out) < 3:
            return []
        if len(set(out)) == len(out):
            return out
    return ring


def quantised(points: list[Point], x: int, y: int, area: bool) -> list[tuple[int, int]]:
    """Tile steps without consecutive repeats; rings are closed; too few vertices give none."""
    step = lambda v: int(min(max(math.floor(v * SCALE + 0.5), 0), SCALE))
    out: list[tuple[int, int]] = []
    for px, py in points:
        q = (step(px - x), step(py - y))
        if not out or out[-1] != q:
            out.append(q)
    if area and out and out[0] != out[-1]:
        out.append(out[0])
    return out if len(out) >= (4 if area else 2) else []


def inside(p: Point, ring: list[Point]) -> bool:
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            hit = not hit
    return hit


def tile_parts(cls: str, vertices: list[Point], holes: list[list[Point]], level: int):
    """(x, y, vertices, holes) of one feature at one level."""
    if cls in ("Poi", "Label") and len(vertices) == 1:
        (px, py), n = project(vertices, level)[0], 1 << level
        cells = n * grid.EXTENT
        gx, gy = (min(max(math.floor(v * grid.EXTENT + 0.5), 0), cells - 1) for v in (px, py))
        yield gx >> 16, gy >> 16, [(gx & 65535, gy & 65535)], []
    elif cls in AREAS:
        seamed = [h for hole in holes for h in seam_rings(hole)]
        for outer in seam_rings(vertices):
            own = [project(h, level) for h in seamed if h and inside(h[0], outer)]
            points = project(outer, level)
            for x, y in covered(points, level):
                ring = quantised(simplify_ring(clip_ring(points, x, y), cls, level, x, y), x, y, True)
                if ring:
                    cut = (quantised(simplify_ring(clip_ring(h, x, y), cls, level, x, y), x, y, True) for h in own)
                    yield x, y, ring, [h for h in cut if h]
    else:
        for line in seam_lines(vertices):
            points = simplify_line(project(line, level), cls, level)
            for x, y in covered(points, level):
                for part in clip_line(points, x, y):
                    if q := quantised(part, x, y, False):
                        yield x, y, q, []


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each run, one run after another."""
    return np.arange(int(sizes.sum())) + np.repeat(starts - offsets(sizes)[:-1], sizes)


class Ragged:
    """Rows of points, one after another: x, y, and the number of points of each row."""

    def __init__(self, x: np.ndarray, y: np.ndarray, sizes: np.ndarray):
        self.x, self.y, self.sizes = x, y, sizes

    @property
    def at(self) -> np.ndarray:
        return offsets(self.sizes)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.sizes)), self.sizes)

    def take(self, rows: np.ndarray) -> Ragged:
        k = spread(self.at[:-1][rows], self.sizes[rows])
        return Ragged(self.x[k], self.y[k], self.sizes[rows])

    def keep(self, mask: np.ndarray) -> Ragged:
        return Ragged(self.x[mask], self.y[mask], np.bincount(self.row[mask], minlength=len(self.sizes)))

    def beside(self) -> tuple[np.ndarray, np.ndarray]:
        """Positions of each point's neighbours before and after it, around its row."""
        n, at = len(self.x), self.at
        held = self.sizes > 0
        first, last = at[:-1][held], at[1:][held] - 1
        before, after = np.arange(n) - 1, np.arange(n) + 1
        before[first], after[last] = last, first
        return before, after

    def least(self, v: np.ndarray, f=np.minimum) -> np.ndarray:
        """The least (or by f greatest) value of each row; rows must not be empty."""
        return f.reduceat(v, self.at[:-1]) if len(v) else v[:0]


def _mapped(f, *columns: np.ndarray) -> np.ndarray:
    """A function of the math module over columns: its last bits differ from numpy's, and parts stay what they were."""
    return np.fromiter(map(f, *(c.tolist() for c in columns)), np.float64, len(columns[0]))


def _projected(r: Ragged, level: int) -> Ragged:
    n = float(1 << level)
    phi = np.minimum(np.maximum(r.y, -grid.MAX_LATITUDE), grid.MAX_LATITUDE) * (math.pi / 180.0)
    up = _mapped(math.log, _mapped(math.tan, phi) + 1.0 / _mapped(math.cos, phi))
    return Ragged((r.x + 180.0) / 360.0 * n, (1.0 - up / math.pi) / 2.0 * n, r.sizes)


def _bounds(r: Ragged, level: int) -> list[np.ndarray]:
    """First and last tile column and row of each row of points; rows must not be empty."""
    edge = lambda v: np.clip(np.floor(v), 0, (1 << level) - 1).astype(np.int64)
    return [edge(r.least(v, f)) for v in (r.x, r.y) for f in (np.minimum, np.maximum)]


def _covers(bounds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, x, y) of the tiles within bounds, row by row of tiles."""
    x0, x1, y0, y1 = bounds
    wide = x1 - x0 + 1
    n = wide * (y1 - y0 + 1)
    row = np.repeat(np.arange(len(n)), n)
    k = spread(np.zeros(len(n), np.int64), n)
    return row, x0[row] + k % wide[row], y0[row] + k // wide[row]


def _half(r: Ragged, axis: int, at: np.ndarray, sign: int) -> Ragged:
    """One side of Sutherland-Hodgman for every ring, `at` by row."""
    along, across = (r.x, r.y) if axis == 0 else (r.y, r.x)
    row = r.row
    edge = at[row]
    held = (along - edge) * sign >= 0
    if held.all():
        return r
    before, _ = r.beside()
    crossing = np.flatnonzero(held[before] != held)
    a, b = before[crossing], crossing
    t = (edge[b] - along[a]) / (along[b] - along[a])
    met, other = np.empty((len(row), 2)), np.empty((len(row), 2))
    met[:, 1], other[:, 1] = along, across
    met[crossing, 0], other[crossing, 0] = along[a] + (along[b] - along[a]) * t, across[a] + (across[b] - across[a]) * t
    keep = np.zeros((len(row), 2), bool)
    keep[crossing, 0], keep[:, 1] = True, held
    sizes = np.bincount(row, weights=keep.sum(axis=1), minlength=len(r.sizes)).astype(np.int64)
    met, other = met[keep], other[keep]
    return Ragged(*((met, other) if axis == 0 else (other, met)), sizes)


def _clipped(r: Ragged, x: np.ndarray, y: np.ndarray) -> Ragged:
    """clip_ring of every ring with its tile."""
    for axis, at, sign in ((0, x, 1), (0, x + 1.0, -1), (1, y, 1), (1, y + 1.0, -1)):
        r = _half(r, axis, at, sign)
    return r


def _distances(r: Ragged, p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """_distance of points at positions p from the segments between positions a and b."""
    dx, dy = r.x[b] - r.x[a], r.y[b] - r.y[a]
    n = dx * dx + dy * dy
    px, py = r.x[p] - r.x[a], r.y[p] - r.y[a]
    flat = n <= EPS
    t = np.where(flat, 0.0, np.clip((px * dx + py * dy) / np.where(flat, 1.0, n), 0.0, 1.0))
    return _mapped(math.hypot, px - t * dx, py - t * dy)


def _rings_simplified(r: Ragged, cls: str, level: int, x: np.ndarray, y: np.ndarray) -> Ragged:
    """simplify_ring of every ring with its tile."""
    if cls == "Water" and level <= SNAP_LEVEL:
        points, at = list(zip(r.x.tolist(), r.y.tolist(), strict=True)), r.at.tolist()
        rings = [snapped(points[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)]
        xy = np.array([p for ring in rings for p in ring], np.float64).reshape(-1, 2)
        return Ragged(xy[:, 0], xy[:, 1], np.array(list(map(len, rings)), np.int64))
    if cls == "Building" or level >= EXACT_LEVEL:
        return r
    row = r.row
    x, y = x[row], y[row]
    on_edge = np.minimum(np.minimum(np.abs(r.x - x), np.abs(r.x - x - 1.0)), np.minimum(np.abs(r.y - y), np.abs(r.y - y - 1.0))) < EPS
    judged = np.flatnonzero(~on_edge & (r.sizes[row] >= 4))
    before, after = r.beside()
    drop = judged[_distances(r, judged, before[judged], after[judged]) <= tolerance(level)]
    left = r.sizes - np.bincount(row[drop], minlength=len(r.sizes))
    keep = np.ones(len(row), bool)
    keep[drop[left[row[drop]] >= 3]] = False
    return r.keep(keep)


def _lines_simplified(r: Ragged, cls: str, level: int) -> Ragged:
    """simplify_line of every line: all stretches that are still open are split in the same round."""
    if cls not in ROADS or level >= EXACT_LEVEL:
        return r
    at, limit = r.at, tolerance(level)
    keep = np.zeros(len(r.x), bool)
    keep[np.repeat(r.sizes < 3, r.sizes)] = True
    lo, hi = at[:-1][r.sizes >= 3], at[1:][r.sizes >= 3] - 1
    keep[lo] = keep[hi] = True
    while len(lo):
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        n = hi - lo - 1
        p, of = spread(lo + 1, n), np.repeat(np.arange(len(n)), n)
        d = _distances(r, p, lo[of], hi[of])
        far = np.maximum.reduceat(d, offsets(n)[:-1]) if len(n) else d
        k = np.flatnonzero(d == far[of])
        k = k[np.diff(of[k], prepend=-1) > 0]  # the first of the farthest
        mid, split = p[k], far > limit
        lo, hi, mid = lo[split], hi[split], mid[split]
        keep[mid] = True
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    return r.keep(keep)


def _lines_clipped(r: Ragged, x: np.ndarray, y: np.ndarray) -> tuple[Ragged, np.ndarray]:
    """The stretches that clip_line makes of every line in its tile, and the row of each."""
    row = r.row
    a = np.flatnonzero(row[1:] == row[:-1])
    of, ax, ay = row[a], r.x[a], r.y[a]
    dx, dy = r.x[a + 1] - ax, r.y[a + 1] - ay
    t0, t1 = np.zeros(len(a)), np.ones(len(a))
    for d, low, high in ((dx, x[of] - ax, x[of] + 1.0 - ax), (dy, y[of] - ay, y[of] + 1.0 - ay)):
        flat = np.abs(d) < EPS
        out = flat & ((low > 0.0) | (high < 0.0))
        by = np.where(flat, 1.0, d)
        u, v = low / by, high / by
        t0 = np.where(out, 1.0, np.where(flat, t0, np.maximum(t0, np.minimum(u, v))))
        t1 = np.where(out, 0.0, np.where(flat, t1, np.minimum(t1, np.maximum(u, v))))
    fx, fy, tx, ty = ax + dx * t0, ay + dy * t0, ax + dx * t1, ay + dy * t1
    same = lambda px, py, qx, qy: (np.abs(px - qx) < EPS) & (np.abs(py - qy) < EPS)
    k = np.flatnonzero((t0 <= t1) & ~same(fx, fy, tx, ty))
    of, fx, fy, tx, ty = of[k], fx[k], fy[k], tx[k], ty[k]
    new = np.ones(len(k), bool)
    new[1:] = (of[1:] != of[:-1]) | ~same(tx[:-1], ty[:-1], fx[1:], fy[1:])
    keep = np.stack([new, np.ones(len(k), bool)], axis=1)
    sizes = np.bincount(np.cumsum(new) - 1, minlength=int(new.sum())) + 1
    return Ragged(np.stack([fx, tx], axis=1)[keep], np.stack([fy, ty], axis=1)[keep], sizes), of[new]


def _steps(r: Ragged, x: np.ndarray, y: np.ndarray, area: bool) -> tuple[Ragged, np.ndarray]:
    """quantised() of every row with its tile: the rows that are left, and which they are."""
    row = r.row
    step = lambda v: np.clip(np.floor(v * SCALE + 0.5), 0, SCALE).astype(np.int32)
    q = Ragged(step(r.x - x[row]), step(r.y - y[row]), r.sizes)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (q.x[1:] != q.x[:-1]) | (q.y[1:] != q.y[:-1])
    q = q.keep(new)
    if area and len(q.x):
        at = q.at
        lo, hi = np.minimum(at[:-1], len(q.x) - 1), np.maximum(at[1:] - 1, 0)
        open_ = (q.sizes > 0) & ((q.x[lo] != q.x[hi]) | (q.y[lo] != q.y[hi]))
        end, first = at[1:][open_], at[:-1][open_]
        q = Ragged(np.insert(q.x, end, q.x[first]), np.insert(q.y, end, q.y[first]), q.sizes + open_)
    rows = np.flatnonzero(q.sizes >= (4 if area else 2))
    return q.take(rows), rows


class Cut:
    """Parts of features: of (their feature's number), x, y, rings or lines, and of their holes the part and the ring."""

    def __init__(self, of, x, y, own: Ragged, hole_of=None, holes: Ragged | None = None):
        none = np.zeros(0, np.int64)
        self.of, self.x, self.y, self.own = of, x, y, own
        self.hole_of, self.holes = (none, Ragged(none, none, none)) if holes is None else (hole_of, holes)


def _points_cut(r: Ragged, level: int) -> Cut:
    p, n = _projected(r, level), (1 << level) * grid.EXTENT
    gx, gy = (np.clip(np.floor(v * grid.EXTENT + 0.5), 0, n - 1).astype(np.int64) for v in (p.x, p.y))
    return Cut(np.arange(len(gx)), gx >> 16, gy >> 16, Ragged(gx & 65535, gy & 65535, r.sizes))


def _lines_cut(points: Ragged, level: int) -> Cut:
    row, x, y = _covers(_bounds(points, level))
    cut, of = _lines_clipped(points.take(row), x, y)
    q, left = _steps(cut, x[of], y[of], False)
    of = of[left]
    return Cut(row[of], x[of], y[of], q)


def _areas_cut(points: Ragged, holes: Ragged, hole_of: np.ndarray, cls: str, level: int) -> Cut:
    """Rings and their holes, which come in the order of their rings."""
    row, x, y = _covers(_bounds(points, level))

    def made(r, x, y):
        return _steps(_rings_simplified(_clipped(r, x, y), cls, level, x, y), x, y, True)

    q, left = made(points.take(row), x, y)
    row, x, y = row[left], x[left], y[left]
    n = np.bincount(hole_of, minlength=len(points.sizes))[row]
    part, hole = np.repeat(np.arange(len(row)), n), spread(np.searchsorted(hole_of, row), n)
    h, left = made(holes.take(hole), x[part], y[part])
    return Cut(row, x, y, q, part[left], h)


def flat_points(column: pa.Array) -> Ragged:
    """A column of point lists without an object for every point; null lists are empty, null numbers NaN."""
    flat = column.flatten()
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    x, y = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in (0, 1))
    return Ragged(x, y, sizes)


#: Points of features times tiles of their boxes that are cut together.
BLOCK = 2_000_000


def cut_groups(kinds: list[str], levels: list[int], lines: Ragged, holes: Ragged, holes_of: np.ndarray):
    """(features, Cut) for groups of features of one class and level, and last (the features left to tile_parts, None).

    Left are those that meet the antimeridian, hold a number that is not finite, or are too large to hold for all their tiles at once."""
    plain = np.ones(len(kinds), bool)
    for r, of in ((lines, np.arange(len(kinds))), (holes, holes_of)):
        if not len(r.x):
            continue
        row = of[r.row]
        plain[row[~(np.isfinite(r.x) & np.isfinite(r.y))]] = False
        own = r.row
        plain[row[1:][(own[1:] == own[:-1]) & ~(np.abs(np.diff(r.x)) <= 180.0)]] = False
        world = (r.x >= -180.0) & (r.x <= 180.0)
        area = np.array([k in AREAS for k in kinds])
        plain[row[area[row] & ~world]] = False
        held = np.flatnonzero(r.sizes > 0)  # a ring wholly on the seam is shifted by a turn
        low = r.take(held).least(r.x)
        plain[of[held[area[of[held]] & (low >= 180.0)]]] = False
    groups: dict[tuple, list[int]] = {}
    for i in np.flatnonzero(plain & (lines.sizes > 0)).tolist():
        point = kinds[i] in ("Poi", "Label") and lines.sizes[i] == 1
        groups.setdefault((kinds[i], levels[i], point), []).append(i)
    for (kind, level, point), members in groups.items():
        rows = np.array(members)
        own = lines.take(rows)
        if point:
            yield rows, _points_cut(own, level)
            continue
        points = _projected(own, level)
        if kind not in AREAS:
            points = _lines_simplified(points, kind, level)
        x0, x1, y0, y1 = _bounds(points, level)
        work = (x1 - x0 + 1) * (y1 - y0 + 1) * points.sizes
        if (large := work > BLOCK).any():
            plain[rows[large]] = False
            rows, own, points, work = rows[~large], own.take(np.flatnonzero(~large)), points.take(np.flatnonzero(~large)), work[~large]
        if not len(rows):
            continue
        work = np.cumsum(work) // BLOCK
        for lo, hi in zip(*(lambda c: (c, [*c[1:], len(rows)]))([0, *(np.flatnonzero(np.diff(work)) + 1).tolist()]), strict=True):
            part, k = rows[lo:hi], np.arange(lo, hi)
            if kind not in AREAS:
                yield part, _lines_cut(points.take(k), level)
                continue
            mine = np.flatnonzero(np.isin(holes_of, part) & (holes.sizes > 0))
            at = np.searchsorted(part, holes_of[mine])
            outer, inner = own.take(k), holes.take(mine)
            start, end = outer.at.tolist(), inner.at.tolist()
            px, py = outer.x.tolist(), outer.y.tolist()
            hx, hy = inner.x.tolist(), inner.y.tolist()
            within = [inside((hx[e], hy[e]), list(zip(px[start[a] : start[a + 1]], py[start[a] : start[a + 1]], strict=True))) for a, e in zip(at.tolist(), end, strict=False)]
            held = np.flatnonzero(np.array(within, bool))
            yield part, _areas_cut(points.take(k), _projected(inner.take(held), level), at[held], kind, level)
    if not plain.all():
        yield np.flatnonzero(~plain), None


VERTICES = "array<struct<x:int,y:int>>"
PART = f"id long, class string, flags int, rank int, name string, building struct<base_dm:int,top_dm:int,roof:string,material:string>, z int, x int, y int, ordinal int, vertices {VERTICES}, holes array<{VERTICES}>"


def point_lists(column: pa.Array) -> list:
    """Lists of points, or lists of such lists, as pairs of numbers, without an object for every point."""
    inner = column.type.value_type
    if not len(column):
        return []
    flat, ends = column.flatten(), np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()
    points = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist(), strict=True)) if pa.types.is_struct(inner) else point_lists(flat)
    known = column.is_valid().to_pylist()
    return [points[lo:hi] if k else None for lo, hi, k in zip([0, *ends], ends, known, strict=False)]


def lists(rows: list[list], made) -> pa.ListArray:
    """A list array of rows whose elements, one after another, made() turns into an array."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), made([x for r in rows for x in r]))


def step_points(points: list[tuple[int, int]]) -> pa.StructArray:
    xy = np.array(points, np.int32).reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])


def _point_array(r: Ragged) -> pa.ListArray:
    points = pa.StructArray.from_arrays([pa.array(r.x.astype(np.int32)), pa.array(r.y.astype(np.int32))], names=["x", "y"])
    return pa.ListArray.from_arrays(pa.array(r.at.astype(np.int32)), points)


def _ragged(rows: list[list[Point]]) -> Ragged:
    xy = np.array([p for r in rows for p in r]).reshape(-1, 2)
    return Ragged(xy[:, 0], xy[:, 1], np.array(list(map(len, rows)), np.int64))


def cut_singly(batch: pa.RecordBatch) -> Cut:
    """The parts that tile_parts makes of every feature of a batch."""
    kinds, levels = batch.column("class").to_pylist(), batch.column("z").to_pylist()
    lines, holes = point_lists(batch.column("vertices")), point_lists(batch.column("holes"))
    found = [(i, *p) for i, (k, z) in enumerate(zip(kinds, levels, strict=True)) for p in tile_parts(k, lines[i] or [], [h or [] for h in holes[i] or []], z)]
    of, x, y = (np.array([f[k] for f in found], np.int64) for k in range(3))
    hole_of = np.repeat(np.arange(len(found)), [len(f[4]) for f in found]).astype(np.int64)
    return Cut(of, x, y, _ragged([f[3] for f in found]), hole_of, _ragged([h for f in found for h in f[4]]))


def ready(features: DataFrame, levels: list[int]) -> DataFrame:
    """features (id, tags, vertices, holes: lists of struct<lon,lat>) at the levels that admit them, with their attributes."""
    t = F.col("tags")
    f = features.withColumns({"class": tags.classify(t), "rank": tags.rank(t), "flags": tags.flags(t), "name": F.coalesce(tags.tag(t, "name"), F.lit(""))}).where("class is not null")
    f = f.withColumn("z", F.explode(F.array(*map(F.lit, levels)))).where(tags.eligible(F.col("class"), F.col("rank"), F.col("z")))
    return f.select("id", "class", "flags", "rank", "name", tags.building(F.col("class"), t).alias("building"), "z", "vertices", "holes")


def cut_batches(batches, schema: T.StructType):
    """Batches of parts, by the schema of PART, of batches of ready() features."""
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    for batch in batches:
        kinds, levels_ = batch.column("class").to_pylist(), batch.column("z").to_pylist()
        lines, inner = flat_points(batch.column("vertices")), batch.column("holes").flatten()
        holes_of = np.repeat(np.arange(batch.num_rows), batch.column("holes").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        for rows, cut in cut_groups(kinds, levels_, lines, flat_points(inner), holes_of):
            if cut is None:
                cut = cut_singly(batch.take(pa.array(rows)))
            rows = rows[cut.of]
            first = np.flatnonzero(np.diff(cut.of, prepend=-1))
            own = {c: batch.column(c).take(pa.array(rows)) for c in ("id", "class", "flags", "rank", "name", "building", "z")}
            own |= {"x": pa.array(cut.x), "y": pa.array(cut.y), "ordinal": pa.array(spread(np.zeros(len(first), np.int64), np.diff(first, append=len(rows))))}
            n = np.bincount(cut.hole_of, minlength=len(rows))
            own |= {"vertices": _point_array(cut.own), "holes": pa.ListArray.from_arrays(pa.array(offsets(n).astype(np.int32)), _point_array(cut.holes))}
            yield pa.RecordBatch.from_arrays([own[c].cast(shape.field(c).type) for c in shape.names], schema=shape)


def parts(features: DataFrame, levels: list[int]) -> DataFrame:
    """features (id, tags, vertices, holes: lists of struct<lon,lat>) at the levels that admit them, cut into tiles."""
    schema = T._parse_datatype_string(PART)
    return ready(features, levels).mapInArrow(lambda batches: cut_batches(batches, schema), schema)


def one_tile(features: DataFrame, level: int) -> DataFrame:
    """features whose vertices all lie in one tile of the level, with that tile; the others are left out."""
    a = lambda v, k: grid.locate(v["lon"], v["lat"], level)[k]
    tiles = F.array_distinct(F.transform("vertices", lambda v: F.struct(a(v, "x").alias("x"), a(v, "y").alias("y"))))
    return features.withColumn("tiles", tiles).where(F.size("tiles") == 1).select(*features.columns, F.lit(level).alias("z"), F.col("tiles")[0]["x"].alias("x"), F.col("tiles")[0]["y"].alias("y"))


def representative(vertices, z, x, y):
    """lon and lat of the middle vertex."""
    mid = F.get(vertices, F.floor(F.size(vertices) / 2).cast("int"))
    return grid.lon_at(z, x.cast("long"), mid["x"]), grid.lat_at(z, y.cast("long"), mid["y"])


def ring_area(ring: list[tuple[int, int]]) -> float:
    """Signed shoelace area."""
    a = np.array(ring, np.float64)
    b = np.roll(a, -1, axis=0)
    return float((a[:, 0] * b[:, 1] - b[:, 0] * a[:, 1]).sum() / 2)
