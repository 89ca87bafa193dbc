"""Meshes of a tile's features: triangulated fills, road ribbons, buildings, the ground grid, and draw plans.

Meshes are made per feature over Arrow batches, of many features at once where their shapes allow, and summed per tile; what a
screen does with them is not this library's concern.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import arrays, style
from . import parts
from .parts import Ragged, flat_points, spread

# Fixed values.
FILL_ORDER = ("Land", "Water", "Park")
ROAD_ORDER = ("RoadPath", "RoadService", "RoadResidential", "RoadSecondary", "RoadPrimary", "RoadTrunk", "RoadMotorway")
LEVELS, PASSES = ("tunnel", "ground", "bridge"), ("casing", "fill")
MITER_LIMIT = 2.0
Point = tuple[float, float]


def area(ring: list[Point]) -> float:
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def opened(ring: list[Point]) -> list[Point]:
    return ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else list(ring)


def _bridged(outer: list[int], holes: list[list[int]], p: list[Point]) -> list[int]:
    """One index ring through outer and holes: each hole is joined to a vertex that it sees, rightmost holes first."""
    ring = outer
    for hole in sorted(holes, key=lambda h: -max(p[i][0] for i in h)):
        k = max(range(len(hole)), key=lambda i: p[hole[i]][0])
        edges = list(zip(ring, ring[1:] + ring[:1], strict=True)) + [e for h in holes for e in zip(h, h[1:] + h[:1], strict=True)]

        def sees(a: int, b: int, edges=edges) -> bool:
            def side(u, v, w):
                return (p[v][0] - p[u][0]) * (p[w][1] - p[u][1]) - (p[v][1] - p[u][1]) * (p[w][0] - p[u][0])

            return not any(u not in (a, b) and v not in (a, b) and p[u] not in (p[a], p[b]) and p[v] not in (p[a], p[b]) and side(a, b, u) * side(a, b, v) <= 0 and side(u, v, a) * side(u, v, b) <= 0 for u, v in edges)

        order = sorted(range(len(ring)), key=lambda i: math.dist(p[ring[i]], p[hole[k]]))
        at = next((i for i in order if sees(ring[i], hole[k])), order[0])
        turned = hole[k:] + hole[:k]
        ring = ring[: at + 1] + turned + [hole[k]] + ring[at:]
    return ring


def triangulate(outer: list[Point], holes: list[list[Point]] = ()) -> tuple[list[Point], list[tuple[int, int, int]]]:
    """(vertices, triangles) by ear clipping; at most one pass over the ring per ear, so folded rings end too.

    Rings are opened first; rings of fewer than three vertices count as absent."""
    rings = [r for r in map(opened, (outer, *holes)) if len(r) >= 3]
    if not rings or len(opened(outer)) < 3:
        return [], []
    p = [v for r in rings for v in r]
    indices, lo = [], 0
    for n, r in enumerate(rings):
        own = list(range(lo, lo + len(r)))
        indices.append(own if (area(r) > 0) == (n == 0) else own[::-1])
        lo += len(r)
    ring, out = _bridged(indices[0], indices[1:], p), []

    def turn(a, b, c):
        return (p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])

    while len(ring) > 3:
        for i in range(len(ring)):
            a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
            if turn(a, b, c) <= 0:
                continue
            corners = (p[a], p[b], p[c])
            if any(p[q] not in corners and turn(a, b, q) >= 0 and turn(b, c, q) >= 0 and turn(c, a, q) >= 0 for q in ring):
                continue
            out.append((a, b, c))
            del ring[i]
            break
        else:  # no ear: drop a flat corner, or the first one of a folded ring
            flat = next((i for i in range(len(ring)) if turn(ring[i - 1], ring[i], ring[(i + 1) % len(ring)]) == 0), 0)
            del ring[flat]
    if turn(*ring) > 0:
        out.append(tuple(ring))
    return p, out


def triangles_area(p: list[Point], triangles) -> float:
    return sum(abs((p[b][0] - p[a][0]) * (p[c][1] - p[a][1]) - (p[b][1] - p[a][1]) * (p[c][0] - p[a][0])) / 2 for a, b, c in triangles)


def walls(ring: list[Point], low: int, high: int):
    """(vertices with heights, triangles) of the walls over a ring."""
    v, t = [], []
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        n = len(v)
        v += [(*a, low), (*b, low), (*b, high), (*a, high)]
        t += [(n, n + 1, n + 2), (n, n + 2, n + 3)]
    return v, t


def roof(ring: list[Point], top: int, kind: str):
    """A ridge along the longer side of the bounding box for gabled and hipped roofs, else the flat ring."""
    if kind not in ("Gabled", "Hipped"):
        p, t = triangulate(ring)
        return [(*q, top) for q in p], t
    xs, ys = [q[0] for q in ring], [q[1] for q in ring]
    x0, x1, y0, y1 = min(xs), max(xs), min(ys), max(ys)
    rise = min(max(top // 3, 10), 40, top)
    inset = 0.25 if kind == "Hipped" else 0.0
    up = lambda v: math.floor(v + 0.5)
    if x1 - x0 >= y1 - y0:
        s = (x1 - x0) * inset
        ends = [(up(x0 + s), up((y0 + y1) / 2)), (up(x1 - s), up((y0 + y1) / 2))]
    else:
        s = (y1 - y0) * inset
        ends = [(up((x0 + x1) / 2), up(y0 + s)), (up((x0 + x1) / 2), up(y1 - s))]
    n = len(ring)
    near = lambda q: n if math.dist(q, ends[0]) <= math.dist(q, ends[1]) else n + 1
    return [(*q, top) for q in ring] + [(*e, top + rise) for e in ends], [(i, (i + 1) % n, near(q)) for i, q in enumerate(ring)]


def building(ring: list[Point], b: dict, lod: str):
    ring = opened(ring)
    if len(ring) < 3:
        return [], []
    if lod == "footprint":
        return roof(ring, b["base_dm"], "Flat")
    v, t = roof(ring, b["top_dm"], b["roof"] if lod == "full" else "Flat")
    wv, wt = walls(ring, b["base_dm"], b["top_dm"])
    return v + wv, t + [tuple(i + len(v) for i in q) for q in wt]


def ribbon(line: list[Point], miter_limit: float = MITER_LIMIT):
    """(vertices (x, y, normal x, normal y, distance), triangles, miters, bevels) of a line without consecutive repeats."""
    line = [q for i, q in enumerate(line) if not i or q != line[i - 1]]
    if len(line) < 2:
        return [], [], 0, 0
    unit = [((b[0] - a[0]) / d, (b[1] - a[1]) / d) for a, b in zip(line, line[1:], strict=False) if (d := math.dist(a, b))]
    v, t, miters, bevels, far = [], [], 0, 0, 0.0

    def pair(q, nx, ny, joined):
        v.extend([(*q, nx, ny, far), (*q, -nx, -ny, far)])
        if joined and len(v) >= 4:
            n = len(v) - 4
            t.extend([(n, n + 1, n + 2), (n + 1, n + 3, n + 2)])

    for i, q in enumerate(line):
        if i:
            far += math.dist(line[i - 1], q)
        if 0 < i < len(line) - 1:
            (ax, ay), (bx, by) = unit[i - 1], unit[i]
            mx, my = -(ay + by), ax + bx
            n = math.hypot(mx, my)
            cos = (mx * -ay + my * ax) / n if n > 1e-9 else 0.0
            if cos > 1e-9 and 1 / cos <= miter_limit:
                miters += 1
                pair(q, mx / n / cos, my / n / cos, True)
            else:
                bevels += 1
                pair(q, -ay, ax, True)
                pair(q, -by, bx, True)
        else:
            ux, uy = unit[min(i, len(unit) - 1)]
            pair(q, -uy, ux, i > 0)
    return v, t, miters, bevels


#: Rings of one shape that are clipped together: fewer, or longer ones, are triangulated one by one.
TOGETHER, CORNERS, BLOCK = 16, 24, 1 << 21


def _cross(x: np.ndarray, y: np.ndarray, a, b, c) -> np.ndarray:
    return (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])


def _bridged_alike(x: np.ndarray, y: np.ndarray, outer: np.ndarray, holes: list[np.ndarray]) -> np.ndarray:
    """_bridged() of many rings whose outers and holes have the same lengths; holes come rightmost first.  A row of positions a ring."""
    ring = outer
    rows = np.arange(len(ring))
    around = lambda r: (r, np.roll(r, -1, axis=1))
    for hole in holes:
        k = x[hole].argmax(axis=1)
        at_hole = hole[rows, k]
        order = np.argsort((x[ring] - x[at_hole][:, None]) ** 2 + (y[ring] - y[at_hole][:, None]) ** 2, axis=1, kind="stable")
        u, v = (np.concatenate(e, axis=1)[:, None, :] for e in zip(around(ring), *map(around, holes), strict=True))
        a, b = ring[:, :, None], at_hole[:, None, None]
        meets = lambda p, q: (x[p] == x[q]) & (y[p] == y[q])
        apart = ~(meets(u, a) | meets(u, b) | meets(v, a) | meets(v, b))
        blocked = apart & (np.sign(_cross(x, y, a, b, u)) * np.sign(_cross(x, y, a, b, v)) <= 0) & (np.sign(_cross(x, y, u, v, a)) * np.sign(_cross(x, y, u, v, b)) <= 0)
        sees = np.take_along_axis(~blocked.any(axis=2), order, axis=1)
        at = order[rows, sees.argmax(axis=1)][:, None]  # the nearest, if none is seen
        h = hole.shape[1]
        j = np.arange(ring.shape[1] + h + 2)[None, :]
        old = np.where(j <= at, j, np.maximum(j - h - 2, 0))
        turned = np.take_along_axis(hole, (k[:, None] + np.clip(j - at - 1, 0, h)) % h, axis=1)
        ring = np.where((j <= at) | (j > at + h + 1), np.take_along_axis(ring, np.minimum(old, ring.shape[1] - 1), axis=1), turned)
    return ring


def _ears(x: np.ndarray, y: np.ndarray, ring: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, corners) of the ears of many rings of one length, each row in the order in which triangulate() cuts them."""
    found, of = [], []
    while ring.shape[1] > 3:
        n = ring.shape[1]
        a, b, c = np.roll(ring, 1, axis=1), ring, np.roll(ring, -1, axis=1)
        turn = _cross(x, y, a, b, c)
        u, v, w, q = a[:, :, None], b[:, :, None], c[:, :, None], ring[:, None, :]
        corner = ((x[q] == x[u]) & (y[q] == y[u])) | ((x[q] == x[v]) & (y[q] == y[v])) | ((x[q] == x[w]) & (y[q] == y[w]))
        held = ~corner & (_cross(x, y, u, v, q) >= 0) & (_cross(x, y, v, w, q) >= 0) & (_cross(x, y, w, u, q) >= 0)
        ear = (turn > 0) & ~held.any(axis=2)
        has = ear.any(axis=1)
        at = np.where(has, ear.argmax(axis=1), (turn == 0).argmax(axis=1))
        k = np.flatnonzero(has)
        of.append(k)
        found.append(np.stack([a[k, at[k]], b[k, at[k]], c[k, at[k]]], axis=1))
        ring = ring[np.arange(n)[None, :] != at[:, None]].reshape(-1, n - 1)
    k = np.flatnonzero(_cross(x, y, *ring.T) > 0)
    of, found = np.concatenate([*of, k]), np.concatenate([*found, ring[k]])
    order = np.argsort(of, kind="stable")
    return of[order], found[order]


def _opened(r: Ragged) -> Ragged:
    at = r.at
    keep = np.ones(len(r.x), bool)
    last, first = at[1:][r.sizes > 1] - 1, at[:-1][r.sizes > 1]
    keep[last[(r.x[first] == r.x[last]) & (r.y[first] == r.y[last])]] = False
    return r.keep(keep)


def fills(outer: Ragged, holes: Ragged, hole_of: np.ndarray) -> tuple[Ragged, np.ndarray, np.ndarray]:
    """(vertices, triangles, feature of each triangle): what triangulate() makes of every ring with its holes, numbers running
    through all vertices.  hole_of: the ring of each hole, ascending.

    Strictly convex rings without holes give fans; other rings are clipped together by the lengths of their outer and holes."""
    outer, holes = _opened(outer), _opened(holes)
    some = outer.sizes >= 3
    keep = np.flatnonzero((holes.sizes >= 3) & some[hole_of])
    holes, hole_of = holes.take(keep), hole_of[keep]
    # One list of rings: every outer and then its holes.
    of = np.concatenate([np.flatnonzero(some), hole_of])
    order = np.argsort(of, kind="stable")
    both = Ragged(*(np.concatenate([o, h]).astype(np.int64) for o, h in ((outer.x, holes.x), (outer.y, holes.y))), np.concatenate([outer.sizes, holes.sizes]))
    rings = both.take(np.concatenate([np.flatnonzero(some), len(outer.sizes) + np.arange(len(holes.sizes))])[order])
    of = of[order]
    vertices = Ragged(rings.x, rings.y, np.bincount(of, weights=rings.sizes, minlength=len(outer.sizes)).astype(np.int64))
    if not len(of):
        return vertices, np.zeros((0, 3), np.int64), of
    is_outer = np.diff(of, prepend=-1) > 0
    x, y, at = rings.x, rings.y, rings.at
    before, after = rings.beside()
    every = np.arange(len(x))
    area2 = rings.least(x * y[after] - x[after] * y, np.add)
    forward = (area2 > 0) == is_outer
    turn = _cross(x, y, before, every, after) * np.where(area2 > 0, 1, -1)[rings.row]
    dx, dy = x[after] - x, y[after] - y
    up = (dy > 0) | ((dy == 0) & (dx > 0))
    once = rings.least((up & ~up[before]).astype(np.int64), np.add) == 1
    n_holes = np.bincount(hole_of, minlength=len(outer.sizes))
    fan = np.flatnonzero(is_outer & (n_holes[of] == 0) & (rings.least(turn) > 0) & once)
    made, made_of = [], []

    def flat(r, j):
        """Position of the j-th vertex of rings r in the direction in which they are clipped."""
        return np.where(forward[r], at[r] + j, at[r + 1] - 1 - j)

    n = rings.sizes[fan] - 2
    r, j = np.repeat(fan, n), spread(np.zeros(len(n), np.int64), n)
    made.append(np.stack([flat(r, rings.sizes[r] - 1), flat(r, j), flat(r, j + 1)], axis=1))
    made_of.append(of[r])
    # The others, by their lengths; holes rightmost first.
    right = rings.least(x, np.maximum)
    alike: dict[tuple, list[list[int]]] = {}
    is_fan = np.zeros(len(of), bool)
    is_fan[fan] = True
    ends = np.append(np.flatnonzero(is_outer), len(of))
    sizes = rings.sizes.tolist()
    for i, end in zip(ends[:-1][~is_fan[ends[:-1]]].tolist(), ends[1:][~is_fan[ends[:-1]]].tolist(), strict=True):
        mine = [i, *(sorted(range(i + 1, end), key=lambda h: -right[h]) if end > i + 2 else range(i + 1, end))]
        alike.setdefault(tuple([sizes[m] for m in mine]), []).append(mine)
    for shape, members in alike.items():
        corners = sum(shape) + 2 * len(shape) - 2
        if len(members) < TOGETHER or corners > CORNERS:
            for mine in members:
                first, last = at[mine[0]], at[max(mine) + 1]
                points = list(zip(x[first:last].tolist(), y[first:last].tolist(), strict=True))
                cuts = [[*points[lo - first : hi - first], points[lo - first]] for lo, hi in ((at[m], at[m + 1]) for m in sorted(mine))]  # closed, as triangulate() opens rings once
                _, t = triangulate(cuts[0], cuts[1:])
                made.append(np.array(t, np.int64).reshape(-1, 3) + first)
                made_of.append(np.full(len(t), of[mine[0]]))
            continue
        step = max(1, BLOCK // corners**2)
        for lo in range(0, len(members), step):
            m = np.array(members[lo : lo + step])
            own = [flat(m[:, k][:, None], np.arange(size)[None, :]) for k, size in enumerate(shape)]
            row, t = _ears(x, y, _bridged_alike(x, y, own[0], own[1:]))
            made.append(t)
            made_of.append(of[m[row, 0]])
    made, made_of = np.concatenate(made), np.concatenate(made_of)
    order = np.argsort(made_of, kind="stable")
    return vertices, made[order], made_of[order]


def ribbons(lines: Ragged, miter_limit: float = MITER_LIMIT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(vertices, vertices a line, miters a line, bevels a line): what ribbon() makes of every line.

    Vertices are rows (x, y, normal x, normal y, distance) in pairs; each pair of a line after its first is joined to the one
    before by two triangles."""
    keep = np.ones(len(lines.x), bool)
    row = lines.row
    keep[1:] = (row[1:] != row[:-1]) | (lines.x[1:] != lines.x[:-1]) | (lines.y[1:] != lines.y[:-1])
    r = lines.keep(keep)
    long = np.flatnonzero(r.sizes >= 2)
    n_lines, r = len(lines.sizes), r.take(long)
    x, y, row, at = r.x.astype(np.float64), r.y.astype(np.float64), r.row, r.at
    first, last = np.zeros(len(x), bool), np.zeros(len(x), bool)
    first[at[:-1]], last[at[1:] - 1] = True, True
    a = np.flatnonzero(~last)
    dx, dy, step = np.zeros(len(x)), np.zeros(len(x)), np.zeros(len(x))
    dx[a], dy[a] = x[a + 1] - x[a], y[a + 1] - y[a]
    step[a] = np.sqrt(dx[a] ** 2 + dy[a] ** 2)
    size = np.where(last, 1.0, step)
    ux, uy = dx / size, dy / size
    far = np.concatenate([[0.0], np.cumsum(step)[:-1]]) if len(x) else step
    far = far - np.repeat(far[at[:-1]], r.sizes)
    prior = np.where(first, np.arange(len(x)), np.arange(len(x)) - 1)
    ax, ay = np.where(first, ux, ux[prior]), np.where(first, uy, uy[prior])
    bx, by = np.where(last, ax, ux), np.where(last, ay, uy)
    mx, my = -(ay + by), ax + bx
    n = np.sqrt(mx**2 + my**2)
    cos = np.where(n > 1e-9, (mx * -ay + my * ax) / np.where(n > 1e-9, n, 1.0), 0.0)
    inner = ~first & ~last
    miter = inner & (cos > 1e-9) & (1 / np.where(cos > 1e-9, cos, 1.0) <= miter_limit)
    bevel = inner & ~miter
    by_miter = np.where(miter, n * cos, 1.0)
    nx, ny = np.where(miter, mx / by_miter, -ay), np.where(miter, my / by_miter, ax)
    k = np.repeat(np.arange(len(x)), 1 + bevel)
    second = np.zeros(len(k), bool)
    second[1:] = k[1:] == k[:-1]
    nx, ny = np.where(second, -by[k], nx[k]), np.where(second, bx[k], ny[k])
    v = np.stack([x[k], y[k], nx, ny, far[k]], axis=1)
    v = np.repeat(v, 2, axis=0)
    v[1::2, 2:4] *= -1.0
    count = lambda mask, each=1: np.bincount(long[row[mask]], minlength=n_lines) * each
    return v, np.bincount(long[row[k]], minlength=n_lines) * 2, count(miter), count(bevel)


MESH = "z int, x int, y int, kind string, class string, material string, first int, triangles int, vertices int, area double, miters int, bevels int"
PIECE = "z int, x int, y int, range int, triangles long, vertices long, area double, miters long, bevels long"
LINE_ORDER = ("Boundary", *ROAD_ORDER)
#: Ranges in the order of their buckets: kind, class and material (buildings) or level (lines).
RANGES = [("fill", c, None) for c in FILL_ORDER] + [("line", c, step) for c in LINE_ORDER for step in LEVELS] + [("building", "Building", m) for m in style.MATERIALS]


def _pieces(batch: pa.RecordBatch, lod: str, miter_limit: float):
    """(rows, range, triangles, vertices, area, miters, bevels) of the meshes of a batch's fills, lines and buildings."""
    coded = batch.column("class").dictionary_encode()
    names, code = [*coded.dictionary.to_pylist(), None], coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    lines, inner = flat_points(batch.column("vertices")), batch.column("holes").flatten()
    holes, hole_of = flat_points(inner), np.repeat(np.arange(batch.num_rows), batch.column("holes").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    place = {(c, m): n for n, (_, c, m) in enumerate(RANGES)}
    fill = np.array([place.get((c, None), -1) for c in names])[code]
    rows = np.flatnonzero(fill >= 0)
    mine = np.flatnonzero(fill[hole_of] >= 0)
    vertices, t, of = fills(lines.take(rows), holes.take(mine), np.searchsorted(rows, hole_of[mine]))
    area = np.abs(_cross(vertices.x, vertices.y, *t.T)) / 2
    none = np.zeros(len(rows), np.int64)
    yield rows, fill[rows], np.bincount(of, minlength=len(rows)), vertices.sizes, np.bincount(of, weights=area, minlength=len(rows)), none, none

    base = np.array([place.get((c, LEVELS[0]), -1) for c in names])[code]
    rows = np.flatnonzero(base >= 0)
    flags = batch.column("flags").take(pa.array(rows)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    step = np.where(flags & style.FLAG_TUNNEL, 0, np.where(flags & style.FLAG_BRIDGE, 2, 1))
    v, n, miters, bevels = ribbons(lines.take(rows), miter_limit)
    # Both vertices of a pair lie on the line, so no triangle has an area before a width moves them along their normals.
    yield rows, base[rows] + step, np.maximum(n - 2, 0), n, np.zeros(len(rows)), miters, bevels

    known = np.flatnonzero(batch.column("building").is_valid().to_numpy(zero_copy_only=False))
    held = [(i, b) for i, b in zip(known.tolist(), batch.column("building").take(pa.array(known)).to_pylist(), strict=True) if b and ("Building", b["material"]) in place]
    at, x, y = lines.at, lines.x, lines.y
    made = [building(list(zip(x[at[i] : at[i + 1]].astype(np.int64).tolist(), y[at[i] : at[i + 1]].astype(np.int64).tolist(), strict=True)), b, lod) for i, b in held]
    rows, none = np.array([i for i, _ in held], np.int64), np.zeros(len(held), np.int64)
    yield rows, np.array([place["Building", b["material"]] for _, b in held], np.int64), np.array([len(t) for _, t in made], np.int64), np.array([len(v) for v, _ in made], np.int64), np.array([triangles_area([q[:2] for q in v], t) for v, t in made], np.float64), none, none


def _piece_batches(batches, schema: T.StructType, lod: str, miter_limit: float):
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(schema)
    for batch in batches:
        for rows, *own in _pieces(batch, lod, miter_limit):
            if len(rows):
                tile = [batch.column(c).take(pa.array(rows)) for c in ("z", "x", "y")]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip((*tile, *map(pa.array, own)), shape, strict=True)], schema=shape)


def pieces(features: DataFrame, lod: str = "full", miter_limit: float = MITER_LIMIT) -> DataFrame:
    """A row per mesh of a part: its tile, the number of its range, and the mesh's sizes."""
    own = features.select("z", "x", "y", "class", "flags", "building", "vertices", "holes")
    schema = T._parse_datatype_string(PIECE)
    return own.mapInArrow(lambda batches: _piece_batches(batches, schema, lod, miter_limit), schema)


def cut_pieces(features: DataFrame, levels: list[int], lod: str = "full", miter_limit: float = MITER_LIMIT) -> DataFrame:
    """pieces() of the parts of features, which stay in the Python worker that cuts them."""
    part, schema = T._parse_datatype_string(parts.PART), T._parse_datatype_string(PIECE)
    return parts.ready(features, levels).mapInArrow(lambda batches: _piece_batches(parts.cut_batches(batches, part), schema, lod, miter_limit), schema)


def summed(pieces: DataFrame) -> DataFrame:
    """The buckets of pieces."""
    total = lambda c, kind="int": F.sum(c).cast(kind).alias(c)
    held = pieces.groupBy("z", "x", "y", "range").agg(total("triangles"), total("vertices"), total("area", "double"), total("miters"), total("bevels")).where("triangles > 0")
    known = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(c).alias("class"), F.lit(m).cast("string").alias("material")) for k, c, m in RANGES))
    held = held.withColumn("at", F.element_at(known, F.col("range") + 1))
    before = Window.partitionBy("z", "x", "y", "at.kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("triangles").over(before), F.lit(0)).cast("int")
    return held.select("z", "x", "y", "at.kind", "at.class", "at.material", first.alias("first"), "triangles", "vertices", "area", "miters", "bevels")


def buckets(features: DataFrame, lod: str = "full", miter_limit: float = MITER_LIMIT) -> DataFrame:
    """One row per tile and contiguous range: fills in class order, lines from path to motorway under ground over, buildings by
    material; `first` is the range's first triangle in its bucket.  features: z, x, y, class (name), flags, building, vertices, holes.

    Features are meshed where they are and only the sizes of their meshes are shuffled, so a tile may hold any number of them."""
    return summed(pieces(features, lod, miter_limit))


def ground_vertices(spark: SparkSession, cells: int) -> DataFrame:
    """(i, j, x, y): a tile's grid of (cells + 1) squared vertices."""
    at = lambda c: F.round(F.col(c) / float(cells) * 65535.0).cast("int")
    g = spark.range((cells + 1) ** 2).select((F.col("id") % (cells + 1)).cast("int").alias("i"), F.floor(F.col("id") / (cells + 1)).cast("int").alias("j"))
    return g.select("i", "j", at("i").alias("x"), at("j").alias("y"))


def ground_triangles(spark: SparkSession, cells: int) -> DataFrame:
    """(ordinal, a, b, c): two triangles a cell."""
    side = cells + 1
    g = spark.range(2 * cells * cells).withColumn("cell", F.floor(F.col("id") / 2))
    corner = F.floor(F.col("cell") / cells) * side + F.col("cell") % cells
    second = F.col("id") % 2 == 1
    pick = lambda first, other: F.when(second, corner + other).otherwise(corner + first).cast("int")
    return g.select(F.col("id").alias("ordinal"), corner.cast("int").alias("a"), pick(1, side + 1).alias("b"), pick(side + 1, side).alias("c"))


def road_plan(spark: SparkSession) -> DataFrame:
    """The forty-eight passes in drawing order: level, casing before fill, class by rank."""
    classes = ("Boundary", *ROAD_ORDER)
    rows = [(i, *r) for i, r in enumerate((level, step, c) for level in LEVELS for step in PASSES for c in classes)]
    return spark.createDataFrame(rows, "ordinal int, level string, step string, class string")


def label_bucket(features: DataFrame) -> DataFrame:
    """(z, x, y, class, id, rank, name, ax, ay) of named features: roads at their half-way point, others at the first vertex."""
    named = features.where((F.col("name") != "") & ~F.col("class").isin("Land", "Water", "Park", "Building", "Boundary"))
    first = F.col("vertices")[0]
    mid = arrays.midpoint(F.col("vertices"))
    road = style.road_rank(F.col("class")).isNotNull()
    pick = lambda c: F.when(road, mid[c]).otherwise(first[c].cast("double")).cast("int")
    return named.select("z", "x", "y", "class", "id", "rank", "name", pick("x").alias("ax"), pick("y").alias("ay"))


def material_ranges(buildings: DataFrame, tile: tuple[str, ...], order: str, material: str = "material") -> DataFrame:
    """Runs of one material in each tile's buildings, sorted by material and then by `order`: material, first (from 0) and n.

    A null material is a run of its own, before the others; equal rows stand side by side in one run."""
    by = Window.partitionBy(*tile).orderBy(F.col(material).asc_nulls_first(), order)
    at = buildings.withColumn("at", F.row_number().over(by) - 1)
    new = at.withColumn("new", ((F.col("at") == 0) | ~F.lag(material).over(by).eqNullSafe(F.col(material))).cast("int"))
    run = new.withColumn("run", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy(*tile, "run").agg(F.first(material).alias(material), F.min("at").alias("first"), F.count("*").alias("n"))
