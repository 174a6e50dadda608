"""Plain geometry on WKB: parsing and writing, measures, closed intersection tests, cell masks and outlines.

A geometry is (kind, coordinates) as in GeoJSON; rings are lists of (x, y). Touching counts as intersecting.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np

from tilewright.cube import RasterError

# Geometry kinds by WKB code.
KINDS = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
CODES = {v: k for k, v in KINDS.items()}
Geometry = tuple


def rectangle(xmin: float, ymin: float, xmax: float, ymax: float) -> Geometry:
    """Upper left, upper right, lower right, lower left."""
    return "Polygon", [[(xmin, ymax), (xmax, ymax), (xmax, ymin), (xmin, ymin), (xmin, ymax)]]


# ---- WKB, WKT, GeoJSON ----


def to_wkb(geometry: Geometry) -> bytes:
    kind, coords = geometry
    head = struct.pack("<BI", 1, CODES[kind])
    if kind == "Point":
        return head + struct.pack("<dd", *coords)
    if kind == "LineString":
        return head + struct.pack("<I", len(coords)) + b"".join(struct.pack("<dd", *p) for p in coords)
    if kind == "Polygon":
        return head + struct.pack("<I", len(coords)) + b"".join(struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r) for r in coords)
    inner = {"MultiPoint": "Point", "MultiLineString": "LineString", "MultiPolygon": "Polygon"}.get(kind)
    parts = coords if inner is None else [(inner, c) for c in coords]
    return head + struct.pack("<I", len(parts)) + b"".join(to_wkb(p) for p in parts)


def from_wkb(data: bytes) -> Geometry:
    def read(at: int) -> tuple[Geometry, int]:
        order = "<" if data[at] else ">"
        code = struct.unpack_from(order + "I", data, at + 1)[0]
        at += 5
        dims = 2
        if code & 0x20000000:  # EWKB: a reference system stands first
            at += 4
        dims += bool(code & 0x80000000) + bool(code & 0x40000000)
        code &= 0x0FFFFFFF
        dims += (0, 1, 1, 2)[code // 1000] if code >= 1000 else 0
        kind = KINDS.get(code % 1000)
        if kind is None:
            raise RasterError(f"Unknown geometry type: {code}")

        def points(n: int, at: int) -> tuple[list, int]:
            flat = struct.unpack_from(f"{order}{dims * n}d", data, at)
            return list(zip(flat[::dims], flat[1::dims])), at + 8 * dims * n

        if kind == "Point":
            found, at = points(1, at)
            return (kind, found[0]), at
        n = struct.unpack_from(order + "I", data, at)[0]
        at += 4
        if kind == "LineString":
            found, at = points(n, at)
            return (kind, found), at
        out = []
        for _ in range(n):
            if kind == "Polygon":
                m = struct.unpack_from(order + "I", data, at)[0]
                found, at = points(m, at + 4)
            else:
                found, at = read(at)
                found = found if kind == "GeometryCollection" else found[1]
            out.append(found)
        return (kind, out), at

    try:
        return read(0)[0]
    except (struct.error, IndexError) as e:
        raise RasterError("Invalid WKB") from e


def from_wkt(text: str) -> Geometry:
    tokens = re.findall(r"[A-Za-z]+|[-+0-9.eE]+|[(),]", text.split(";", 1)[-1] if text.upper().startswith("SRID=") else text)
    at = 0

    def numbers() -> tuple[float, float]:
        nonlocal at
        values = []
        while at < len(tokens) and tokens[at] not in "(),":
            values.append(float(tokens[at]))
            at += 1
        return values[0], values[1]

    def listed(item):
        nonlocal at
        if tokens[at].upper() == "EMPTY":
            at += 1
            return []
        at += 1
        out = [item()]
        while tokens[at] == ",":
            at += 1
            out.append(item())
        at += 1
        return out

    def bracketed():
        return listed(numbers)[0] if tokens[at] == "(" else numbers()

    def geometry() -> Geometry:
        nonlocal at
        kind = next((k for k in CODES if k.upper() == tokens[at].upper()), None)
        if kind is None:
            raise RasterError(f"Unknown geometry type: {tokens[at]}")
        at += 1
        if tokens[at].upper() in ("Z", "M", "ZM"):
            at += 1
        if kind == "Point":
            return kind, bracketed()
        if kind == "GeometryCollection":
            return kind, listed(geometry)
        depth = {"LineString": 0, "MultiPoint": 0, "Polygon": 1, "MultiLineString": 1, "MultiPolygon": 2}[kind]
        item = bracketed if kind == "MultiPoint" else numbers
        for _ in range(depth):
            item = (lambda inner: lambda: listed(inner))(item)
        return kind, listed(item)

    try:
        return geometry()
    except (IndexError, ValueError) as e:
        raise RasterError(f"Invalid WKT: {text[:60]}") from e


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() and abs(x) < 1e15 else repr(float(x))


def to_wkt(geometry: Geometry) -> str:
    kind, coords = geometry

    def body(c, depth: int) -> str:
        if depth == 0:
            return f"{_number(c[0])} {_number(c[1])}"
        return "(" + ", ".join(body(x, depth - 1) for x in c) + ")"

    if kind == "GeometryCollection":
        return f"GEOMETRYCOLLECTION ({', '.join(map(to_wkt, coords))})" if coords else "GEOMETRYCOLLECTION EMPTY"
    if not len(coords):
        return f"{kind.upper()} EMPTY"
    depth = {"Point": 0, "LineString": 1, "MultiPoint": 1, "Polygon": 2, "MultiLineString": 2, "MultiPolygon": 3}[kind]
    return f"{kind.upper()} ({body(coords, 0)})" if kind == "Point" else f"{kind.upper()} {body(coords, depth)}"


def from_geojson(text: str) -> Geometry:
    value = json.loads(text)
    if value["type"] == "FeatureCollection":
        return "GeometryCollection", [from_geojson(json.dumps(f)) for f in value["features"]]
    if value["type"] == "Feature":
        value = value["geometry"]
    if value["type"] == "GeometryCollection":
        return "GeometryCollection", [from_geojson(json.dumps(g)) for g in value["geometries"]]

    def pairs(c):
        return (float(c[0]), float(c[1])) if c and isinstance(c[0], (int, float)) else [pairs(x) for x in c]

    return value["type"], pairs(value["coordinates"])


def to_geojson(geometry: Geometry) -> str:
    kind, coords = geometry
    if kind == "GeometryCollection":
        return json.dumps({"type": kind, "geometries": [json.loads(to_geojson(g)) for g in coords]})
    return json.dumps({"type": kind, "coordinates": coords})


@lru_cache(maxsize=256)
def parsed(wkb: bytes) -> Geometry:
    return from_wkb(wkb)


# ---- measures ----


def polygons(geometry: Geometry) -> list[list]:
    """The polygons (lists of rings) of a geometry."""
    kind, coords = geometry
    if kind == "Polygon":
        return [coords] if coords else []
    if kind == "MultiPolygon":
        return list(coords)
    if kind == "GeometryCollection":
        return [p for g in coords for p in polygons(g)]
    return []


def segments(geometry: Geometry) -> np.ndarray:
    """All edges, n x 4; a lone point is an edge of length 0."""
    kind, coords = geometry
    lines = {"Point": lambda: [[coords, coords]], "MultiPoint": lambda: [[p, p] for p in coords], "LineString": lambda: [coords], "MultiLineString": lambda: coords, "Polygon": lambda: coords, "MultiPolygon": lambda: [r for p in coords for r in p]}
    if kind == "GeometryCollection":
        parts = [segments(g) for g in coords]
        return np.concatenate(parts) if parts else np.zeros((0, 4))
    out = [np.concatenate([np.asarray(line[:-1], float), np.asarray(line[1:], float)], axis=1) for line in lines[kind]() if len(line) > 1]
    return np.concatenate(out) if out else np.zeros((0, 4))


def _ring_area(ring) -> float:
    if len(ring) <= 64:  # an array would cost more than it saves
        ox, oy = ring[0]
        return float(sum((ax - ox) * (by - oy) - (bx - ox) * (ay - oy) for (ax, ay), (bx, by) in zip(ring, ring[1:]))) / 2
    p = np.asarray(ring, float)
    p = p - p[0]
    return float(np.sum(p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1])) / 2


def area(geometry: Geometry) -> float:
    return sum(abs(_ring_area(p[0])) - sum(abs(_ring_area(r)) for r in p[1:]) for p in polygons(geometry))


def perimeter(geometry: Geometry) -> float:
    s = segments(("MultiPolygon", polygons(geometry)))
    return float(np.hypot(s[:, 2] - s[:, 0], s[:, 3] - s[:, 1]).sum())


def envelope(geometry: Geometry) -> tuple[float, float, float, float] | None:
    s = segments(geometry)
    if not len(s):
        return None
    return float(s[:, [0, 2]].min()), float(s[:, [1, 3]].min()), float(s[:, [0, 2]].max()), float(s[:, [1, 3]].max())


# ---- columns of polygons of one ring of five points ----

_RING = np.dtype([("order", "u1"), ("kind", "<u4"), ("rings", "<u4"), ("points", "<u4"), ("ring", "<f8", (10,))])


def ring_wkb(rings: np.ndarray) -> list[bytes]:
    """WKB of polygons with one ring of five points each, n x 10: they all have the same layout."""
    out = np.zeros(len(rings), _RING)
    out["order"], out["kind"], out["rings"], out["points"], out["ring"] = 1, 3, 1, 5, rings
    raw = out.tobytes()
    return [raw[i : i + _RING.itemsize] for i in range(0, len(raw), _RING.itemsize)]


def point_wkb(x: np.ndarray, y: np.ndarray) -> list[bytes]:
    out = np.zeros(len(x), np.dtype([("order", "u1"), ("kind", "<u4"), ("x", "<f8"), ("y", "<f8")]))
    out["order"], out["kind"], out["x"], out["y"] = 1, 1, x, y
    raw = out.tobytes()
    return [raw[i : i + 21] for i in range(0, len(raw), 21)]


def rings_of(shapes) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow column of WKB: the rows that are such polygons, and their points, n x 5 x 2."""
    blobs = shapes.to_pylist()
    rows = np.array([i for i, b in enumerate(blobs) if b is not None and len(b) == _RING.itemsize], np.int64)
    found = np.frombuffer(b"".join(blobs[i] for i in rows.tolist()), _RING)
    same = (found["order"] == 1) & (found["kind"] == 3) & (found["rings"] == 1) & (found["points"] == 5)
    return rows[same], found["ring"][same].reshape(-1, 5, 2)


def boxes_of(shapes) -> tuple[np.ndarray, np.ndarray]:
    """Of an Arrow column of WKB: the rows that are axis-parallel rectangles, and xmin, ymin, xmax, ymax of each."""
    rows, rings = rings_of(shapes)
    closed = (rings[:, 0] == rings[:, 4]).all(axis=1)
    along_x = (rings[:, :-1, 1] == rings[:, 1:, 1]) & (rings[:, :-1, 0] != rings[:, 1:, 0])
    along_y = (rings[:, :-1, 0] == rings[:, 1:, 0]) & (rings[:, :-1, 1] != rings[:, 1:, 1])
    turns = np.where(along_x, 1, np.where(along_y, 2, 0))
    square = closed & (turns.min(axis=1, initial=3) > 0) & (turns[:, 0] != turns[:, 1]) & (turns[:, 1] != turns[:, 2]) & (turns[:, 2] != turns[:, 3])
    return rows[square], np.concatenate([rings[square].min(axis=1), rings[square].max(axis=1)], axis=1)


def ring_areas(rings: np.ndarray) -> np.ndarray:
    p = rings - rings[:, :1]
    return np.abs((p[:, :-1, 0] * p[:, 1:, 1] - p[:, 1:, 0] * p[:, :-1, 1]).sum(axis=1)) / 2


def ring_lengths(rings: np.ndarray) -> np.ndarray:
    d = np.diff(rings, axis=1)
    return np.hypot(d[:, :, 0], d[:, :, 1]).sum(axis=1)


# ---- predicates ----


def inside(geometry: Geometry, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Points inside the polygons by the even-odd rule of each polygon; points on an edge may go either way."""
    out = np.zeros(np.broadcast(x, y).shape, bool)
    for rings in polygons(geometry):
        odd = np.zeros(out.shape, bool)
        for x0, y0, x1, y1 in segments(("Polygon", rings)):
            if y0 != y1:
                cross = (y0 > y) != (y1 > y)
                odd ^= cross & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
        out |= odd
    return out


def _side(ax, ay, bx, by, cx, cy):
    return np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def _segments_meet(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether any closed segment of s meets any of t."""
    for x0, y0, x1, y1 in s:
        near = (np.minimum(t[:, 0], t[:, 2]) <= max(x0, x1)) & (np.maximum(t[:, 0], t[:, 2]) >= min(x0, x1)) & (np.minimum(t[:, 1], t[:, 3]) <= max(y0, y1)) & (np.maximum(t[:, 1], t[:, 3]) >= min(y0, y1))
        if near.any():
            u = t[near]
            a, b = _side(x0, y0, x1, y1, u[:, 0], u[:, 1]), _side(x0, y0, x1, y1, u[:, 2], u[:, 3])
            c, d = _side(u[:, 0], u[:, 1], u[:, 2], u[:, 3], x0, y0), _side(u[:, 0], u[:, 1], u[:, 2], u[:, 3], x1, y1)
            if ((a * b <= 0) & (c * d <= 0)).any():
                return True
    return False


def intersects(a: Geometry, b: Geometry) -> bool:
    """Whether two geometries share a point, edges included."""
    ea, eb = envelope(a), envelope(b)
    if ea is None or eb is None or ea[0] > eb[2] or eb[0] > ea[2] or ea[1] > eb[3] or eb[1] > ea[3]:
        return False
    s, t = segments(a), segments(b)
    if _segments_meet(s, t):
        return True
    starts = lambda g: (lambda z: (z[:, 0], z[:, 1]))(segments(g))
    return bool(inside(b, *starts(a)).any() or inside(a, *starts(b)).any())


def rectangles_meet(geometry: Geometry, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Which closed rectangles (x0 <= x1, y0 <= y1, arrays of one shape) share a point with the geometry."""
    out = np.zeros(x0.shape, bool)
    for ax, ay, bx, by in segments(geometry):
        near = (x0 <= max(ax, bx)) & (x1 >= min(ax, bx)) & (y0 <= max(ay, by)) & (y1 >= min(ay, by)) & ~out
        if not near.any():
            continue
        dx, dy = bx - ax, by - ay
        corner = [dx * (y - ay) - dy * (x - ax) for x, y in ((x0[near], y0[near]), (x1[near], y0[near]), (x1[near], y1[near]), (x0[near], y1[near]))]
        low, high = np.minimum.reduce(corner), np.maximum.reduce(corner)
        out[near] = (low <= 0) & (high >= 0)
    rest = ~out
    if rest.any() and polygons(geometry):
        out[rest] = inside(geometry, (x0[rest] + x1[rest]) / 2, (y0[rest] + y1[rest]) / 2)
    return out


def cell_mask(geometry: Geometry, transform, first_col: int, first_row: int, cols: int, rows: int) -> np.ndarray:
    """rows x cols: cells whose closed rectangle meets the geometry. Cells of rotated grids are held by their corners' bounds."""
    return cell_masks(geometry, transform, np.array([first_col]), np.array([first_row]), cols, rows)[0]


def cell_masks(geometry: Geometry, transform, first_col: np.ndarray, first_row: np.ndarray, cols: int, rows: int) -> np.ndarray:
    """cell_mask of many tiles of one size: tiles x rows x cols."""
    g = transform
    mask = np.zeros((len(first_col), rows, cols), bool)
    box = envelope(geometry)
    if box is None or not mask.size:
        return mask
    c, r = np.meshgrid(np.arange(cols, dtype=float), np.arange(rows, dtype=float))
    c, r = first_col[:, None, None] + c, first_row[:, None, None] + r
    xs = [g[0] + g[1] * (c + i) + g[2] * (r + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
    ys = [g[3] + g[4] * (c + i) + g[5] * (r + j) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1))]
    x0, x1, y0, y1 = np.minimum.reduce(xs), np.maximum.reduce(xs), np.minimum.reduce(ys), np.maximum.reduce(ys)
    near = (x0 <= box[2]) & (x1 >= box[0]) & (y0 <= box[3]) & (y1 >= box[1])
    if near.any():
        mask[near] = rectangles_meet(geometry, x0[near], y0[near], x1[near], y1[near])
    return mask


# ---- outlines ----


def outline(mask: np.ndarray) -> list[list[list[tuple[int, int]]]]:
    """The polygons of a mask's cells as rings of grid corners (column, row); cells that touch at a corner only are apart.

    Boundary edges run with the cell on their right, and are joined to rings by turning towards it.
    """
    padded = np.pad(mask, 1)
    edges: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def add(rows, cols, start, step):
        for r, c in zip(rows.tolist(), cols.tolist()):
            edges.setdefault((c + start[0], r + start[1]), []).append(step)

    add(*np.nonzero(mask & ~padded[:-2, 1:-1]), (0, 0), (1, 0))
    add(*np.nonzero(mask & ~padded[1:-1, 2:]), (1, 0), (0, 1))
    add(*np.nonzero(mask & ~padded[2:, 1:-1]), (1, 1), (-1, 0))
    add(*np.nonzero(mask & ~padded[1:-1, :-2]), (0, 1), (0, -1))
    shells, holes = [], []
    while edges:
        start = next(iter(edges))
        at, step = start, edges[start][0]
        ring, corner = [], None
        while True:
            steps = edges[at]
            if corner is not None:
                right = (-step[1], step[0])  # towards the cell on the right
                step = next(s for s in (right, step, (step[1], -step[0])) if s in steps)
            if corner != step:
                ring.append(at)
                corner = step
            steps.remove(step)
            if not steps:
                del edges[at]
            at = (at[0] + step[0], at[1] + step[1])
            if at == start and (at not in edges or (-step[1], step[0]) not in edges[at]):
                break
        if len(ring) > 2 and (ring[-1][0] == ring[0][0] == ring[1][0] or ring[-1][1] == ring[0][1] == ring[1][1]):
            ring = ring[1:]
        ring.append(ring[0])
        (shells if _ring_area(ring) > 0 else holes).append(ring)
    out = [[ring] for ring in shells]
    if holes:
        boxes = [(min(x for x, _ in ring), min(y for _, y in ring), max(x for x, _ in ring), max(y for _, y in ring)) for ring in shells]
        areas = [abs(_ring_area(r)) for r in shells]
    for hole in holes:
        # a point just inside the ring of cells that surrounds the hole
        (x0, y0), (x1, y1) = hole[0], hole[1]
        dx, dy = (x1 > x0) - (x1 < x0), (y1 > y0) - (y1 < y0)
        px, py = x0 + 0.5 * dx - 0.5 * dy, y0 + 0.5 * dy + 0.5 * dx
        near = [i for i, box in enumerate(boxes) if box[0] < px < box[2] and box[1] < py < box[3]]
        own = near[0] if len(near) == 1 else min((i for i in near if _surrounds(shells[i], px, py)), key=areas.__getitem__)
        out[own].append(hole)
    return out


def _surrounds(ring: list[tuple[int, int]], x: float, y: float) -> bool:
    """Whether a ring of axis-parallel edges surrounds a point that lies on none of its lines."""
    return sum(ax == bx and ax > x and (ay > y) != (by > y) for (ax, ay), (bx, by) in zip(ring, ring[1:])) % 2 == 1


def mask_geometry(mask: np.ndarray, transform, first_col: int, first_row: int) -> Geometry | None:
    """The union of a mask's cells in world coordinates; None without cells."""
    if not mask.any():
        return None
    g = transform

    def world(p):
        c, r = p[0] + first_col, p[1] + first_row
        return g[0] + g[1] * c + g[2] * r, g[3] + g[4] * c + g[5] * r

    found = [[[world(p) for p in ring] for ring in rings] for rings in outline(mask)]
    return ("Polygon", found[0]) if len(found) == 1 else ("MultiPolygon", found)
