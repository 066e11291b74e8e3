"""Points near other points, and points within regions, by quadtree partitions and bulk-loaded R-trees."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RADIUS = 6_371_000.0
WORLD = (-180.0, -90.0, 180.0, 90.0)

#: Points that the partitioning may look at on the driver; only how evenly the work is spread depends on them.
SAMPLE = 60_000
#: Points that a leaf should hold, and how many a task should read.
LEAF_POINTS, TASK_POINTS = 20_000, 150_000


#: What a row does in its leaf.
PROBE, PROBED = 1, 2


@dataclass
class QuadTree:
    """Leaves of a quadtree over longitude and latitude, split where the sample is dense. Cells are half-open, so each point has one leaf."""

    box: np.ndarray = field(default_factory=lambda: np.array([WORLD]))
    child: np.ndarray = field(default_factory=lambda: np.full((1, 4), -1))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros(1, int))
    count: np.ndarray = field(default_factory=lambda: np.zeros(1))

    @classmethod
    def of_sample(cls, x: np.ndarray, y: np.ndarray, capacity: float, least: float = 1e-5, world: tuple = WORLD) -> QuadTree:
        """``capacity``: sampled points a leaf may hold; ``least``: width below which a cell isn't split."""
        boxes, children, leaves, counts = [], [], [], []

        def grow(x0: float, y0: float, x1: float, y1: float, at: np.ndarray) -> int:
            me = len(boxes)
            boxes.append((x0, y0, x1, y1)), children.append([-1] * 4), leaves.append(-1), counts.append(len(at))
            if len(at) <= capacity or x1 - x0 < 2 * least:
                return me
            mx, my = (x0 + x1) / 2, (y0 + y1) / 2
            part = (x[at] >= mx) + 2 * (y[at] >= my)
            corners = [(x0, y0, mx, my), (mx, y0, x1, my), (x0, my, mx, y1), (mx, my, x1, y1)]
            children[me] = [grow(*corners[q], at[part == q]) for q in range(4)]
            return me

        grow(*world, np.arange(len(x)))
        n = 0
        for i, c in enumerate(children):
            if c[0] < 0:
                leaves[i], n = n, n + 1
        return cls(np.array(boxes), np.array(children), np.array(leaves), np.array(counts))

    def owner(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), int)
        while len(at := np.flatnonzero(self.leaf[node] < 0)):
            b = self.box[node[at]]
            q = (x[at] >= (b[:, 0] + b[:, 2]) / 2) + 2 * (y[at] >= (b[:, 1] + b[:, 3]) / 2)
            node[at] = self.child[node[at], q]
        return self.leaf[node]

    def touched(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of box, leaf) for all leaves that a box touches."""
        item, node = np.arange(len(x0)), np.zeros(len(x0), int)
        items, found = [], []
        while len(item):
            b = self.box[node]
            hit = (b[:, 0] <= x1[item]) & (b[:, 2] >= x0[item]) & (b[:, 1] <= y1[item]) & (b[:, 3] >= y0[item])
            item, node = item[hit], node[hit]
            done = self.leaf[node] >= 0
            items.append(item[done]), found.append(self.leaf[node[done]])
            item, node = np.repeat(item[~done], 4), self.child[node[~done]].ravel()
        return (np.concatenate(items), np.concatenate(found)) if items else (np.empty(0, int), np.empty(0, int))

    def weights(self) -> np.ndarray:
        out = np.zeros(self.leaf.max() + 1)
        at = self.leaf >= 0
        out[self.leaf[at]] = self.count[at]
        return out


class RTree:
    """A bulk-loaded R-tree (sort-tile-recursive) over boxes; probes go down level by level for all queries at once."""

    def __init__(self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, fan: int = 16):
        self.fan, boxes = fan, np.stack([x0, y0, x1, y1], 1) if len(x0) else np.empty((0, 4))
        n = len(boxes)
        slices = max(1, math.ceil(math.sqrt(n / fan)))
        by_x = np.argsort(x0 + x1, kind="stable")
        strip = np.empty(n, int)
        strip[by_x] = np.arange(n) // max(1, math.ceil(n / slices))
        self.order = np.lexsort((y0 + y1, strip))
        self.levels = [boxes[self.order]]
        while len(top := self.levels[-1]) > fan:
            cuts = np.arange(0, len(top), fan)
            self.levels.append(np.concatenate([np.minimum.reduceat(top[:, :2], cuts), np.maximum.reduceat(top[:, 2:], cuts)], 1))

    def query(
        self, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, most: int | None = None
    ) -> tuple[np.ndarray, np.ndarray] | None:
        """(query, entry) pairs whose boxes touch. None if more than ``most`` pairs are open at a time, unless there is one query only."""
        n, top = len(x0), len(self.levels[-1])
        q, e = np.repeat(np.arange(n), top), np.tile(np.arange(top), n)
        for depth in range(len(self.levels) - 1, -1, -1):
            b = self.levels[depth][e]
            hit = (b[:, 0] <= x1[q]) & (b[:, 2] >= x0[q]) & (b[:, 1] <= y1[q]) & (b[:, 3] >= y0[q])
            q, e = q[hit], e[hit]
            if most is not None and n > 1 and len(q) * (self.fan if depth else 1) > most:
                return None
            if depth:
                below = len(self.levels[depth - 1])
                q, e = np.repeat(q, self.fan), (e[:, None] * self.fan + np.arange(self.fan)).ravel()
                q, e = q[e < below], e[e < below]
        return q, self.order[e]

    def near_one(self, x: np.ndarray, y: np.ndarray, beam: int = 8) -> np.ndarray:
        """For each point an entry that is likely to be near: down the tree by the ``beam`` nearest boxes, as many may hold the point. Its distance
        bounds that of the nearest.
        """
        out = [self._near(x[i : i + 2048], y[i : i + 2048], beam) for i in range(0, len(x), 2048)]
        return self.order[np.concatenate(out)] if out else np.zeros(0, int)

    def _near(self, x: np.ndarray, y: np.ndarray, beam: int) -> np.ndarray:
        below = np.tile(np.arange(len(self.levels[-1])), (len(x), 1))
        for depth in range(len(self.levels) - 1, -1, -1):
            boxes = self.levels[depth]
            b = boxes[np.minimum(below, len(boxes) - 1)]
            gap_x = np.maximum(0, np.maximum(b[..., 0] - x[:, None], x[:, None] - b[..., 2]))
            gap_y = np.maximum(0, np.maximum(b[..., 1] - y[:, None], y[:, None] - b[..., 3]))
            far = np.where(below < len(boxes), gap_x * gap_x + gap_y * gap_y, np.inf)
            if not depth:
                return below[np.arange(len(x)), far.argmin(1)]
            if far.shape[1] > beam:
                below = np.take_along_axis(below, np.argpartition(far, beam - 1, axis=1)[:, :beam], 1)
            below = (below[..., None] * self.fan + np.arange(self.fan)).reshape(len(x), -1)


def great_circle(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    """Metres on the sphere, by the haversine formula."""
    a, b = np.radians(y0), np.radians(y1)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(x1 - x0) / 2) ** 2
    return 2 * RADIUS * np.arcsin(np.minimum(1, np.sqrt(h)))


def _reach(y: np.ndarray, metres: float) -> tuple[np.ndarray, float]:
    """Half width and half height in degrees of the box around a circle of ``metres``; 360 where it holds a pole."""
    angle = metres / RADIUS * (1 + 1e-9) + 1e-12
    s = np.sin(min(angle, math.pi / 2)) / np.maximum(np.cos(np.radians(y)), 1e-300)
    wide = np.where((s >= 1) | (np.abs(y) + np.degrees(angle) >= 90), 360.0, np.degrees(np.arcsin(np.minimum(1, s))))
    return wide * (1 + 1e-9) + 1e-12, float(np.degrees(angle))


def valid_position(x: Column, y: Column) -> Column:
    """Both given, numbers, and in the possible range."""
    return F.coalesce(x.between(-180, 180) & y.between(-90, 90) & ~F.isnan(x) & ~F.isnan(y), F.lit(False))


def _sample(points: DataFrame, x: str, y: str, size: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, int]:
    """At most about ``size`` coordinates drawn from all over the table, and the number of its rows."""
    n = points.count()
    rows = points.select(x, y)
    if n > size:
        rows = rows.sample(fraction=size / n, seed=7)
    got = rows.limit(2 * size).toPandas()
    return got[x].to_numpy(float), got[y].to_numpy(float), n


def _pairs_of_leaf(
    key: np.ndarray, x: np.ndarray, y: np.ndarray, probe: np.ndarray, build: np.ndarray, metres: float
) -> tuple[np.ndarray, np.ndarray]:
    """Indices (a, b) with key[a] < key[b] of near pairs, ``a`` a probing point: it lies in this leaf, so no other leaf reports the pair."""
    b, a = np.flatnonzero(build), np.flatnonzero(probe)
    tree = RTree(x[b], y[b], x[b], y[b])
    found_a, found_b = [], []
    wide, high = _reach(y[a], metres)
    for start in range(0, len(a), 4096):
        at = slice(start, start + 4096)
        q, e = tree.query(x[a[at]] - wide[at], y[a[at]] - high, x[a[at]] + wide[at], y[a[at]] + high)
        i, j = a[at][q], b[e]
        keep = great_circle(x[i], y[i], x[j], y[j]) <= metres
        i, j = i[keep], j[keep]
        less = key[i] < key[j]
        found_a.append(i[less]), found_b.append(j[less])
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (np.empty(0, int), np.empty(0, int))


def near_pairs(points: DataFrame, key: str, x: str, y: str, metres: float, leaf_points: int = LEAF_POINTS) -> DataFrame:
    """(``key_a``, ``key_b``, ``metres``): the pairs of different keys, the smaller string first, at most ``metres`` apart on the great circle.

    A quadtree grown on a sample of at most ``SAMPLE`` points cuts the world into leaves of about ``leaf_points`` points. Every point goes to its
    own leaf, and as a replica to each other leaf that its circle's box touches (across the antimeridian with its longitude turned by 360, at
    a pole all around). In a leaf, points probe an STR-packed R-tree of points and replicas; the exact distance decides; and a pair is
    reported only in the leaf of its smaller key, the reference point. Cells aren't split below four times the distance; a leaf that would
    still hold far more than ``leaf_points`` is cut into parts by hash, and each pair of parts, one probing the other, is a task's work of its own.

    Shuffles: the distinct points, their leaves, and the pairs, of which a key with several positions may report one more than once; those
    have the smallest distance. Keys are compared as strings. Rows with a null key or without a valid position take no part; repeated rows count
    once. Empty tables give no rows; other columns are not read.
    """
    clean = points.select(F.col(key).cast("string").alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    clean = clean.where(F.col("k").isNotNull() & valid_position(F.col("x"), F.col("y"))).distinct()
    sx, sy, n = _sample(clean, "x", "y")
    per = max(1.0, n / max(1, len(sx)))
    reach = math.degrees(metres / RADIUS)
    tree = QuadTree.of_sample(sx, sy, leaf_points / per, least=max(4 * reach, 1e-6))
    parts = np.maximum(1, np.ceil(tree.weights() * per / (4 * leaf_points))).astype(int)
    tasks = max(1, math.ceil(1.2 * n / TASK_POINTS))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            px, py = (batch.column(i).to_numpy() for i in (1, 2))
            own = tree.owner(px, py)
            wide, high = _reach(py, metres)
            index, leaf, sx = [], [], []
            for turn in (0.0, 360.0, -360.0):
                at = np.arange(len(px)) if not turn else np.flatnonzero((px - wide < -180) if turn > 0 else (px + wide > 180))
                i, found = tree.touched(px[at] + turn - wide[at], py[at] - high, px[at] + turn + wide[at], py[at] + high)
                index.append(at[i]), leaf.append(found), sx.append(px[at[i]] + turn)
            index, leaf, sx = np.concatenate(index), np.concatenate(leaf), np.concatenate(sx)
            home = (leaf == own[index]) & (sx == px[index])
            many = parts[leaf]
            mine = np.zeros(len(index), np.int64)
            if (many > 1).any():
                mine = np.array([hash_of(k) for k in batch.column(0).take(pa.array(index)).to_pylist()], np.int64) % many
            # in a leaf that is one part, a row does both; else one row probes each part, one is probed by each
            columns = []
            cut = many > 1
            for role, rows in (
                (PROBE + PROBED, np.flatnonzero(home & ~cut)), (PROBED, np.flatnonzero(~home | cut)), (PROBE, np.flatnonzero(home & cut))
            ):
                rep = np.repeat(rows, many[rows])
                other = np.arange(len(rep)) - np.repeat(np.cumsum(many[rows]) - many[rows], many[rows])
                pair = mine[rep] * many[rep] + other if role & PROBE else other * many[rep] + mine[rep]
                columns.append((leaf[rep], pair, np.full(len(rep), role), index[rep], sx[rep]))
            leaf, pair, role, at, sx = (np.concatenate(c) for c in zip(*columns))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(leaf, pa.int32()), pa.array(pair, pa.int64()), pa.array(role, pa.int32()), batch.column(0).take(pa.array(at)),
                    pa.array(sx), pa.array(py[at])
                ],
                names=["leaf", "pair", "role", "k", "x", "y"],
            )

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _held(batches)
        if table is None:
            return
        keys, xs, ys, role = table["k"].to_pandas().to_numpy(), table["x"].to_numpy(), table["y"].to_numpy(), table["role"].to_numpy()
        for at in _cells(table["leaf"].to_numpy(), table["pair"].to_numpy()):
            a, b = _pairs_of_leaf(keys[at], xs[at], ys[at], (role[at] & PROBE) > 0, (role[at] & PROBED) > 0, metres)
            a, b = at[a], at[b]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[a], pa.string()), pa.array(keys[b], pa.string()), pa.array(great_circle(xs[a], ys[a], xs[b], ys[b]))],
                names=["key_a", "key_b", "metres"]
            )

    leaves = clean.mapInArrow(spread, "leaf int, pair long, role int, k string, x double, y double")
    found = leaves.repartition(tasks, "leaf", "pair").mapInArrow(probe, "key_a string, key_b string, metres double")
    return found.groupBy("key_a", "key_b").agg(F.min("metres").alias("metres"))


def _held(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    """The rows of a task's leaves, of which it has about ``TASK_POINTS``."""
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held) if held else None


def _cells(leaf: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
    """The rows of each (leaf, part)."""
    order = np.lexsort((part, leaf))
    change = (np.diff(leaf[order]) != 0) | (np.diff(part[order]) != 0)
    return np.split(order, np.flatnonzero(change) + 1)


def hash_of(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


_RING = re.compile(r"\(([^()]*)\)")
_POINT = re.compile(r"([-+]?[\d.]+(?:[eE][-+]?\d+)?)\s+([-+]?[\d.]+(?:[eE][-+]?\d+)?)")


def parse_wkt(text: str | None) -> list[list[np.ndarray]]:
    """The polygons of a POLYGON or MULTIPOLYGON text, each a list of rings (n x 2, closed), the outer ring first. Anything else has none. Case and
    blanks don't matter.
    """
    if text is None:
        return []
    s = re.sub(r"^\s*SRID=\d+;", "", text, flags=re.I).strip()
    m = re.match(r"(MULTIPOLYGON|POLYGON)\s*(?:Z|M|ZM)?\s*(?=\()", s, re.I)
    if not m:
        return []
    body = s[m.end() :]
    groups = [body] if m[1].upper() == "POLYGON" else re.split(r"\)\s*\)\s*,\s*\(\s*\(", body)
    out = []
    for g in groups:
        rings = []
        for ring in re.split(r"\)\s*,\s*\(", g):
            points = np.array([(float(a), float(b)) for a, b in _POINT.findall(ring)]).reshape(-1, 2)
            if len(points) >= 3:
                rings.append(points if (points[0] == points[-1]).all() else np.vstack([points, points[:1]]))
        if rings:
            out.append(rings)
    return out


def multipolygon(polygons: list[list[np.ndarray]]) -> str:
    """The text of polygons, with all digits of their coordinates."""
    ring = lambda r: "(" + ",".join(f"{a!r} {b!r}" for a, b in r.tolist()) + ")"
    return "MULTIPOLYGON(" + ",".join("(" + ",".join(map(ring, rings)) + ")" for rings in polygons) + ")"


def within(polygons: list[list[np.ndarray]], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which points lie in one of the polygons, by the parity of crossed borders; holes are outside."""
    inside = np.zeros(len(x), bool)
    for rings in polygons:
        parity = np.zeros(len(x), bool)
        for ring in rings:
            for start in range(0, len(ring) - 1, 512):
                edge = ring[start : start + 513]
                x1, y1, x2, y2 = edge[:-1, 0], edge[:-1, 1], edge[1:, 0], edge[1:, 1]
                for lo in range(0, len(x), 8192):
                    px, py = x[lo : lo + 8192, None], y[lo : lo + 8192, None]
                    cross = (y1 > py) != (y2 > py)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        parity[lo : lo + 8192] ^= (np.count_nonzero(cross & (px < (x2 - x1) * (py - y1) / (y2 - y1) + x1), axis=1) & 1).astype(bool)
        inside |= parity
    return inside


class Regions:
    """Parsed regions under an R-tree of the boxes of their polygons."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.parts, boxes = [], [], []
        for i, t in zip(ids, texts):
            for rings in parse_wkt(t):
                low, high = rings[0].min(0), rings[0].max(0)
                self.ids.append(i), self.parts.append(rings), boxes.append((*low, *high))
        self.boxes = np.array(boxes, float).reshape(-1, 4)
        self.tree = RTree(*self.boxes.T) if boxes else None

    def containing(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, polygon) pairs. Polygons of one region may both be reported."""
        points, parts = [np.empty(0, int)], [np.empty(0, int)]
        for start in range(0, len(x) if self.tree else 0, 8192):
            px, py = x[start : start + 8192], y[start : start + 8192]
            q, e = self.tree.query(px, py, px, py)
            order = np.argsort(e, kind="stable")
            q, e = q[order], e[order]
            for at in np.split(np.arange(len(e)), np.flatnonzero(np.diff(e)) + 1):
                if len(at):
                    hit = q[at][within([self.parts[e[at[0]]]], px[q[at]], py[q[at]])]
                    points.append(hit + start), parts.append(np.full(len(hit), e[at[0]]))
        return np.concatenate(points), np.concatenate(parts)


def inside_regions(
    points: DataFrame, key: str, x: str, y: str, regions: DataFrame, region: str, wkt: str, leaf_points: int = LEAF_POINTS
) -> DataFrame:
    """(``key``, ``region``): the regions that contain each point, straight borders in longitude and latitude, holes outside.

    A quadtree grown on a sample of the points cuts the plane. A point goes to its leaf, a region as a replica to each leaf that the box of one
    of its polygons touches, with just those polygons. Every leaf bulk-loads and probes its own R-tree, and the exact crossing test decides. The
    point is the reference: it is in one leaf only, so no pair comes twice. A leaf with far too many points is cut into parts, each with its replicas.

    Points without a key or two finite coordinates, and regions without a text that can be read as polygons, take no part. Repeated points
    give repeated rows; several rows of one region count as one region. Points exactly on a border may count either way. Empty tables give no
    rows; other columns are not read. If ``region`` is named like ``key`` it gets the suffix ``_``.
    """
    name = region if region.lower() != key.lower() else region + "_"
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < 1e300)
    clean = points.select(
        F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")
    ).where(F.col(key).isNotNull() & finite(F.col("x")) & finite(F.col("y")))
    areas = regions.select(F.col(region).alias("r"), F.col(wkt).alias("w")).where("r is not null and w is not null")
    kinds = (points.schema[key].dataType, regions.schema[region].dataType)
    schema = T.StructType([T.StructField(key, kinds[0]), T.StructField(name, kinds[1])])

    def hits(k: pa.Array, px: np.ndarray, py: np.ndarray, loaded: Regions) -> pa.RecordBatch:
        p, part = loaded.containing(px, py)
        coded = {r: i for i, r in enumerate(dict.fromkeys(loaded.ids))}
        code = np.array([coded[r] for r in loaded.ids], int)[part] if len(part) else part
        both = np.unique(p * max(1, len(coded)) + code)
        p, code = both // max(1, len(coded)), both % max(1, len(coded))
        names = pa.array(list(coded)) if coded else pa.array([], pa.string())
        return pa.RecordBatch.from_arrays([k.take(pa.array(p)), names.take(pa.array(code))], names=[key, name])

    sx, sy, n = _sample(clean, "x", "y")
    per = max(1.0, n / max(1, len(sx)))
    tree = QuadTree.of_sample(sx, sy, leaf_points / per)
    chunks = np.maximum(1, np.ceil(tree.weights() * per / (4 * leaf_points))).astype(int)
    target = pa.schema([pa.field(key, _arrow(kinds[0])), pa.field(name, _arrow(kinds[1]))])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_row = 0
        for b in batches:
            leaf = tree.owner(b.column(1).to_numpy(), b.column(2).to_numpy())
            chunk = (np.arange(len(leaf)) + at_row) % chunks[leaf]
            at_row += len(leaf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), pa.array(chunk, pa.int32()), *b.columns], names=["leaf", "chunk", "k", "x", "y"]
            )

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts, leaf, chunk = [], [], [], []
            for r, w in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                polygons = parse_wkt(w)
                boxes = np.array([(*p[0].min(0), *p[0].max(0)) for p in polygons], float).reshape(-1, 4)
                # cells at the rim of the world also own the points beyond it
                c = np.clip(boxes, [WORLD[0], WORLD[1]] * 2, [WORLD[2], WORLD[3]] * 2)
                item, cells = tree.touched(*c.T)
                for cell in np.unique(cells).tolist():
                    text = multipolygon([polygons[i] for i in np.unique(item[cells == cell]).tolist()])
                    for part in range(chunks[cell]):
                        ids.append(r), texts.append(text), leaf.append(cell), chunk.append(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), pa.array(chunk, pa.int32()), pa.array(ids, b.column(0).type), pa.array(texts, pa.string())],
                names=["leaf", "chunk", "r", "w"]
            )

    spread = clean.mapInArrow(
        place,
        T.StructType(
            [
                T.StructField("leaf", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("k", kinds[0]),
                T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())
            ]
        )
    )
    copies = areas.mapInArrow(
        replicate,
        T.StructType(
            [
                T.StructField("leaf", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("r", kinds[1]),
                T.StructField("w", T.StringType())
            ]
        )
    )
    both = spread.select(
        "*", F.lit(None).cast(kinds[1]).alias("r"), F.lit(None).cast("string").alias("w")
    ).unionByName(copies, allowMissingColumns=True)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _held(batches)
        if table is None:
            return
        region_row = table["w"].is_valid().to_numpy()
        for at in _cells(table["leaf"].to_numpy(), table["chunk"].to_numpy()):
            mine, pts = at[region_row[at]], at[~region_row[at]]
            if len(mine) and len(pts):
                some = table.take(pa.array(pts))
                loaded = Regions(table["r"].take(pa.array(mine)).to_pylist(), table["w"].take(pa.array(mine)).to_pylist())
                yield hits(some["k"].combine_chunks(), some["x"].to_numpy(), some["y"].to_numpy(), loaded).cast(target)

    tasks = max(1, math.ceil(n / TASK_POINTS))
    return both.repartition(tasks, "leaf", "chunk").mapInArrow(probe, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
