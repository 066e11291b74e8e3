"""Points matched onto the nearest vertices and edges, and nodes added where they meet the network."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from wayloom.operators.spatial import LEAF_POINTS, TASK_POINTS, QuadTree, RTree, _cells, _held, _sample
from wayloom.schema import Graph
from wayloom.session import materialize


#: Pairs of a point and a thing that a task compares at a time.
MAX_PAIRS = 1_000_000


def _distance2(px: np.ndarray, py: np.ndarray, fx: np.ndarray, fy: np.ndarray, tx: np.ndarray, ty: np.ndarray) -> np.ndarray:
    """Squared planar distance of points to line segments, which may be points."""
    dx, dy = tx - fx, ty - fy
    length = dx * dx + dy * dy
    u = np.clip(((px - fx) * dx + (py - fy) * dy) / np.where(length > 0, length, 1.0), 0.0, 1.0)
    x, y = px - fx - u * dx, py - fy - u * dy
    return x * x + y * y


def _nearest(points: DataFrame, things: DataFrame, leaf_things: int = LEAF_POINTS) -> DataFrame:
    """(``pid``, ``px``, ``py``, ``d2``, ``tid``, ``fx``, ``fy``, ``tx``, ``ty``, ``flag``): for each of ``points`` (``pid``, ``px``, ``py``) the
    nearest of ``things`` (``tid``, the two ends of a segment, and a ``flag`` that is carried along), of equal ones the smallest ``tid``.

    A quadtree grown on a sample of the things cuts the plane. The nearest thing of the sample bounds each point's distance, so the point
    goes to the leaves that a circle of that size touches, and a thing to those that its box touches. In a leaf the bound is tightened by
    a way down the R-tree of its things, and all within it are compared. The best of a point's leaves is the answer: exact, with one shuffle of both
    sides
    and one of the candidates. Leaves with far too many points are cut into parts, each with the things of its leaf.
    """
    sx, sy, n_things = _sample(things, "fx", "fy")
    px, py, n_points = _sample(points, "px", "py")
    kinds = points.schema["pid"].dataType, things.schema["tid"].dataType
    box = things.agg(F.min(F.least("fx", "tx")), F.min(F.least("fy", "ty")), F.max(F.greatest("fx", "tx")), F.max(F.greatest("fy", "ty"))).first()
    grow = max(1e-9, 1e-9 * max(abs(v) for v in box))
    world = (box[0] - grow, box[1] - grow, box[2] + grow, box[3] + grow)
    tree = QuadTree.of_sample(sx, sy, leaf_things / max(1.0, n_things / len(sx)), least=max(1e-9, (world[2] - world[0]) * 1e-6), world=world)
    asked = np.bincount(tree.owner(px, py), minlength=len(tree.weights())) * max(1.0, n_points / max(1, len(px)))
    parts = np.maximum(1, np.ceil(asked / (4 * LEAF_POINTS))).astype(int)
    tasks = max(1, math.ceil(1.2 * (n_things + n_points) / TASK_POINTS))
    known = np.stack([sx, sy], 1)

    def place_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, seen = RTree(known[:, 0], known[:, 1], known[:, 0], known[:, 1]), 0
        for b in batches:
            x, y = b.column(1).to_numpy(), b.column(2).to_numpy()
            at = near.near_one(x, y)
            r = np.hypot(x - known[at, 0], y - known[at, 1]) * (1 + 1e-9) + 1e-12
            i, leaf = tree.touched(x - r, y - r, x + r, y + r)
            part = (i + seen) % parts[leaf]
            seen += len(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf, pa.int32()), pa.array(part, pa.int32()), *b.take(pa.array(i)).columns, pa.array(r[i])],
                names=["leaf", "part", "pid", "px", "py", "r"]
            )

    def place_things(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fx, fy, tx, ty = (b.column(k).to_numpy() for k in range(1, 5))
            i, leaf = tree.touched(np.minimum(fx, tx), np.minimum(fy, ty), np.maximum(fx, tx), np.maximum(fy, ty))
            rep = np.repeat(np.arange(len(i)), parts[leaf])
            part = np.arange(len(rep)) - np.repeat(np.cumsum(parts[leaf]) - parts[leaf], parts[leaf])
            yield pa.RecordBatch.from_arrays(
                [pa.array(leaf[rep], pa.int32()), pa.array(part, pa.int32()), *b.take(pa.array(i[rep])).columns],
                names=["leaf", "part", "tid", "fx", "fy", "tx", "ty", "flag"]
            )

    number = lambda *names: [T.StructField(c, T.DoubleType()) for c in names]
    cell = [T.StructField("leaf", T.IntegerType()), T.StructField("part", T.IntegerType())]
    point, thing = T.StructField("pid", kinds[0]), T.StructField("tid", kinds[1])
    a = points.select("pid", "px", "py").mapInArrow(place_points, T.StructType([*cell, point, *number("px", "py", "r")]))
    b = things.select("tid", "fx", "fy", "tx", "ty", "flag").mapInArrow(
        place_things, T.StructType([*cell, thing, *number("fx", "fy", "tx", "ty", "flag")])
    )
    found = T.StructType([point, *number("px", "py", "d2"), thing, *number("fx", "fy", "tx", "ty", "flag")])
    target = to_arrow_schema(found)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _held(batches)
        if table is None:
            return
        x, y, r = (table[c].to_numpy() for c in ("px", "py", "r"))
        ends = [table[c].to_numpy() for c in ("fx", "fy", "tx", "ty", "flag")]
        is_point = ~np.isnan(r)
        order = pc.sort_indices(table["tid"]).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        for at in _cells(table["leaf"].to_numpy(), table["part"].to_numpy()):
            who, what = at[is_point[at]], at[~is_point[at]]
            if not len(who) or not len(what):
                continue
            fx, fy, tx, ty = (c[what] for c in ends[:4])
            near = RTree(np.minimum(fx, tx), np.minimum(fy, ty), np.maximum(fx, tx), np.maximum(fy, ty))
            todo = [who[start : start + 4096] for start in range(0, len(who), 4096)][::-1]
            while todo:
                w = todo.pop()
                one = near.near_one(x[w], y[w])
                bound = np.sqrt(_distance2(x[w], y[w], fx[one], fy[one], tx[one], ty[one])) * (1 + 1e-9) + 1e-12
                bound = np.minimum(bound, r[w])
                pairs = near.query(x[w] - bound, y[w] - bound, x[w] + bound, y[w] + bound, most=MAX_PAIRS)
                if pairs is None:  # far from all things a circle holds many of them: fewer points at a time
                    todo += [w[len(w) // 2 :], w[: len(w) // 2]]
                    continue
                q, e = pairs
                d2 = _distance2(x[w[q]], y[w[q]], fx[e], fy[e], tx[e], ty[e])
                best = np.lexsort((rank[what[e]], d2, q))
                best = best[np.concatenate([[True], np.diff(q[best]) != 0])] if len(best) else best
                p, t = w[q[best]], what[e[best]]
                columns = [
                    table["pid"].take(pa.array(p)).combine_chunks(), pa.array(x[p]), pa.array(y[p]), pa.array(d2[best]),
                    table["tid"].take(pa.array(t)).combine_chunks(), *[pa.array(c[t]) for c in ends]
                ]
                yield pa.RecordBatch.from_arrays(columns, names=target.names).cast(target)

    both = a.unionByName(b, allowMissingColumns=True)
    got = both.repartition(tasks, "leaf", "part").select(
        "leaf", "part", "pid", "px", "py", "r", "tid", "fx", "fy", "tx", "ty", "flag"
    ).mapInArrow(probe, found)
    best = got.groupBy("pid", "px", "py").agg(F.min(F.struct("d2", "tid", "fx", "fy", "tx", "ty", "flag")).alias("m"))
    return best.select("pid", "px", "py", "m.*")


def _points(points: DataFrame, key: str, x: str, y: str) -> DataFrame:
    out = points.select(F.col(key).alias("pid"), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py"))
    return out.where(_finite("px") & _finite("py") & F.col("pid").isNotNull()).distinct()


def _finite(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e300)


def points_to_vertices(points: DataFrame, key: str, x: str, y: str, vertices: DataFrame, connected: bool = False) -> DataFrame:
    """(``key``, ``id``, ``dist``): the nearest vertex of each point, by planar distance, of equal ones the smallest id.

    ``vertices``: ``id``, ``x``, ``y``, and ``component`` for ``connected``, which restricts them to component 1. Points and vertices without
    finite coordinates take no part; repeated points count once.
    """
    v = vertices.where("component = 1") if connected else vertices
    v = v.select(F.col("id").alias("tid"), F.col("x").cast("double").alias("fx"), F.col("y").cast("double").alias("fy"))
    v = materialize(
        v.where(F.col("tid").isNotNull() & _finite("fx") & _finite("fy")).withColumns({"tx": F.col("fx"), "ty": F.col("fy"), "flag": F.lit(0.0)})
    )
    pts = materialize(_points(points, key, x, y))
    if not v.limit(1).count():
        return pts.select(
            F.col("pid").alias(key), F.lit(None).cast(vertices.schema["id"].dataType).alias("id"), F.lit(None).cast("double").alias("dist")
        ).limit(0)
    return _nearest(pts, v).select(F.col("pid").alias(key), F.col("tid").alias("id"), F.sqrt("d2").alias("dist"))


def points_to_edges(points: DataFrame, key: str, x: str, y: str, graph: Graph) -> DataFrame:
    """(``key``, ``edge``, ``d_signed``, ``x``, ``y``): the nearest edge of each point, the foot on it, and the planar distance, negative on the left
    of the edge.

    Edges are named by the graph's order column, of equal ones the first. Edges of no length or without finite coordinates never match.
    """
    e = graph.edges.select(
        F.col(f"`{graph.order}`").alias("tid"), *[graph[f"{end}_{a}"].cast("double").alias(f"{end[0]}{a}") for end in ("from", "to") for a in "xy"]
    )
    e = materialize(e.where(_finite("fx") & _finite("fy") & _finite("tx") & _finite("ty") & F.col("tid").isNotNull()).where("fx <> tx or fy <> ty"))
    # both directions of a street are measured from the same end, so that they are equally far
    back = F.struct("fx", "fy") > F.struct("tx", "ty")
    swap = {a: F.when(back, F.col(b)).otherwise(F.col(a)) for a, b in (("fx", "tx"), ("fy", "ty"), ("tx", "fx"), ("ty", "fy"))}
    things = e.select("tid", *[c.alias(a) for a, c in swap.items()], F.when(back, -1.0).otherwise(1.0).alias("flag"))
    pts = materialize(_points(points, key, x, y))
    if not e.limit(1).count():
        return pts.select(
            F.col("pid").alias(key), F.lit(0).cast("bigint").alias("edge"), F.lit(0.0).alias("d_signed"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y")
        ).limit(0)
    got = _nearest(pts, things)
    dx, dy = F.col("tx") - F.col("fx"), F.col("ty") - F.col("fy")
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("px") - F.col("fx")) * dx + (F.col("py") - F.col("fy")) * dy) / (dx * dx + dy * dy)))
    cross = dx * (F.col("py") - F.col("fy")) - dy * (F.col("px") - F.col("fx"))
    signed = -F.signum(cross) * F.col("flag") * F.sqrt("d2")
    return got.select(
        F.col("pid").alias(key), F.col("tid").alias("edge"), signed.alias("d_signed"), (F.col("fx") + u * dx).alias("x"),
        (F.col("fy") + u * dy).alias("y")
    )


def add_nodes(graph: Graph, points: DataFrame, key: str, x: str, y: str, dist_tol: float = 1e-6, intersections_only: bool = False) -> Graph:
    """Split each matched edge, and the one back if there is one, at the feet of its points; unless ``intersections_only``, points further than
    ``dist_tol`` (degrees) are joined to their foot by new edges of the same ratios. A foot's id is a hash of its place, so both
    directions share it; a point's vertex has its own key as id."""
    from wayloom.functions.geo import haversine

    e, r = graph.edges, graph.roles
    fid, tid = graph["from_id"].cast("string"), graph["to_id"].cast("string")
    named = e.select(F.col(f"`{graph.order}`").alias("edge__"), F.least(fid, tid).alias("a__"), F.greatest(fid, tid).alias("b__"))
    feet = points_to_edges(points, key, x, y, graph).join(
        points.select(F.col(key), F.col(x).cast("double").alias("px"), F.col(y).cast("double").alias("py")).dropDuplicates([key]), key
    )
    feet = materialize(
        feet.join(named, F.col("edge") == F.col("edge__")).select(
            "a__", "b__", F.col(key).cast("string").alias("pid"), "px", "py", F.col("x").alias("qx"), F.col("y").alias("qy"),
            F.abs("d_signed").alias("off"),
            F.substring(F.sha2(F.concat_ws("|", F.col("x").cast("string"), F.col("y").cast("string")), 256), 1, 10).alias("q")
        )
    )
    # an edge with its feet in order; the number of feet of one edge is that of the points nearest to it
    at = F.pow(F.col("qx") - graph["from_x"], 2) + F.pow(F.col("qy") - graph["from_y"], 2)
    hit = e.withColumns({"a__": F.least(fid, tid), "b__": F.greatest(fid, tid)}).join(feet, ["a__", "b__"])
    ordered = hit.groupBy(F.col(f"`{graph.order}`").alias("o__")).agg(
        F.array_sort(F.collect_set(F.struct(at.alias("t"), F.col("q"), F.col("qx"), F.col("qy")))).alias("s__")
    )
    ends = lambda end: F.struct(F.lit(-1.0 if end == "from" else 1e300).alias("t"), graph[f"{end}_id"].cast("string").alias("q"), graph[f"{end}_x"].alias("qx"), graph[f"{end}_y"].alias("qy"))
    stops = F.concat(F.array(ends("from")), F.col("s__"), F.array(ends("to")))
    with_stops = e.join(ordered, e[graph.order] == F.col("o__"))
    pieces = with_stops.withColumn("stops__", stops).select(
        "*",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(1), F.size("stops__") - 1),
                lambda i: F.struct(F.element_at("stops__", i).alias("a"), F.element_at("stops__", i + 1).alias("b"))
            )
        ).alias("k__", "p__")
    )
    d = haversine(F.col("p__.a.qx"), F.col("p__.a.qy"), F.col("p__.b.qx"), F.col("p__.b.qy"))
    ids = {
        r["from_id"]: F.col("p__.a.q"), r["to_id"]: F.col("p__.b.q"), r["from_x"]: F.col("p__.a.qx"), r["from_y"]: F.col("p__.a.qy"),
        r["to_x"]: F.col("p__.b.qx"), r["to_y"]: F.col("p__.b.qy")
    }
    scaled = {r["d"]: d} | {
        r[k]: graph[k] * F.try_divide(d, graph["d"]) for k in ("d_weighted", "time", "time_weighted") if k in r and r[k] != r["d"]
    }
    id_col = r.get("edge_id", graph.order)
    new_id = {id_col: F.concat_ws("_", F.col(f"`{id_col}`").cast("string"), F.col("k__").cast("string"))}
    as_text = {id_col, r["from_id"], r["to_id"]}

    def shaped(frame: DataFrame, change: dict) -> DataFrame:
        return frame.select(
            *[
                (
                    change.get(c, F.col(f"`{c}`")).cast("string") if c in as_text else change.get(c, F.col(f"`{c}`")).cast(e.schema[c].dataType)
                ).alias(c) for c in e.columns
            ]
        )

    out = shaped(
        e.join(ordered.select("o__"), e[graph.order] == F.col("o__"), "left_anti"), {}
    ).unionByName(shaped(pieces.where(d > 0), ids | scaled | new_id))
    if not intersections_only:
        far = hit.where(F.col("off") > dist_tol).dropDuplicates(["pid"])
        gap = haversine(F.col("px"), F.col("py"), F.col("qx"), F.col("qy"))
        for k, (end, back) in enumerate((("from", "to"), ("to", "from"))):
            link = {
                r[f"{end}_id"]: F.col("pid"), r[f"{back}_id"]: F.col("q"), r[f"{end}_x"]: F.col("px"), r[f"{end}_y"]: F.col("py"),
                r[f"{back}_x"]: F.col("qx"), r[f"{back}_y"]: F.col("qy")
            }
            sized = {r["d"]: gap} | {
                r[c]: graph[c] * F.try_divide(gap, graph["d"]) for c in ("d_weighted", "time", "time_weighted") if c in r and r[c] != r["d"]
            }
            out = out.unionByName(shaped(far, link | sized | {id_col: F.concat_ws("_", F.lit("link"), F.col("pid"), F.lit(str(k)))}))
    return graph.with_edges(out)
