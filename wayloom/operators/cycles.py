"""Fundamental cycles of the network, and polygons made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.kernel import fundamental_cycles
from wayloom.operators.structure import component_labels, contract, vertices
from wayloom.schema import Graph
from wayloom.session import materialize

#: Edges of a component up to which one task takes it whole; larger ones are worked on by joins, with the same cycles.
MAX_EDGES = 200_000


def _normal(ring: list) -> list:
    """The ring from its least vertex on, towards the lesser of that one's neighbours."""
    at = ring.index(min(ring))
    ring = ring[at:] + ring[:at]
    return ring[:1] + ring[:0:-1] if ring[1] > ring[-1] else ring


def _rings_in_tasks(e: DataFrame, kind: T.DataType) -> DataFrame:
    """(``ring``) of components, each in one task. ``e``: ``label``, ``u``, ``v``."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        names, coded = np.unique(np.concatenate([p["u"].to_numpy(), p["v"].to_numpy()]), return_inverse=True)
        found = fundamental_cycles(coded[: len(p)], coded[len(p) :])
        rows = [[names[i] for i in _normal(c)] for c in found]
        return pd.DataFrame({"ring": rows}) if rows else pd.DataFrame({"ring": pd.Series([], dtype=object)})

    return e.groupBy("label").applyInPandas(run, T.StructType([T.StructField("ring", T.ArrayType(kind))]))


def _rings_by_joins(e: DataFrame, max_rounds: int) -> DataFrame:
    """The same for components of any size: a level of the spanning trees a round, then a step up from both ends of all other edges a round."""
    near = materialize(e.select(F.col("u").alias("a"), F.col("v").alias("b")).union(e.select("v", "u")))
    fresh = materialize(
        e.select(F.col("label").alias("id")).distinct().withColumns({"parent": F.lit(None).cast(e.schema["u"].dataType), "depth": F.lit(0)})
    )
    tree = fresh
    for depth in range(1, max_rounds):
        step = near.join(
            fresh.select(F.col("id").alias("a")), "a"
        ).groupBy(F.col("b").alias("id")).agg(F.min("a").alias("parent")).withColumn("depth", F.lit(depth))
        fresh = materialize(step.join(tree.select("id"), "id", "left_anti"))
        if not fresh.limit(1).count():
            break
        # the tables of earlier levels are joined into one, so that the plan stays short
        tree = materialize(tree.unionByName(fresh)) if depth % 8 == 0 else tree.unionByName(fresh)
    else:
        raise RuntimeError(f"spanning trees are deeper than {max_rounds} edges")
    tree = materialize(tree)
    of = lambda c: tree.select(F.col("id").alias(c), F.col("parent").alias(f"p{c}"), F.col("depth").alias(f"d{c}"))
    both = e.select(F.col("u").alias("a"), F.col("v").alias("b")).join(of("a"), "a").join(of("b"), "b")
    chords = both.where("not (coalesce(pa = b, false) or coalesce(pb = a, false))").select(
        "a", "b", F.array("a").alias("left"), F.array("b").alias("right")
    )
    todo, done = materialize(chords), []
    for _ in range(max_rounds):
        step = todo.join(of("a"), "a").join(of("b"), "b")
        up_a, up_b = F.col("da") >= F.col("db"), F.col("db") >= F.col("da")
        moved = step.select(
            F.when(up_a, F.col("pa")).otherwise(F.col("a")).alias("a"), F.when(up_b, F.col("pb")).otherwise(F.col("b")).alias("b"),
            F.when(up_a, F.array_append("left", F.col("pa"))).otherwise(F.col("left")).alias("left"), F.when(
                up_b, F.array_append("right", F.col("pb"))
            ).otherwise(F.col("right")).alias("right"),
        )
        moved = materialize(moved)
        done.append(moved.where("a = b"))
        todo = moved.where("a <> b")
        if not todo.limit(1).count():
            break
    else:
        raise RuntimeError(f"cycles are longer than {max_rounds} edges")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    ring = F.concat("left", F.reverse(F.slice("right", F.lit(1), F.size("right") - 1)))
    first = F.array_position(ring, F.array_min(ring)).cast("int")
    turned = F.concat(F.slice(ring, first, F.size(ring)), F.slice(ring, F.lit(1), first - 1))
    back = F.concat(F.slice("t", F.lit(1), F.lit(1)), F.reverse(F.slice("t", F.lit(2), F.size("t"))))
    return out.select(turned.alias("t")).select(F.when(F.element_at("t", 2) > F.element_at("t", -1), back).otherwise(F.col("t")).alias("ring"))


def cycles(graph: Graph, max_edges: int = MAX_EDGES, max_rounds: int = 100_000) -> DataFrame:
    """(``cycle_id``, ``pos``, ``id``, and ``x``, ``y`` if the graph has them): a basis of the undirected cycles of each component, vertices in order.

    There are E - V + 1 of a component with E distinct edges and V vertices: each edge beyond a spanning tree closes one. The tree is that of
    the fewest edges from the component's least vertex, each vertex under the least of its neighbours that are one edge nearer. Components of at most
    ``max_edges``
    edges are taken whole by a task, larger ones by joins, with the same result. ``cycle_id`` is a hash of the cycle's vertices.
    """
    e = graph.edges.select(
        F.least(graph["from_id"], graph["to_id"]).alias("u"), F.greatest(graph["from_id"], graph["to_id"]).alias("v")
    ).where("u is not null and v is not null and u <> v").distinct()
    e = materialize(e)
    label = component_labels(e.select(F.col("u").alias("a"), F.col("v").alias("b")))
    e = materialize(e.join(label, e["u"] == label["id"]).drop("id"))
    large = materialize(e.groupBy("label").count().where(F.col("count") > max_edges).select("label"))
    rings = _rings_in_tasks(e.join(large, "label", "left_anti"), e.schema["u"].dataType)
    if large.limit(1).count():
        rings = rings.unionByName(_rings_by_joins(e.join(large, "label", "left_semi"), max_rounds))
    out = rings.select(F.sha2(F.concat_ws("|", "ring"), 256).substr(1, 16).alias("cycle_id"), F.posexplode("ring").alias("pos", "id"))
    if graph.is_spatial:
        out = out.join(vertices(graph).select("id", "x", "y"), "id").select("cycle_id", "pos", "id", "x", "y")
    return out


def cycle_rank(graph: Graph) -> DataFrame:
    """(``component``, ``n_vertices``, ``n_edges``, ``rank``): per component, named by its smallest vertex, the number of independent cycles, edges
    minus vertices plus one.
    """
    e = graph.edges.select(
        F.least(graph["from_id"], graph["to_id"]).alias("a"), F.greatest(graph["from_id"], graph["to_id"]).alias("b")
    ).where("a is not null and b is not null").distinct()
    e = materialize(e)
    label = materialize(component_labels(e))
    n_v = label.groupBy("label").agg(F.count(F.lit(1)).alias("n_vertices"))
    n_e = e.where("a <> b").join(label, e["a"] == label["id"]).groupBy("label").agg(F.count(F.lit(1)).alias("n_edges"))
    out = n_v.join(n_e, "label", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0).cast("bigint")))
    return out.select(F.col("label").alias("component"), "n_vertices", "n_edges", (F.col("n_edges") - F.col("n_vertices") + 1).alias("rank"))


def full_cycles(graph: Graph, max_edges: int = MAX_EDGES) -> DataFrame:
    """The cycles of the contracted graph with all vertices of the original one between them. Chains that run beside another edge, or back to where
    they began, are not contracted, or their cycles would be lost.
    """
    short, mapped = contract(graph)
    ends = graph.edges.select(F.col(f"`{graph.order}`").alias("edge_old"), graph["from_id"].alias("f"), graph["to_id"].alias("t"))
    loops = short.edges.where(short["from_id"] == short["to_id"]).select(
        F.col(f"`{short.roles.get('edge_id', short.order)}`").cast("string").alias("edge_new")
    )
    whole = ends.join(mapped.join(loops, "edge_new", "left_anti"), "edge_old", "left_anti")
    whole = materialize(whole.select("f").union(whole.select("t")).distinct())
    if whole.limit(1).count():
        short, mapped = contract(graph, whole)
    found = materialize(cycles(short, max_edges))
    id_col = short.roles.get("edge_id", short.order)
    step = found.alias("a").join(found.alias("b"), (F.col("a.cycle_id") == F.col("b.cycle_id"))).join(
        found.groupBy(F.col("cycle_id").alias("c__")).agg(F.max("pos").alias("last")), F.col("a.cycle_id") == F.col("c__")
    ).where("b.pos = case when a.pos = last then 0 else a.pos + 1 end")
    step = step.select(F.col("a.cycle_id").alias("cycle_id"), F.col("a.pos").alias("side"), F.col("a.id").alias("u"), F.col("b.id").alias("v"))
    named = short.edges.select(short["from_id"].alias("f"), short["to_id"].alias("t"), F.col(f"`{id_col}`").cast("string").alias("edge_new"))
    there = step.join(named, (step["u"] == named["f"]) & (step["v"] == named["t"])).select("cycle_id", "side", "edge_new", F.lit(1).alias("way"))
    back = step.join(named, (step["v"] == named["f"]) & (step["u"] == named["t"])).select("cycle_id", "side", "edge_new", F.lit(-1).alias("way"))
    one = there.unionByName(back).groupBy("cycle_id", "side").agg(F.max(F.struct("way", "edge_new")).alias("m")).select("cycle_id", "side", "m.*")
    old = graph.edges.select(F.col(f"`{graph.order}`").alias("edge_old"), graph["from_id"].alias("f"), graph["to_id"].alias("t"))
    steps = one.join(mapped, "edge_new").join(old, "edge_old").select(
        "cycle_id", "side", (F.col("pos") * F.col("way")).alias("k"), F.when(F.col("way") > 0, F.col("f")).otherwise(F.col("t")).alias("id")
    )
    ring = steps.groupBy("cycle_id").agg(F.array_sort(F.collect_list(F.struct("side", "k", "id"))).alias("s"))
    return ring.select("cycle_id", F.posexplode("s.id").alias("pos", "id"))


def polygons(graph: Graph, least_edges: int = 100) -> DataFrame:
    """(``cycle_id``, ``wkt``): the cycles of the components that have more than ``least_edges`` edges, as closed polygons."""
    pairs = graph.edges.select(graph["from_id"].alias("a"), graph["to_id"].alias("b"))
    label = component_labels(pairs)
    large = pairs.join(label, pairs["a"] == label["id"]).groupBy("label").count().where(F.col("count") > least_edges)
    members = label.join(large, "label").select(F.col("id").alias("id__"))
    part = graph.with_edges(graph.edges.join(members, graph["from_id"] == F.col("id__"), "left_semi"))
    return rings_to_wkt(cycles(part))


def rings_to_wkt(found: DataFrame) -> DataFrame:
    """Ordered vertices to polygon texts; rings are as long as their cycles."""
    points = F.array_sort(F.collect_list(F.struct("pos", "x", "y")))
    text = F.transform(F.concat(F.col("s"), F.array(F.element_at("s", 1))), lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string")))
    return found.groupBy("cycle_id").agg(points.alias("s")).select(
        "cycle_id", F.concat(F.lit("POLYGON (("), F.array_join(text, ", "), F.lit("))")).alias("wkt")
    )

