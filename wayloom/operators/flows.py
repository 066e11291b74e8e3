"""Flows on the network: aggregated along routes, dispersed from origins, and by spatial interaction; and centrality."""

from __future__ import annotations

import math
import re
import time
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.kernel import Csr
from wayloom.operators import routing
from wayloom.operators.parts import Parts
from wayloom.operators.structure import contract
from wayloom.operators.turns import routed, uncompound
from wayloom.schema import Graph
from wayloom.session import materialize


# The coefficients of the logistic curve of cycling over distance.
LOGISTIC = {"constant": -3.894, "d": -0.5872, "root of d": 1.832, "d squared": 0.007956}


def _part(kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("edge", kind), T.StructField("flow", T.DoubleType())])


def _with_edges(graph: Graph, parts: DataFrame, name: str) -> DataFrame:
    """All edges of the graph and their summed parts, 0 where there are none."""
    sums = parts.groupBy("edge").agg(F.sum("flow").alias(name))
    order = graph.order
    e = graph.edges if name not in graph.edges.columns else graph.edges.drop(name)
    return e.join(
        sums.withColumnRenamed("edge", "edge__"), e[order] == F.col("edge__"), "left"
    ).drop("edge__").withColumn(name, F.coalesce(F.col(name), F.lit(0.0)))


def _load(graph: Graph, edges: DataFrame, flows: DataFrame, norm: bool, how: str | Parts) -> DataFrame:
    """Partial sums of (``from_id``, ``to_id``, ``flow``) by edge, by the kernel: each task routes its sources and returns a row for each edge that it
    loaded.
    """
    kind = edges.schema["ord"].dataType

    def by_part(g: Csr, _: list, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        at, to, flow = g.index(rows["a"]).tolist(), g.index(rows["b"]).tolist(), rows["x"].to_pylist()
        goals: dict = {}
        for a, z, f in zip(at, to, flow):
            if a >= 0 and z >= 0:
                goals.setdefault(a, {})[z] = f
        onto = np.zeros(len(g.w))
        trees = g.searches(list(goals)) if g.blocks else ((a, g.search(a, targets=goals[a])) for a in goals)
        for a, tree in trees:
            g.load(tree, goals[a], norm, onto)
        used = np.flatnonzero(onto)
        yield pa.RecordBatch.from_arrays([g.edge_of(used), pa.array(onto[used])], names=["edge", "flow"])

    if isinstance(how, Parts):
        return how.run(how.at_home(flows, "from_id"), "from_id", by_part, _part(kind), target="to_id", number="flow")
    csr, _ = routing.load(edges)
    sent = graph.edges.sparkSession.sparkContext.broadcast(csr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, goals = sent.value, {}
        for b in batches:
            for a, z, f in zip(*(c.to_pylist() for c in b.columns)):
                goals.setdefault(a, []).append((z, f))
        onto = np.zeros(len(g.w))
        for a, tree in routing.trees_of(g, goals):
            if tree is not None:
                to = g.index([z for z, _ in goals[a]])
                g.load(tree, {t: f for t, (_, f) in zip(to.tolist(), goals[a]) if t >= 0}, norm, onto)
        at = np.flatnonzero(onto)
        yield pa.RecordBatch.from_arrays([g.edge_of(at), pa.array(onto[at])], names=["edge", "flow"])

    return routing.spread(flows.select("from_id", "to_id", "flow"), "from_id").mapInArrow(run, _part(kind))


def _on_contracted(graph: Graph, table: DataFrame, work, names: list[str]) -> DataFrame:
    """``work(contracted graph, table)``, whose edges have the columns ``names``, on the graph's own edges; 0 on those that contraction has dropped.
    """
    ends = table.select(F.col("from_id").alias("id"))
    short, mapped = contract(graph, (ends.union(table.select("to_id")) if "to_id" in table.columns else ends).distinct())
    id_col = short.roles.get("edge_id", short.order)
    loaded = work(short, table).select(F.col(f"`{id_col}`").cast("string").alias("edge_new"), *names)
    parts = mapped.join(loaded, "edge_new").select(F.col("edge_old").alias("edge__"), *names)
    e = graph.edges.drop(*names)
    return e.join(parts, e[graph.order] == F.col("edge__"), "left").drop("edge__").fillna(0.0, names)


def flows_aggregate(
    graph: Graph, flows: DataFrame, tol: float = 1e-12, norm_sums: bool = True, pairwise: bool = False, strategy: str = "auto", name: str = "flow",
    contract_first: bool = False
) -> DataFrame:
    """The graph's edges with the column ``flow``: the sum of all flows (``from_id``, ``to_id``, ``flow``) that are routed over each edge, with
    ``norm_sums`` each divided by the number of its route's edges.

    Flows of a pair are added up first; flows from a vertex to itself, null, not positive, or at most ``tol`` of the origin's largest one are not
    routed (``pairwise``: no tolerance), nor those without a route.
    Of parallel edges the one of least weight takes all. An empty table of flows gives 0 on all edges. ``contract_first``: routed on the contracted
    graph, of which the ends of flows stay vertices, and given back to the edges that were contracted; ``norm_sums`` then divides by
    the edges of the contracted route. With a penalty for turns, compound edges give their flow to both of their edges.
    """
    if contract_first:
        return _on_contracted(graph, flows, lambda g, f: flows_aggregate(g, f, tol, norm_sums, pairwise, strategy, name), [name])
    turning, junctions = routed(graph)
    if junctions is not None:
        loaded = flows_aggregate(turning, flows, tol, norm_sums, pairwise, strategy, name)
        plain = uncompound(turning.with_edges(loaded), junctions, [name]).edges
        kind = {f.name: f.dataType for f in graph.edges.schema.fields}
        return plain.select(*[F.col(f"`{c}`").cast(kind[c]) if c in kind else F.col(c) for c in plain.columns])
    sums = flows.where("from_id <> to_id and flow is not null").groupBy("from_id", "to_id").agg(F.sum("flow").alias("flow")).where("flow > 0")
    if not pairwise:
        top = sums.groupBy("from_id").agg(F.max("flow").alias("top"))
        sums = sums.join(top, "from_id").where(F.col("flow") > F.col("top") * tol).drop("top")
    edges, everyone = routing.prepared(graph)
    kind = edges.schema["from_id"].dataType
    sums = sums.withColumns({c: F.col(c).cast(kind) for c in ("from_id", "to_id")})
    sums = routing.ends_of(graph, routing.ends_of(graph, sums, "from_id", "start", everyone), "to_id", "end", everyone)
    how = routing.way(graph, edges, strategy)
    if how != "loop":
        return _with_edges(graph, _load(graph, edges, sums, norm_sums, how), name)
    reached = materialize(routing.tree_loop(edges, sums.select(F.col("from_id").alias("id"))))
    steps = routing.path_steps_loop(reached, sums)
    length = reached.select(F.col("source").alias("from_id"), F.col("vertex").alias("to_id"), "hops")
    parts = steps.join(sums, ["from_id", "to_id"]).join(length, ["from_id", "to_id"])
    return _with_edges(graph, parts.select("edge", (F.col("flow") / (F.col("hops") if norm_sums else F.lit(1))).alias("flow")), name)


def flows_si(
    graph: Graph, origins: DataFrame, destinations: DataFrame, k: float | list[float] = 500.0, tol: float = 1e-12, norm_sums: bool = True, strategy: str = "auto", name: str = "flow"
) -> DataFrame:
    """Singly constrained spatial interaction: flows of each origin's density among the destinations, aggregated along the routes.

    Each origin's density ``n`` (``id``, ``n``) is shared among the destinations (``id``, ``n``) in proportion to n exp(-d / k). Several ``k`` give
    the columns ``flow1``, ``flow2`` and so on; so do columns ``k1``, ``k2`` ... of ``origins``, each origin's own; a column ``k`` is its only one.
    Destinations beyond -k ln(tol) get none. Routes are searched once.
    """
    own = [c for c in origins.columns if re.fullmatch(r"k\d*", c)]
    ks = own or [float(x) for x in (k if isinstance(k, list) else [k])]
    o = origins.groupBy("id").agg(F.sum("n").alias("n_from"), *[F.first(c).cast("double").alias(c) for c in own]).withColumnRenamed("id", "from_id")
    d = destinations.groupBy("id").agg(F.sum("n").alias("n_to")).withColumnRenamed("id", "to_id")
    reached = routing.trees(graph, o.select(F.col("from_id").alias("id")), strategy=strategy)
    near = reached.select(
        F.col("source").alias("from_id"), F.col("vertex").alias("to_id"), "d"
    ).where("from_id <> to_id").join(o, "from_id").join(d, "to_id")
    near = materialize(near)
    out, names = graph, [name] if len(ks) == 1 else [f"{name}{i + 1}" for i in range(len(ks))]
    for column, one in zip(names, ks):
        kk = F.col(one) if own else F.lit(one)
        pull = near.where(F.col("d") <= -kk * math.log(tol)).withColumn("e", F.col("n_to") * F.exp(-F.col("d") / kk))
        total = pull.groupBy("from_id").agg(F.sum("e").alias("total")).where(F.col("total") > tol)
        flows = pull.join(total, "from_id").select("from_id", "to_id", (F.col("n_from") * F.try_divide("e", "total")).alias("flow"))
        out = out.with_edges(flows_aggregate(out, flows, 0.0, norm_sums, pairwise=True, strategy=strategy, name=column))
    return out.edges


def flows_disperse(graph: Graph, origins: DataFrame, k: float | list[float] = 500.0, tol: float = 1e-12, strategy: str = "auto") -> DataFrame:
    """The graph's edges with ``flow`` (several ``k``: ``flow1``, ``flow2`` ...): each origin's density ``n`` (``id``, ``n``) is dispersed to the
    vertices it reaches in proportion to exp(-d / k), each vertex' part on the last edge of its route.

    For k > 0 the search ends at -k ln(tol), for k not above 0 the logistic curve of cycling models is used on all reached vertices. An origin whose
    parts add up to ``tol`` at most is skipped.
    """
    ks = [float(x) for x in (k if isinstance(k, list) else [k])]
    limit = -max(ks) * math.log(tol) if min(ks) > 0 else None
    o = origins.groupBy("id").agg(F.sum("n").alias("n")).withColumnRenamed("id", "source")
    reached = routing.trees(graph, o.select(F.col("source").alias("id")), limit=limit, strategy=strategy).where("prev is not null")
    d = F.col("d")
    c = LOGISTIC
    logistic = F.lit(c["constant"]) + c["d"] * d + c["root of d"] * F.sqrt(d) + c["d squared"] * d * d
    parts = [F.exp(-d / x) if x > 0 else 1 / (1 + F.exp(-logistic)) for x in ks]
    weighed = materialize(reached.select("source", "edge", *[p.alias(f"e{i}") for i, p in enumerate(parts)]))
    total = weighed.groupBy("source").agg(*[F.sum(f"e{i}").alias(f"t{i}") for i in range(len(ks))]).join(o, "source")
    out, names = graph.edges, ["flow"] if len(ks) == 1 else [f"flow{i + 1}" for i in range(len(ks))]
    joined = weighed.join(total, "source")
    sums = joined.groupBy("edge").agg(
        *[F.sum(F.when(F.col(f"t{i}") > tol, F.col("n") * F.col(f"e{i}") / F.col(f"t{i}"))).alias(n) for i, n in enumerate(names)]
    )
    out = graph.edges.drop(*names)
    return out.join(sums.withColumnRenamed("edge", "edge__"), out[graph.order] == F.col("edge__"), "left").drop("edge__").fillna(0.0, names)


def centrality(
    graph: Graph, edges: bool = True, column: str = "d_weighted", vertex_weights: DataFrame | None = None, threshold: float | None = None,
    contract_first: bool = False, strategy: str = "auto"
) -> DataFrame:
    """Betweenness of directed routes by least ``column``: the graph's edges with ``centrality``, or (``id``, ``centrality``) of the vertices. Not
    halved, not normalised; ends count for edges, not for vertices.

    Each source's part is weighted by ``vertex_weights`` (``id``, ``n``; 1 if not given); routes longer than ``threshold`` (by ``column``) aren't
    followed. Of parallel edges the first of the least weight counts. Every task sums the parts of its sources before the
    shuffle. Each component must fit a task. ``contract_first``: of the contracted graph, whose junctions are then the only sources; edges get the
    value
    of the edge that they were contracted to.
    """
    if contract_first:
        if not edges:  # as the contracted graph has them
            return centrality(contract(graph)[0], False, column, vertex_weights, threshold)
        at = vertex_weights if vertex_weights is not None else routing.vertex_ids(graph).limit(0)
        table = at.select(F.col("id").alias("from_id"))
        return _on_contracted(graph, table, lambda g, _: centrality(g, True, column, vertex_weights, threshold), ["centrality"])
    std, ids = routing.prepared(graph, column)
    how = routing.way(graph, std, strategy, column)
    if how == "loop":
        raise ValueError(f"centrality needs components of at most {routing.KERNEL_EDGES} edges; contract the graph first")
    sources = ids.withColumn("n", F.lit(1.0)) if vertex_weights is None else ids.join(
        vertex_weights.groupBy("id").agg(F.sum("n").cast("double").alias("n")), "id"
    )
    ord_kind, id_kind = std.schema["ord"].dataType, ids.schema["id"].dataType

    def by_part(g: Csr, _: list, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        onto = np.zeros(len(g.w) if edges else g.n)
        for at, n in zip(g.index(rows["a"]).tolist(), rows["x"].to_pylist()):
            if at >= 0 and n is not None:
                g.brandes(at, threshold, n, edges, onto)
        at = np.flatnonzero(onto)
        yield pa.RecordBatch.from_arrays([g.edge_of(at) if edges else g.id_of(at), pa.array(onto[at])], names=["edge", "flow"])

    if isinstance(how, Parts):
        parts = how.run(how.at_home(sources, "id"), "id", by_part, _part(ord_kind if edges else id_kind), number="n")
        if edges:
            return _with_edges(graph, parts, "centrality")
        sums = parts.groupBy(F.col("edge").alias("id")).agg(F.sum("flow").alias("centrality"))
        return ids.join(sums, "id", "left").select("id", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))
    csr, _ = routing.load(std)
    sent = graph.edges.sparkSession.sparkContext.broadcast(csr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g: Csr = sent.value
        onto = np.zeros(len(g.w) if edges else g.n)
        for b in batches:
            for at, n in zip(g.index(b.column(0).to_pylist()).tolist(), b.column(1).to_pylist()):
                if at >= 0:
                    g.brandes(at, threshold, n, edges, onto)
        at = np.flatnonzero(onto)
        yield pa.RecordBatch.from_arrays([g.edge_of(at) if edges else pa.array(at, pa.int64()), pa.array(onto[at])], names=["edge", "flow"])

    kind = ord_kind if edges else T.LongType()
    parts = routing.spread(sources, "id").mapInArrow(run, _part(kind))
    if edges:
        return _with_edges(graph, parts, "centrality")
    names = graph.edges.sparkSession.createDataFrame(
        [(i, v) for i, v in enumerate(csr.names.to_pylist())],
        T.StructType([T.StructField("edge", T.LongType()), T.StructField("id", ids.schema["id"].dataType)])
    )
    sums = names.join(parts.groupBy("edge").agg(F.sum("flow").alias("centrality")), "edge").select("id", "centrality")
    return ids.join(sums, "id", "left").select("id", F.coalesce("centrality", F.lit(0.0)).alias("centrality"))


def estimate_centrality_threshold(
    graph: Graph, tolerance: float = 1e-3, start: float | None = None, grow: float = 1.1, max_rounds: int = 60
) -> float:
    """The least distance threshold, growing by a tenth, from which the centrality no longer changes by more than ``tolerance`` (1 - r squared against
    the step before).
    """
    d = start or graph.standard().agg(F.avg("w")).first()[0] * 10
    last = centrality(graph, threshold=d).select(F.col(graph.order).alias("k"), F.col("centrality").alias("a"))
    for _ in range(max_rounds):
        d *= grow
        now = centrality(graph, threshold=d).select(F.col(graph.order).alias("k"), F.col("centrality").alias("b"))
        r = last.join(now, "k").agg(F.corr("a", "b")).first()[0]
        if r is None or 1 - r * r < tolerance:
            return d
        last = now.withColumnRenamed("b", "a")
    return d


def estimate_centrality_time(graph: Graph, sources: int = 100, threshold: float | None = None) -> str:
    """H:M:S that the full centrality is expected to take, from the time of ``sources`` of them."""
    ids = routing.vertex_ids(graph)
    began = time.time()
    centrality(
        graph, vertex_weights=ids.orderBy(F.xxhash64("id")).limit(sources).withColumn("n", F.lit(1.0)), threshold=threshold
    ).agg(F.sum("centrality")).collect()
    s = int((time.time() - began) * max(1.0, ids.count() / sources))
    return f"{s // 3600:02d}:{s // 60 % 60:02d}:{s % 60:02d}"
