"""Distances, times, nearest targets, paths and distances by category.

Three strategies give the same results. The kernel sends the graph as arrays to every executor, where each task searches from its share of the sources;
it is taken while the counted edges stay within ``WHOLE_EDGES``, or within ``KERNEL_EDGES`` if most are of one component. Larger graphs are searched by
parts: a task holds the edges of some components and searches from the sources in them. Where a component is beyond ``KERNEL_EDGES``, the search is a
loop over regions of it: tasks settle the open routes inside their regions, and joins hand over those that cross a border, so neither the graph nor the
routes need to fit anywhere.
"""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.kernel import Csr, Tree
from wayloom.operators import match
from wayloom.operators.parts import Parts, RegionOf, Regions, parts_of, regions_of
from wayloom.operators.structure import vertices
from wayloom.operators.turns import routed
from wayloom.schema import TRAVELLED, Graph
from wayloom.session import forget, materialize, small

#: Edges, and bytes of their arrays, that may be sent to every executor.
KERNEL_EDGES, KERNEL_BYTES = 5_000_000, 400 << 20
#: Edges up to which a graph is sent without asking for its components.
WHOLE_EDGES = 1_000_000
# Names of heaps that callers may give.
HEAPS = ["BHeap", "FHeap", "TriHeap", "TriHeapExt", "Heap23", "set"]

# The wording of errors.
NO_WEIGHTED_TIME = "Graph does not contain a weighted time column from which to calculate fastest paths."
NO_TIME = "Graph does not contain a time column."
NO_LIMIT = "'dlimit' must be specified if no 'to' points are given."
NO_COORDINATES = "Unable to determine geographical coordinates in from/to"
NOT_IN_GRAPH = "from/to are not numeric yet can not be matched onto graph vertices"

#: Targets that may be sent along; with more of them the loop is taken.
KERNEL_TARGETS = 2_000_000
#: Targets of a block, where they are more than that.
BLOCK_TARGETS = 100_000
#: Pairs that a task writes, where the answer is each source with each target.
TASK_PAIRS = 20_000_000

_ARROW = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64()}


def vertex_ids(graph: Graph) -> DataFrame:
    e = graph.edges
    return e.select(graph["from_id"].alias("id")).union(e.select(graph["to_id"].alias("id"))).where("id is not null").distinct()


def prepared(graph: Graph, weight: str = "d_weighted", length: str = "d", extra: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges of ``Graph.standard``, all vertices' ``id``), of a table that is written once: an edge source may be dear, and is asked for both,
    measured and loaded. Edges that are such a table already are not written again.
    """
    table = graph.standard(weight, length, extra, whole=True)
    if not (graph.order and hasattr(graph.edges, "_shared_path")):
        table = materialize(table)
    ids = table.select(F.col("from_id").alias("id")).union(table.select("to_id")).where("id is not null").distinct()
    return table.where(TRAVELLED), ids


def ends_of(graph: Graph, frame: DataFrame, column: str, end: str, everyone: DataFrame) -> DataFrame:
    """``frame`` with the ids of ``column`` as routes of the graph need them.

    In a graph with compound junctions a route leaves a junction from its vertex with the suffix _start and arrives at the one with _end.
    """
    if not graph.attributes.get("compound"):
        return frame
    known = everyone.where(F.col("id").endswith("_" + end)).select(F.col("id").alias("k__"))
    out = frame.join(known, F.concat(F.col(column), F.lit("_" + end)) == F.col("k__"), "left")
    return out.withColumn(column, F.coalesce("k__", F.col(column))).drop("k__")


def plain_ends(graph: Graph, frame: DataFrame, start: str | None = "from_id", end: str | None = "to_id") -> DataFrame:
    """The ids of a result without the suffixes of ``ends_of``; the way from a junction to itself is 0 also where it has two vertices."""
    if not graph.attributes.get("compound"):
        return frame
    strip = {c: F.regexp_replace(c, tail, "") for c, tail in ((start, "_start$"), (end, "_end$")) if c}
    out = frame.select(*[strip.get(c, F.col(c)).alias(c) if c in strip else F.col(c) for c in frame.columns])
    return out.withColumn("d", F.when(F.col(start) == F.col(end), 0.0).otherwise(F.col("d"))) if "d" in out.columns else out


def way(graph: Graph, edges: DataFrame, strategy: str = "auto", weight: str = "d_weighted", length: str = "d") -> str | Parts:
    """How ``edges`` of the graph are searched: ``kernel``, ``loop`` or by the parts that are returned. As arrays an edge measures 36 bytes, and its
    ids.
    """
    if strategy in ("kernel", "loop"):
        return strategy
    if strategy == "parts":
        return parts_of(graph, edges, weight, length)
    if strategy != "auto":
        raise ValueError(f"unknown strategy {strategy!r}")
    size = F.lit(36)
    for c in ("from_id", "to_id", "ord"):
        size = size + (F.octet_length(c) + 4 if isinstance(edges.schema[c].dataType, T.StringType) else F.lit(8))
    n, total = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    fits = n <= KERNEL_EDGES and total <= KERNEL_BYTES
    if fits and n <= WHOLE_EDGES:
        return "kernel"
    parts = parts_of(graph, edges, weight, length)
    if fits and 2 * parts.largest > n:
        return "kernel"
    return parts if parts.largest <= KERNEL_EDGES and parts.largest * (total / n) <= KERNEL_BYTES else "loop"


def load(edges: DataFrame, category: str | None = None) -> tuple[Csr, list]:
    """The arrays of an edge table of ``Graph.standard`` that is known to fit, and the categories in order."""
    t = edges.toArrow()
    column = lambda c: t[c].combine_chunks()
    kinds, codes = [], None
    if category:
        values = t[category].to_pylist()
        kinds = sorted({v for v in values if v is not None})
        code = {v: i for i, v in enumerate(kinds)}
        codes = np.array([code.get(v, -1) for v in values], np.int64)
    number = lambda c: column(c).to_numpy(zero_copy_only=False)
    return Csr(column("from_id"), column("to_id"), number("w"), number("d"), column("ord"), codes), kinds


def per_source(
    spark: SparkSession, csr: Csr, sources: DataFrame, work: Callable[[Csr, list], Iterator[pa.RecordBatch]], schema: T.StructType
) -> DataFrame:
    """Run ``work(csr, source ids)`` in every task; the graph is broadcast once."""
    sent = spark.sparkContext.broadcast(csr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield from work(sent.value, b.column(0).to_pylist())

    return sources.mapInArrow(run, schema)


def trees_of(g: Csr, goals: dict) -> Iterator[tuple]:
    """(source id, tree or None) for a table of sources and the ids of their targets."""
    at = g.index(goals)
    place = {k: a for k, a in zip(at.tolist(), goals) if k >= 0}
    yield from ((a, None) for k, a in zip(at.tolist(), goals) if k < 0)
    if g.blocks:
        yield from ((place[s], tree) for s, tree in g.searches(list(place)))
        return
    for k, a in place.items():
        to = g.index([z if not isinstance(z, tuple) else z[0] for z in goals[a]])
        yield a, g.search(k, targets=to[to >= 0].tolist())


def spread(sources: DataFrame, on: str) -> DataFrame:
    """Sources over all cores: a search is worth a task even for few rows."""
    return sources.repartition(max(1, sources.sparkSession.sparkContext.defaultParallelism * 2), on)


def endpoints(graph: Graph, ids: DataFrame | list | None, everyone: DataFrame | None = None, end: str | None = None) -> DataFrame:
    """A frame with the one column ``id`` of the graph's vertex type, each once.

    ``ids``: None for all vertices; a list or a frame's ``id`` (else its first) column; places in the order of the vertices, as a frame with the one
    column ``n``, counted from 0; or points, as (x, y) pairs or a frame with ``x`` and ``y`` but no ``id``, for the vertices nearest to
    them. Ids given as a list must be in the graph. ``end`` (start or end): which of a compound junction's vertices is meant.
    """
    spark = graph.edges.sparkSession
    everyone = vertex_ids(graph) if everyone is None else everyone
    kind = everyone.schema["id"].dataType
    done = lambda frame: (ends_of(graph, frame, "id", end, everyone) if end else frame).distinct()
    if ids is None:
        if end and graph.attributes.get("compound"):
            return everyone.where(~F.col("id").endswith("_end" if end == "start" else "_start"))
        return everyone
    points = None
    if isinstance(ids, DataFrame):
        if ids.columns == ["n"]:
            numbered = vertices(graph, numbered=True).select(F.col("id").cast(kind).alias("id"), F.col("n").alias("n__"))
            return done(numbered.join(ids, F.col("n__") == F.col("n"), "left_semi").select("id"))
        if "id" in ids.columns or not {"x", "y"} <= set(ids.columns):
            return done(ids.select(F.col("id" if "id" in ids.columns else ids.columns[0]).cast(kind).alias("id")))
        points = ids.select("x", "y")
    elif ids and all(isinstance(i, tuple | list) and len(i) == 2 for i in ids):
        points = spark.createDataFrame([(float(a), float(b)) for a, b in ids], "x double, y double")
    if points is not None:
        if not graph.is_spatial:
            raise ValueError(NO_COORDINATES)
        keyed = points.withColumn("k", F.concat_ws("|", "x", "y"))
        return done(match.points_to_vertices(keyed, "k", "x", "y", vertices(graph)).select(F.col("id").cast(kind).alias("id")))
    frame = done(spark.createDataFrame([(i,) for i in ids], T.StructType([T.StructField("id", kind)])))
    if len(ids) and frame.join(everyone, "id", "left_anti").limit(1).count():
        raise ValueError(NOT_IN_GRAPH)
    return frame


def few(ids: DataFrame) -> list | None:
    """The ids that may be sent to every task, or None if they are more than ``KERNEL_TARGETS``."""
    rows = ids.limit(KERNEL_TARGETS + 1).collect()
    return [r[0] for r in rows] if len(rows) <= KERNEL_TARGETS else None


def each_target(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """(``from_id``, ``to_id``): the rows of the answer, each source with each of the stated targets. Up to ``KERNEL_TARGETS`` of them go to every
    task, more are met block by block.
    """
    to_list = few(targets)
    if to_list is None:
        blocks = max(2 * sources.sparkSession.sparkContext.defaultParallelism, -(-targets.count() // BLOCK_TARGETS))
        held = targets.select(F.col("id").alias("to_id"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b_"))
        asked = sources.select(
            F.col("id").alias("from_id"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("b_")
        )
        return asked.join(held, "b_").drop("b_")
    kind = sources.schema["id"].dataType
    sent = sources.sparkSession.sparkContext.broadcast(to_list)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = pa.array(sent.value, _ARROW[kind])
        for b in batches:
            for source in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.repeat(source, len(ends)), ends], names=["from_id", "to_id"])

    return spread(sources, "id").mapInArrow(run, T.StructType([T.StructField("from_id", kind), T.StructField("to_id", kind)]))


def tree_loop(edges: DataFrame, sources: DataFrame, limit: float | None = None, max_rounds: int = 100_000) -> DataFrame:
    """(``source``, ``vertex``, ``w``, ``d``, ``hops``, ``prev``, ``edge``) of all best routes, by rounds over regions of the graph: a task settles the
    open routes inside its region; those that leave it are joined with the labels of the next one, and the least (w, d, hops, prev) of each vertex is
    kept. What lies in a region without borders is settled by the first round. ``limit``: only rows within this length are returned, and routes beyond
    it are followed only while they may show that a vertex isn't within.
    """
    held = regions_of(edges)
    at = F.col("source") == F.col("id")
    start = sources.select(F.col("id").alias("source")).where("source is not null").distinct().join(held.homes, at).select(
        "source", F.col("source").alias("vertex"), "region", _label(edges).alias("l"), F.lit(True).alias("fresh"), F.lit(0.0).alias("top_w")
    )
    names = ["source", "vertex", "l.*"]
    within = lambda frame: frame if limit is None else frame.where(F.col("d") <= limit)
    step = _settled(held, start, edges, limit)
    if not held.borders:
        return within(step.select(*names))
    first = materialize(step)
    labels = _going(first.where("open").groupBy("source", "vertex", "region").agg(F.min(F.struct("l", "fresh")).alias("m")), limit)
    for _ in range(max_rounds):
        if not labels.where("going").limit(1).count():
            break
        step = _settled(held, labels.where("going"), edges, limit)
        both = labels.where("not going").select("source", "vertex", "region", "l", "fresh").unionByName(step.drop("open"))
        old, labels = labels, _going(both.groupBy("source", "vertex", "region").agg(F.min(F.struct("l", "fresh")).alias("m")), limit)
        forget(old)
    else:
        raise RuntimeError(f"routes are still open after {max_rounds} rounds")
    return within(first.where("not open").select(*names).unionByName(labels.select(*names)))


def _label(edges: DataFrame) -> Column:
    """The label of a source itself."""
    kinds = {f.name: f.dataType for f in edges.schema.fields}
    return F.struct(
        F.lit(0.0).alias("w"), F.lit(0.0).alias("d"), F.lit(0).cast("bigint").alias("hops"), F.lit(None).cast(kinds["from_id"]).alias("prev"),
        F.lit(None).cast(kinds["ord"]).alias("edge")
    )


def _going(merged: DataFrame, limit: float | None) -> DataFrame:
    """The labels as a table, with ``going`` where the region has an open route of the source that must be followed. A route beyond the limit waits, and
    is followed once it may be the better one to a vertex that now seems within.
    """
    labels = merged.select("source", "vertex", "region", "m.l", "m.fresh").withColumn("top_w", F.lit(0.0))
    go = F.col("fresh")
    if limit is not None:
        near = F.when(F.col("l.d") <= limit, F.col("l.w"))
        labels = labels.withColumn("top_w", F.coalesce(F.max(near).over(Window.partitionBy("source")), F.lit(0.0)))
        go = go & ((F.col("l.d") <= limit) | (F.col("l.w") < F.col("top_w")))
    return materialize(labels.withColumn("going", F.max(go).over(Window.partitionBy("source", "region"))))


def _settled(held: Regions, labels: DataFrame, edges: DataFrame, limit: float | None) -> DataFrame:
    """The labels of ``labels``' sources and regions once all open routes inside the regions are settled, and of the routes that leave them: those are
    ``fresh``, as are routes that wait beyond the limit. ``open``: whether the region has borders.
    """
    kinds = {f.name: f.dataType for f in edges.schema.fields}
    kind, ord_kind = kinds["from_id"], kinds["ord"]
    fields = [
        ("source", kind), ("vertex", kind), ("region", T.LongType()), ("w", T.DoubleType()), ("d", T.DoubleType()), ("hops", T.LongType()), ("prev", kind),
        ("edge", ord_kind), ("fresh", T.BooleanType()), ("open", T.BooleanType())
    ]

    def batch(source, g: Csr, v: np.ndarray, columns: list[pa.Array], near: RegionOf, fresh: np.ndarray) -> pa.RecordBatch:
        n = len(v)
        return pa.RecordBatch.from_arrays(
            [pa.repeat(pa.scalar(source, _ARROW[kind]), n), g.id_of(v), pa.array(near.region[v]), *columns, pa.array(fresh), pa.repeat(near.open, n)],
            names=[f[0] for f in fields]
        )

    def work(g: Csr, near: RegionOf, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sources, at = rows.column("source").combine_chunks(), g.index(rows.column("vertex").combine_chunks())
        if (ends := at < 0).any():  # vertices that no edge of the region touches
            rest = rows.filter(pa.array(ends))
            yield from pa.table(
                [*(rest.column(f[0]) for f in fields[:8]), pa.array(np.zeros(len(rest), bool)), pa.repeat(near.open, len(rest))], names=[f[0] for f in fields]
            ).to_batches()
            rows, at = rows.filter(pa.array(~ends)), at[~ends]
            sources = rows.column("source").combine_chunks()
        if not len(at):
            return
        plain, groups, hops, at = [], [], rows.column("hops").to_pylist(), at.tolist()
        cuts = np.flatnonzero(pc.not_equal(sources.slice(1), sources.slice(0, len(sources) - 1)).to_numpy(zero_copy_only=False)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(sources)]):
            alone = j - i == 1 and hops[i] == 0 and (limit is None or not near.open)
            (plain if alone else groups).append((i, j))
        place = {at[i]: sources[i].as_py() for i, _ in plain}
        found = g.searches(list(place)) if limit is None else ((k, g.search(k, limit=limit)) for k in place)
        for k, t in found:
            yield batch(place[k], g, t.v, [pa.array(t.w), pa.array(t.d), pa.array(t.hops), g.id_of(t.prev), g.edge_of(t.edge)], near, near.outside[t.v])
        for i, j in groups:
            part = rows.slice(i, j - i)
            seeds = list(zip(*(part.column(c).to_pylist() for c in ("w", "d", "hops", "prev", "edge"))))
            where = at[i:j]
            label = dict(zip(where, seeds))
            going = [v for v, f in zip(where, part.column("fresh").to_pylist()) if f]
            waits = g.resume(label, going, near.outside_list, limit, part.column("top_w")[0].as_py())
            v = np.fromiter(label, np.int64, len(label))
            columns = [pa.array([x[c] for x in label.values()], _ARROW[f]) for c, f in enumerate((T.DoubleType(), T.DoubleType(), T.LongType(), kind, ord_kind))]
            fresh = near.outside[v] | np.isin(v, np.fromiter(waits, np.int64, len(waits)))
            yield batch(sources[i].as_py(), g, v, columns, near, fresh)

    out = held.run(labels, work, T.StructType([T.StructField(*f) for f in fields]))
    return out.select("source", "vertex", "region", F.struct("w", "d", "hops", "prev", "edge").alias("l"), "fresh", "open")


def _tree_batch(g: Csr, kind: T.DataType, source, tree: Tree) -> pa.RecordBatch:
    ids = [pa.repeat(pa.scalar(source, _ARROW[kind]), len(tree.v)), g.id_of(tree.v)]
    numbers = [pa.array(tree.w), pa.array(tree.d), pa.array(tree.hops)]
    return pa.RecordBatch.from_arrays(
        [*ids, *numbers, g.id_of(tree.prev), g.edge_of(tree.edge)], names=["source", "vertex", "w", "d", "hops", "prev", "edge"]
    )


def trees(
    graph: Graph, sources: DataFrame | list | None = None, limit: float | None = None, weight: str = "d_weighted", length: str = "d",
    strategy: str = "auto"
) -> DataFrame:
    """The best routes from each source to every vertex that it reaches (within ``limit`` of length).

    One row per source and vertex with the route's weight, length, edges and last step. In graphs with compound junctions the rows are of the graph's
    own vertices.
    """
    graph, _ = routed(graph)
    edges, everyone = prepared(graph, weight, length)
    wanted = endpoints(graph, sources, everyone, "start").where("id is not null")
    how = way(graph, edges, strategy, weight, length)
    if how == "loop":
        return tree_loop(edges, wanted, limit)
    kind = wanted.schema["id"].dataType

    def work(g: Csr, ids: list) -> Iterator[pa.RecordBatch]:
        place = {k: i for i, k in zip(ids, g.index(ids).tolist()) if k >= 0}
        found = g.searches(list(place)) if limit is None else ((k, g.search(k, limit=limit)) for k in place)
        for k, tree in found:
            if limit is not None:
                near = tree.d <= limit
                tree = Tree(*[getattr(tree, f)[near] for f in ("v", "w", "d", "hops", "prev", "edge")])
            yield _tree_batch(g, kind, place[k], tree)

    fields = [
        ("source", kind), ("vertex", kind), ("w", T.DoubleType()), ("d", T.DoubleType()), ("hops", T.LongType()), ("prev", kind),
        ("edge", edges.schema["ord"].dataType)
    ]
    schema = T.StructType([T.StructField(*f) for f in fields])
    if isinstance(how, Parts):
        return how.run(how.at_home(wanted, "id"), "id", lambda g, _, rows: work(g, rows["a"].to_pylist()), schema)
    return per_source(graph.edges.sparkSession, load(edges)[0], spread(wanted, "id"), work, schema)


def _dists_by_parts(graph: Graph, parts: Parts, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """As ``dists``. A source's lengths to the targets of its home are one array, in which a target has a place; elsewhere there is no route, so the
    searches give no row for each pair of the answer.
    """
    kind = sources.schema["id"].dataType
    n_from, n_to = sources.count(), targets.count()
    turned = n_to < n_from
    if turned:
        sources, targets = targets, sources
    place = F.row_number().over(Window.partitionBy("home").orderBy("id")) - 1
    homed = materialize(parts.at_home(targets, "id").withColumn("n", place))

    def work(g: Csr, held: list[pa.RecordBatch], rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ends = np.full(sum(b.num_rows for b in held), -1)
        for b in held:
            ends[b.column(5).to_numpy().astype(np.int64)] = g.index(b.column(3))
        known = ends[ends >= 0].tolist()
        at = g.index(rows["a"]).tolist()
        found = dict(g.searches(list({k for k in at if k >= 0}), known)) if known else {}
        for i, k in enumerate(at):
            d = np.full(g.n + 1, np.nan)
            if k in found:
                d[found[k].v] = found[k].d
            row = d[ends]
            line = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), pa.array(row, mask=np.isnan(row)))
            yield pa.RecordBatch.from_arrays([rows["a"].slice(i, 1), rows["home"].slice(i, 1), line], names=["id", "home", "found"])

    schema = T.StructType([T.StructField("id", kind), T.StructField("home", T.LongType()), T.StructField("found", T.ArrayType(T.DoubleType()))])
    asked = parts.at_home(sources, "id")
    lines = parts.run(asked, "id", work, schema, held=homed, turned=turned, numbers=False).unionByName(
        parts.outside(sources, "id"), allowMissingColumns=True
    )
    places = homed.select("id", "home", "n").unionByName(parts.outside(targets, "id"), allowMissingColumns=True)
    names = ("to_id", "from_id") if turned else ("from_id", "to_id")
    lines = lines.select(F.col("id").alias(names[0]), F.col("home").alias("h__"), "found")
    places = materialize(places.select(F.col("id").alias(names[1]), F.col("home").alias("k__"), "n"))
    lines, places = (plain_ends(graph, f, *(c if c in f.columns else None for c in ("from_id", "to_id"))) for f in (lines, places))
    held = small(places, KERNEL_TARGETS)
    if held is not places:
        # the writing of the pairs takes far longer than the searches, whose tasks are as uneven as the parts
        tasks = max(2 * lines.sparkSession.sparkContext.defaultParallelism, min(-(-n_from * n_to // TASK_PAIRS), n_from, n_to))
        pairs = lines.repartition(tasks, names[0]).crossJoin(held)
    else:
        blocks = max(2 * lines.sparkSession.sparkContext.defaultParallelism, -(-places.count() // BLOCK_TARGETS))
        pairs = lines.withColumn("b_", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(
            places.withColumn("b_", F.pmod(F.xxhash64(names[1]), F.lit(blocks)).cast("int")), "b_"
        )
    d = F.when(F.col("h__") == F.col("k__"), F.get("found", F.col("n"))).when(F.col("from_id") == F.col("to_id"), 0.0)
    if graph.attributes.get("compound"):
        d = F.when(F.col("from_id") == F.col("to_id"), 0.0).otherwise(d)
    return pairs.select("from_id", "to_id", d.alias("d"))


def dists(
    graph: Graph, from_ids=None, to_ids=None, shortest: bool = True, strategy: str = "auto", length: str = "d", weight: str | None = None,
    heap: str | None = None
) -> DataFrame:
    """(``from_id``, ``to_id``, ``d``): the length of the best route for each source and target, null where there is none, 0 from a vertex to itself.

    Routes have the least ``d_weighted`` (``shortest``) or the least ``time_weighted``; of equal ones the shorter. Ids that aren't in the graph
    are an error in lists, and unreachable in frames. Repeated ids give one row a pair. If there are more sources than targets the graph is
    turned round and searched from the targets. In graphs with compound junctions ids are those of the plain graph. ``heap`` may name one of
    ``HEAPS``, which all give the same result and are the same here.
    """
    if heap is not None and heap not in HEAPS:
        raise ValueError(f"there is no heap {heap!r}")
    weight = weight or ("d_weighted" if shortest else "time_weighted")
    if weight == "time_weighted":
        graph.require(weight, NO_WEIGHTED_TIME)
    graph, _ = routed(graph)
    edges, everyone = prepared(graph, weight, length)
    sources, targets = endpoints(graph, from_ids, everyone, "start"), endpoints(graph, to_ids, everyone, "end")
    how = way(graph, edges, strategy, weight, length)
    if isinstance(how, Parts):
        return _dists_by_parts(graph, how, sources, targets)
    to_list = few(targets) if how == "kernel" else None
    if to_list is None:
        reached = tree_loop(edges, sources)
        got = reached.select(F.col("source").alias("from_id"), F.col("vertex").alias("to_id"), "d")
        return plain_ends(graph, each_target(sources, targets).join(got, ["from_id", "to_id"], "left"))
    turned = False
    if from_ids is not None and len(to_list) < (n_from := sources.limit(len(to_list) + 1).count()) and (from_list := few(sources)) is not None:
        edges = edges.select("ord", F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"), "w", "d")
        sources, to_list, turned = targets, from_list, bool(n_from)
    csr, _ = load(edges)
    kind = sources.schema["id"].dataType
    names = ["to_id", "from_id"] if turned else ["from_id", "to_id"]
    same = {v: i for i, v in enumerate(to_list)}
    columns = pa.array(to_list, _ARROW[kind])

    def work(g: Csr, ids: list) -> Iterator[pa.RecordBatch]:
        ends = g.index(columns)
        known = ends[ends >= 0].tolist()
        at = g.index(ids)
        place = dict(zip(at.tolist(), ids))
        missing = [(i, None) for i, k in zip(ids, at.tolist()) if k < 0]
        for source, tree in itertools.chain(((place[s], t) for s, t in g.searches([k for k in place if k >= 0], known)), missing):
            d = np.full(g.n + 1, np.nan)
            if tree is not None:
                d[tree.v] = tree.d
            found = d[ends]
            if source in same:
                found[same[source]] = 0.0
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(pa.scalar(source, _ARROW[kind]), len(columns)), columns, pa.array(found, mask=np.isnan(found))], names=[*names, "d"]
            )

    fields = [T.StructField(names[0], kind), T.StructField(names[1], kind), T.StructField("d", T.DoubleType())]
    out = per_source(graph.edges.sparkSession, csr, spread(sources, "id"), work, T.StructType(fields))
    return plain_ends(graph, out.select("from_id", "to_id", "d"))


def times(graph: Graph, from_ids=None, to_ids=None, shortest: bool = False, strategy: str = "auto") -> DataFrame:
    """As ``dists``, of travel times (column ``time``): along the fastest routes, or with ``shortest`` along the routes of least weighted distance."""
    graph.require("time", NO_TIME)
    return dists(graph, from_ids, to_ids, shortest, strategy, length="time").withColumnRenamed("d", "time")


def dists_pairwise(graph: Graph, pairs: DataFrame, shortest: bool = True, strategy: str = "auto", length: str = "d") -> DataFrame:
    """``pairs`` (``from_id``, ``to_id``, and whatever else) with the length ``d`` of each pair's best route (``d_`` if there is such a column). Each
    source is searched once, for its own targets only; a source with many pairs is one search.
    """
    weight = "d_weighted" if shortest else "time_weighted"
    name = "d" if "d" not in {c.lower() for c in pairs.columns} else "d_"
    graph, _ = routed(graph)
    edges, everyone = prepared(graph, weight, length)
    kind = edges.schema["from_id"].dataType
    asked = pairs.select(
        F.col("from_id").cast(kind).alias("from_id"), F.col("to_id").cast(kind).alias("to_id")
    ).where("from_id is not null and to_id is not null").distinct()
    wanted = ends_of(graph, ends_of(graph, asked, "from_id", "start", everyone), "to_id", "end", everyone)
    how = way(graph, edges, strategy, weight, length)
    schema = T.StructType([T.StructField("from_id", kind), T.StructField("to_id", kind), T.StructField("d", T.DoubleType())])
    if isinstance(how, Parts):

        def work(g: Csr, _: list, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            at, to = g.index(rows["a"]), g.index(rows["b"])
            ends: dict[int, list] = {}
            for i, k in enumerate(at.tolist()):
                ends.setdefault(k, []).append(i)
            found = np.full(len(at), np.nan)
            alone = [k for k in ends if k >= 0]
            trees = g.searches(alone) if g.blocks else ((k, g.search(k, targets=[t for t in to[ends[k]].tolist() if t >= 0])) for k in alone)
            for k, tree in trees:
                d = np.full(g.n + 1, np.nan)
                d[tree.v] = tree.d
                found[ends[k]] = d[to[ends[k]]]
            same = pc.equal(rows["a"], rows["b"]).to_numpy(zero_copy_only=False)
            found[same] = 0.0
            yield pa.RecordBatch.from_arrays([rows["a"], rows["b"], pa.array(found, mask=np.isnan(found))], names=["from_id", "to_id", "d"])

        far = how.outside(wanted, "from_id").withColumn("d", F.when(F.col("from_id") == F.col("to_id"), 0.0))
        got = how.run(how.at_home(wanted, "from_id"), "from_id", work, schema, target="to_id", numbers=False).unionByName(far)
    elif how == "kernel":
        csr, _ = load(edges)
        sent = graph.edges.sparkSession.sparkContext.broadcast(csr)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g = sent.value
            goals: dict = {}
            for b in batches:
                for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    goals.setdefault(a, []).append(z)
            for a, tree in trees_of(g, goals):
                ends = goals[a]
                d = np.full(g.n + 1, np.nan)
                to = g.index(ends)
                if tree is not None:
                    d[tree.v] = tree.d
                found = np.where([z == a for z in ends], 0.0, d[to])
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(pa.scalar(a, _ARROW[kind]), len(ends)), pa.array(ends, _ARROW[kind]), pa.array(found, mask=np.isnan(found))],
                    names=["from_id", "to_id", "d"]
                )

        got = spread(wanted, "from_id").mapInArrow(run, schema)
    else:
        reached = tree_loop(edges, wanted.select(F.col("from_id").alias("id")))
        got = wanted.join(reached.select(F.col("source").alias("from_id"), F.col("vertex").alias("to_id"), "d"), ["from_id", "to_id"])
    got = plain_ends(graph, got).withColumnRenamed("d", "found__")
    return pairs.join(got, ["from_id", "to_id"], "left").withColumnRenamed("found__", name)


def dists_nearest(graph: Graph, from_ids=None, to_ids=None, shortest: bool = True, strategy: str = "auto") -> DataFrame:
    """(``from_id``, ``to_id``, ``d``): for each source the target whose route has the least weight (of equal ones the shorter route, then the smaller
    id) and its length; nulls where none can be reached. The search ends at the first target.
    """
    weight = "d_weighted" if shortest else "time_weighted"
    graph, _ = routed(graph)
    edges, everyone = prepared(graph, weight)
    sources, targets = endpoints(graph, from_ids, everyone, "start"), endpoints(graph, to_ids, everyone, "end")
    how = way(graph, edges, strategy, weight)
    to_list = few(targets) if how == "kernel" else None
    if to_list is None and not isinstance(how, Parts):
        reached = tree_loop(edges, sources).join(targets.select(F.col("id").alias("vertex")), "vertex", "left_semi")
        got = reached.groupBy("source").agg(F.min(F.struct("w", "d", "vertex")).alias("m"))
        out = sources.join(got, sources["id"] == got["source"], "left").select(
            F.col("id").alias("from_id"), F.col("m.vertex").alias("to_id"), F.col("m.d").alias("d")
        )
        return plain_ends(graph, out)
    kind = sources.schema["id"].dataType

    def work(g: Csr, ids: list, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        goals = set(ends[ends >= 0].tolist())
        out = []
        for source, at in zip(ids, g.index(ids).tolist()):
            best = (None, None)
            if at >= 0 and goals:
                tree = g.search(at, targets=goals, nearest=True)
                if len(tree.v) and int(tree.v[-1]) in goals:
                    # others may be open at the same weight and length: the smallest id counts
                    full = g.search(at, targets=goals) if _tied(g, tree) else tree
                    hits = [(w, d, v) for w, d, v in zip(full.w.tolist(), full.d.tolist(), full.v.tolist()) if v in goals]
                    w, d, v = min(hits)
                    best = (g.names[v].as_py(), d)
            out.append((source, *best))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], _ARROW[kind] if i < 2 else pa.float64()) for i in range(3)], names=["from_id", "to_id", "d"]
        )

    fields = [T.StructField("from_id", kind), T.StructField("to_id", kind), T.StructField("d", T.DoubleType())]
    if isinstance(how, Parts):
        goals_of = lambda g, held: np.concatenate([g.index(b.column(3)) for b in held] or [np.empty(0, np.int64)])
        out = how.run(
            how.at_home(sources, "id"), "id", lambda g, held, rows: work(g, rows["a"].to_pylist(), goals_of(g, held)), T.StructType(fields),
            held=how.at_home(targets, "id").withColumn("n", F.lit(0.0))
        )
        far = how.outside(sources, "id").select(F.col("id").alias("from_id"))
        return plain_ends(graph, out.unionByName(far, allowMissingColumns=True))
    near = lambda g, ids: work(g, ids, g.index(to_list))
    return plain_ends(graph, per_source(graph.edges.sparkSession, load(edges)[0], spread(sources, "id"), near, T.StructType(fields)))


def _tied(g: Csr, tree: Tree) -> bool:
    """Whether another vertex might be settled at the weight at which the search ended."""
    last = tree.w[-1]
    out = np.concatenate([np.arange(g.start[v], g.start[v + 1]) for v in tree.v[:-1].tolist()] or [np.empty(0, int)])
    if not len(out):
        return False
    w = dict(zip(tree.v.tolist(), tree.w.tolist()))
    reach = np.array([w[v] for v in g.tail[out].tolist()]) + g.w[out]
    return bool(np.any((reach == last) & (g.head[out] != tree.v[-1])))


def paths(
    graph: Graph, from_ids=None, to_ids=None, pairs: DataFrame | None = None, strategy: str = "auto", weight: str = "d_weighted",
    unreached: bool = True
) -> DataFrame:
    """(``from_id``, ``to_id``, ``vertices``, ``edges``, ``d``): the vertex ids and the edges (by the graph's order column) of the best routes, in
    order.

    From a vertex to itself the vertices are [v, v] and the edges null; pairs without a route have nulls, or no row if not ``unreached``. Either
    sources and targets, or ``pairs`` of them.
    """
    graph, _ = routed(graph)
    edges, everyone = prepared(graph, weight)
    kind, ord_kind = edges.schema["from_id"].dataType, edges.schema["ord"].dataType
    if pairs is not None:
        wanted = pairs.select(
            F.col("from_id").cast(kind).alias("from_id"), F.col("to_id").cast(kind).alias("to_id")
        ).where("from_id is not null and to_id is not null").distinct()
        wanted = ends_of(graph, ends_of(graph, wanted, "from_id", "start", everyone), "to_id", "end", everyone)
    else:
        sources, targets = endpoints(graph, from_ids, everyone, "start"), endpoints(graph, to_ids, everyone, "end")
    how = way(graph, edges, strategy, weight)
    if pairs is None and (unreached or not isinstance(how, Parts)):
        wanted = each_target(sources, targets)
    if how == "loop":
        reached = materialize(tree_loop(edges, wanted.select(F.col("from_id").alias("id")).distinct()))
        steps = path_steps_loop(reached, wanted)
        route = steps.groupBy("from_id", "to_id").agg(F.sort_array(F.collect_list(F.struct("pos", "vertex", "edge"))).alias("s"))
        full = wanted.join(route, ["from_id", "to_id"], "left").join(
            reached.select(F.col("source").alias("from_id"), F.col("vertex").alias("to_id"), "d"), ["from_id", "to_id"], "left"
        )
        own = F.col("from_id") == F.col("to_id")
        return (full if unreached else full.where(own | F.col("s").isNotNull())).select(
            "from_id", "to_id",
            F.when(own, F.array("from_id", "from_id")).when(
                F.col("s").isNotNull(), F.concat(F.array("from_id"), F.col("s.vertex"))
            ).alias("vertices"),
            F.when(~own, F.col("s.edge")).alias("edges"), F.when(own, 0.0).otherwise(F.col("d")).alias("d")
        )

    def work(g: Csr, goals: dict, whole: bool) -> Iterator[pa.RecordBatch]:
        for a, tree in trees_of(g, goals):
            ends = goals[a]
            to = g.index(ends)
            found, d = {}, {}
            if tree is not None:
                found, d = g.paths(tree, to[to >= 0]), dict(zip(tree.v.tolist(), tree.d.tolist()))
            rows = []
            for z, t in zip(ends, to.tolist()):
                if z == a:
                    rows.append((a, z, [a, a], None, 0.0))
                elif t in found:
                    rows.append((a, z, g.id_of(found[t][0]).to_pylist(), g.edge_of(found[t][1]).to_pylist(), d[t]))
                elif whole:
                    rows.append((a, z, None, None, None))
            kinds = [_ARROW[kind], _ARROW[kind], pa.list_(_ARROW[kind]), pa.list_(_ARROW[ord_kind]), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["from_id", "to_id", "vertices", "edges", "d"]
            )

    fields = [("from_id", kind), ("to_id", kind), ("vertices", T.ArrayType(kind)), ("edges", T.ArrayType(ord_kind)), ("d", T.DoubleType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    if isinstance(how, Parts):
        each_end = pairs is None

        def search(g: Csr, held: list, rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            goals: dict = {}
            if each_end:
                ends = [z for b in held for z in b.column(3).to_pylist()]
                goals = dict.fromkeys(rows["a"].to_pylist(), ends) if ends else {}
            else:
                for a, z in zip(rows["a"].to_pylist(), rows["b"].to_pylist()):
                    goals.setdefault(a, []).append(z)
            yield from work(g, goals, False)

        if pairs is None:
            held = how.at_home(targets, "id").withColumn("n", F.lit(0.0))
            got = how.run(how.at_home(sources, "id"), "id", search, schema, held=held)
        else:
            got = how.run(how.at_home(wanted, "from_id"), "from_id", search, schema, target="to_id")
        own = F.col("from_id") == F.col("to_id")
        if unreached:
            return wanted.join(got, ["from_id", "to_id"], "left").withColumns(
                {"vertices": F.when(own, F.array("from_id", "from_id")).otherwise(F.col("vertices")), "d": F.when(own, 0.0).otherwise(F.col("d"))}
            )
        far = how.outside(sources.join(targets, "id", "left_semi"), "id").select(
            F.col("id").alias("from_id"), F.col("id").alias("to_id")
        ) if pairs is None else how.outside(wanted.where(own), "from_id")
        return got.unionByName(far.withColumns({"vertices": F.array("from_id", "from_id"), "d": F.lit(0.0)}), allowMissingColumns=True)
    csr, _ = load(edges)
    sent = graph.edges.sparkSession.sparkContext.broadcast(csr)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        goals: dict = {}
        for b in batches:
            for a, z in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                goals.setdefault(a, []).append(z)
        yield from work(sent.value, goals, unreached)

    return spread(wanted, "from_id").mapInArrow(run, schema)


def path_steps_loop(reached: DataFrame, wanted: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """(``from_id``, ``to_id``, ``pos``, ``vertex``, ``edge``): the steps of the routes to ``wanted`` from a table of trees, by following all of them
    back one step a round.
    """
    tree = reached.select(F.col("source").alias("from_id"), F.col("vertex").alias("at"), "prev", "edge", "hops")
    open_ = wanted.select("from_id", "to_id", F.col("to_id").alias("at"))
    parts: list[DataFrame] = []
    for _ in range(max_rounds):
        step = materialize(open_.join(tree, ["from_id", "at"]).where("prev is not null"))
        if not step.limit(1).count():
            break
        parts.append(step.select("from_id", "to_id", F.col("hops").alias("pos"), F.col("at").alias("vertex"), "edge"))
        open_ = step.select("from_id", "to_id", F.col("prev").alias("at"))
    else:
        raise RuntimeError(f"routes are still open after {max_rounds} rounds")
    if not parts:
        return open_.join(tree, ["from_id", "at"]).select(
            "from_id", "to_id", F.col("hops").alias("pos"), F.col("at").alias("vertex"), "edge"
        ).limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def path_edges(
    graph: Graph, from_ids=None, to_ids=None, pairs: DataFrame | None = None, strategy: str = "auto", weight: str = "d_weighted"
) -> DataFrame:
    """(``from_id``, ``to_id``, ``pos``, ``edge``): one row per edge of each route, ``pos`` from 1."""
    routes = paths(graph, from_ids, to_ids, pairs, strategy, weight, unreached=False).where("edges is not null")
    return routes.select(
        "from_id", "to_id", F.posexplode("edges").alias("pos0", "edge")
    ).select("from_id", "to_id", (F.col("pos0") + 1).alias("pos"), "edge")


def dists_categorical(graph: Graph, category: str, from_ids=None, to_ids=None, pairs: DataFrame | None = None, strategy: str = "auto") -> DataFrame:
    """(``from_id``, ``to_id``, ``category``, ``d``): the length of each route on the edges of each category; edges without a category count in the
    route's length only. Categories that a route doesn't use have no row.
    """
    steps = path_edges(graph, from_ids, to_ids, pairs, strategy)
    e = graph.standard(extra=[category]).select(F.col("ord").alias("edge"), F.col("d").alias("part"), F.col(f"`{category}`").alias("category"))
    return steps.join(e, "edge").where("category is not null").groupBy("from_id", "to_id", "category").agg(F.sum("part").alias("d"))


def categorical_proportions(graph: Graph, category: str, from_ids=None, to_ids=None, strategy: str = "auto") -> DataFrame:
    """(``category``, ``d``, ``proportion``): over all routes, the length on each category and its share of the total length. Edges without a category
    count in the total.
    """
    steps = path_edges(graph, from_ids, to_ids, strategy=strategy)
    e = graph.standard(extra=[category]).select(F.col("ord").alias("edge"), F.col("d").alias("part"), F.col(f"`{category}`").alias("category"))
    by_kind = steps.join(e, "edge").groupBy("category").agg(F.sum("part").alias("d"))
    total = by_kind.agg(F.sum("d").alias("total"))
    return by_kind.join(F.broadcast(total)).where("category is not null").select("category", "d", F.try_divide("d", "total").alias("proportion"))


def categorical_within(graph: Graph, category: str, from_ids, limit: float | None, strategy: str = "auto") -> DataFrame:
    """(``from_id``, ``category``, ``d``): for each source, the summed lengths by category of the routes to the first vertices beyond ``limit``: those
    further than it whose previous vertex is nearer.
    """
    if limit is None:
        raise ValueError(NO_LIMIT)
    reached = materialize(trees(graph, from_ids, strategy=strategy))
    before = reached.select("source", F.col("vertex").alias("prev"), F.col("d").alias("d_prev"))
    first = reached.join(before, ["source", "prev"]).where((F.col("d") > limit) & (F.col("d_prev") < limit)).select(
        F.col("source").alias("from_id"), F.col("vertex").alias("to_id")
    )
    return dists_categorical(graph, category, pairs=first, strategy=strategy).groupBy("from_id", "category").agg(F.sum("d").alias("d"))


def compare_strategies(graph: Graph, sources: int = 100, seed: int = 0) -> dict[str, float]:
    """Seconds that the kernel and the loop take for all routes from the same ``sources`` vertices."""
    start = materialize(vertex_ids(graph).orderBy(F.xxhash64("id", F.lit(seed))).limit(sources))
    took = {}
    for strategy in ("kernel", "loop"):
        began = time.time()
        trees(graph, start, strategy=strategy).agg(F.sum("d")).collect()
        took[strategy] = time.time() - began
    return took
