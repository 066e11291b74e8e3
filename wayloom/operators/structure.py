"""The structure of graphs: vertices, components, contraction, duplicates, merging, sampling, insertion."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.functions import geo
from wayloom.schema import Graph
from wayloom.session import forget, materialize

#: Pairs, and bytes of their ids, whose components one task finds; more are joined round by round.
TASK_PAIRS, TASK_BYTES = 5_000_000, 160 << 20
#: Pairs that a task reduces at a time to those that connect their vertices.
FOREST_PAIRS = 1_000_000


def vertices(graph: Graph, numbered: bool = False) -> DataFrame:
    """(``id``, and ``x``, ``y``, ``component`` if the graph has them): each vertex once, as its first edge has it; the start of an edge comes before
    its end. ``numbered`` adds ``n``, counted from 0 in the order of first occurrence, which takes a global
    sort: done by ranges and per-range counts, not in one task. Edges' null ids make no vertex; null coordinates give way to later ones."""
    order = F.col(f"`{graph.order}`") if graph.order else F.monotonically_increasing_id()
    parts = []
    for turn, end in enumerate(("from", "to")):
        cols = [graph[f"{end}_id"].alias("id"), order.alias("o_"), F.lit(turn).alias("t_")]
        if graph.is_spatial:
            cols += [graph[f"{end}_x"].alias("x"), graph[f"{end}_y"].alias("y")]
        if graph.has("component"):
            cols.append(graph["component"].alias("component"))
        parts.append(graph.edges.select(*cols))
    every = parts[0].unionByName(parts[1]).where("id is not null")
    aggs = [F.min(F.struct("o_", "t_")).alias("first_")]
    if graph.is_spatial:
        place = F.struct("o_", "t_", "x", "y")
        aggs.append(F.min(F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), place)).alias("p_"))
    if graph.has("component"):
        aggs.append(F.min(F.struct("o_", "t_", "component")).alias("c_"))
    out = every.groupBy("id").agg(*aggs)
    cols = ["id", *(["p_.x", "p_.y"] if graph.is_spatial else []), *(["c_.component"] if graph.has("component") else [])]
    if not numbered:
        return out.select(*cols)
    ranged = materialize(out.repartitionByRange("first_").sortWithinPartitions("first_").withColumn("part_", F.spark_partition_id()))
    counts = ranged.groupBy("part_").count().orderBy("part_").collect()  # a row per partition
    start, base = {}, 0
    for r in counts:
        start[r.part_], base = base, base + r["count"]
    offset = F.lit(0) if not start else F.create_map(*[F.lit(x) for kv in start.items() for x in kv])[F.col("part_")]
    rank = F.row_number().over(Window.partitionBy("part_").orderBy("first_", "id"))
    return ranged.withColumn("n", (rank - 1 + offset).cast("bigint")).select(*cols, "n")


def degrees(graph: Graph) -> DataFrame:
    """(``id``, ``n_in``, ``n_out``): edges that end and begin at each vertex, parallel ones counted."""
    a = graph.edges.select(graph["from_id"].alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"))
    b = graph.edges.select(graph["to_id"].alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    return a.union(b).where("id is not null").groupBy("id").agg(F.sum("i").cast("bigint").alias("n_in"), F.sum("o").cast("bigint").alias("n_out"))


def deduplicate(graph: Graph) -> Graph:
    """Of the edges with the same ends only the first, with the least ``d_weighted`` and the least ``time_weighted`` of all, taken independently. One
    aggregation with partial results, no window, so a pair of vertices that holds much of the table is no problem.
    """
    e = graph.edges
    order = F.col(f"`{graph.order}`") if graph.order else F.monotonically_increasing_id()
    least = [r for r in ("d_weighted", "time_weighted") if graph.has(r) and graph.roles[r] != graph.roles["d"]]
    kept = e.select(
        graph["from_id"].alias("f_"), graph["to_id"].alias("t_"), F.struct(order.alias("o_"), *[F.col(f"`{c}`") for c in e.columns]).alias("row_"),
        *[graph[r].alias(f"{r}_") for r in least]
    )
    one = kept.groupBy("f_", "t_").agg(F.min("row_").alias("row_"), *[F.min(f"{r}_").alias(f"{r}_") for r in least])
    new = {graph.roles[r]: F.col(f"{r}_") for r in least}
    return graph.with_edges(one.select(*[new.get(c, F.col(f"row_.`{c}`")).alias(c) for c in e.columns]))


def has_duplicates(graph: Graph) -> bool:
    return bool(graph.edges.groupBy(graph["from_id"], graph["to_id"]).count().where("count > 1").limit(1).count())


def merge_directed(graph: Graph, columns: list[str]) -> Graph:
    """One row for both directions: the first-seen row of each pair of vertices, with the sum of ``columns`` over both; rows whose sum isn't above 0
    (in every column) are removed.
    """
    e = graph.edges
    order = F.col(f"`{graph.order}`") if graph.order else F.monotonically_increasing_id()
    a, b = graph["from_id"], graph["to_id"]
    pair = [F.least(a, b).alias("lo_"), F.greatest(a, b).alias("hi_")]
    one = e.select(
        *pair, F.struct(order.alias("o_"), *[F.col(f"`{c}`") for c in e.columns]).alias("row_")
    ).groupBy("lo_", "hi_").agg(F.min("row_").alias("row_"), *[F.sum(f"row_.`{c}`").alias(f"s_{c}") for c in columns])
    keep = F.lit(False)
    for c in columns:
        keep = keep | (F.col(f"s_{c}") > 0)
    return graph.with_edges(one.where(keep).select(*[(F.col(f"s_{c}") if c in columns else F.col(f"row_.`{c}`")).alias(c) for c in e.columns]))


def _least_of_components(tail: np.ndarray, head: np.ndarray, n: int) -> np.ndarray:
    """The smallest vertex of each vertex' component: roots are hung below the least root next to them, until no pair is of two roots."""
    root = np.arange(n, dtype=np.int32)
    while len(tail):
        a, b = root[tail], root[head]
        apart = a != b
        tail, head, a, b = tail[apart], head[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while len(tail):
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def _forest(pairs: DataFrame) -> DataFrame:
    """Of the pairs (``lo``, ``hi``) that a task has, ``FOREST_PAIRS`` at a time, so many as connect the same vertices: each vertex with the least one
    that it is connected to. The components stay as they were.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in itertools.chain(batches, [None]):
            if b is not None and b.num_rows:
                held.append(b)
                n += b.num_rows
            if held and (b is None or n >= FOREST_PAIRS):
                names, root = _roots(held)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(root)), names], names=["lo", "hi"])
                held, n = [], 0

    return pairs.mapInArrow(search, pairs.schema)


def _roots(held: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray]:
    """(the ids of pairs in order, for each the place of the least one of its component)."""
    ids = pa.concat_arrays([b.column(i) for i in (0, 1) for b in held])
    coded, half = ids.dictionary_encode(), len(ids) // 2
    names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    del ids, coded
    rank = pc.sort_indices(names)
    names, place = names.take(rank), np.empty(len(rank), np.int32)
    place[rank.to_numpy()] = np.arange(len(rank), dtype=np.int32)
    codes = place[codes]
    return names, _least_of_components(codes[:half], codes[half:], len(names))


def _labels_in_a_task(pairs: DataFrame) -> DataFrame:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        names, root = _roots(held)
        for i in range(0, len(names), 100_000):
            yield pa.RecordBatch.from_arrays([names.slice(i, 100_000), names.take(pa.array(root[i : i + 100_000]))], names=["id", "label"])

    kind = pairs.schema["lo"].dataType
    return pairs.repartition(1).mapInArrow(search, T.StructType([T.StructField("id", kind), T.StructField("label", kind)]))


def component_labels(pairs: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(``id``, ``label``): the smallest id of each vertex' weakly connected component. Up to ``TASK_PAIRS`` pairs are taken by one task; more by
    alternating large-star and small-star joins, O(log n) rounds, each written to the shared folder. ``pairs``: columns ``a``, ``b``.
    """
    both = pairs.where("a is not null and b is not null")
    every = both.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    coded = every.schema["lo"].dataType in (T.StringType(), T.LongType(), T.IntegerType())
    every = materialize((_forest(every) if coded else every).distinct())
    if coded:
        size = F.lit(0)
        for c in ("lo", "hi"):
            size = size + (F.octet_length(c) + 4 if every.schema[c].dataType == T.StringType() else F.lit(8))
        n, total = every.agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
        if n <= TASK_PAIRS and total <= TASK_BYTES:
            return _labels_in_a_task(every)
    everyone = materialize(every.select(F.col("lo").alias("id")).union(every.select("hi")).distinct())
    e = materialize(every.where("lo <> hi"))
    forget(every)
    for _ in range(max_rounds):
        # large star: the greater neighbours of each vertex are tied to the least of its neighbourhood
        near = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select("hi", "lo"))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.join(least, "u").where("v > u and v <> m").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct()
        large = materialize(large)
        # small star: the smaller neighbours and the vertex itself are tied to the least of them
        low = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        tied = large.join(low, large["hi"] == low["u"]).select("lo", "u", "m")
        small = materialize(tied.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).union(low.select("m", "u")).distinct())
        done = small.join(e, ["lo", "hi"], "left_anti").limit(1).count() == 0 and e.join(small, ["lo", "hi"], "left_anti").limit(1).count() == 0
        forget(e, large)
        e = small
        if done:
            break
    star = e.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("label"))
    return everyone.join(star, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def components(graph: Graph, name: str = "component") -> Graph:
    """The edges with ``component``, numbered from 1 by decreasing number of edges, ties by the smallest vertex id. Edges without both ends have null.
    """
    e = graph.edges.drop(name)
    pairs = graph.edges.select(graph["from_id"].alias("a"), graph["to_id"].alias("b"))
    labels = materialize(component_labels(pairs))
    sizes = graph.edges.select(graph["from_id"].alias("id")).groupBy("id").count().join(labels, "id").groupBy("label").agg(F.sum("count").alias("k"))
    # ranks by ranges: a component's number is the number of those before it
    ranked = materialize(
        sizes.repartitionByRange(F.desc("k"), F.asc("label")).sortWithinPartitions(F.desc("k"), F.asc("label")).withColumn(
            "part_", F.spark_partition_id()
        )
    )
    start, base = {}, 0
    for r in ranked.groupBy("part_").count().orderBy("part_").collect():
        start[r.part_], base = base, base + r["count"]
    offset = F.lit(0) if not start else F.create_map(*[F.lit(x) for kv in start.items() for x in kv])[F.col("part_")]
    number = ranked.withColumn(
        "c_", (F.row_number().over(Window.partitionBy("part_").orderBy(F.desc("k"), "label")) + offset).cast("int")
    ).select("label", "c_")
    by_vertex = labels.join(number, "label").select(F.col("id").alias("id__"), "c_")
    start_col = F.when(graph["to_id"].isNotNull(), graph["from_id"])
    out = e.withColumn("f__", start_col).join(by_vertex, F.col("f__") == F.col("id__"), "left").drop("f__", "id__").withColumnRenamed("c_", name)
    return Graph(out, graph.roles | {"component": name}, graph.order, graph.attributes)


def contract(graph: Graph, keep: DataFrame | None = None, same: list[str] | None = None, max_rounds: int = 64) -> tuple[Graph, DataFrame]:
    """(contracted graph, edge map ``edge_new``, ``edge_old``, ``pos``): chains of vertices that are no junctions become one edge.

    A vertex goes if it has one edge in and one out, from and to different vertices, or two of each with the same two neighbours; if on each way
    through it the two edges have the same ratio of weight to length (to 1e-6) and
    equal values in the columns ``same``; and if it isn't in ``keep`` (a frame of ids). Chains are found by pointer doubling over the edges: O(log
    length) joins, whatever the length. A ring without any junction is cut at its
    smallest vertex. New edges have the summed d, weight and times, the other columns of their first old edge, and an id that is a hash of the old
    ones and their order. Of parallel edges the one of least weight is kept,
    and the edge map has only kept edges; untouched edges keep their ids and map to themselves.
    """
    if graph.edges.limit(1).count() == 0:
        raise ValueError("graph is empty")
    same = same or []
    # before contraction, of parallel edges only the lightest counts
    first = deduplicate(graph)
    e = first.edges
    key = graph.order
    named = e.select(
        F.col(f"`{key}`").alias("e"), first["from_id"].alias("u"), first["to_id"].alias("v"), first["d"].alias("d"), first["d_weighted"].alias("w"),
        F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in same]).alias("s") if same else F.lit(0).alias("s")
    ).where("u is not null and v is not null and u <> v")
    named = materialize(named)
    into = named.groupBy(F.col("v").alias("x")).agg(F.count(F.lit(1)).alias("ki"), F.min("u").alias("i0"), F.max("u").alias("i1"))
    out = named.groupBy(F.col("u").alias("x")).agg(F.count(F.lit(1)).alias("ko"), F.min("v").alias("o0"), F.max("v").alias("o1"))
    through = into.join(out, "x").where("(ki = 1 and ko = 1 and i0 <> o0) or (ki = 2 and ko = 2 and i0 = o0 and i1 = o1)")
    if keep is not None:
        through = through.join(keep.select(F.col(keep.columns[0]).alias("x")), "x", "left_anti")
    through = through.select("x")
    ways = named.alias("a").join(named.alias("b"), F.col("a.v") == F.col("b.u")).where("a.u <> b.v").join(through, F.col("a.v") == F.col("x"))
    ratio = lambda t: F.when(F.col(f"{t}.d") > 0, F.col(f"{t}.w") / F.col(f"{t}.d"))
    even = F.coalesce(
        F.abs(ratio("a") - ratio("b")) < 1e-6, (F.col("a.w") == F.col("b.w")) & (F.col("a.d") == F.col("b.d"))
    ) & (F.col("a.s") == F.col("b.s"))
    ways = ways.select("x", F.col("a.e").alias("before"), F.col("b.e").alias("e"), even.alias("even"))
    ways = materialize(ways)
    uneven = ways.where("not even").select("x").distinct()
    links = ways.join(uneven, "x", "left_anti").select("e", "before", "x")

    def chains(links: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(``e``, ``head``, ``pos``, ``least``) by doubling, and the same of the edges that never come to a head: rings."""
        state = named.select("e").join(links, "e", "left").select(
            "e", F.col("before").alias("jump"), F.when(F.col("before").isNotNull(), 1).otherwise(0).cast("bigint").alias("pos"),
            F.coalesce("before", "e").alias("head"), F.col("x").alias("least")
        )
        state = materialize(state)
        for _ in range(max_rounds):
            far = state.select(
                F.col("e").alias("jump"), F.col("jump").alias("j2"), F.col("pos").alias("p2"), F.col("head").alias("h2"), F.col("least").alias("l2")
            )
            grown = state.join(far, "jump", "left").select(
                "e", F.col("j2").alias("jump"), (F.col("pos") + F.coalesce("p2", F.lit(0))).alias("pos"), F.coalesce("h2", "head").alias("head"),
                F.least("least", "l2").alias("least")
            )
            old, state = state, materialize(grown)
            forget(old)
            left = state.where("jump is not null")
            if not left.limit(1).count():
                break
            # what is still on the way after more jumps than there are edges is a ring
            if left.agg(F.min("pos")).first()[0] > 2 * n_edges:
                break
        return state.where("jump is null"), state.where("jump is not null")

    n_edges = named.count()
    ended, rings = chains(links)
    if rings.limit(1).count():
        cut = rings.select("least").distinct().select(F.col("least").alias("x"))
        ended, _ = chains(materialize(links.join(cut, "x", "left_anti")))
    ended = materialize(ended.select("e", "head", "pos"))
    sums = [r for r in ("d", "d_weighted", "time", "time_weighted") if graph.has(r)]
    sum_cols = list(dict.fromkeys(graph.roles[r] for r in sums))
    rows = e.join(ended, e[key] == ended["e"]).drop("e")
    hashed = F.bit_xor(F.xxhash64(F.col(f"`{key}`"), F.col("pos")))
    last = [c for r, c in graph.roles.items() if r in ("to_id", "to_x", "to_y")]
    chain = rows.groupBy("head").agg(
        F.count(F.lit(1)).alias("k_"), hashed.alias("h_"), F.min_by(
            F.struct(*[F.col(f"`{c}`") for c in e.columns]), "pos"
        ).alias("first_"), F.max_by(
            F.struct(*[F.col(f"`{c}`") for c in last]), "pos"
        ).alias("last_"), *[F.sum(f"`{c}`").alias(f"s_{c}") for c in sum_cols]
    )
    id_col = graph.roles.get("edge_id", key)
    new_id = F.when(
        F.col("k_") == 1, F.col(f"first_.`{id_col}`").cast("string")
    ).otherwise(F.concat(F.lit("a"), F.lower(F.lpad(F.hex("h_"), 16, "0"))))

    def value(c: str) -> Column:
        if c == id_col:
            return new_id
        if c in sum_cols:
            return F.col(f"s_{c}")
        if c in last:
            return F.col(f"last_.`{c}`")
        return F.col(f"first_.`{c}`")

    short = materialize(chain.select(*[value(c).alias(c) for c in e.columns], F.col("head").alias("head__"), F.col(f"first_.`{key}`").alias("ord__")))
    lightest = Window.partitionBy(F.col(f"`{graph.roles['from_id']}`"), F.col(f"`{graph.roles['to_id']}`")).orderBy(
        F.col(f"`{graph.roles['d_weighted']}`"), F.col(f"`{graph.roles['d']}`"), "ord__"
    )
    short = materialize(short.withColumn("rank__", F.row_number().over(lightest)).where("rank__ = 1").drop("rank__"))
    mapped = ended.join(
        short.select(F.col("head__").alias("head"), F.col(f"`{id_col}`").alias("edge_new")), "head"
    ).select("edge_new", F.col("e").alias("edge_old"), "pos")
    return Graph(
        short.drop("head__", "ord__") if id_col == key else short.drop("head__").withColumn(key, F.col("ord__")).drop("ord__"), graph.roles, key,
        graph.attributes
    ), mapped


def uncontract(contracted: Graph, edge_map: DataFrame, original: Graph) -> Graph:
    """The original edges with the columns that the contracted graph has beyond theirs. Edges that the contracted graph no longer has are left out."""
    new = [c for c in contracted.edges.columns if c not in original.edges.columns]
    id_col = contracted.roles.get("edge_id", contracted.order)
    values = edge_map.join(
        contracted.edges.select(F.col(f"`{id_col}`").cast("string").alias("edge_new"), *new), "edge_new"
    ).select(F.col("edge_old").alias("e__"), *new)
    e = original.edges
    return original.with_edges(e.join(values, e[original.order] == F.col("e__")).drop("e__"))


def sample(graph: Graph, n: int, seed: int = 0, max_rounds: int = 10_000) -> Graph:
    """A connected part of the largest component with ``n`` vertices: grown from one vertex by whole rounds of neighbours, the last round cut by hash.
    The same for the same ``seed``.
    """
    g = components(graph)
    e = materialize(g.edges.where(g["component"] == 1))
    near = materialize(e.select(g["from_id"].alias("a"), g["to_id"].alias("b")).union(e.select(g["to_id"], g["from_id"])).distinct())
    mark = lambda c: F.xxhash64(c, F.lit(seed))
    got = materialize(near.select("a").distinct().orderBy(mark(F.col("a"))).limit(1))
    size, fresh = 1, got
    for _ in range(max_rounds):
        if size >= n:
            break
        step = near.join(fresh, "a").select(F.col("b").alias("a")).distinct().join(got, "a", "left_anti")
        fresh = materialize(step.orderBy(mark(F.col("a"))).limit(n - size))
        added = fresh.count()
        if not added:
            break
        got, size = materialize(got.union(fresh)), size + added
    inside = got.withColumnRenamed("a", "id__")
    out = e.join(inside, g["from_id"] == F.col("id__"), "left_semi").join(inside, g["to_id"] == F.col("id__"), "left_semi")
    return graph.with_edges(out.select(*graph.edges.columns) if "component" in graph.edges.columns else out.drop("component"))


def insert_vertex(graph: Graph, v1, v2, x: float | None = None, y: float | None = None, new_id: str | None = None) -> Graph:
    """Split the edges between ``v1`` and ``v2``, in both directions if there are both, at (``x``, ``y``) or half way. Lengths are measured anew,
    weights and times keep their ratio to it; the parts' ids end in _a and _b.
    """
    if not graph.is_spatial:
        raise ValueError("only edges of graphs with coordinates can be split")
    a, b = graph["from_id"], graph["to_id"]
    hit = F.coalesce((a == F.lit(v1)) & (b == F.lit(v2)) | (a == F.lit(v2)) & (b == F.lit(v1)), F.lit(False))
    e = graph.edges
    if not e.where(hit).limit(1).count():
        raise ValueError("Nominated vertices do not define any edges in graph")
    fx, fy, tx, ty = (graph[r] for r in ("from_x", "from_y", "to_x", "to_y"))
    mx = F.lit(float(x)) if x is not None else (fx + tx) / 2
    my = F.lit(float(y)) if y is not None else (fy + ty) / 2
    name = new_id or F.substring(
        F.sha2(F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"), mx.cast("string"), my.cast("string")), 256), 1, 10
    )
    name = F.lit(name) if isinstance(name, str) else name
    kind = {f.name: f.dataType for f in e.schema.fields}
    parts = []
    for part, (x0, y0, x1, y1) in enumerate(((fx, fy, mx, my), (mx, my, tx, ty))):
        d = geo.haversine(x0, y0, x1, y1)
        ratio = F.try_divide(d, graph["d"])
        new = {graph.roles["d"]: d} | {
            graph.roles[r]: graph[r] * ratio for r in ("d_weighted", "time", "time_weighted") if graph.has(r) and graph.roles[r] != graph.roles["d"]
        }
        new |= {graph.roles["to_id"]: name, graph.roles["to_x"]: mx, graph.roles["to_y"]: my} if part == 0 else {
            graph.roles["from_id"]: name, graph.roles["from_x"]: mx, graph.roles["from_y"]: my
        }
        if graph.has("edge_id"):
            new[graph.roles["edge_id"]] = F.concat(graph["edge_id"].cast("string"), F.lit("_ab"[0] + "ab"[part]))
        typed = {c: v if c == graph.roles.get("edge_id") else v.cast(kind[c]) for c, v in new.items()}
        parts.append(
            F.struct(
                *[typed.get(c, F.col(f"`{c}`").cast("string") if c == graph.roles.get("edge_id") else F.col(f"`{c}`")).alias(c) for c in e.columns]
            )
        )
    whole = F.struct(*[(F.col(f"`{c}`").cast("string") if c == graph.roles.get("edge_id") else F.col(f"`{c}`")).alias(c) for c in e.columns])
    return graph.with_edges(e.select(F.inline(F.when(hit, F.array(*parts)).otherwise(F.array(whole)))))
