"""Turn penalties and restrictions at junctions."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayloom.schema import Graph
from wayloom.session import materialize

#: Distinct edges that must leave a vertex for it to be a junction, and the rank from the kerb beyond which a turn crosses the traffic.
MIN_EDGES, FREE_TURNS = 4, 2


def turn_pairs(graph: Graph, left_side: bool = False) -> DataFrame:
    """(``vertex``, ``edge_in``, ``edge_out``, ``rank``, ``penalty``): each way through a junction, with the rank of the turn around it, clockwise
    from the edge on which one arrives, counted from the side on which one drives.
    """
    e = graph.edges.select(
        F.col(f"`{graph.order}`").alias("e"), graph["from_id"].alias("u"), graph["to_id"].alias("v"),
        *[graph[f"{end}_{a}"].alias(f"{end[0]}{a}") for end in ("from", "to") for a in "xy"]
    )
    e = e.where("u is not null and v is not null")
    crossing = e.groupBy(F.col("u").alias("vertex")).agg(F.count_distinct("e").alias("k")).where(F.col("k") >= MIN_EDGES).select("vertex")
    into = e.join(crossing, e["v"] == crossing["vertex"], "left_semi").select(
        F.col("v").alias("vertex"), F.col("e").alias("edge_in"), F.atan2(F.col("fy") - F.col("ty"), F.col("fx") - F.col("tx")).alias("a_in")
    )
    out = e.join(crossing, e["u"] == crossing["vertex"], "left_semi").select(
        F.col("u").alias("vertex"), F.col("e").alias("edge_out"), F.atan2(F.col("ty") - F.col("fy"), F.col("tx") - F.col("fx")).alias("a_out")
    )
    # clockwise angle from the direction back to where one comes from
    pairs = into.join(out, "vertex").where("edge_in <> edge_out").withColumn(
        "turn", F.pmod(F.col("a_in") - F.col("a_out"), F.lit(2 * 3.141592653589793))
    )
    around = Window.partitionBy("vertex", "edge_in")
    place = F.row_number().over(around.orderBy("turn", "edge_out")) - 1
    rank = place if left_side else F.count(F.lit(1)).over(around) - place
    return pairs.withColumn("rank", rank.cast("int")).select("vertex", "edge_in", "edge_out", "rank", (F.col("rank") > FREE_TURNS).alias("penalty"))


def turn_restrictions(properties: DataFrame, members: DataFrame) -> DataFrame:
    """(``relation_``, ``only``, ``way_from``, ``via``, ``way_to``): the turns that restrictions forbid or, ``only``, prescribe, each once. Relations
    without a from way, via node or to way, and null values, give none; with several members of a role, each combination counts.
    """
    kind = F.lower(F.trim("value"))
    rule = properties.where(
        (F.col("key") == "restriction") & kind.rlike("^(no|only)_")
    ).select("relation_", kind.startswith("only_").alias("only")).distinct()
    part = lambda role, name, what: members.where((F.col("role") == role) & (F.col("type") == what) & F.col("member").isNotNull()).select("relation_", F.col("member").alias(name)).distinct()
    return rule.join(
        part("from", "way_from", "way"), "relation_"
    ).join(part("via", "via", "node"), "relation_").join(part("to", "way_to", "way"), "relation_")


def compound_junctions(
    graph: Graph, penalty: float, left_side: bool = False, restrictions: DataFrame | None = None, way: str | None = None
) -> tuple[Graph, DataFrame]:
    """(graph, ``edge``, ``edge_in``, ``edge_out``): the graph with an edge for each way through a junction, whose lengths, weights and times are
    those of the two edges, and whose times have the ``penalty`` if the turn crosses the traffic.

    Ends at junctions get the suffixes _start (of edges that leave) and _end (that arrive), so that routes pass a junction only by its compound edges.
    Forbidden turns have none; of prescribed ones only the prescribed turn has.
    """
    pairs = turn_pairs(graph, left_side)
    e, r, o = graph.edges, graph.roles, graph.order
    if restrictions is not None and way is not None:
        w = e.select(F.col(f"`{o}`").alias("e__"), F.col(f"`{way}`").alias("w__"))
        named = pairs.join(
            w.select(F.col("e__").alias("edge_in"), F.col("w__").alias("way_from")), "edge_in"
        ).join(w.select(F.col("e__").alias("edge_out"), F.col("w__").alias("out__")), "edge_out")
        rule = restrictions.select("only", "way_from", F.col("via").alias("vertex"), "way_to")
        no = rule.where("not only").select("way_from", "vertex", F.col("way_to").alias("out__"))
        only = rule.where("only").groupBy("way_from", "vertex").agg(F.collect_set("way_to").alias("allowed"))
        named = named.join(no, ["way_from", "vertex", "out__"], "left_anti").join(only, ["way_from", "vertex"], "left")
        pairs = named.where(
            F.col("allowed").isNull() | F.array_contains("allowed", F.col("out__"))
        ).select("vertex", "edge_in", "edge_out", "rank", "penalty")
    pairs = materialize(pairs)
    crossing = pairs.select(F.col("vertex").cast("string").alias("x__")).distinct()
    fid, tid = graph["from_id"].cast("string"), graph["to_id"].cast("string")
    a = crossing.select(F.col("x__").alias("xf__"), F.lit(True).alias("jf__"))
    b = crossing.select(F.col("x__").alias("xt__"), F.lit(True).alias("jt__"))
    id_col = r.get("edge_id", o)
    marked = e.join(a, fid == F.col("xf__"), "left").join(b, tid == F.col("xt__"), "left")
    ends = {
        r["from_id"]: F.when(F.col("jf__"), F.concat(fid, F.lit("_start"))).otherwise(fid),
        r["to_id"]: F.when(F.col("jt__"), F.concat(tid, F.lit("_end"))).otherwise(tid), id_col: F.col(f"`{id_col}`").cast("string")
    }
    plain = marked.select(*[ends.get(c, F.col(f"`{c}`")).alias(c) for c in e.columns])
    first, second = e.select(*[F.col(f"`{c}`").alias(f"in_{c}") for c in e.columns]), e.select(
        *[F.col(f"`{c}`").alias(f"out_{c}") for c in e.columns]
    )
    both = pairs.join(first, F.col("edge_in") == F.col(f"in_{o}")).join(second, F.col("edge_out") == F.col(f"out_{o}"))
    both = both.join(
        a, F.col(f"in_{r['from_id']}").cast("string") == F.col("xf__"), "left"
    ).join(b, F.col(f"out_{r['to_id']}").cast("string") == F.col("xt__"), "left")
    sums = {r[k] for k in ("d", "d_weighted", "time", "time_weighted") if k in r}
    timed = {r[k] for k in ("time", "time_weighted") if k in r}
    late = {r[k] for k in ("to_id", "to_x", "to_y") if k in r}

    def joined(c: str):
        if c == id_col:
            return F.concat_ws("_", F.lit("j"), F.col("edge_in").cast("string"), F.col("edge_out").cast("string"))
        if c in sums:
            return F.col(f"in_{c}") + F.col(f"out_{c}") + (F.when(F.col("penalty"), float(penalty)).otherwise(0.0) if c in timed else F.lit(0.0))
        if c == r["from_id"]:
            return F.when(F.col("jf__"), F.concat(F.col(f"in_{c}").cast("string"), F.lit("_start"))).otherwise(F.col(f"in_{c}").cast("string"))
        if c == r["to_id"]:
            return F.when(F.col("jt__"), F.concat(F.col(f"out_{c}").cast("string"), F.lit("_end"))).otherwise(F.col(f"out_{c}").cast("string"))
        return F.col(f"out_{c}") if c in late else F.col(f"in_{c}")

    through = both.select(*[joined(c).alias(c) for c in e.columns])
    named = pairs.select(
        F.concat_ws("_", F.lit("j"), F.col("edge_in").cast("string"), F.col("edge_out").cast("string")).alias("edge"), "edge_in", "edge_out"
    )
    return replace(graph, edges=plain.unionByName(through), attributes=graph.attributes | {"compound": True}), named


def routed(graph: Graph) -> tuple[Graph, DataFrame | None]:
    """(graph to route on, its compound edges): with compound junctions where the graph's attribute ``turn_penalty`` asks for them, else as it is.

    Further attributes: ``left_side``, ``restrictions`` (a frame of ``turn_restrictions``) and ``way`` (the column of the ways that they name).
    """
    penalty = graph.attributes.get("turn_penalty") or 0.0
    if not penalty or graph.attributes.get("compound"):
        return graph, None
    a = graph.attributes
    turning, named = compound_junctions(graph, penalty, a.get("left_side", False), a.get("restrictions"), a.get("way"))
    return replace(turning, attributes=turning.attributes | {"plain": graph}), named


def uncompound(graph: Graph, junctions: DataFrame, columns: list[str]) -> Graph:
    """The graph without compound edges, whose values in ``columns`` are added to both of their edges."""
    id_col = graph.roles.get("edge_id", graph.order)
    e = graph.edges
    j = e.select(F.col(f"`{id_col}`").alias("edge"), *columns).join(junctions, "edge")
    parts = j.select(F.col("edge_in").cast("string").alias("e__"), *columns).unionByName(
        j.select(F.col("edge_out").cast("string").alias("e__"), *columns)
    )
    sums = parts.groupBy("e__").agg(*[F.sum(c).alias(f"s_{c}") for c in columns])
    left = e.join(
        junctions.select("edge"), F.col(f"`{id_col}`") == F.col("edge"), "left_anti"
    ).join(sums, F.col(f"`{id_col}`") == F.col("e__"), "left")
    plain = lambda c: F.regexp_replace(F.col(f"`{c}`").cast("string"), "_(start|end)$", "")
    change = {
        c: F.col(f"`{c}`") + F.coalesce(F.col(f"s_{c}"), F.lit(0.0)) for c in columns
    } | {graph.roles[k]: plain(graph.roles[k]) for k in ("from_id", "to_id")}
    out = left.select(*[change.get(c, F.col(f"`{c}`")).alias(c) for c in e.columns])
    return replace(graph, edges=out, attributes={k: v for k, v in graph.attributes.items() if k != "compound"})
