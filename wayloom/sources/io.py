"""Graphs on disk, and in the forms of other tools."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators.structure import contract, vertices
from wayloom.schema import Graph

_CACHE = {"on": True}


def save_graph(graph: Graph, path: str, contracted: bool = True) -> None:
    """The graph, its vertices, and its contraction with vertices and edge map, as Parquet tables in one folder, which any file system of Spark may
    hold.
    """
    graph.edges.write.mode("overwrite").parquet(os.path.join(path, "graph"))
    vertices(graph).write.mode("overwrite").parquet(os.path.join(path, "vertices"))
    meta = {"order": graph.order, "attributes": {k: v for k, v in graph.attributes.items() if isinstance(v, str | int | float | bool)}}
    graph.edges.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").parquet(os.path.join(path, "meta"))
    if contracted:
        short, mapped = contract(graph)
        short.edges.write.mode("overwrite").parquet(os.path.join(path, "graph_c"))
        vertices(short).write.mode("overwrite").parquet(os.path.join(path, "vertices_c"))
        mapped.write.mode("overwrite").parquet(os.path.join(path, "edge_map"))


def load_graph(spark: SparkSession, path: str) -> dict[str, Graph | DataFrame]:
    """What ``save_graph`` wrote: ``graph``, ``vertices``, and if there are such ``graph_c``, ``vertices_c``, ``edge_map``."""
    meta = json.loads(spark.read.parquet(os.path.join(path, "meta")).first()[0])
    out: dict = {}
    for name in ("graph", "vertices", "graph_c", "vertices_c", "edge_map"):
        try:
            table = spark.read.parquet(os.path.join(path, name))
        except Exception as e:  # a graph saved without its contraction
            if "PATH_NOT_FOUND" in str(e):
                continue
            raise
        out[name] = Graph.of(table, meta["order"], **meta["attributes"]) if name.startswith("graph") else table
    return out


def graph_hash(graph: Graph) -> int:
    """A number that changes if any edge's id does, whatever their order."""
    key = graph["edge_id"] if graph.has("edge_id") else F.concat_ws("|", graph["from_id"], graph["to_id"])
    return graph.edges.agg(F.bit_xor(F.xxhash64(key.cast("string")))).first()[0] or 0


def caching(on: bool | None = None) -> bool:
    """Whether ``cached`` keeps tables; sets it if ``on`` is given."""
    if on is not None:
        _CACHE["on"] = on
    return _CACHE["on"]


def cached(df: DataFrame) -> DataFrame:
    return df.cache() if _CACHE["on"] else df


def clear_cache(spark: SparkSession) -> None:
    spark.catalog.clearCache()


def to_vertices_and_edges(graph: Graph, weight: str = "d") -> tuple[DataFrame, DataFrame]:
    """The pair of tables that graph libraries take: vertices (``id`` ...) and edges (``src``, ``dst``, ``weight``, and the other columns)."""
    ends = {graph.roles.get("from_id"), graph.roles.get("to_id")}
    rest = [c for c in graph.edges.columns if c not in ends and c.lower() not in ("src", "dst", "weight")]
    return vertices(graph), graph.edges.select(
        graph["from_id"].alias("src"), graph["to_id"].alias("dst"), graph[weight].alias("weight"), *[F.col(f"`{c}`") for c in rest]
    )


def from_vertices_and_edges(nodes: DataFrame, edges: DataFrame) -> Graph:
    """An edge table from such a pair: coordinates by two joins, ``weight`` as ``d`` unless there is one; text columns that hold nothing but numbers
    become numbers.
    """
    v = nodes.dropDuplicates(["id"])
    spatial = {"x", "y"} <= set(v.columns)
    e = edges.withColumnsRenamed({"src": "from_id", "dst": "to_id"})
    if "d" not in e.columns:
        e = e.withColumn("d", F.col("weight").cast("double"))
    if "ord" not in e.columns and "edge_id" not in e.columns:
        e = e.withColumn("ord", F.monotonically_increasing_id())
    if spatial:
        e = e.drop("from_lon", "from_lat", "to_lon", "to_lat")
        for end in ("from", "to"):
            e = e.join(v.select(F.col("id").alias(f"{end}_id"), F.col("x").alias(f"{end}_lon"), F.col("y").alias(f"{end}_lat")), f"{end}_id", "left")
    text = [f.name for f in e.schema.fields if f.dataType.typeName() == "string" and f.name not in ("from_id", "to_id", "edge_id")]
    if text:
        odd = e.agg(
            *[F.max(F.coalesce(F.col(f"`{c}`").try_cast("double").isNull() & F.col(f"`{c}`").isNotNull(), F.lit(False))).alias(c) for c in text]
        ).first()
        full = e.agg(*[F.count(f"`{c}`").alias(c) for c in text]).first()
        e = e.withColumns({c: F.col(f"`{c}`").try_cast("double") for c in text if odd[c] is False and full[c]})
    return Graph.of(e)


def to_lines(graph: Graph) -> DataFrame:
    """(``edge_id``, ``wkt``, and the columns of the contracted graph but for its coordinates): each of its edges as the line through all vertices
    between.
    """
    short, mapped = contract(graph)
    id_col = short.roles.get("edge_id", short.order)
    old = graph.edges.select(F.col(f"`{graph.order}`").alias("edge_old"), *[graph[r].alias(r) for r in ("from_x", "from_y", "to_x", "to_y")])
    parts = mapped.join(old, "edge_old").groupBy("edge_new").agg(
        F.array_sort(F.collect_list(F.struct("pos", "from_x", "from_y", "to_x", "to_y"))).alias("s")
    )
    point = lambda a, b: F.concat_ws(" ", a.cast("string"), b.cast("string"))
    line = F.concat(
        F.array(point(F.element_at("s", 1)["from_x"], F.element_at("s", 1)["from_y"])), F.transform("s", lambda p: point(p["to_x"], p["to_y"]))
    )
    left_out = {id_col.lower(), "edge_id", "wkt", "edge_new", "s", *(short.roles[r].lower() for r in ("from_x", "from_y", "to_x", "to_y"))}
    more = [F.col(f"`{c}`") for c in short.edges.columns if c.lower() not in left_out]
    named = short.edges.select(F.col(f"`{id_col}`").cast("string").alias("edge_new"), *more).join(parts, "edge_new")
    return named.select(F.col("edge_new").alias("edge_id"), F.concat(F.lit("LINESTRING ("), F.array_join(line, ", "), F.lit(")")).alias("wkt"), *more)


def flow_classes(graph: Graph, flow: str = "flow", classes: int = 30) -> DataFrame:
    """The edges with ``share`` (flow over the largest flow) and ``class`` (1 to ``classes``) for drawing."""
    top = graph.edges.agg(F.max(flow)).first()[0] or 0.0
    share = F.col(flow) / top if top else F.lit(0.0)
    return graph.edges.withColumn("share", share).withColumn("class", F.greatest(F.lit(1), F.ceil(F.col("share") * classes).cast("int")))
