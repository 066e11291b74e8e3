"""What can be reached within distances or times: vertices and hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.kernel import concave_hull
from wayloom.operators import routing
from wayloom.operators.structure import vertices
from wayloom.schema import Graph


def isoverts(graph: Graph, from_ids, dlim: list[float] | None = None, tlim: list[float] | None = None, strategy: str = "auto") -> DataFrame:
    """(``from_id``, ``dlim`` or ``tlim``, ``id``, and the vertex' ``x``, ``y`` if the graph has them): every vertex within each limit of each source.
    At the largest limit the length must be below it, at the others not above.
    """
    if dlim and tlim:
        raise ValueError("Only one of dlim or tlim can be provided")
    limits, name = (dlim, "dlim") if dlim else (tlim, "tlim")
    if not limits:
        raise ValueError("dlim must be specified")
    top = float(max(limits))
    length, weight = ("d", "d_weighted") if dlim else ("time", "time_weighted")
    reached = routing.trees(graph, from_ids, limit=top, weight=weight, length=length, strategy=strategy).where(F.col("d") < top)
    # each row goes to the limits it is within: a handful of constants, no join
    within = F.filter(F.array(*[F.lit(float(x)) for x in sorted(limits)]), lambda x: (F.col("d") <= x))
    out = reached.select(F.col("source").alias("from_id"), F.col("vertex").alias("id"), "d")
    if graph.is_spatial:
        out = out.join(vertices(graph).select("id", "x", "y"), "id")
    return out.select("from_id", F.explode(within).alias(name), "id", *(["x", "y"] if graph.is_spatial else []))


def iso_hulls(
    graph: Graph, from_ids, dlim: list[float] | None = None, tlim: list[float] | None = None, concavity: float = 0.0, length_threshold: float = 0.0,
    strategy: str = "auto"
) -> DataFrame:
    """(``from_id``, limit, ``pos``, ``id``, ``x``, ``y``): the hull of the vertices within each limit of each source, a closed ring in order.
    ``concavity`` from 0 (convex) to 1; sides up to ``length_threshold`` aren't dug in.
    """
    if not 0 <= concavity <= 1:
        raise ValueError("concavity must be between 0 and 1")
    if not graph.is_spatial:
        raise ValueError("iso-contours need a graph with coordinates")
    points = isoverts(graph, from_ids, dlim, tlim, strategy)
    name = "dlim" if dlim else "tlim"
    kind = points.schema["id"].dataType

    def hull(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("id")
        x, y = p["x"].to_numpy(float), p["y"].to_numpy(float)
        at = concave_hull(x, y, concavity, length_threshold)
        at = np.concatenate([at, at[:1]])
        q = p.iloc[at]
        return pd.DataFrame({"from_id": q["from_id"], name: q[name], "pos": np.arange(len(q)), "id": q["id"], "x": q["x"], "y": q["y"]})

    fields = [
        ("from_id", points.schema["from_id"].dataType), (name, T.DoubleType()), ("pos", T.LongType()), ("id", kind), ("x", T.DoubleType()),
        ("y", T.DoubleType())
    ]
    # a group is what one source reaches, which the search bounds
    return points.groupBy("from_id", name).applyInPandas(hull, T.StructType([T.StructField(*f) for f in fields]))


def isodists(graph: Graph, from_ids, dlim: list[float], concavity: float = 0.0, length_threshold: float = 0.0) -> DataFrame:
    return iso_hulls(graph, from_ids, dlim=dlim, concavity=concavity, length_threshold=length_threshold)


def isochrones(graph: Graph, from_ids, tlim: list[float], concavity: float = 0.0, length_threshold: float = 0.0) -> DataFrame:
    graph.require("time", "isochrones need a graph with times")
    return iso_hulls(graph, from_ids, tlim=tlim, concavity=concavity, length_threshold=length_threshold)
