"""Street networks from ways (lines) or from normalised tables: lengths, weights, speeds, times."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators.structure import components
from wayloom.schema import Graph
from wayloom.session import bounded_rows, small

# How truth is written in tags; factors of weight for ways of many lanes; unused railways.
YES, NO = ["yes", "y", "true", "t", "1"], ["no", "n", "false", "f", "0"]
LANE_FACTORS = [(8, 1.2), (6, 1.1), (4, 1.05)]
LANE_MODES = ["foot", "bicycle", "wheelchair", "horse"]
DEAD_RAILWAYS = ["abandoned", "disused", "proposed", "razed"]
MPH, WALK_KMH = 1.609344, 10.0


def truth(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.isin(YES) | (low == "-1"), True).when(low.isin(NO), False)


def speed_kmh(c: Column) -> Column:
    """A tag's speed in km/h: its first number, miles if it says so; walking pace is 10; no limit and anything else are null."""
    low = F.lower(F.trim(c))
    number = F.regexp_replace(F.regexp_extract(low, r"(\d+(?:[.,]\d+)?)", 1), ",", ".").try_cast("double")
    return F.when(low.rlike("^walk"), WALK_KMH).when(low.rlike("mph|mi/h|miles"), number * MPH).otherwise(number)


def lane_factor(lanes: Column) -> Column:
    """The factor by which many lanes make a way worse for slow modes; lanes are compared as numbers."""
    n = F.regexp_extract(lanes, r"^\s*(\d+)", 1).try_cast("int")
    out = F.lit(1.0)
    for least, factor in sorted(LANE_FACTORS):
        out = F.when(n >= least, factor).otherwise(out)
    return F.when(n.isNull(), 1.0).otherwise(out)


def segments(ways: DataFrame, id_col: str, geometry: str = "geometry", keep: list[str] | None = None) -> DataFrame:
    """One row per segment of each line (an array of struct(id, x, y), ids may be null) in its own direction; vertices without an id are named by
    their coordinates to 10 decimals.
    """
    at = F.col("p__")
    name = lambda p: F.coalesce(p["id"].cast("string"), F.concat_ws("-", F.format_string("%.10f", p["x"].cast("double")), F.format_string("%.10f", p["y"].cast("double"))))
    pairs = F.when(
        F.size(geometry) > 1,
        F.transform(
            F.sequence(F.lit(1), F.size(geometry) - 1),
            lambda i: F.struct(F.element_at(geometry, i).alias("a"), F.element_at(geometry, i + 1).alias("b"))
        )
    )
    rows = ways.select(F.col(id_col).alias("way_id"), *(keep or []), F.posexplode(pairs).alias("seg", "p__"))
    return rows.select(
        "way_id", "seg", *(keep or []), name(at["a"]).alias("from_id"), at["a"]["x"].cast("double").alias("from_lon"),
        at["a"]["y"].cast("double").alias("from_lat"), name(at["b"]).alias("to_id"), at["b"]["x"].cast("double").alias("to_lon"),
        at["b"]["y"].cast("double").alias("to_lat")
    )


def both_ways(e: DataFrame, one_way: Column) -> DataFrame:
    """The edges and, where the way isn't ``one_way``, those back."""
    swap = {"from_id": "to_id", "to_id": "from_id", "from_lon": "to_lon", "to_lon": "from_lon", "from_lat": "to_lat", "to_lat": "from_lat"}
    there = F.struct(*[F.col(c) for c in e.columns], F.lit(0).alias("back"))
    back = F.struct(*[F.col(swap.get(c, c)).alias(c) for c in e.columns], F.lit(1).alias("back"))
    # one pass: a row gives one or two
    return e.select(F.inline(F.when(F.coalesce(one_way, F.lit(False)), F.array(there)).otherwise(F.array(there, back))))


def kinds_of(profile: DataFrame) -> list[str]:
    """The kinds of way that a profile knows, longest first."""
    rows = bounded_rows(profile.where("way is not null").select(F.lower(F.trim("way")).alias("w")).distinct(), 1_000, "kinds of way")
    return sorted((r.w for r in rows), key=lambda w: (-len(w), w))


def remapped(highway: Column, known: list[str]) -> Column:
    """The profile's kind of a way: itself if the profile knows it, else the longest known kind that it begins with; any foot or pedestrian way is a
    path.
    """
    low = F.lower(F.trim(highway))
    begun = F.filter(F.array(*map(F.lit, known)), lambda k: low.startswith(k))
    kind = F.when(low.isin(known), low).otherwise(F.coalesce(F.try_element_at(begun, F.lit(1)), low)) if known else low
    return F.when(kind.rlike("pedestrian|footway"), "path").otherwise(kind)


def weigh(e: DataFrame, profile: DataFrame | float, highway: Column) -> DataFrame:
    """``e`` with ``d_weighted`` = d / value of its kind of way and the profile's ``profile_speed``; kinds of value 0 or that the profile doesn't know
    are dropped (``unknown_kinds`` tells them).
    """
    if isinstance(profile, float):
        return e.withColumns({"d_weighted": F.col("d") / profile, "profile_speed": F.lit(None).cast("double")})
    p = profile.where("way is not null").groupBy(F.lower(F.trim("way")).alias("k__")).agg(
        F.max("value").alias("v__"), F.max("max_speed").alias("profile_speed")
    )
    out = e.withColumn("k__", remapped(highway, kinds_of(profile))).join(small(p.where("v__ > 0")), "k__")
    return out.withColumn("d_weighted", F.col("d") / F.col("v__")).drop("k__", "v__")


def unknown_kinds(ways: DataFrame, profile: DataFrame, highway: str = "highway") -> DataFrame:
    """(``kind``, ``n``): the kinds of way for which the profile has no value, and their rows."""
    known = kinds_of(profile)
    rows = ways.where(F.col(highway).isNotNull()).groupBy(remapped(F.col(highway), known).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
    return rows.where(~F.col("kind").isin(known)) if known else rows


def set_speeds(e: DataFrame, mode: str, maxspeed: str | None, highway: str, surface: str | None, surface_table: DataFrame | None) -> DataFrame:
    """``e`` with ``speed`` in km/h. Cars: the tag, else the median of the tagged ways of its kind, else the profile's; other modes: the tag or the
    profile's, whichever is less. Null where the profile has none; at most what the surface allows.
    """
    tag = speed_kmh(F.col(maxspeed)) if maxspeed else F.lit(None).cast("double")
    e = e.withColumn("tag__", tag)
    if mode == "motorcar":
        medians = e.where("tag__ is not null").groupBy(F.col(highway).alias("h__")).agg(F.percentile("tag__", F.lit(0.5)).alias("m__"))
        e = e.join(small(medians), F.col(highway) == F.col("h__"), "left").drop("h__")
        speed = F.coalesce("tag__", "m__", "profile_speed")
    else:
        e = e.withColumn("m__", F.lit(None).cast("double"))
        speed = F.least("tag__", "profile_speed")
    e = e.withColumn("speed", F.when(F.col("profile_speed").isNull() & F.lit(mode != "motorcar"), None).otherwise(speed))
    if surface and surface_table is not None:
        s = surface_table.where(F.col("name") == mode).groupBy(F.col("value").alias("s__")).agg(F.min("max_speed").alias("top__"))
        e = e.join(small(s), F.lower(F.trim(surface)) == F.col("s__"), "left").withColumn("speed", F.least("speed", "top__")).drop("s__", "top__")
    return e.drop("tag__", "m__")


def set_times(e: DataFrame, mode: str, elevation: bool = False) -> DataFrame:
    """``time`` = d / speed in seconds and ``time_weighted`` = d_weighted / speed; with ``elevation`` (column ``dz``) on foot by Tobler's pace, by
    bicycle more slowly uphill.
    """
    pace = F.col("speed") * 1000 / 3600
    e = e.withColumns({"time": F.try_divide(F.col("d"), pace), "time_weighted": F.try_divide(F.col("d_weighted"), pace)})
    if elevation and mode in ("foot", "bicycle"):
        slope = F.when(F.col("d") > 0, F.col("dz") / F.col("d")).otherwise(0.0)
        factor = F.exp(3.5 * F.abs(slope + 0.05)) / F.exp(F.lit(3.5 * 0.05)) if mode == "foot" else F.when(slope > 0, 1 + 11 * slope).otherwise(1.0)
        e = e.withColumns(
            {"time": F.col("time") * F.coalesce(factor, F.lit(1.0)), "time_weighted": F.col("time_weighted") * F.coalesce(factor, F.lit(1.0))}
        )
    return e


def weight_ways(
    ways: DataFrame, profile: DataFrame | float, mode: str = "bicycle", id_col: str = "way_id", highway: str = "highway",
    keep: list[str] | None = None, surface_table: DataFrame | None = None, measure: str = "haversine", **options
) -> Graph:
    """A network of lines (``id_col``, ``geometry``, ``highway``, and the tags ``oneway``, ``maxspeed``, ``lanes``, ``surface`` if there are such):
    segments in both directions unless one-way, weighted by the profile.

    ``measure``: of lengths; "auto" for the one that suits the table's extent. ``options`` are attributes of the graph: ``turn_penalty`` (seconds)
    and ``left_side``, by which it is routed.
    """
    tags = [c for c in ("oneway", "oneway_bicycle", "maxspeed", "lanes", "surface") if c in ways.columns]
    held = list(dict.fromkeys([highway, *tags, *(keep or [])]))
    e = segments(ways.where(F.col(highway).isNotNull()), id_col, keep=held)
    one_way = truth(F.col("oneway")) if "oneway" in tags else F.lit(False)
    if mode == "foot":
        one_way = F.lit(False)
    if mode == "bicycle" and "oneway_bicycle" in tags:
        one_way = F.coalesce(truth(F.col("oneway_bicycle")), one_way)
    e = both_ways(e, one_way)
    if measure == "auto":
        measure = geo.measure_for(e, "from_lon", "from_lat")
    e = e.withColumn("d", geo.distance(measure)(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat")))
    e = weigh(e, profile, F.col(highway))
    if "lanes" in tags and mode in LANE_MODES:
        e = e.withColumn("d_weighted", F.col("d_weighted") * lane_factor(F.col("lanes")))
    e = set_times(
        set_speeds(e, mode, "maxspeed" if "maxspeed" in tags else None, highway, "surface" if "surface" in tags else None, surface_table), mode
    ).drop("profile_speed", "speed")
    e = e.withColumn(
        "edge_id",
        F.substring(F.sha2(F.concat_ws("|", F.col("way_id").cast("string"), F.col("seg").cast("string"), F.col("back").cast("string")), 256), 1, 16)
    ).drop("seg", "back")
    return components(Graph.of(e, order="edge_id", profile=mode, **options))


def tags_wide(objects: DataFrame, keys: list[str]) -> DataFrame:
    """(``object_``, one column per key): the first value of each key, by one conditional aggregation each."""
    return objects.where(F.col("key").isin(keys)).groupBy("object_").agg(
        *[F.min(F.when(F.col("key") == k, F.col("value"))).alias(k.replace(":", "_")) for k in keys]
    )


def tagged_nodes(nodes: DataFrame, wanted: list[tuple[str, str]], need_all: bool = False) -> DataFrame:
    """(``vertex_``): nodes that have any, or all, of the (key, value) pairs."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in wanted])
    hit = nodes.where(F.array_contains(pairs, F.struct("key", "value")))
    if not need_all:
        return hit.select("vertex_").distinct()
    return hit.groupBy("vertex_").agg(F.count_distinct("key", "value").alias("n")).where(F.col("n") == len(set(wanted))).select("vertex_")


def traffic_lights(nodes: DataFrame) -> DataFrame:
    """(``vertex_``): nodes with traffic signals, of a road or of a crossing."""
    road = tagged_nodes(nodes, [("highway", "traffic_signals")])
    return road.union(tagged_nodes(nodes, [("highway", "crossing"), ("crossing", "traffic_signals")], need_all=True)).distinct()


def crossing_ways(objects: DataFrame) -> DataFrame:
    """(``object_``): ways marked as footway crossings."""
    return tags_wide(objects, ["highway", "footway"]).where("highway = 'footway' and footway = 'crossing'").select("object_")


def wait_at_lights(e: DataFrame, wait: float, lights: DataFrame, crossings: DataFrame) -> DataFrame:
    """``e`` with the seconds of ``wait`` in ``time``: at signals, on the edges of crossings that end there, and on all edges that start there unless
    an edge of a crossing that waits does so too.
    """
    signal = small(lights.select(F.col("vertex_").alias("s__")))
    marked = e.join(signal.withColumn("ends__", F.lit(True)), F.col("`.vx1`") == F.col("s__"), "left").drop("s__")
    marked = marked.join(signal.withColumn("starts__", F.lit(True)), F.col("`.vx0`") == F.col("s__"), "left").drop("s__")
    marked = marked.join(
        small(crossings.select(F.col("object_").alias("o__")).distinct().withColumn("crosses__", F.lit(True))), F.col("object_") == F.col("o__"),
        "left"
    ).drop("o__")
    first = F.coalesce(F.col("ends__") & F.col("crosses__"), F.lit(False))
    waiting = marked.where(first).select(F.col("`.vx0`").alias("w__")).distinct().withColumn("waits__", F.lit(True))
    marked = marked.join(waiting, F.col("`.vx0`") == F.col("w__"), "left").drop("w__")
    second = F.coalesce(F.col("starts__"), F.lit(False)) & F.col("waits__").isNull()
    seconds = F.when(first, float(wait)).otherwise(0.0) + F.when(second, float(wait)).otherwise(0.0)
    return marked.withColumn("time", F.col("time") + seconds).drop("ends__", "starts__", "crosses__", "waits__")


def weight_tables(
    tables: dict[str, DataFrame], profile: DataFrame | float, mode: str = "bicycle", surface_table: DataFrame | None = None, lights: float = 0.0,
    measure: str = "haversine", keep: list[str] | None = None, **options
) -> Graph:
    """A network of normalised tables: ``vertex`` (vertex_, x_, y_, perhaps z_), ``edge`` (edge_, .vx0, .vx1), ``object_link_edge`` (edge_, object_),
    ``object`` (object_, key, value), perhaps ``nodes`` (vertex_, key, value).

    Coordinates, length, tags, weight, speed and time are joined in turn; seconds of ``lights`` are waited at traffic signals (``wait_at_lights``); of
    edges with the same ends the shortest is kept; and two-way edges are repeated the other way, roundabouts
    not, one-way ones for bicycles against the traffic at twice the weight if so tagged. ``keep``: further keys to keep as columns. ``options``: as
    for ``weight_ways``.
    """
    for name in ("vertex", "edge", "object_link_edge", "object"):
        if name not in tables:
            raise ValueError(f"the network has no table {name}")
    v = tables["vertex"].dropDuplicates(["vertex_"])
    high = "z_" in v.columns
    end = lambda k: v.select(F.col("vertex_").alias(f".vx{k}"), F.col("x_").alias(f"x{k}"), F.col("y_").alias(f"y{k}"), *([F.col("z_").alias(f"z{k}")] if high else []))
    e = tables["edge"].select("`.vx0`", "`.vx1`", "edge_").join(end(0), ".vx0", "left").join(end(1), ".vx1", "left")
    if measure == "auto":
        measure = geo.measure_for(v, "x_", "y_")
    e = e.withColumn("d", geo.distance(measure)(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")))
    e = e.withColumn("dz", F.col("z1") - F.col("z0") if high else F.lit(None).cast("double"))
    keys = ["highway", "oneway", "oneway:bicycle", "maxspeed", "lanes", "surface", "junction", "foot", "bicycle"]
    link = tables["object_link_edge"].select("edge_", "object_").dropDuplicates(["edge_"])
    e = e.join(link, "edge_", "left").join(
        tags_wide(tables["object"], list(dict.fromkeys([*keys, *(keep or [])]))), "object_", "left"
    ).where("highway is not null")
    if mode in ("foot", "bicycle"):
        e = e.where(F.coalesce(F.lower(mode) != "no", F.lit(True)) & ~F.col("highway").rlike("^(motorway|trunk)"))
    e = weigh(e, profile, F.col("highway"))
    e = set_speeds(e, mode, "maxspeed", "highway", "surface", surface_table)
    if mode in LANE_MODES:
        e = e.withColumn("d_weighted", F.col("d_weighted") * lane_factor(F.col("lanes")))
    shortest = Window.partitionBy(F.col("`.vx0`"), F.col("`.vx1`")).orderBy("d", "edge_")
    e = e.withColumn("r__", F.row_number().over(shortest)).where("r__ = 1").drop("r__")
    one_way = F.coalesce(
        truth(F.col("oneway")) | F.col("junction").isin("roundabout", "circular"), F.col("junction").isin("roundabout", "circular"), F.lit(False)
    )
    if mode == "foot":
        one_way = F.lit(False)
    contra = (F.coalesce(truth(F.col("oneway_bicycle")) == F.lit(False), F.lit(False)) & one_way) if mode == "bicycle" else F.lit(False)
    swap = {".vx0": ".vx1", ".vx1": ".vx0", "x0": "x1", "x1": "x0", "y0": "y1", "y1": "y0"}
    q = lambda c: F.col(f"`{c}`")
    there = F.struct(*[q(c).alias(c) for c in e.columns])
    turned = {c: q(swap.get(c, c)) for c in e.columns} | {
        "edge_": F.concat(F.col("edge_").cast("string"), F.lit("_r")), "dz": -F.col("dz"),
        "d_weighted": F.when(contra, F.col("d_weighted") * 2).otherwise(F.col("d_weighted"))
    }
    e = e.withColumn("edge_", F.col("edge_").cast("string"))
    back = F.struct(*[turned[c].alias(c) for c in e.columns])
    e = e.select(F.inline(F.when(one_way & ~contra, F.array(there)).otherwise(F.array(there, back))))
    e = set_times(e, mode, high)
    if lights and "nodes" in tables:
        e = wait_at_lights(e, lights, traffic_lights(tables["nodes"]), crossing_ways(tables["object"]))
    e = e.select(
        q(".vx0").cast("string").alias("from_id"), q(".vx1").cast("string").alias("to_id"), F.col("edge_").alias("edge_id"),
        F.col("x0").alias("from_lon"), F.col("y0").alias("from_lat"), F.col("x1").alias("to_lon"), F.col("y1").alias("to_lat"), "d",
        F.col("object_").alias("way_id"), "highway", "d_weighted", "time", "time_weighted", *(["dz"] if high else []),
        *[q(k.replace(":", "_")) for k in keep or [] if k != "highway"]
    )
    return components(Graph.of(e, order="edge_id", profile=mode, **options))


def weight_railway(
    ways: DataFrame, id_col: str = "way_id", kind: str = "railway", keep: list[str] | None = None, measure: str = "haversine"
) -> Graph:
    """A network of railway lines, each length its own weight; lines out of use are left out."""
    alive = ways.where(F.col(kind).isNotNull() & ~F.lower(kind).isin(DEAD_RAILWAYS))
    e = both_ways(segments(alive, id_col, keep=list(dict.fromkeys([kind, *(keep or [])]))), F.lit(False))
    e = e.withColumn(
        "d", geo.distance(measure)(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat"))
    ).withColumn("d_weighted", F.col("d"))
    e = e.withColumn(
        "edge_id",
        F.substring(F.sha2(F.concat_ws("|", F.col("way_id").cast("string"), F.col("seg").cast("string"), F.col("back").cast("string")), 256), 1, 16)
    ).drop("seg", "back")
    return components(Graph.of(e, order="edge_id"))


def ways_around(ways: DataFrame, points: DataFrame, expand: float = 0.1, x: str = "x", y: str = "y", geometry: str = "geometry") -> DataFrame:
    """The lines of a table of ways that have a vertex in the box around ``points``, grown by ``expand`` of its size: what a network for routing
    between them is built of.
    """
    west, south, east, north = expand_box(points, expand=expand, x=x, y=y)
    across = lambda v: v.between(west, east) if west <= east else (v >= west) | (v <= east)
    return ways.where(F.exists(geometry, lambda p: across(p["x"]) & p["y"].between(south, north)))


def expand_box(
    points: DataFrame | None = None, box: tuple[float, float, float, float] | list | str | None = None, expand: float = 0.05, x: str = "x",
    y: str = "y"
) -> tuple[float, float, float, float]:
    """(west, south, east, north) around points or of a box (four numbers, also in a text, or corners or a polygon as pairs), grown by a share of its
    size, latitudes held within the globe and longitudes turned into -180..180.
    """
    if isinstance(box, str):
        box = re.findall(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?", box)
    if box is not None:
        flat = [float(v) for part in box for v in (part if isinstance(part, list | tuple) else [part])]
        if len(flat) < 4 or len(flat) % 2:
            raise ValueError("a box needs two corners")
        xs, ys = flat[0::2], flat[1::2]
        west, east, south, north = min(xs), max(xs), min(ys), max(ys)
    elif points is not None:
        r = points.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
        west, south, east, north = r
    else:
        raise ValueError("either points or a box must be given")
    w, h = (east - west) * expand, (north - south) * expand
    turn = lambda v: (v + 180) % 360 - 180 if not -180 <= v <= 180 else v
    return turn(west - w), max(-90.0, south - h), turn(east + w), min(90.0, north + h)
