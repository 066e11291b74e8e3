"""Weighting profiles: how good each kind of way is for a mode of travel, its speeds, and penalties."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

# Modes; km/h by kind of way and mode group; km/h by surface; seconds at traffic lights and for turns across the traffic.
MODES = ["foot", "horse", "wheelchair", "bicycle", "moped", "motorcycle", "motorcar", "goods", "hgv", "psv"]
CAR_SPEEDS = {
    "motorway": 90, "trunk": 85, "primary": 65, "secondary": 55, "tertiary": 40, "unclassified": 25, "residential": 25, "service": 15, "living_street": 10,
    "motorway_link": 45, "trunk_link": 40, "primary_link": 30, "secondary_link": 25, "tertiary_link": 20,
}
CAR_MODES = ["motorcar", "goods", "hgv", "psv", "motorcycle"]
USUAL_SLOW_SPEEDS = [("bicycle", 15), ("wheelchair", 5), ("horse", 6.4), ("foot", 5)]
SLOW_SPEEDS = [
    ("bicycle", "track", 12),
    ("bicycle", "path", 12),
    ("bicycle", "steps", 4),
    ("bicycle", "bridleway", 8),
    ("bicycle", "footway", 4),
    ("bicycle", "pedestrian", 4),
    ("wheelchair", "track", 2),
    ("wheelchair", "steps", None),
    ("wheelchair", "bridleway", None),
    ("wheelchair", "footway", 4),
    ("wheelchair", "pedestrian", 4),
    ("horse", "steps", 2),
    ("foot", "steps", 2),
]
NO_SLOW_SPEED = ["motorway", "trunk", "motorway_link", "trunk_link"]
MOPED_TOP = 50
SURFACES = [
    ("motorcar", "cement", 80),
    ("motorcar", "compacted", 80),
    ("motorcar", "fine_gravel", 80),
    ("motorcar", "paving_stones", 60),
    ("motorcar", "metal", 60),
    ("motorcar", "bricks", 60),
    ("motorcar", "grass", 40),
    ("motorcar", "wood", 40),
    ("motorcar", "sett", 40),
    ("motorcar", "grass_paver", 40),
    ("motorcar", "gravel", 40),
    ("motorcar", "unpaved", 40),
    ("motorcar", "ground", 40),
    ("motorcar", "dirt", 40),
    ("motorcar", "pebblestone", 40),
    ("motorcar", "tartan", 40),
    ("motorcar", "cobblestone", 30),
    ("motorcar", "clay", 30),
    ("motorcar", "earth", 20),
    ("motorcar", "stone", 20),
    ("motorcar", "rocky", 20),
    ("motorcar", "sand", 20),
    ("motorcar", "mud", 10),
    ("bicycle", "cobblestone:flattened", 10),
    ("bicycle", "paving_stones", 10),
    ("bicycle", "compacted", 10),
    ("bicycle", "cobblestone", 6),
    ("bicycle", "unpaved", 6),
    ("bicycle", "fine_gravel", 6),
    ("bicycle", "gravel", 6),
    ("bicycle", "pebblestone", 6),
    ("bicycle", "ground", 6),
    ("bicycle", "dirt", 6),
    ("bicycle", "earth", 6),
    ("bicycle", "grass", 6),
    ("bicycle", "mud", 3),
    ("bicycle", "sand", 3),
    ("bicycle", "sett", 10),
    ("foot", "fine_gravel", 4),
    ("foot", "gravel", 4),
    ("foot", "pebblestone", 4),
    ("foot", "mud", 2),
    ("foot", "sand", 2),
]
LIGHTS = {"foot": 2.0, "wheelchair": 2.0, "bicycle": 2.0}
LIGHTS_OTHER = 8.0
TURNS = {"foot": 0.0, "horse": 0.0, "bicycle": 6.0}
TURN_OTHER = 7.5
UNRESTRICTED = ["foot", "horse", "wheelchair", "bicycle"]


def way_speed(mode: str, way: str) -> float | None:
    usual = dict(USUAL_SLOW_SPEEDS)
    if mode in usual:
        special = {w: v for m, w, v in SLOW_SPEEDS if m == mode}
        return None if way in NO_SLOW_SPEED else special.get(way, usual[mode])
    speed = CAR_SPEEDS.get(way)
    return min(speed, MOPED_TOP) if mode == "moped" and speed else speed


def surface_speeds(spark: SparkSession) -> DataFrame:
    rows = [(mode, "surface", surface, float(speed)) for mode, surface, speed in SURFACES]
    return spark.createDataFrame(rows, "name string, key string, value string, max_speed double")


def penalties(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(m, LIGHTS.get(m, LIGHTS_OTHER), TURNS.get(m, TURN_OTHER), m not in UNRESTRICTED) for m in MODES],
        "name string, traffic_lights double, turn double, restrictions boolean"
    )


def profile(table: DataFrame, name: str | float | DataFrame | None) -> DataFrame | float:
    """(``way``, ``value``, ``max_speed``) of a profile: by name from a table of profiles, a frame of one's own (``way``, ``value``, and perhaps
    ``max_speed``), or a number for all ways.
    """
    if isinstance(name, int | float):
        return float(name)
    if isinstance(name, DataFrame):
        return name if "max_speed" in name.columns else name.selectExpr("way", "value", "cast(null as double) as max_speed")
    out = table.where(table["name"] == name).select("way", "value", "max_speed")
    if not out.limit(1).count():
        raise ValueError(f"there is no weighting profile {name!r}")
    return out


def turns_restricted(spark: SparkSession, mode: str) -> bool:
    return bool(penalties(spark).where(f"name = '{mode}' and restrictions").count())


def write_profiles(tables: dict[str, DataFrame], file: str) -> None:
    """Profile tables, a few hundred rows, as one JSON file that people edit."""
    with open(file, "w") as f:
        json.dump({k: [r.asDict() for r in t.limit(100_000).collect()] for k, t in tables.items()}, f, indent=1)


def read_profiles(spark: SparkSession, file: str) -> dict[str, DataFrame]:
    with open(file) as f:
        tables = json.load(f)
    schema = {
        "weighting_profiles": "name string, way string, value double, max_speed double", "surface_speeds": "name string, key string, value string, max_speed double",
        "penalties": "name string, traffic_lights double, turn double, restrictions boolean",
    }
    typed = lambda r, s: tuple(float(r[c.split()[0]]) if "double" in c and r.get(c.split()[0]) is not None else r.get(c.split()[0]) for c in s.split(", "))
    return {k: spark.createDataFrame([typed(r, schema[k]) for r in rows], schema[k]) for k, rows in tables.items() if k in schema}
