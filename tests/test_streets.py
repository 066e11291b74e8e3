import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayloom.operators import flows, match, routing
from wayloom.schema import Graph, column_roles
from wayloom.sources import network
from wayloom.streaming import latest_edges

EDGE = "edge_id long, from_id string, from_lon double, from_lat double, to_id string, to_lon double, to_lat double, d double, d_weighted double, time double, time_weighted double"


@pytest.fixture(scope="module")
def crossroads(spark):
    """Four arms that meet at c, each 100 m and 10 s, both ways."""
    at = {"c": (0.0, 0.0), "n": (0.0, 1.0), "e": (1.0, 0.0), "s": (0.0, -1.0), "w": (-1.0, 0.0)}
    rows = []
    for i, arm in enumerate("nesw"):
        for j, (a, b) in enumerate((("c", arm), (arm, "c"))):
            rows.append((10 * i + j, a, *at[a], b, *at[b], 100.0, 100.0, 10.0, 10.0))
    return spark.createDataFrame(rows, EDGE)


def test_turn_penalties_are_routed_by_themselves(spark, crossroads):
    plain, turning = Graph.of(crossroads), Graph.of(crossroads, turn_penalty=5.0)
    times = lambda g: {(r.from_id, r.to_id): r.time for r in routing.times(g).collect()}
    a, b = times(plain), times(turning)
    assert set(a) == set(b) and a["s", "w"] == 20.0
    # on the right: the turn to the left crosses the traffic, those ahead and to the right do not
    assert b["s", "w"] == 25.0 and b["s", "e"] == 20.0 and b["s", "c"] == 10.0 and b["c", "n"] == 10.0 and b["c", "c"] == 0.0
    left = times(Graph.of(crossroads, turn_penalty=5.0, left_side=True))
    assert left["s", "e"] >= 20.0 and left != b
    table = spark.createDataFrame([("s", "w", 3.0)], "from_id string, to_id string, flow double")
    loads = {(r.from_id, r.to_id): r.flow for r in flows.flows_aggregate(turning, table, norm_sums=False).collect()}
    assert loads["s", "c"] == loads["c", "w"] == 3.0 and sum(loads.values()) == 6.0 and len(loads) == 8
    pairs = spark.createDataFrame([("s", "w"), ("s", "s")], "from_id string, to_id string")
    got = {(r.from_id, r.to_id): r.d for r in routing.dists_pairwise(turning, pairs, shortest=False, length="time").collect()}
    assert got == {("s", "w"): 25.0, ("s", "s"): 0.0}


def test_contraction_first(spark):
    chain = [(i, f"a{i}", f"a{i + 1}", 1.0, 1.0) for i in range(6)] + [(10 + i, f"a{i + 1}", f"a{i}", 1.0, 1.0) for i in range(6)] + [(20, "a3", "b", 1.0, 1.0), (21, "b", "a3", 1.0, 1.0)]
    g = Graph.of(spark.createDataFrame(chain, "edge_id long, from_id string, to_id string, d double, d_weighted double"))
    table = spark.createDataFrame([("a0", "a6", 2.0), ("b", "a1", 1.0)], "from_id string, to_id string, flow double")
    key = lambda df: {r.edge_id: r.flow for r in df.collect()}
    assert key(flows.flows_aggregate(g, table, norm_sums=False, contract_first=True)) == key(flows.flows_aggregate(g, table, norm_sums=False))
    by_edge = {r.edge_id: r.centrality for r in flows.centrality(g, contract_first=True).collect()}
    assert len(by_edge) == len(chain) and by_edge[0] == by_edge[1] == by_edge[2] > 0


def test_places_as_numbers(spark, crossroads):
    g = Graph.of(crossroads)
    first = spark.createDataFrame([(0,), (1,)], "n long")
    assert {r.from_id for r in routing.dists(g, first, ["s"]).collect()} == {"c", "n"}


def test_waiting_at_lights(spark):
    rows = [("1", "a", "b", "cross"), ("2", "a", "x", "road"), ("3", "b", "x", "road"), ("4", "x", "b", "road")]
    e = spark.createDataFrame(rows, "edge_ string, `.vx0` string, `.vx1` string, object_ string").withColumn("time", F.lit(1.0))
    nodes = spark.createDataFrame([("b", "highway", "traffic_signals"), ("a", "highway", "crossing"), ("a", "crossing", "traffic_signals"), ("x", "crossing", "traffic_signals")], "vertex_ string, key string, value string")
    objects = spark.createDataFrame([("cross", "highway", "footway"), ("cross", "footway", "crossing"), ("road", "highway", "primary")], "object_ string, key string, value string")
    lights = network.traffic_lights(nodes)
    assert {r[0] for r in lights.collect()} == {"a", "b"}
    got = {r.edge_: r.time for r in network.wait_at_lights(e, 8.0, lights, network.crossing_ways(objects)).collect()}
    # 1 crosses and ends at b; 2 starts at a, from where a crossing edge waits already; 3 starts at b; 4 only ends at one
    assert got == {"1": 9.0, "2": 1.0, "3": 9.0, "4": 1.0}


def test_kinds_of_ways(spark):
    profile = spark.createDataFrame([("primary", 1.0, None), ("primary_link", 0.5, None), ("path", 0.25, None), ("motorway", 0.0, None)], "way string, value double, max_speed double")
    e = spark.createDataFrame([(1, "primary"), (2, "primary_road"), (3, "primary_link_x"), (4, " Footway"), (5, "pedestrian_zone"), (6, "motorway"), (7, "canal"), (8, None)], "id int, highway string").withColumn("d", F.lit(10.0))
    got = {r.id: r.d_weighted for r in network.weigh(e, profile, F.col("highway")).collect()}
    assert got == {1: 10.0, 2: 10.0, 3: 20.0, 4: 40.0, 5: 40.0}
    assert [tuple(r) for r in network.unknown_kinds(e, profile).collect()] == [("canal", 1)]


def test_the_last_delivery_counts(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    rows = [(1, day(2), 10.0), (1, day(5), 20.0), (2, day(3), 1.0), (None, day(3), 1.0), (3, None, 1.0), (1, day(1), 30.0)]
    df = spark.createDataFrame(rows, "edge_id int, loaded_at timestamp, d double")
    assert {r.edge_id: r.d for r in latest_edges(df).collect()} == {1: 20.0, 2: 1.0}
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = latest_edges(stream).writeStream.outputMode("update").format("memory").queryName("latest_edges_test").trigger(availableNow=True).start()
    run.awaitTermination()
    assert {r.edge_id: r.d for r in spark.table("latest_edges_test").collect()} == {1: 20.0, 2: 1.0}


def test_nearest_by_leaves_equals_brute_force(spark, monkeypatch):
    import random

    rng = random.Random(6)
    v = [(f"v{i:03d}", rng.gauss(0, 1) ** 3, rng.gauss(0, 1) ** 3) for i in range(400)] + [("far", 999.0, -999.0), ("nul", None, 1.0)]
    p = [(i, rng.gauss(0, 2), rng.gauss(0, 2)) for i in range(200)] + [(900, 5000.0, 0.0), (901, None, 0.0)]
    real = match._nearest
    monkeypatch.setattr(match, "_nearest", lambda a, b: real(a, b, leaf_things=15))
    got = {r.k: r.id for r in match.points_to_vertices(spark.createDataFrame(p, "k int, x double, y double"), "k", "x", "y", spark.createDataFrame(v, "id string, x double, y double")).collect()}
    want = {k: min(((x - u) ** 2 + (y - w) ** 2, i) for i, u, w in v if u is not None)[1] for k, x, y in p if x is not None}
    assert got == want


def test_roles_of_columns():
    assert column_roles([".vx0", ".vx1", "edge_", "d", "w"]) == {"from_id": ".vx0", "to_id": ".vx1", "d": "d", "d_weighted": "w", "edge_id": "edge_"}
    with pytest.raises(ValueError, match="distance"):
        column_roles(["from", "to", "x"])


def test_boxes_and_ways_around(spark):
    assert network.expand_box(box="1.0, 2.0; 3.0 4.0", expand=0.0) == (1.0, 2.0, 3.0, 4.0)
    assert network.expand_box(box=[(0.0, 0.0), (2.0, 0.0), (1.0, 3.0)], expand=0.0) == (0.0, 0.0, 2.0, 3.0)
    ways = spark.createDataFrame([("in", [("a", 0.5, 0.5), ("b", 9.0, 9.0)]), ("out", [("c", 5.0, 5.0)]), ("none", None)], "way_id string, geometry array<struct<id:string,x:double,y:double>>")
    points = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0)], "x double, y double")
    assert [r.way_id for r in network.ways_around(ways, points).collect()] == ["in"]


def test_several_decays(spark, crossroads):
    g = Graph.of(crossroads)
    n = spark.createDataFrame([("s", 2.0), ("w", 1.0)], "id string, n double")
    two = {r.edge_id: (r.flow1, r.flow2) for r in flows.flows_si(g, n, n, k=[50.0, 500.0]).collect()}
    own = {r.edge_id: (r.flow1, r.flow2) for r in flows.flows_si(g, n.withColumns({"k1": F.lit(50.0), "k2": F.lit(500.0)}), n).collect()}
    assert two == own and len(two) == 8 and sum(a for a, _ in two.values()) == pytest.approx(3.0)
    with pytest.raises(ValueError, match="heap"):
        routing.dists(g, heap="pile")
