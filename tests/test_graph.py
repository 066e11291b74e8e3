import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom.operators import cycles, flows, iso, match, routing, structure, turns
from wayloom.plans import graph_queries
from wayloom.schema import Graph, column_roles
from wayloom.sources import io, network, profiles

EDGE = "edge_id long, from_id string, to_id string, d double, d_weighted double"


def graph(spark, rows, schema=EDGE):
    return Graph.of(spark.createDataFrame(rows, schema))


@pytest.fixture(scope="module")
def toy(spark):
    return graph(spark, [(1, "s", "a", 1.0, 1.0), (2, "s", "b", 2.0, 2.0), (3, "s", "t", 10.0, 10.0), (4, "a", "t", 20.0, 20.0), (5, "b", "t", 3.0, 3.0)])


@pytest.fixture(scope="module")
def town(spark):
    """A seeded random graph with ties and parallel edges, in integers."""
    rng = random.Random(11)
    rows = [(i, f"v{rng.randrange(24):02d}", f"v{rng.randrange(24):02d}", float(rng.randrange(1, 9)), float(rng.randrange(1, 9))) for i in range(110)]
    return graph(spark, [r for r in rows if r[1] != r[2]])


def as_dict(df, value="d"):
    return {(r.from_id, r.to_id): r[value] for r in df.collect()}


def test_shortest_is_exact(toy):
    assert as_dict(routing.dists(toy, ["s"], ["t"]))["s", "t"] == 5.0
    got = as_dict(routing.dists(toy))
    assert got["t", "s"] is None and got["t", "t"] == 0.0 and len(got) == 16


def test_strategies_agree(town):
    kernel, loop = as_dict(routing.dists(town, strategy="kernel")), as_dict(routing.dists(town, strategy="loop"))
    assert kernel == loop
    key = lambda df: {(r.source, r.vertex): tuple(r) for r in df.collect()}
    assert key(routing.trees(town, strategy="kernel")) == key(routing.trees(town, strategy="loop"))
    assert key(routing.trees(town, limit=6.0, strategy="kernel")) == key(routing.trees(town, limit=6.0, strategy="loop"))
    path = lambda df: {(r.from_id, r.to_id): (r.vertices, r.edges, r.d) for r in df.collect()}
    a, b = path(routing.paths(town, strategy="kernel")), path(routing.paths(town, strategy="loop"))
    assert a == b
    assert all(len(v) == len(e) + 1 for v, e, _ in a.values() if e)
    near = lambda s: sorted(map(tuple, routing.dists_nearest(town, None, ["v01", "v05"], strategy=s).collect()))
    assert near("kernel") == near("loop")


def test_dense_search_agrees(town, monkeypatch):
    from wayloom import kernel

    want = as_dict(routing.dists(town))
    csr, _ = routing.load(town.standard())
    for source in range(csr.n):
        heap, arrays = csr._search_heap(source, None, None, False), csr._search_arrays(source, None, None, False)
        assert dict(zip(heap.v.tolist(), zip(heap.w, heap.d, heap.hops, heap.prev))) == dict(zip(arrays.v.tolist(), zip(arrays.w, arrays.d, arrays.hops, arrays.prev)))
    csr.w[:3], csr._lists = csr.w[3], None
    whole = [csr._search_heap(i, None, None, False) for i in range(csr.n)]
    label = lambda t: dict(zip(t.v.tolist(), zip(t.w, t.d, t.hops, t.prev, t.edge)))
    assert [label(t) for t in csr._search_block(np.arange(csr.n))] == [label(t) for t in whole]
    monkeypatch.setattr(kernel, "DENSE_DEGREE", 0)
    assert [label(t) for _, t in csr.searches(list(range(csr.n)))] == [label(t) for t in whole] and want


def test_turned_and_pairwise(spark, town):
    full = as_dict(routing.dists(town))
    some = [f"v{i:02d}" for i in range(12)]
    turned = as_dict(routing.dists(town, some, ["v03"]))
    assert turned == {(s, "v03"): full[s, "v03"] for s in some}
    pairs = spark.createDataFrame([("v00", "v03", "x"), ("v00", "v03", "x"), ("v01", "v01", "y"), (None, "v01", "z"), ("nix", "v01", "z")], "from_id string, to_id string, d string")
    got = [tuple(r) for r in routing.dists_pairwise(town, pairs).collect()]
    assert len(got) == 5 and ("v00", "v03", "x", full["v00", "v03"]) in got and ("v01", "v01", "y", 0.0) in got and ("nix", "v01", "z", None) in got


def test_more_targets_than_may_be_sent(toy, monkeypatch):
    rows = lambda df: sorted(map(str, df.collect()))
    ask = lambda: [rows(routing.dists(toy, ["s", "a"], ["a", "b", "t"])), rows(routing.dists(toy, ["s", "a", "b"], ["t"])), rows(routing.dists_nearest(toy, ["s", "a"], ["a", "b", "t"])), rows(routing.paths(toy, ["s"], ["a", "b", "t"]))]
    sent = ask()
    monkeypatch.setattr(routing, "KERNEL_TARGETS", 2)
    assert ask() == sent


def test_nearest_target_first_in_order(spark):
    g = graph(spark, [(1, "s", "near", 1.0, 1.0), (2, "s", "far", 9.0, 9.0), (3, "x", "b", 1.0, 1.0), (4, "x", "a", 1.0, 1.0)])
    got = {r.from_id: (r.to_id, r.d) for r in routing.dists_nearest(g, ["s", "x"], ["near", "far", "a", "b"]).collect()}
    assert got == {"s": ("near", 1.0), "x": ("a", 1.0)}


def test_errors(spark, toy):
    with pytest.raises(ValueError, match="can not be matched"):
        routing.dists(toy, ["nowhere"])
    with pytest.raises(ValueError, match="weighted time"):
        routing.dists(toy, shortest=False)
    with pytest.raises(ValueError, match="dlim must"):
        iso.isoverts(toy, None)
    with pytest.raises(ValueError, match="Only one"):
        iso.isoverts(toy, None, dlim=[1.0], tlim=[1.0])
    with pytest.raises(ValueError, match="dlimit"):
        routing.categorical_within(toy, "edge_id", None, None)
    with pytest.raises(ValueError, match="empty"):
        structure.contract(toy.with_edges(toy.edges.limit(0)))
    with pytest.raises(Exception, match="negative"):
        routing.dists(graph(spark, [(1, "a", "b", 1.0, -1.0)])).collect()


def test_null_weights_are_no_edges(spark):
    g = graph(spark, [(1, "a", "b", 1.0, None), (2, "a", "b", 7.0, 7.0), (3, None, "b", 1.0, 1.0), (4, "b", "c", math.nan, 1.0)])
    got = as_dict(routing.dists(g))
    assert got["a", "b"] == 7.0 and got["b", "c"] is None


def test_flows(spark, town):
    v = routing.vertex_ids(town)
    table = routing.each_target(v, v).withColumn("flow", F.lit(2.0))
    key = lambda g: {r.edge_id: round(r.flow, 9) for r in g.collect()}
    kernel, loop = flows.flows_aggregate(town, table), flows.flows_aggregate(town, table, strategy="loop")
    assert key(kernel) == key(loop)
    reached = routing.trees(town).where("hops > 0").count()
    assert sum(key(kernel).values()) == pytest.approx(2.0 * reached)  # a unit is shared by the edges of its route
    assert sum(key(flows.flows_aggregate(town, table.limit(0))).values()) == 0
    n = v.withColumn("n", F.lit(3.0))
    assert sum(key(flows.flows_disperse(town, n, k=5.0)).values()) == pytest.approx(3.0 * routing.trees(town).where("hops > 0").select("source").distinct().count())
    assert key(flows.flows_si(town, n, n, k=5.0)) == key(flows.flows_si(town, n.withColumn("k", F.lit(5.0)), n))
    two = flows.flows_disperse(town, n, k=[5.0, 50.0]).select("flow1", "flow2").first()
    assert two is not None


def test_centrality_with_ties(spark):
    g = graph(spark, [(1, "a", "b", 1.0, 1.0), (2, "a", "c", 1.0, 1.0), (3, "b", "d", 1.0, 1.0), (4, "c", "d", 1.0, 1.0), (5, "d", "e", 1.0, 1.0), (6, "d", "e", 1.0, 1.0)])
    by_vertex = {r.id: r.centrality for r in flows.centrality(g, edges=False).collect()}
    assert by_vertex == {"a": 0.0, "b": 1.0, "c": 1.0, "d": 3.0, "e": 0.0}
    by_edge = {r.edge_id: r.centrality for r in flows.centrality(g).collect()}
    assert by_edge == {1: 2.0, 2: 2.0, 3: 3.0, 4: 3.0, 5: 4.0, 6: 0.0}
    weighted = {r.id: r.centrality for r in flows.centrality(g, edges=False, vertex_weights=spark.createDataFrame([("a", 2.0)], "id string, n double")).collect()}
    assert weighted["d"] == 2.0
    assert {r.id: r.centrality for r in flows.centrality(g, edges=False, threshold=0.5).collect()}["d"] == 0.0


def test_flows_by_named_edges(spark, cross):
    table = spark.createDataFrame([("s", "n", 4.0), ("s", "n", 2.0), ("s", "s", 9.0), ("s", "zz", 1.0), ("n", None, 1.0)], "from_id string, to_id string, flow double")
    got = {r.edge_id: r.flow for r in flows.flows_aggregate(cross, table, norm_sums=False).collect()}
    assert got["in_s"] == got["out_n"] == 6.0 and sum(got.values()) == 12.0
    assert {r.edge_id: r.centrality for r in flows.centrality(cross).collect()}["in_n"] == 4.0


def test_components_and_sample(spark):
    chain = [(i, f"a{i:03d}", f"a{i + 1:03d}", 1.0, 1.0) for i in range(60)]
    g = graph(spark, [*chain, (100, "b", "c", 1.0, 1.0), (101, "c", "b", 1.0, 1.0), (102, "x", "y", 1.0, 1.0), (103, "y", "x", 1.0, 1.0), (104, "q", "q", 1.0, 1.0), (105, None, "z", 1.0, 1.0)])
    got = {r.edge_id: r.component for r in structure.components(g).edges.collect()}
    assert all(got[i] == 1 for i in range(60)) and got[100] == got[101] == 2 and got[102] == 3 and got[104] == 4 and got[105] is None
    part = structure.sample(g, 12, seed=5)
    assert routing.vertex_ids(part).count() == 12
    assert structure.components(part).edges.select("component").distinct().count() == 1


def test_contract_and_back(spark):
    rows = []
    names = ["j1", "m1", "m2", "m3", "j2"]
    for i, (a, b) in enumerate(zip(names, names[1:])):  # two-way chain
        rows += [(10 + i, a, b, 1.0, 2.0), (20 + i, b, a, 1.0, 2.0)]
    rows += [(30, "j1", "e1", 5.0, 5.0), (31, "e1", "j1", 5.0, 5.0), (32, "j2", "e2", 5.0, 5.0), (33, "e2", "j2", 5.0, 5.0), (34, "j1", "e3", 1.0, 1.0), (35, "e3", "j2", 1.0, 3.0)]
    rows += [(40, "r1", "r2", 1.0, 1.0), (41, "r2", "r3", 1.0, 1.0), (42, "r3", "r1", 1.0, 1.0)]  # a ring
    g = graph(spark, rows)
    short, mapped = structure.contract(g)
    edges = {(r.from_id, r.to_id): (r.edge_id, r.d, r.d_weighted) for r in short.edges.collect()}
    assert edges["j1", "j2"][1:] == (4.0, 8.0) and edges["j2", "j1"][1:] == (4.0, 8.0)
    assert ("j1", "e3") in edges and ("e3", "j2") in edges  # the weights have different ratios there
    assert edges["r1", "r1"][1:] == (3.0, 3.0)
    assert edges["j1", "e1"][0] == "30" and len(edges) == 9
    assert mapped.count() == len(rows)
    kept = {(r.from_id, r.to_id) for r in structure.contract(g, spark.createDataFrame([("m2",)], "id string"))[0].edges.collect()}
    assert ("j1", "m2") in kept and ("m2", "j2") in kept and ("j1", "j2") not in kept
    back = structure.uncontract(short.with_edges(short.edges.withColumn("load", F.lit(1))), mapped, g)
    assert back.edges.where("load = 1").count() == len(rows)
    other = {(r.from_id, r.to_id) for r in structure.contract(g.with_edges(g.edges.withColumn("kind", F.when(F.col("edge_id").isin(10, 20), "x").otherwise("y"))), same=["kind"])[0].edges.collect()}
    assert ("j1", "m1") in other and ("m1", "j2") in other


def test_duplicates_and_merge(spark):
    g = graph(spark, [(1, "a", "b", 4.0, 9.0, 7.0), (2, "a", "b", 5.0, 3.0, 5.0), (3, "b", "a", 1.0, 1.0, 1.0)], EDGE + ", time_weighted double")
    assert structure.has_duplicates(g)
    one = {r.edge_id: (r.d, r.d_weighted, r.time_weighted) for r in structure.deduplicate(g).edges.collect()}
    assert one == {1: (4.0, 3.0, 5.0), 3: (1.0, 1.0, 1.0)}
    merged = structure.merge_directed(g.with_edges(g.edges.withColumn("flow", F.lit(2.0))), ["flow"]).edges.collect()
    assert [(r.edge_id, r.flow) for r in merged] == [(1, 6.0)]


XY = "edge_id string, from_id string, from_lon double, from_lat double, to_id string, to_lon double, to_lat double, d double, d_weighted double"


@pytest.fixture(scope="module")
def cross(spark):
    arms = {"n": (0.0, 1e-3), "e": (1e-3, 0.0), "s": (0.0, -1e-3), "w": (-1e-3, 0.0)}
    rows = []
    for a, (x, y) in arms.items():
        rows += [(f"in_{a}", a, x, y, "c", 0.0, 0.0, 111.195, 111.195), (f"out_{a}", "c", 0.0, 0.0, a, x, y, 111.195, 111.195)]
    return graph(spark, rows, XY)


def test_turns(spark, cross):
    pairs = {(r.edge_in, r.edge_out): (r["rank"], r.penalty) for r in turns.turn_pairs(cross, left_side=True).collect()}
    assert len(pairs) == 16
    assert [pairs["in_s", f"out_{a}"][0] for a in "swne"] == [0, 1, 2, 3]
    assert pairs["in_s", "out_e"][1] and not pairs["in_s", "out_w"][1]
    full, made = turns.compound_junctions(cross.with_edges(cross.edges.withColumns({"time": F.lit(10.0), "time_weighted": F.lit(10.0)})), 5.0)
    full = Graph.of(full.edges, order="edge_id")
    assert made.count() == 16 and full.edges.count() == 24
    d = as_dict(routing.dists(full, ["s"], ["n"]))
    assert d["s", "n"] == pytest.approx(222.39)
    rules = spark.createDataFrame([(False, "in_s", "c", "out_n")], "only boolean, way_from string, via string, way_to string")
    barred, _ = turns.compound_junctions(cross.with_edges(cross.edges.withColumn("way", F.col("edge_id"))), 5.0, restrictions=rules, way="way")
    assert as_dict(routing.dists(Graph.of(barred.edges, order="edge_id"), ["s"], ["n"]))["s", "n"] == pytest.approx(444.78)  # by another arm and back
    loaded = full.with_edges(full.edges.withColumn("flow", F.when(F.col("edge_id") == "j_in_s_out_n", 3.0).otherwise(0.0)))
    plain = {r.edge_id: r.flow for r in turns.uncompound(loaded, made, ["flow"]).edges.collect()}
    assert len(plain) == 8 and plain["in_s"] == plain["out_n"] == 3.0 and plain["in_n"] == 0.0


def test_insert_match_and_add(spark, cross):
    split = structure.insert_vertex(cross, "n", "c")
    rows = split.edges.collect()
    assert len(rows) == 10 and {r.edge_id for r in rows} >= {"in_n_a", "in_n_b", "out_n_a", "out_n_b", "in_e"}
    assert sum(r.d for r in rows) == pytest.approx(8 * 111.195, rel=1e-4)
    with pytest.raises(ValueError, match="do not define"):
        structure.insert_vertex(cross, "n", "s")
    pts = spark.createDataFrame([("p", 5e-4, 1e-4), ("q", -2e-4, 5e-4), ("far", 1.0, 1.0), ("nul", None, 1.0)], "k string, x double, y double")
    v = structure.vertices(cross)
    near = {r.k: r.id for r in match.points_to_vertices(pts, "k", "x", "y", v).collect()}
    assert near["far"] in ("n", "e") and "nul" not in near
    on = {r.k: r for r in match.points_to_edges(pts, "k", "x", "y", cross).collect()}
    assert on["p"].x == pytest.approx(5e-4) and abs(on["p"].d_signed) == pytest.approx(1e-4)
    assert on["p"].edge in ("in_e", "out_e") and on["p"].d_signed == pytest.approx(1e-4 if on["p"].edge == "in_e" else -1e-4)
    more = match.add_nodes(cross, pts.where("k in ('p', 'q')"), "k", "x", "y")
    d = as_dict(routing.dists(Graph.of(more.edges, order="edge_id"), ["p"], ["q"]))
    assert d["p", "q"] == pytest.approx((1e-4 + 5e-4 + 5e-4 + 2e-4) * 111_195, rel=1e-3)


def test_iso(spark, cross):
    got = {(r.from_id, r.dlim, r.id) for r in iso.isoverts(cross, ["c"], dlim=[50.0, 200.0]).collect()}
    assert got == {("c", 50.0, "c")} | {("c", 200.0, a) for a in "cnesw"}
    ring = [r.id for r in iso.isodists(cross, ["c"], [200.0]).orderBy("pos").collect()]
    assert len(ring) == 5 and ring[0] == ring[-1] and set(ring) == set("nesw")
    assert iso.isodists(cross, ["c"], [200.0], concavity=0.5).count() >= 5


def test_cycles(spark):
    rows = []
    for i, (a, b) in enumerate([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("x", "y")]):
        rows += [(2 * i, a, b, 1.0, 1.0), (2 * i + 1, b, a, 1.0, 1.0)]
    g = graph(spark, rows)
    rings = {}
    for r in cycles.cycles(g).orderBy("cycle_id", "pos").collect():
        rings.setdefault(r.cycle_id, []).append(r.id)
    assert sorted(map(sorted, rings.values())) == [["a", "b", "c"], ["c", "d", "e"]]
    assert {r.component: r["rank"] for r in cycles.cycle_rank(g).collect()} == {"a": 2, "x": 0}


def test_cycles_through_contraction(spark):
    names = ["j1", "m1", "m2", "j2", "m3"]
    rows, at = [], {"j1": (0.0, 0.0), "m1": (0.0, 1.0), "m2": (0.5, 2.0), "j2": (1.0, 1.0), "m3": (1.0, 0.0), "t1": (-1.0, 0.0), "t2": (2.0, 1.0)}
    for a, b in [*zip(names, names[1:] + names[:1]), ("j1", "t1"), ("j2", "t2"), ("j1", "j2")]:
        for u, v in ((a, b), (b, a)):
            rows.append((f"{u}{v}", u, *at[u], v, *at[v], 1.0, 1.0))
    g = graph(spark, rows, XY)
    full = {}
    for r in cycles.full_cycles(g).orderBy("cycle_id", "pos").collect():
        full.setdefault(r.cycle_id, []).append(r.id)
    assert sum(len(v) for v in full.values()) == 4 + 3 and len(full) == 2
    assert all(r.wkt.startswith("POLYGON ((") for r in cycles.polygons(g, least_edges=5).collect())
    assert cycles.polygons(g, least_edges=100).count() == 0
    key = lambda df: sorted(map(tuple, df.select("cycle_id", "pos", "id").collect()))
    assert key(cycles.cycles(g, max_edges=4)) == key(cycles.cycles(g))  # a component taken by joins has the same cycles


def test_estimates_and_strategies(spark, town):
    assert flows.estimate_centrality_threshold(town, tolerance=0.01) > 0
    assert len(flows.estimate_centrality_time(town, sources=5).split(":")) == 3
    assert set(routing.compare_strategies(town, 3)) == {"kernel", "loop"}


def test_ends_by_coordinates(spark, cross, toy):
    want = as_dict(routing.dists(cross, ["s"], ["n"]))
    assert as_dict(routing.dists(cross, [(0.0001, -9e-4)], [(0.0, 2e-3)])) == want
    assert as_dict(routing.dists(cross, spark.createDataFrame([(0.0001, -9e-4)], "x double, y double"), ["n"])) == want
    assert as_dict(routing.dists(cross, spark.createDataFrame([(0.0, "s")], "x double, id string"), ["n"])) == want
    with pytest.raises(ValueError, match="geographical coordinates"):
        routing.dists(toy, [(0.0, 0.0)])


def test_roles():
    assert column_roles(["from", "to", "dist"]) == {"from_id": "from", "to_id": "to", "d": "dist", "d_weighted": "dist"}
    assert column_roles([".vx0", ".vx1", "d", "w"])["d_weighted"] == "w"
    r = column_roles(["edge_id", "from_id", "from_lon", "from_lat", "to_id", "to_lon", "to_lat", "d", "d_weighted", "time", "time_weighted", "component", "highway"])
    assert r["from_x"] == "from_lon" and r["to_y"] == "to_lat" and r["time_weighted"] == "time_weighted" and r["component"] == "component"
    with pytest.raises(ValueError):
        column_roles(["a", "b"])


def test_weighting_of_ways(spark):
    rows = [
        ("w1", [("a", 0.0, 0.0), ("b", 0.0, 1e-3), ("c", 0.0, 2e-3)], "residential", None, "30 mph", "10", "sand"),
        ("w2", [(None, 0.0, 0.0), (None, 1e-3, 0.0)], "track", "yes", "walk", None, None), ("w3", [("a", 0.0, 0.0), ("z", 1.0, 0.0)], "motorway", None, None, None, None), ("w4", None, "residential", None, None, None, None), ("w5", [("a", 0.0, 0.0)], None, None, None, None, None),
    ]
    ways = spark.createDataFrame(rows, "way_id string, geometry array<struct<id:string,x:double,y:double>>, highway string, oneway string, maxspeed string, lanes string, surface string")
    profile = spark.createDataFrame([("residential", 0.5, 15.0), ("track", 1.0, 12.0), ("motorway", 0.0, None)], "way string, value double, max_speed double")
    g = network.weight_ways(ways, profile, mode="bicycle", surface_table=profiles.surface_speeds(spark))
    out = {(r.way_id, r.from_id, r.to_id): r for r in g.edges.collect()}
    assert len(out) == 5
    r = out["w1", "a", "b"]
    assert r.d == pytest.approx(111.19, rel=1e-3) and r.d_weighted == pytest.approx(r.d / 0.5 * 1.2)
    assert r.time == pytest.approx(r.d / (3 * 1000 / 3600))  # sand
    w2 = next(v for k, v in out.items() if k[0] == "w2")
    assert w2.time == pytest.approx(w2.d / (10 * 1000 / 3600))
    assert g.has("component")
    flat = network.weight_ways(ways.drop("lanes"), 1.0, mode="foot")
    assert all(r.d == r.d_weighted for r in flat.edges.collect())
    rail = network.weight_railway(spark.createDataFrame([("r1", [("a", 0.0, 0.0), ("b", 1.0, 0.0)], "rail"), ("r2", [("a", 0.0, 0.0), ("b", 1.0, 0.0)], "disused")], "way_id string, geometry array<struct<id:string,x:double,y:double>>, railway string"))
    assert rail.edges.count() == 2


def test_weighting_of_tables(spark):
    t = {
        "vertex": spark.createDataFrame([("a", 0.0, 0.0, 0.0), ("b", 0.0, 1e-3, 5.0), ("c", 1e-3, 1e-3, 5.0)], "vertex_ string, x_ double, y_ double, z_ double"),
        "edge": spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "a", "b")], "edge_ string, `.vx0` string, `.vx1` string"),
        "object_link_edge": spark.createDataFrame([("e1", "o1"), ("e2", "o2"), ("e3", "o1")], "edge_ string, object_ string"),
        "object": spark.createDataFrame([("o1", "highway", "residential"), ("o2", "highway", "residential"), ("o2", "oneway", "yes"), ("o2", "oneway:bicycle", "no")], "object_ string, key string, value string"),
        "nodes": spark.createDataFrame([("b", "highway", "traffic_signals")], "vertex_ string, key string, value string"),
    }
    profile = spark.createDataFrame([("residential", 1.0, 15.0)], "way string, value double, max_speed double")
    out = {(r.from_id, r.to_id): r for r in network.weight_tables(t, profile, keep=["oneway:bicycle"], turn_penalty=5.0).edges.collect()}
    lit = {(r.from_id, r.to_id): r for r in network.weight_tables(t, profile, lights=8.0).edges.collect()}
    assert out["b", "c"].oneway_bicycle == "no"
    assert set(out) == {("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")}
    assert out["c", "b"].d_weighted == pytest.approx(2 * out["b", "c"].d_weighted)
    assert lit["b", "a"].time == pytest.approx(out["b", "a"].time + 8) and lit["a", "b"].time == out["a", "b"].time  # who starts at the lights waits
    with pytest.raises(ValueError):
        network.weight_tables({}, profile)
    assert network.expand_box(box=[(1.0, 2.0), (3.0, 4.0)], expand=0.0) == (1.0, 2.0, 3.0, 4.0)
    assert network.expand_box(box=(179.0, 0.0, 180.0, 90.0), expand=0.5) == (178.5, -45.0, -179.5, 90.0)


def test_save_convert_profiles(spark, cross, tmp_path):
    io.save_graph(cross, str(tmp_path / "g"))
    back = io.load_graph(spark, str(tmp_path / "g"))
    assert set(back) == {"graph", "vertices", "graph_c", "vertices_c", "edge_map"}
    assert io.graph_hash(back["graph"]) == io.graph_hash(cross)
    nodes, edges = io.to_vertices_and_edges(cross)
    again = io.from_vertices_and_edges(nodes, edges)
    assert as_dict(routing.dists(again)) == as_dict(routing.dists(cross))
    assert io.to_lines(cross).count() == 8
    assert {r["class"] for r in io.flow_classes(cross.with_edges(cross.edges.withColumn("flow", F.when(F.col("edge_id") == "in_n", 3.0).otherwise(1.0)))).collect()} == {30, 10}
    tables = {"surface_speeds": profiles.surface_speeds(spark), "penalties": profiles.penalties(spark)}
    profiles.write_profiles(tables, str(tmp_path / "p.json"))
    got = profiles.read_profiles(spark, str(tmp_path / "p.json"))
    assert sorted(got["penalties"].collect()) == sorted(tables["penalties"].collect())
    assert profiles.turns_restricted(spark, "motorcar") and not profiles.turns_restricted(spark, "foot")
    assert io.caching(False) is False and io.caching(True) is True


def test_every_query_has_a_name_of_its_own():
    assert set(graph_queries.SQL) <= set(graph_queries.Q)
