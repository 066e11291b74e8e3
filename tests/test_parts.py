"""Routing by parts of the graph against the kernel, which holds all of it."""

import random

import pytest
from pyspark.sql import functions as F

from wayloom import session
from wayloom.operators import flows, parts, routing, structure
from wayloom.schema import Graph

EDGE = "edge_id long, from_id string, to_id string, d double, d_weighted double"
rows = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def towns(spark):
    """Components of several sizes with ties, parallel edges and loops, and a vertex that only has an edge without a weight."""
    rng, out = random.Random(5), []
    for town in range(6):
        for _ in range(6 + 8 * town):
            a, b = (f"{town}v{rng.randrange(4 + town):02d}" for _ in "ab")
            out.append((len(out), a, b, float(rng.randrange(1, 6)), float(rng.randrange(1, 6))))
    return Graph.of(spark.createDataFrame([*out, (9999, "0v00", "alone", 1.0, None)], EDGE))


@pytest.fixture(params=[20])
def size(request, monkeypatch):
    """Edges of a part: some components are larger, the others are put together."""
    monkeypatch.setattr(parts, "PART_EDGES", request.param)


def test_trees_by_parts(towns, size):
    for limit in (None, 6.0):
        assert rows(routing.trees(towns, limit=limit, strategy="parts")) == rows(routing.trees(towns, limit=limit, strategy="kernel"))


def test_centrality_by_parts(spark, towns, size):
    weights = spark.createDataFrame([("5v01", 2.0), ("3v00", 1.0), ("alone", 1.0), ("nix", 1.0)], "id string, n double")
    for edges in (True, False):
        for n in (None, weights):
            ask = lambda s: {r[0]: round(r["centrality"], 9) for r in flows.centrality(towns, edges, vertex_weights=n, strategy=s).collect()}  # noqa: B023, E731
            assert ask("parts") == ask("kernel")


def test_centrality_of_a_graph_beyond_the_bound(towns, monkeypatch):
    want = rows(flows.centrality(towns, edges=False))
    n = towns.edges.count()
    monkeypatch.setattr(routing, "KERNEL_EDGES", n - 1)
    assert rows(flows.centrality(towns, edges=False)) == want
    monkeypatch.setattr(routing, "KERNEL_EDGES", 3)
    with pytest.raises(ValueError, match="components"):
        flows.centrality(towns)


def test_flows_by_parts(spark, towns, size):
    v = routing.vertex_ids(towns)
    table = routing.each_target(v, v).withColumn("flow", F.lit(2.0))
    ask = lambda s: {r.edge_id: round(r.flow, 9) for r in flows.flows_aggregate(towns, table, strategy=s).collect()}
    assert ask("parts") == ask("kernel")


def test_dists_by_parts(spark, towns, size, monkeypatch):
    ends = spark.createDataFrame([("5v01",), ("5v02",), ("3v00",), ("0v00",), ("alone",), ("nix",)], "id string")
    for a, b in ((None, None), (None, ends), (ends, None), (ends, ends.limit(3))):
        assert rows(routing.dists(towns, a, b, strategy="parts")) == rows(routing.dists(towns, a, b, strategy="kernel"))
    want = rows(routing.dists(towns, None, ends, strategy="kernel"))
    monkeypatch.setattr(routing, "KERNEL_TARGETS", 2)
    assert rows(routing.dists(towns, None, ends, strategy="parts")) == want


def test_nearest_by_parts(spark, towns, size):
    ends = spark.createDataFrame([("5v01",), ("5v02",), ("3v00",), ("0v00",), ("alone",), ("nix",)], "id string")
    for a, b in ((None, ends), (ends, ends), (ends, None)):
        assert rows(routing.dists_nearest(towns, a, b, strategy="parts")) == rows(routing.dists_nearest(towns, a, b, strategy="kernel"))


def test_pairs_and_paths_by_parts(spark, towns, size):
    v = routing.vertex_ids(towns)
    pairs = routing.each_target(v, v).union(spark.createDataFrame([("nix", "nix"), ("nix", "5v01"), ("5v01", "nix"), (None, "5v01")], "a string, b string"))
    ask = lambda s: [rows(routing.dists_pairwise(towns, pairs, strategy=s)), rows(routing.paths(towns, pairs=pairs, strategy=s)), rows(routing.paths(towns, strategy=s))]
    assert ask("parts") == ask("kernel")
    ends = v.union(spark.createDataFrame([("nix",)], "id string"))
    for more in ({"pairs": pairs}, {"from_ids": ends, "to_ids": ends}):
        want = [r for r in rows(routing.paths(towns, strategy="kernel", **more)) if "vertices=None" not in r]
        for s in ("kernel", "parts", "loop"):
            assert rows(routing.paths(towns, strategy=s, unreached=False, **more)) == want


def test_turns_by_parts(spark, monkeypatch):
    """Compound junctions are in the parts of their plain vertices."""
    at = [(x, y) for x in range(3) for y in range(3)]
    out = []
    for town in range(3):
        for x, y in at:
            for u, v in ((x + 1, y), (x, y + 1), (x - 1, y), (x, y - 1)):
                if (u, v) in at:
                    w = 1.0 + (3 * x + 5 * y + u) % 4
                    out.append((len(out), f"{town}{x}{y}", float(x), float(y), f"{town}{u}{v}", float(u), float(v), w, w, w, w))
    e = spark.createDataFrame(out, "edge_id long, from_id string, from_lon double, from_lat double, to_id string, to_lon double, to_lat double, d double, d_weighted double, time double, time_weighted double")
    g = Graph.of(e, turn_penalty=5.0)
    monkeypatch.setattr(parts, "PART_EDGES", 50)
    ids = spark.createDataFrame([("000",), ("011",), ("111",), ("222",), ("nix",)], "id string")
    for a, b in ((None, None), (ids, None), (None, ids)):
        assert rows(routing.times(g, a, b, strategy="parts")) == rows(routing.times(g, a, b, strategy="kernel"))


def test_components_in_a_task(spark, monkeypatch):
    """The labels that one task finds are those of the rounds of joins; ids of several kinds, loops and repeated pairs."""
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(7, 7), (400, 400), (None, 5)]
    for kind in ("long", "string"):
        frame = spark.createDataFrame([tuple(str(x) if kind == "string" and x is not None else x for x in p) for p in pairs], f"a {kind}, b {kind}")
        ask = lambda most: monkeypatch.setattr(structure, "TASK_PAIRS", most) or rows(structure.component_labels(frame))  # noqa: B023, E731
        written = []
        monkeypatch.setattr(structure, "materialize", lambda df: written.append(df) or session.materialize(df))
        in_a_task = ask(5_000_000)
        assert len(written) == 1  # one table, not two a round
        assert in_a_task == ask(0)
    assert rows(structure.component_labels(frame.limit(0))) == []


def test_kept_graph_is_written_once(spark, tmp_path):
    """What a query asks for several times doesn't look for the last deliveries each time."""
    from datetime import datetime

    from wayloom.plans import street_queries as sq

    e = [(k, "20", "21", 1.0, 2.0 + k, 3.0, 4.0, "road", 0.0, 0.0, 1.0, 1.0, datetime(2025, 1, 1 + n)) for k in (1, 2) for n in (0, 1)]
    spark.createDataFrame(
        e, "edge_id int, from_id string, to_id string, d double, d_weighted double, time double, time_weighted double, highway string, from_lon double, from_lat double, to_lon double, to_lat double, loaded_at timestamp"
    ).write.parquet(f"{tmp_path}/graph.parquet")
    g = sq.kept(sq.network(spark, str(tmp_path)), "d", "d_weighted")
    assert "Aggregate" not in g.edges._jdf.queryExecution().toString()
    assert rows(g.edges) == rows(sq.network(spark, str(tmp_path)).edges.select(*g.edges.columns)) and g.edges.count() == 2


def test_components_of_the_forest(spark, monkeypatch):
    """Before pairs are shuffled, each task keeps only as many as connect their vertices, with the same components."""
    rng = random.Random(7)
    pairs = [(10 * (k % 3) + rng.randrange(10), 10 * (k % 3) + rng.randrange(10)) for k in range(400)] + [(70, 71), (72, 72)]
    frame = spark.createDataFrame(pairs, "lo long, hi long").coalesce(1)
    assert structure._forest(frame).count() == 33  # a pair for each vertex
    monkeypatch.setattr(structure, "FOREST_PAIRS", 50)
    labels = {r.id: r.label for r in structure.component_labels(frame.toDF("a", "b")).collect()}
    assert labels == {v: 10 * (v // 10) for v in range(30)} | {70: 70, 71: 70, 72: 72}


def test_written_edges_are_not_written_again(spark, towns, monkeypatch):
    """The pairs of suppliers take a window over all lines: they are asked for once, and written once."""
    kept = towns.with_edges(session.materialize(towns.edges))
    want, written = rows(routing.prepared(towns)[0]), []
    monkeypatch.setattr(routing, "materialize", lambda df: written.append(df) or session.materialize(df))
    assert rows(routing.prepared(kept)[0]) == want and not written


def test_pairs_of_equal_lines(spark, tmp_path):
    """Lines that differ in part and price only give the same pairs in any order."""
    from wayloom.plans import fixtures as fx

    lines = [(1, 1, 5, 2.0, 9, 1.0), (1, 1, 5, 2.0, 3, 7.0), (1, 1, 6, 4.0, 1, 1.0), (1, 2, 5, 8.0, 1, 1.0), (2, 1, 6, 1.0, 1, 1.0), (2, 1, 5, 3.0, 1, 1.0)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_linenumber int, l_suppkey long, l_quantity double, l_partkey long, l_extendedprice double"
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    pairs = fx._supplier_pairs(spark, str(tmp_path))
    assert sorted(map(tuple, pairs.collect())) == [(5, 6, 5), (6, 5, 4)]
    assert "l_extendedprice:" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_turn_times_look_for_the_last_deliveries_once(spark, tmp_path, monkeypatch):
    """The compound graph is made of a table that is written, of the columns that it needs."""
    from wayloom.plans import street_queries as sq

    class Seen(Exception):
        pass

    def seen(g, *_):
        assert "loaded_at" not in g.edges._jdf.queryExecution().optimizedPlan().toString() and "highway" not in g.edges.columns
        raise Seen

    spark.createDataFrame(
        [], "edge_id int, from_id string, to_id string, d double, d_weighted double, time double, time_weighted double, highway string, from_lon double, from_lat double, to_lon double, to_lat double, loaded_at timestamp"
    ).write.parquet(f"{tmp_path}/graph.parquet")
    monkeypatch.setattr(sq.routing, "times", seen)
    monkeypatch.setattr(sq, "signals", lambda *_: None)
    with pytest.raises(Seen):
        sq.street_turn_times(spark, str(tmp_path))


def test_loop_over_regions(spark, towns, monkeypatch):
    """Rounds over regions: components whole in one, which no round rewrites, and cut into several, whose borders are crossed again and again."""
    ends = spark.createDataFrame([("5v01",), ("4v03",), ("0v00",), ("nix",)], "id string")
    asks = [{"sources": ends}, {"limit": 6.0}]
    want = [rows(routing.trees(towns, strategy="kernel", **more)) for more in asks]
    written, counted = [], lambda df: written.append(df) or session.materialize(df)
    monkeypatch.setattr(routing, "materialize", counted)
    assert rows(routing.trees(towns, strategy="loop", **asks[0])) == want[0] and len(written) == 1  # the edges, and no round's labels
    monkeypatch.setattr(parts, "PART_EDGES", 10)
    monkeypatch.setattr(parts, "REGION_EDGES", 20)
    for more, found in zip(asks, want):
        assert rows(routing.trees(towns, strategy="loop", **more)) == found


def test_pairs_are_written_by_even_tasks(spark, towns, monkeypatch):
    """One part holds all of a large component; its sources' pairs are written by many tasks all the same."""
    monkeypatch.setattr(routing, "TASK_PAIRS", 100)
    found = routing.dists(towns, strategy="parts")
    each = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(each) > 12 and max(each) < sum(each) / 6


def test_street_dists_look_for_the_last_deliveries_once(spark, tmp_path, monkeypatch):
    from wayloom.plans import street_queries as sq

    class Seen(Exception):
        pass

    def seen(g, start, _):
        assert all("loaded_at" not in f._jdf.queryExecution().optimizedPlan().toString() for f in (g.edges, start))
        raise Seen

    spark.createDataFrame(
        [], "edge_id int, from_id string, to_id string, d double, d_weighted double, time double, time_weighted double, highway string, from_lon double, from_lat double, to_lon double, to_lat double, loaded_at timestamp"
    ).write.parquet(f"{tmp_path}/graph.parquet")
    monkeypatch.setattr(sq.routing, "dists", seen)
    monkeypatch.setattr(sq, "signals", lambda *_: None)
    with pytest.raises(Seen):
        sq.street_dists(spark, str(tmp_path))
