"""Routing on the street table, and its SQL: recursive best routes with one row kept for each source and vertex.

Lengths and weights are taken in whole millimetres, so sums are exact in any order. Sources are the vertices whose id is divisible by 20, searched
against all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.operators import flows, iso, match, routing, structure
from wayloom.plans import fixtures as fx
from wayloom.schema import Graph
from wayloom.session import materialize, read

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def network(spark: SparkSession, d: str) -> Graph:
    """The street table, lengths and weights in whole millimetres."""
    e = fx.streets(spark, d).edges
    return Graph.of(
        e.select(
            "edge_id", "from_id", "to_id", F.round(F.col("d") * 1000).alias("d"), F.round(F.col("d_weighted") * 1000).alias("d_weighted"),
            F.round(F.col("time") * 1000).alias("time"), F.round(
                F.col("time_weighted") * 1000
            ).alias("time_weighted"), "highway", "from_lon", "from_lat", "to_lon", "to_lat",
        ),
        order="edge_id",
    )


def kept(g: Graph, *columns: str) -> Graph:
    """The graph with the named columns only, written once: to find the last deliveries takes a shuffle of the whole table each time it is asked for."""
    return Graph.of(materialize(g.edges.select("edge_id", "from_id", "to_id", *columns)), order="edge_id")


def sources(g: Graph) -> DataFrame:
    return routing.vertex_ids(g).where(F.col("id").cast("bigint") % 20 == 0)


def signals(spark: SparkSession, d: str) -> DataFrame:
    """The vertices at which a turn is restricted."""
    return read(spark, d, "relation_members").where(
        "type = 'node' and role = 'via' and member is not null"
    ).select(F.col("member").alias("id")).distinct()


def _edges(length: str = "d", weight: str = "d_weighted") -> str:
    return (
        f"all_ as (select from_id f, to_id t, round({weight}*1000) w, round({length}*1000) d, edge_id e from ({fx.SQL_STREETS}) s_ where from_id is "
        "not null and to_id is not null), "
        "e as (select * from all_ where w is not null and d is not null and not isnan(w) and not isnan(d)), v as (select f id from all_ union "
        "select t from all_), "
        "src as (select id from v where cast(id as bigint)%20=0), "
        "b as (select f, t, m.w w, m.d d, m.e e from (select f, t, min({'w': w, 'd': d, 'e': e}) m from e group by 1, 2) x)"
    )


_ROUTES = (
    "r(f, v, w, d, h, p, e) using key (f, v) as (select id, id, cast(0 as double), cast(0 as double), cast(0 as bigint), cast('' as varchar), "
    "cast(null as int) from src where id in (select f from b union select t from b) union "
    "select k.f, k.v, k.m.w, k.m.d, k.m.h, k.m.p, k.m.e from (select n.f, n.v, min({'w': n.w, 'd': n.d, 'h': n.h, 'p': n.p, 'e': n.e}) m "
    "from (select r.f, b.t v, r.w+b.w w, r.d+b.d d, r.h+1 h, r.v p, b.e from r join b on b.f=r.v) n group by 1, 2) k left join recurring.r o on "
    "o.f=k.f and o.v=k.v "
    "where o.w is null or (k.m.w, k.m.d, k.m.h, k.m.p) < (o.w, o.d, o.h, o.p))"
)


def best(length: str = "d", weight: str = "d_weighted", more: str = "") -> str:
    """Common table expressions all_, e, v, src, b and r (f, v, w, d, h, p, e): the best routes from each source, with their edges, last vertex and
    last edge.
    """
    return f"with recursive {_edges(length, weight)}, {_ROUTES}{more}"


_TREES = " select f from_id, v to_id, w, d, h hops, nullif(p, '') prev, e edge from r"
_VIA = ", via as (select distinct member id from relation_members where type='node' and role='via' and member is not null)"


def _trees(g: Graph, strategy: str = "auto", **more) -> DataFrame:
    found = routing.trees(g, sources(g), strategy=strategy, **more)
    return found.select(F.col("source").alias("from_id"), F.col("vertex").alias("to_id"), "w", "d", "hops", "prev", "edge")


@query(best() + _TREES)
def street_trees(spark: SparkSession, d: str) -> DataFrame:
    return _trees(network(spark, d))


@query(best() + _TREES)
def street_trees_by_joins(spark: SparkSession, d: str) -> DataFrame:
    return _trees(network(spark, d), "loop")


@query(best("time", "time_weighted") + _TREES)
def street_times(spark: SparkSession, d: str) -> DataFrame:
    return _trees(network(spark, d), weight="time_weighted", length="time")


@query(
    best(more=_VIA) + " select s.id from_id, t.id to_id, case when s.id=t.id then 0 else r.d end d from src s cross join via t left join r on r.f=s.id and r.v=t.id"
)
def street_dists(spark: SparkSession, d: str) -> DataFrame:
    g = kept(network(spark, d), "d", "d_weighted")
    return routing.dists(g, sources(g), signals(spark, d))


@query(
    best(more=_VIA) + " select s.id from_id, m.v to_id, m.d d from src s left join (select f, min({'w': w, 'd': d, 'v': v}) m from r where v in (select id from via) group by 1) x on x.f=s.id"
)
def street_nearest(spark: SparkSession, d: str) -> DataFrame:
    g = network(spark, d)
    return routing.dists_nearest(g, sources(g), signals(spark, d))


@query(
    best() + " select x.f from_id, x.t to_id, r.d from (select distinct s.id f, e.f t from src s join all_ e on e.t=s.id) x left join r on r.f=x.f and r.v=x.t"
)
def street_pairwise(spark: SparkSession, d: str) -> DataFrame:
    """From each source to the starts of the edges that end there."""
    g = network(spark, d)
    back = g.edges.select(
        F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")
    ).where("from_id is not null and to_id is not null").distinct()
    return routing.dists_pairwise(g, back.where(F.col("from_id").cast("bigint") % 20 == 0))


_WALK = ", walk(f, t, z, e, h, d) as (select f, v, p, e, h, d from r where h>0{only} union all select w.f, w.t, r.p, r.e, w.h, w.d from walk w join r on r.f=w.f and r.v=w.z where r.h>0)"


@query(
    best(
        more=_VIA + _WALK.format(only=" and v in (select id from via)")
    ) + " select f from_id, t to_id, cast(count(*) as bigint) n_edges, cast(sum(e) as bigint) edge_sum, max(d) d from walk group by 1, 2"
)
def street_paths(spark: SparkSession, d: str) -> DataFrame:
    g = network(spark, d)
    routes = routing.paths(g, sources(g), signals(spark, d), unreached=False).where("edges is not null")
    steps = F.aggregate("edges", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return routes.select("from_id", "to_id", F.size("edges").cast("bigint").alias("n_edges"), steps.alias("edge_sum"), "d")


@query(
    best(more=_WALK.format(only="")) + ", q as (select e, sum(cast(t as bigint)%7+1) flow from walk group by 1)"
    " select s.edge_id, cast(coalesce(q.flow, 0) as double) flow from (" + fx.SQL_STREETS + ") s left join q on q.e=s.edge_id"
)
def street_flows(spark: SparkSession, d: str) -> DataFrame:
    """From each source to all vertices it reaches, more to some than to others."""
    g = kept(network(spark, d), "d", "d_weighted")
    pairs = routing.trees(g, sources(g)).where("hops > 0").select(F.col("source").alias("from_id"), F.col("vertex").alias("to_id"))
    table = pairs.withColumn("flow", (F.col("to_id").cast("bigint") % 7 + 1).cast("double"))
    return flows.flows_aggregate(g, table, norm_sums=False, pairwise=True).select("edge_id", "flow")


_UNIQUE = "(round(d_weighted*1000)*4096+edge_id%4096)/1000"


@query(
    best(
        weight=_UNIQUE, more=_WALK.format(only="")
    ) + ", q as (select z, count(*) n from walk where z<>f group by 1) select v.id, cast(coalesce(q.n, 0) as double) centrality from v left join q on q.z=v.id"
)
def street_centrality(spark: SparkSession, d: str) -> DataFrame:
    """The part of the sources in the betweenness of each vertex; weights made unique, as SQL follows one of equal routes only."""
    g = network(spark, d)
    g = g.with_edges(g.edges.withColumn("d_weighted", F.col("d_weighted") * 4096 + F.col("edge_id") % 4096))
    return flows.centrality(g, edges=False, vertex_weights=sources(g).withColumn("n", F.lit(1.0)))


_TURNS = (
    f"s as ({fx.SQL_STREETS}), j as (select from_id x from s where from_id is not null and to_id is not null group by 1 having count(distinct edge_id)>=4), "
    "t as (select edge_id e, from_id f, to_id t, round(time*1000) d, round(time_weighted*1000) w, from_lon fx, from_lat fy, to_lon tx, to_lat ty "
    "from s where from_id is not null and to_id is not null), "
    "i as (select t x, e, d, w, f, atan2(fy-ty, fx-tx) a from t where t in (select x from j)), o as (select f x, e, d, w, t, atan2(ty-fy, tx-fx) a "
    "from t where f in (select x from j)), "
    "tp as (select i.x, i.e e_in, o.e e_out, i.f, o.t, i.d+o.d d, i.w+o.w w, case when i.a-o.a<0 then i.a-o.a+2*pi() else i.a-o.a end turn from i "
    "join o on o.x=i.x where i.e<>o.e), "
    "tr as (select *, count(*) over (partition by x, e_in)-row_number() over (partition by x, e_in order by turn nulls first, e_out)+1 k from tp), "
    "st as (select x, x||'_start' y from j), en as (select x, x||'_end' y from j), "
    "cmp as (select coalesce(st.y, q.f) f, coalesce(en.y, q.t) t, w, d, e from (select f, t, w, d, cast(e as varchar) e from t union all "
    "select f, t, w+case when k>2 then 7500 else 0 end, d+case when k>2 then 7500 else 0 end, 'j_'||e_in||'_'||e_out from tr) q left join st on "
    "st.x=q.f left join en on en.x=q.t)"
)
_TURNED = (
    "with recursive " + _TURNS + ", b as (select f, t, m.w w, m.d d from (select f, t, min({'w': w, 'd': d}) m from cmp where w is not null and d is not null and not isnan(w) and not isnan(d) group by 1, 2) z), "
    "v as (select from_id id from s where from_id is not null union select to_id from s where to_id is not null), src as (select v.id, "
    "coalesce(st.y, v.id) y from v left join st on st.x=v.id where cast(v.id as bigint)%20=0), "
    "r(f, v, w, d) using key (f, v) as (select y, y, cast(0 as double), cast(0 as double) from src union select k.f, k.v, k.m.w, k.m.d from (select "
    "r.f, b.t v, min({'w': r.w+b.w, 'd': r.d+b.d}) m from r join b on b.f=r.v group by 1, 2) k "
    "left join recurring.r o on o.f=k.f and o.v=k.v where o.w is null or (k.m.w, k.m.d)<(o.w, o.d))" + _VIA + ", vt as (select via.id, coalesce(en.y, via.id) y from via left join en on en.x=via.id) "
    "select src.id from_id, vt.id to_id, case when src.id=vt.id then 0 else r.d end as time from src cross join vt left join r on r.f=src.y and r.v=vt.y"
)


@query(_TURNED)
def street_turn_times(spark: SparkSession, d: str) -> DataFrame:
    """Times of the fastest routes, with 7.5 seconds for each turn across the traffic."""
    g = kept(network(spark, d), "d", "time", "time_weighted", "from_lon", "from_lat", "to_lon", "to_lat")
    g = Graph.of(g.edges, order="edge_id", turn_penalty=7500.0)
    return routing.times(g, sources(g), signals(spark, d))


_PLACE = (
    ", ends_ as (select from_id id, edge_id*2 o, from_lon x, from_lat y from (" + fx.SQL_STREETS + ") a union all select to_id, edge_id*2+1, to_lon, to_lat from (" + fx.SQL_STREETS + ") a), "
    "at_ as (select id, min_by(x, o) filter (where x is not null and y is not null) x, min_by(y, o) filter (where x is not null and y is not null) "
    "y from ends_ group by 1)"
)


@query(
    best(more=_PLACE) + " select r.f from_id, l.dlim, r.v id, at_.x, at_.y from r join (values (cast(500000 as double)), (1000000), (2000000)) l(dlim) on r.d<=l.dlim and r.d<2000000 join at_ on at_.id=r.v"
)
def street_isoverts(spark: SparkSession, d: str) -> DataFrame:
    g = kept(network(spark, d), "d", "d_weighted", "from_lon", "from_lat", "to_lon", "to_lat")
    return iso.isoverts(g, sources(g), dlim=[500_000, 1_000_000, 2_000_000])


_LABELS = (
    f"with recursive s as ({fx.SQL_STREETS}), n as (select from_id a, to_id b from s where from_id is not null and to_id is not null union select "
    "to_id, from_id from s where from_id is not null and to_id is not null), "
    "l(id, label) using key (id) as (select a, a from n union select k.id, k.label from (select n.b id, min(l.label) label from l join n on "
    "n.a=l.id group by 1) k left join recurring.l o on o.id=k.id where k.label<o.label)"
)


@query(
    _LABELS + ", k as (select label, row_number() over (order by count(*) desc, label) c from s join l on l.id=s.from_id where s.to_id is not null group by 1) select s.edge_id, cast(k.c as int) component from s left join l on l.id=s.from_id and s.to_id is not null left join k on k.label=l.label"
)
def street_components(spark: SparkSession, d: str) -> DataFrame:
    return structure.components(fx.streets(spark, d)).edges.select("edge_id", "component")


@query(
    _LABELS + ", m as (select distinct least(from_id,to_id) a, greatest(from_id,to_id) b from s where from_id is not null and to_id is not null), nv as (select label, count(distinct id) n from l group by 1), ne as (select label, count(*) filter (where a<>b) n from m join l on l.id=m.a group by 1) select nv.label component, nv.n n_vertices, ne.n n_edges, ne.n-nv.n+1 as rank from nv join ne on ne.label=nv.label"
)
def street_cycle_rank(spark: SparkSession, d: str) -> DataFrame:
    from wayloom.operators import cycles

    return cycles.cycle_rank(fx.streets(spark, d))


_POINTS = "p as (select distinct cast(edge_id as bigint) k, from_lon+((edge_id*7919)%1000-500)/1e6 px, from_lat+((edge_id*104729)%1000-500)/1e6 py from graph where edge_id%20=0 and from_lon is not null and from_lat is not null and not isnan(from_lon) and not isnan(from_lat))"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Places a little beside the starts of the edges whose id is divisible by 20, matched against all of the network."""
    k = F.col("edge_id").cast("bigint")
    g = read(spark, d, "graph").where(
        "edge_id % 20 = 0 and from_lon is not null and from_lat is not null and not isnan(from_lon) and not isnan(from_lat)"
    )
    return g.select(
        k.alias("k"), (F.col("from_lon") + ((k * 7919) % 1000 - 500) / 1e6).alias("px"),
        (F.col("from_lat") + ((k * 104729) % 1000 - 500) / 1e6).alias("py")
    ).distinct()


@query(
    f"with {_POINTS}, v as (select distinct id, x, y from vertex where id is not null and x is not null and y is not null and not isnan(x) and not isnan(y)), "
    "m as (select k, min({'d': (px-x)*(px-x)+(py-y)*(py-y), 'id': id}) m from p join v on abs(px-x)<=0.05 and abs(py-y)<=0.05 group by 1) select k, "
    "m.id id, round(sqrt(m.d), 9) dist from m"
)
def street_match_vertices(spark: SparkSession, d: str) -> DataFrame:
    """All of the points have a vertex within the SQL's box: that of their own edge."""
    v = read(spark, d, "vertex").select("id", "x", "y")
    return match.points_to_vertices(points(spark, d), "k", "px", "py", v).withColumn("dist", F.round("dist", 9))


@query(
    f"with {_POINTS}, s as (select edge_id e, (from_lon, from_lat) > (to_lon, to_lat) back, from_lon a1, from_lat b1, to_lon a2, to_lat b2 from "
    f"({fx.SQL_STREETS}) q where from_lon is not null and from_lat is not null and to_lon is not null and to_lat is not null and (from_lon<>to_lon "
    "or from_lat<>to_lat)), "
    "o as (select e, case when back then -1 else 1 end way, case when back then a2 else a1 end fx, case when back then b2 else b1 end fy, case when "
    "back then a1 else a2 end tx, case when back then b1 else b2 end ty from s), "
    "u as (select k, e, way, fx, fy, tx, ty, px, py, least(1.0, greatest(0.0, ((px-fx)*(tx-fx)+(py-fy)*(ty-fy))/((tx-fx)*(tx-fx)+(ty-fy)*(ty-fy)))) "
    "u from p join o on px between least(fx,tx)-0.05 and greatest(fx,tx)+0.05 and py between least(fy,ty)-0.05 and greatest(fy,ty)+0.05), "
    "z as (select k, e, (px-fx-u*(tx-fx))*(px-fx-u*(tx-fx))+(py-fy-u*(ty-fy))*(py-fy-u*(ty-fy)) d2, way*sign((tx-fx)*(py-fy)-(ty-fy)*(px-fx)) side, "
    "fx+u*(tx-fx) qx, fy+u*(ty-fy) qy from u), "
    "m as (select k, min({'d': d2, 'e': e, 's': side, 'x': qx, 'y': qy}) m from z group by 1) select k, m.e edge, round(-m.s*sqrt(m.d), 9) "
    "d_signed, round(m.x, 7) x, round(m.y, 7) y from m"
)
def street_match_edges(spark: SparkSession, d: str) -> DataFrame:
    got = match.points_to_edges(points(spark, d), "k", "px", "py", fx.streets(spark, d))
    return got.select("k", "edge", F.round("d_signed", 9).alias("d_signed"), F.round("x", 7).alias("x"), F.round("y", 7).alias("y"))


_CYCLES = (
    _LABELS + ", roots as (select distinct label from l), m as (select distinct least(a, b) a, greatest(a, b) b from n where a<>b), "
    "dep(id, d) using key (id) as (select label, 0 from roots union select k.id, k.d from (select n.b id, min(dep.d)+1 d from dep join n on "
    "n.a=dep.id group by 1) k left join recurring.dep o on o.id=k.id where o.d is null or k.d<o.d), "
    "par as (select x.id, min(n.a) p, min(x.d) d from dep x join n on n.b=x.id join dep y on y.id=n.a and y.d=x.d-1 group by 1 union all select "
    "label, null, 0 from roots), "
    "ch as (select m.a u, m.b v from m join par x on x.id=m.a join par y on y.id=m.b where coalesce(x.p<>m.b, true) and coalesce(y.p<>m.a, true)), "
    "c(u, v, a, b) as (select u, v, u, v from ch union all select c.u, c.v, case when x.d>=y.d then x.p else c.a end, case when y.d>=x.d then y.p "
    "else c.b end from c join par x on x.id=c.a join par y on y.id=c.b where c.a<>c.b), "
    "z as (select u, v, a id from c union select u, v, b from c) "
    "select cast(count(*) as bigint) n, min(id) least, max(id) greatest, cast(sum(cast(id as bigint)) as bigint) id_sum from z group by u, v"
)


def _rings(spark: SparkSession, d: str, **more) -> DataFrame:
    from wayloom.operators import cycles

    ids = F.col("id").cast("bigint")
    found = cycles.cycles(fx.streets(spark, d), **more)
    return found.groupBy("cycle_id").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("least"), F.max("id").alias("greatest"), F.sum(ids).alias("id_sum")
    ).drop("cycle_id")


@query(_CYCLES)
def street_cycles(spark: SparkSession, d: str) -> DataFrame:
    return _rings(spark, d)


@query(_CYCLES)
def street_cycles_by_joins(spark: SparkSession, d: str) -> DataFrame:
    """The same with all but the smallest components taken by joins."""
    return _rings(spark, d, max_edges=50)
