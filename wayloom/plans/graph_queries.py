"""The queries of the routing operators, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions import geo
from wayloom.operators import flows, iso, match, routing, structure, turns
from wayloom.plans import fixtures as fx
from wayloom.session import materialize, read
from wayloom.sources import network, profiles

Q: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        Q[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def min_plus(edges: str, w: str = "w", d: str = "d", rounds: int = 4) -> str:
    """Common table expressions e, v and p (f, t, w, d): best routes by squaring, up to 2^rounds edges."""
    parts = [
        f"e as ({edges})", "v as (select f as v from e union select t from e)",
        f"p0 as (select f,t,w,d from (select f,t,w,d,row_number() over (partition by f,t order by w,d) r from (select f,t,{w} w,{d} d from e union "
        "all select v,v,0,0 from v) a) b where r=1)"
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"p{i} as (select f,t,w,d from (select a.f,b.t,a.w+b.w w,a.d+b.d d,row_number() over (partition by a.f,b.t order by a.w+b.w,a.d+b.d) r "
            f"from p{i-1} a join p{i-1} b on a.t=b.f) x where r=1)"
        )
    return "with " + ", ".join(parts) + f", p as (select * from p{rounds})"


def routes(edges: str, hops: int = 8) -> str:
    """Common table expressions e, v and r (f, t, w, d, es, vs): best routes with their edges and vertices, up to ``hops`` edges."""
    parts = [
        f"e as ({edges})", "v as (select f as v from e union select t from e)",
        "r0 as (select v f, v t, cast(0 as double) w, cast(0 as double) d, cast([] as bigint[]) es, [v] vs from v)"
    ]
    for i in range(1, hops + 1):
        parts.append(
            f"r{i} as (select f,t,w,d,es,vs from (select *, row_number() over (partition by f,t order by w,d,len(es)) k from (select * from r{i-1} union all "
            f"select a.f, b.t, a.w+b.w, a.d+b.d, list_append(a.es,b.e), list_append(a.vs,b.t) from r{i-1} a join e b on a.t=b.f) x) y where k=1)"
        )
    return "with " + ", ".join(parts) + f", r as (select * from r{hops})"


ALL_PAIRS = " select a.v from_id, b.v to_id, p.d d from v a cross join v b left join p on p.f=a.v and p.t=b.v"


@query(min_plus(fx.SQL_NATIONS) + ALL_PAIRS)
def dists_all_pairs(spark: SparkSession, d: str) -> DataFrame:
    return routing.dists(fx.nations(spark, d))


@query(min_plus(fx.SQL_NATIONS) + ALL_PAIRS)
def dists_by_joins(spark: SparkSession, d: str) -> DataFrame:
    return routing.dists(fx.nations(spark, d), strategy="loop")


@query(min_plus(fx.SQL_SUPPLIERS) + ALL_PAIRS)
def dists_suppliers(spark: SparkSession, d: str) -> DataFrame:
    return routing.dists(fx.suppliers(spark, d))


@query(min_plus(fx.SQL_NATIONS, w="tw") + ALL_PAIRS)
def dists_fastest(spark: SparkSession, d: str) -> DataFrame:
    return routing.dists(fx.nations(spark, d), shortest=False)


@query(min_plus(fx.SQL_NATIONS, w="tw", d="tm") + ALL_PAIRS.replace("p.d d", "p.d as time"))
def times(spark: SparkSession, d: str) -> DataFrame:
    return routing.times(fx.nations(spark, d))


@query(min_plus(fx.SQL_NATIONS, d="tm") + ALL_PAIRS.replace("p.d d", "p.d as time"))
def times_shortest(spark: SparkSession, d: str) -> DataFrame:
    return routing.times(fx.nations(spark, d), shortest=True)


@query(min_plus(fx.SQL_SUPPLIERS) + " select e.t from_id, e.f to_id, p.d d from e left join p on p.f=e.t and p.t=e.f")
def dists_pairwise(spark: SparkSession, d: str) -> DataFrame:
    g = fx.suppliers(spark, d)
    g = g.with_edges(materialize(g.edges.select("edge_id", "from_id", "to_id", "d", "d_weighted")))
    return routing.dists_pairwise(g, g.edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))


_ASIA = "(select cast(n_nationkey as bigint) n from nation join region on n_regionkey=r_regionkey where r_name='ASIA')"


@query(
    min_plus(fx.SQL_NATIONS) + f" select v from_id, x.t to_id, x.d d from v left join (select f,t,d,row_number() over (partition by f order by w,d,t) k from p where t in {_ASIA}) x on x.f=v and k=1"
)
def dists_nearest(spark: SparkSession, d: str) -> DataFrame:
    targets = read(spark, d, "nation").join(
        read(spark, d, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select("n_nationkey")
    return routing.dists_nearest(fx.nations(spark, d), None, targets)


@query(
    min_plus(fx.SQL_NATIONS) + " select p.f from_id, l.dlim dlim, p.t id, (p.t*7919%1000)/1000.0 x, (p.t*104729%1000)/1000.0 y from p join (values (2000.0::double),(5000.0),(10000.0)) l(dlim) on p.d<=l.dlim and p.d<10000"
)
def isoverts(spark: SparkSession, d: str) -> DataFrame:
    return iso.isoverts(fx.nations(spark, d), None, dlim=[2000, 5000, 10000])


@query()
def isodists(spark: SparkSession, d: str) -> DataFrame:
    return iso.isodists(fx.nations(spark, d), None, [5000, 10000])


@query(
    routes(fx.SQL_NATIONS) + " select a.v from_id, b.v to_id, case when a.v=b.v then cast(a.v as varchar)||'>'||cast(a.v as varchar) else array_to_string(r.vs,'>') end path, r.d d from v a cross join v b left join r on r.f=a.v and r.t=b.v"
)
def paths(spark: SparkSession, d: str) -> DataFrame:
    return routing.paths(fx.nations(spark, d)).select(
        "from_id", "to_id", F.array_join(F.col("vertices").cast("array<string>"), ">").alias("path"), "d"
    )


_STEPS = ", s as (select f,t,d total,len(es) n,unnest(es) x from r)"


@query(routes(fx.SQL_NATIONS) + _STEPS + " select s.f from_id, s.t to_id, e.k category, sum(e.d) d from s join e on e.e=s.x group by 1,2,3")
def categorical_long(spark: SparkSession, d: str) -> DataFrame:
    return routing.dists_categorical(fx.nations(spark, d), "edge_type")


@query(
    routes(fx.SQL_NATIONS) + _STEPS + " select e.k category, sum(e.d) d, round(sum(e.d)/(sum(sum(e.d)) over ()),6) proportion from s join e on e.e=s.x group by 1"
)
def categorical_proportions(spark: SparkSession, d: str) -> DataFrame:
    return routing.categorical_proportions(fx.nations(spark, d), "edge_type").withColumn("proportion", F.round("proportion", 6))


@query(
    routes(fx.SQL_NATIONS) + ", far as (select r.f,r.t,r.es from r join r q on q.f=r.f and q.t=list_extract(r.vs,len(r.vs)-1) where r.d>4000 and q.d<4000 and r.f<>r.t), s as (select f,t,unnest(es) x from far)"
    " select s.f from_id, e.k category, sum(e.d) d from s join e on e.e=s.x group by 1,2"
)
def categorical_within(spark: SparkSession, d: str) -> DataFrame:
    return routing.categorical_within(fx.nations(spark, d), "edge_type", None, 4000.0)


def _flow_table(g) -> DataFrame:
    """A flow for each pair of nations, from their numbers."""
    v = routing.vertex_ids(g)
    pairs = routing.each_target(v, v)
    return pairs.withColumn("flow", ((F.col("from_id") * 7 + F.col("to_id") * 13) % 10 + 1).cast("double"))


_FLOW = "((s.f*7+s.t*13)%10+1)"


@query(
    routes(fx.SQL_NATIONS) + _STEPS + f", g as (select x, sum({_FLOW}::double/n) q from s group by 1) select e.e edge_id, e.f from_id, e.t to_id, round(coalesce(g.q,0),6) flow from e left join g on g.x=e.e"
)
def flows_aggregate(spark: SparkSession, d: str) -> DataFrame:
    g = fx.nations(spark, d)
    return _flow_result(flows.flows_aggregate(g, _flow_table(g)))


def _flow_result(e: DataFrame, name: str = "flow") -> DataFrame:
    return e.select("edge_id", "from_id", "to_id", F.round(name, 6).alias(name))


_SI = ", pull as (select f,t,d,len(es) n,es,(1+t%7)*exp(-d/5000.0) e from r where f<>t), tot as (select f,sum(e) s from pull group by 1), s as (select pull.f,pull.t,n,(1+pull.f%5)*e/tot.s q,unnest(es) x from pull join tot on tot.f=pull.f)"


@query(
    routes(fx.SQL_NATIONS) + _SI + ", g as (select x,sum(q/n) q from s group by 1) select e.e edge_id, e.f from_id, e.t to_id, round(coalesce(g.q,0),6) flow from e left join g on g.x=e.e"
)
def flows_si(spark: SparkSession, d: str) -> DataFrame:
    g = fx.nations(spark, d)
    v = routing.vertex_ids(g)
    return _flow_result(flows.flows_si(g, v.withColumn("n", 1.0 + F.col("id") % 5), v.withColumn("n", 1.0 + F.col("id") % 7), k=5000.0))


@query(
    routes(fx.SQL_NATIONS) + ", one as (select f,t,es[len(es)] x,exp(-d/5000.0) e from r where f<>t), tot as (select f,sum(e) s from one group by 1), g as (select x,sum((1+one.f%5)*e/s) q from one join tot on tot.f=one.f group by 1)"
    " select e.e edge_id, e.f from_id, e.t to_id, round(coalesce(g.q,0),6) flow from e left join g on g.x=e.e"
)
def flows_disperse(spark: SparkSession, d: str) -> DataFrame:
    g = fx.nations(spark, d)
    return _flow_result(flows.flows_disperse(g, routing.vertex_ids(g).withColumn("n", 1.0 + F.col("id") % 5), k=5000.0))


@query(
    routes(fx.SQL_NATIONS) + _STEPS + ", g as (select x,count(*) q from s group by 1) select e.e edge_id, e.f from_id, e.t to_id, cast(coalesce(g.q,0) as double) centrality from e left join g on g.x=e.e"
)
def centrality_edge(spark: SparkSession, d: str) -> DataFrame:
    return _flow_result(flows.centrality(fx.nations(spark, d)), "centrality")


@query(
    routes(fx.SQL_NATIONS) + ", s as (select unnest(vs[2:len(vs)-1]) x from r where len(es)>1), g as (select x,count(*) q from s group by 1) select v id, cast(coalesce(g.q,0) as double) centrality from v left join g on g.x=v"
)
def centrality_vertex(spark: SparkSession, d: str) -> DataFrame:
    return flows.centrality(fx.nations(spark, d), edges=False)


_CHAIN = (
    "with s as (select cast(event_id as bigint) event_id, user_id, event_type, round(coalesce(value,0)*100) d, lead(event_id) over w nxt, "
    "row_number() over w i, count(*) over (partition by user_id) n from events window w as (partition by user_id order by ts,event_id)), "
    "a as (select *, (event_type='purchase' or i=1 or i=n) anchor from s), c as (select *, sum(case when anchor then 1 else 0 end) over (partition "
    "by user_id order by i) seg from a), "
    "g as (select user_id, seg, min_by(event_id,i) from_id, cast(max_by(nxt,i) as bigint) to_id, sum(d) d, count(*) k from c where nxt is not null "
    "group by 1,2)"
)


def _contracted(spark: SparkSession, d: str):
    """The chains of events between purchases, and each user's first and last event."""
    keep = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").cast("bigint").alias("id"))
    g = fx.event_chains(spark, d)
    return g, *structure.contract(g, keep)


@query(_CHAIN + " select from_id, to_id, d from g")
def contract_chain(spark: SparkSession, d: str) -> DataFrame:
    return _contracted(spark, d)[1].edges.select("from_id", "to_id", "d")


@query(
    _CHAIN + " select c.event_id edge_id, g.from_id chain_from, g.to_id chain_to, g.k n_old from c join g on g.user_id is not distinct from c.user_id and g.seg=c.seg where c.nxt is not null"
)
def uncontract_chain(spark: SparkSession, d: str) -> DataFrame:
    g, short, mapped = _contracted(spark, d)
    size = mapped.groupBy(F.col("edge_new").alias("x")).agg(F.count(F.lit(1)).alias("n_old"))
    e = short.edges.join(size, F.col("edge_id").cast("string") == F.col("x")).select(
        *short.edges.columns, F.col("from_id").alias("chain_from"), F.col("to_id").alias("chain_to"), "n_old"
    )
    return structure.uncontract(short.with_edges(e), mapped, g).edges.select("edge_id", "chain_from", "chain_to", "n_old")


@query(
    f"with e as ({fx.SQL_RAW}) select min(ord) ord, f from_id, t to_id, min_by(d,ord) d, min(w) d_weighted, min(tw) time_weighted from e group by f,t"
)
def dedupe_edges(spark: SparkSession, d: str) -> DataFrame:
    return structure.deduplicate(fx.raw_edges(spark, d)).edges


@query(
    f"with e as ({fx.SQL_RAW}) select min(ord) ord, min_by(f,ord) from_id, min_by(t,ord) to_id, sum(d) d from e group by least(f,t),greatest(f,t) "
    "having sum(d)>0"
)
def merge_directed(spark: SparkSession, d: str) -> DataFrame:
    return structure.merge_directed(fx.raw_edges(spark, d), ["d"]).edges.select("ord", "from_id", "to_id", "d")


@query(
    f"with e as ({fx.SQL_RAW}) select id, cast(sum(i) as bigint) n_in, cast(sum(o) as bigint) n_out from (select f id,0 i,1 o from e union all "
    "select t,1,0 from e) x group by 1"
)
def degree(spark: SparkSession, d: str) -> DataFrame:
    return structure.degrees(fx.raw_edges(spark, d))


@query(
    f"with e as ({fx.SQL_RAW}), x as (select f id,ord*2 o from e union all select t,ord*2+1 from e), y as (select id,min(o) o from x group by 1) "
    "select id, row_number() over (order by o)-1 n from y"
)
def vertices(spark: SparkSession, d: str) -> DataFrame:
    return structure.vertices(fx.raw_edges(spark, d), numbered=True)


@query(
    f"with s as ({fx.SQL_STREETS}), x as (select from_id id, edge_id*2 o, from_lon x, from_lat y, component from s union all select to_id, "
    "edge_id*2+1, to_lon, to_lat, component from s)"
    " select id, min_by(x,o) filter (where x is not null and y is not null) x, min_by(y,o) filter (where x is not null and y is not null) y, "
    "min_by(component,o) component from x where id is not null group by 1"
)
def street_vertices(spark: SparkSession, d: str) -> DataFrame:
    return structure.vertices(fx.streets(spark, d)).select("id", "x", "y", "component")


@query(
    f"with s as ({fx.SQL_STREETS}) select min(edge_id) edge_id, from_id, to_id, min_by(d,edge_id) filter (where true) d, min(d_weighted) d_weighted, min(time_weighted) time_weighted from s group by from_id,to_id".replace(
        "min_by(d,edge_id) filter (where true) d", "arg_min_null(d,edge_id) d"
    )
)
def street_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return structure.deduplicate(fx.streets(spark, d)).edges.select("edge_id", "from_id", "to_id", "d", "d_weighted", "time_weighted")


_CONTRACTED = (
    f"with recursive s as ({fx.SQL_STREETS}), n as (select min(edge_id) e, from_id u, to_id v, arg_min_null(d, edge_id) d, min(d_weighted) w from s "
    "where from_id is not null and to_id is not null group by 2, 3), "
    "e as (select * from n where u<>v), i as (select v x, count(*) k, min(u) lo, max(u) hi from e group by 1), o as (select u x, count(*) k, min(v) "
    "lo, max(v) hi from e group by 1), "
    "th as (select i.x from i join o on o.x=i.x where i.k=1 and o.k=1 and i.lo<>o.lo or i.k=2 and o.k=2 and i.lo=o.lo and i.hi=o.hi), "
    "ways as (select th.x, a.e before, b.e e, coalesce(abs(case when a.d>0 then a.w/a.d end-case when b.d>0 then b.w/b.d end)<1e-6, a.w=b.w and "
    "a.d=b.d) even from e a join e b on a.v=b.u and a.u<>b.v join th on th.x=a.v), "
    "li as (select e, before from ways where x not in (select x from ways where even is not true)), "
    "c(head, e, pos) as (select e, e, 0 from e where e not in (select e from li) union all select c.head, li.e, c.pos+1 from c join li on li.before=c.e), "
    "sums as (select c.head, min_by(e.u, c.pos) f, max_by(e.v, c.pos) t, sum(e.d) d, sum(e.w) w from c join e on e.e=c.e group by 1), "
    "best as (select *, row_number() over (partition by f, t order by w nulls first, d nulls first, head) r_ from sums) select f from_id, t to_id, "
    "round(d, 6) d, round(w, 6) d_weighted from best where r_=1"
)


@query(_CONTRACTED)
def street_contract(spark: SparkSession, d: str) -> DataFrame:
    short = structure.contract(fx.streets(spark, d))[0].edges
    return short.select("from_id", "to_id", F.round("d", 6).alias("d"), F.round("d_weighted", 6).alias("d_weighted"))


@query()
def street_lines(spark: SparkSession, d: str) -> DataFrame:
    from wayloom.sources import io

    return io.to_lines(fx.streets(spark, d))


@query()
def street_sample(spark: SparkSession, d: str) -> DataFrame:
    return structure.sample(fx.streets(spark, d), 100, seed=1).edges.select("edge_id", "from_id", "to_id", "d")


@query()
def add_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The nations' graph with the customers joined to it."""
    g = fx.nations(spark, d)
    return match.add_nodes(g, _customers(spark, d), "custkey", "x", "y").edges.select("edge_id", "from_id", "to_id", F.round("d", 3).alias("d"))


@query()
def isochrones(spark: SparkSession, d: str) -> DataFrame:
    return iso.isochrones(fx.nations(spark, d), None, [5000, 10000])


_PV = "v as (select distinct cast(l_suppkey as bigint) id, ((l_suppkey::bigint)*7919%1000)/1000.0 vx, ((l_suppkey::bigint)*104729%1000)/1000.0 vy from lineitem), p as (select cast(c_custkey as bigint) k, ((c_custkey::bigint)*7919%1000)/1000.0 px, ((c_custkey::bigint)*104729%1000)/1000.0 py from customer)"


def _customers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("bigint")
    return read(spark, d, "customer").select(k.alias("custkey"), (k * 7919 % 1000 / 1000.0).alias("x"), (k * 104729 % 1000 / 1000.0).alias("y"))


@query(
    f"with {_PV}, m as (select k,id,(px-vx)*(px-vx)+(py-vy)*(py-vy) d2 from p cross join v) select custkey, id, dist from (select k custkey, id, "
    "round(sqrt(d2),6) dist, row_number() over (partition by k order by d2,id) r from m) x where r=1"
)
def match_points_verts(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("l_suppkey").cast("bigint")
    v = read(spark, d, "lineitem").select(s.alias("id"), (s * 7919 % 1000 / 1000.0).alias("x"), (s * 104729 % 1000 / 1000.0).alias("y")).distinct()
    return match.points_to_vertices(_customers(spark, d), "custkey", "x", "y", v).withColumn("dist", F.round("dist", 6))


@query(
    f"with e as ({fx.SQL_NATIONS}), {_PV}, u as (select "
    "p.k,e,fx,fy,tx,ty,px,py,least(1.0,greatest(0.0,((px-fx)*(tx-fx)+(py-fy)*(ty-fy))/((tx-fx)*(tx-fx)+(ty-fy)*(ty-fy)))) u from p cross join e "
    "where fx<>tx or fy<>ty), "
    "m as (select k, (px-fx-u*(tx-fx))*(px-fx-u*(tx-fx))+(py-fy-u*(ty-fy))*(py-fy-u*(ty-fy)) d2 from u) select k custkey, round(sqrt(min(d2)),6) "
    "dist from m group by 1"
)
def match_points_edges(spark: SparkSession, d: str) -> DataFrame:
    return match.points_to_edges(
        _customers(spark, d), "custkey", "x", "y", fx.nations(spark, d)
    ).select("custkey", F.round(F.abs("d_signed"), 6).alias("dist"))


_HAV = "2*6371000.0*asin(least(1.0,sqrt(pow(sin(radians({y1}-({y0}))/2),2)+cos(radians({y0}))*cos(radians({y1}))*pow(sin(radians({x1}-({x0}))/2),2))))"


@query(
    f"with e as ({fx.SQL_NATIONS}), o as (select f a,t b from e order by e limit 1), m as (select e.*, (f=a and t=b) or (f=b and t=a) hit, (fx+tx)/2 "
    "mx, (fy+ty)/2 my from e cross join o), "
    f"h as (select *, {_HAV.format(x0='fx', y0='fy', x1='mx', y1='my')} d0, {_HAV.format(x0='mx', y0='my', x1='tx', y1='ty')} d1 from m where hit) "
    "select cast(f as varchar) u, cast(t as varchar) v, round(d,4) d, w d_weighted from m where not hit union all select cast(f as varchar), '-1', "
    "round(d0,4), round(w*d0/d) from h union all select '-1', cast(t as varchar), round(d1,4), round(w*d1/d) from h"
)
def insert_vertex(spark: SparkSession, d: str) -> DataFrame:
    g = fx.nations(spark, d)
    first = g.edges.orderBy("edge_id").select("from_id", "to_id").first()
    out = structure.insert_vertex(g, first[0], first[1], new_id="-1")
    return out.edges.select(
        F.col("from_id").cast("string").alias("u"), F.col("to_id").cast("string").alias("v"), F.round("d", 4).alias("d"),
        F.round("d_weighted").alias("d_weighted")
    )


_KMH = "case when lower(trim(maxspeed)) ~ '^walk.*' then 10.0 when regexp_matches(lower(maxspeed),'mph|mi/h|miles') then {n}*1.609344 else {n} end".format(n="try_cast(replace(regexp_extract(lower(maxspeed),'([0-9]+([.,][0-9]+)?)',1),',','.') as double)")


@query(f"select highway, median({_KMH}) speed from graph where highway is not null and ({_KMH}) is not null group by 1")
def maxspeed_median(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "graph").select("highway", network.speed_kmh(F.col("maxspeed")).alias("s")).where("highway is not null and s is not null")
    return g.groupBy("highway").agg(F.percentile("s", F.lit(0.5)).alias("speed"))


@query(
    "select edge_id, d_weighted*cast(case when n>=8 then 1.2 when n>=6 then 1.1 when n>=4 then 1.05 else 1.0 end as double) d_weighted from (select "
    "edge_id, d_weighted, try_cast(regexp_extract(lanes,'^\\s*([0-9]+)',1) as int) n from graph) x"
)
def lane_weights(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "graph").select("edge_id", (F.col("d_weighted") * network.lane_factor(F.col("lanes"))).alias("d_weighted"))


_KIND = "case when lower(trim({c})) in ('pedestrian','footway') then 'path' else lower(trim({c})) end"


@query(
    f"with s as ({fx.SQL_STREETS}), p as (select lower(trim(way)) k, max(value) v, max(max_speed) ms from weighting_profiles where name='pedal' "
    "group by 1 having max(value)>0) "
    f"select edge_id, d/v d_weighted, ms profile_speed from s join p on p.k={_KIND.format(c='highway')}"
)
def profile_weights(spark: SparkSession, d: str) -> DataFrame:
    e = fx.streets(spark, d).edges.drop("d_weighted")
    w = network.weigh(e, profiles.profile(read(spark, d, "weighting_profiles"), "pedal"), F.col("highway"))
    return w.select("edge_id", "d_weighted", "profile_speed")


@query(
    f"with s as ({fx.SQL_STREETS}), j as (select from_id x from s group by 1 having count(distinct edge_id)>=4), i as (select to_id x, edge_id e, "
    "atan2(from_lat-to_lat,from_lon-to_lon) a from s where to_id in (select x from j)), "
    "o as (select from_id x, edge_id e, atan2(to_lat-from_lat,to_lon-from_lon) a from s where from_id in (select x from j)), w as (select i.x "
    "vertex, i.e edge_in, o.e edge_out, case when i.a-o.a<0 then i.a-o.a+2*pi() else i.a-o.a end turn from i join o on o.x=i.x where i.e<>o.e) "
    "select vertex, edge_in, count(*) n_ways, sum(case when k>2 then 1 else 0 end)::bigint n_penalty from (select *, count(*) over (partition by "
    "vertex,edge_in) - row_number() over (partition by vertex,edge_in order by turn,edge_out)+1 k from w) q group by 1,2"
)
def turn_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = turns.turn_pairs(fx.streets(spark, d))
    return pairs.groupBy("vertex", "edge_in").agg(F.count(F.lit(1)).alias("n_ways"), F.sum(F.col("penalty").cast("bigint")).alias("n_penalty"))


@query(
    "with r as (select distinct relation_, lower(trim(value)) like 'only\\_%' escape '\\' as \"only\" from relation_properties where key='restriction' and regexp_matches(lower(trim(value)),'^(no|only)_')), "
    "m as (select distinct * from relation_members where member is not null) select r.relation_, r.\"only\", a.member way_from, b.member via, c.member way_to from r join m a on a.relation_=r.relation_ and a.role='from' and a.type='way' "
    "join m b on b.relation_=r.relation_ and b.role='via' and b.type='node' join m c on c.relation_=r.relation_ and c.role='to' and c.type='way'"
)
def turn_restrictions(spark: SparkSession, d: str) -> DataFrame:
    return turns.turn_restrictions(read(spark, d, "relation_properties"), read(spark, d, "relation_members"))


_RULES = (
    "ru as (select distinct relation_, lower(trim(value)) like 'only\\_%' escape '\\' as only_ from relation_properties where key='restriction' and "
    "regexp_matches(lower(trim(value)),'^(no|only)_')), "
    "mb as (select distinct relation_, member, type, role from relation_members where member is not null), rule as (select distinct ru.only_, "
    "a.member way_from, b.member via, c.member way_to from ru join mb a on a.relation_=ru.relation_ and a.role='from' and a.type='way' "
    "join mb b on b.relation_=ru.relation_ and b.role='via' and b.type='node' join mb c on c.relation_=ru.relation_ and c.role='to' and c.type='way')"
)
_COMPOUND = (
    f"with s as ({fx.SQL_STREETS}), {_RULES}, j as (select from_id x from s where from_id is not null and to_id is not null group by 1 having "
    "count(distinct edge_id)>=4), "
    "t as (select edge_id e, way_id y, from_id f, to_id t, d, time tm, from_lon fx, from_lat fy, to_lon tx, to_lat ty from s where from_id is not "
    "null and to_id is not null), "
    "i as (select t x, e, y, d, tm, f, atan2(fy-ty, fx-tx) a from t where t in (select x from j)), o as (select f x, e, y, d, tm, t, atan2(ty-fy, "
    "tx-fx) a from t where f in (select x from j)), "
    "tp as (select i.x, i.e e_in, o.e e_out, i.y y_in, o.y y_out, i.f, o.t, i.d+o.d d, i.tm+o.tm tm, case when i.a-o.a<0 then i.a-o.a+2*pi() else "
    "i.a-o.a end turn from i join o on o.x=i.x where i.e<>o.e), "
    "tr as (select *, count(*) over (partition by x, e_in)-row_number() over (partition by x, e_in order by turn nulls first, e_out)+1 k from tp), "
    "ok as (select tr.* from tr where not exists (select 1 from rule where not only_ and way_from=y_in and via=x and way_to=y_out) and (not exists "
    "(select 1 from rule where only_ and way_from=y_in and via=x) or exists (select 1 from rule where only_ and way_from=y_in and via=x and "
    "way_to=y_out))), "
    "jj as (select distinct x from ok), q as (select cast(edge_id as varchar) e, from_id f, to_id t, d, time tm from s union all select "
    "'j_'||e_in||'_'||e_out, f, t, d, tm+case when k>2 then 7.5 else 0 end from ok) "
    "select q.e edge_id, case when a.x is null then q.f else q.f||'_start' end from_id, case when b.x is null then q.t else q.t||'_end' end to_id, "
    "q.d, q.tm as time from q left join jj a on a.x=q.f left join jj b on b.x=q.t"
)


def _compound(spark: SparkSession, d: str):
    rules = turns.turn_restrictions(read(spark, d, "relation_properties"), read(spark, d, "relation_members"))
    return turns.compound_junctions(fx.streets(spark, d), 7.5, restrictions=rules, way="way_id")


@query(_COMPOUND)
def compound_junctions(spark: SparkSession, d: str) -> DataFrame:
    return _compound(spark, d)[0].edges.select("edge_id", "from_id", "to_id", "d", "time")


@query(f"select cast(edge_id as varchar) edge_id, from_id, to_id, d from ({fx.SQL_STREETS}) s")
def uncompound(spark: SparkSession, d: str) -> DataFrame:
    """The street table through compound junctions and back."""
    g, named = _compound(spark, d)
    return turns.uncompound(g.with_edges(g.edges.withColumn("load", F.lit(0.0))), named, ["load"]).edges.select("edge_id", "from_id", "to_id", "d")


@query(f"select edge_id, from_id, to_id, d, d_weighted, highway from ({fx.SQL_STREETS}) s")
def save_load(spark: SparkSession, d: str) -> DataFrame:
    from wayloom.session import shared_dir
    from wayloom.sources import io

    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    io.save_graph(fx.streets(spark, d), path, contracted=False)
    return io.load_graph(spark, path)["graph"].edges.select("edge_id", "from_id", "to_id", "d", "d_weighted", "highway")


_TOPS = "(values " + ", ".join(f"('{v}', {float(x)})" for m, v, x in profiles.SURFACES if m == "motorcar") + ") tops(surface, top)"


@query(
    f"with s as ({fx.SQL_STREETS}), p as (select lower(trim(way)) k, max(value) v, max(max_speed) ms from weighting_profiles where name='pedal' "
    "group by 1 having max(value)>0), "
    f"x as (select s.edge_id, s.highway, s.surface, p.ms, {_KMH} tag from s join p on p.k={
        _KIND.format(c='highway')
    }), m as (select highway, median(tag) med from x where tag is not null group by 1) "
    f"select x.edge_id, round(least(coalesce(x.tag, m.med, x.ms), t.top), 6) speed from x left join m on m.highway=x.highway left join {
        _TOPS.replace('tops(', 't(')
    } on t.surface=lower(trim(x.surface))"
)
def street_speeds(spark: SparkSession, d: str) -> DataFrame:
    """Speeds of cars: tags, medians of the kind of way, the profile, and at most what the surface allows."""
    e = network.weigh(fx.streets(spark, d).edges, profiles.profile(read(spark, d, "weighting_profiles"), "pedal"), F.col("highway"))
    out = network.set_speeds(e, "motorcar", "maxspeed", "highway", "surface", profiles.surface_speeds(spark))
    return out.select("edge_id", F.round("speed", 6).alias("speed"))


_TAG = "min(value) filter (where key='{k}')"
_SC = (
    f"with s as ({fx.SQL_STREETS}), v as (select distinct id, x, y from vertex where id is not null and x between -180 and 180 and y between -90 and 90), "
    + "w as (select object_, " + ", ".join(
        f"{_TAG.format(k=k)} {k}" for k in ("highway", "oneway", "maxspeed", "lanes", "junction", "bicycle")
    ) + " from sc_object group by 1), "
    "e as (select cast(s.edge_id as varchar) e, s.from_id f, s.to_id t, " + _HAV.format(
        x0="a.x", y0="a.y", x1="b.x", y1="b.y"
    ) + " d, w.* from s left join v a on a.id=s.from_id left join v b on b.id=s.to_id join w on w.object_=s.way_id "
    "where w.highway is not null and coalesce(lower(w.bicycle)<>'no', true) and not regexp_matches(w.highway, '^(motorway|trunk)')), "
    "p as (select lower(trim(way)) k, max(value) v, max(max_speed) ms from weighting_profiles where name='pedal' group by 1 having max(value)>0), "
    "z as (select e.*, d/p.v*case when try_cast(regexp_extract(lanes,'^\\s*([0-9]+)',1) as int)>=8 then 1.2 when "
    "try_cast(regexp_extract(lanes,'^\\s*([0-9]+)',1) as int)>=6 then 1.1 when try_cast(regexp_extract(lanes,'^\\s*([0-9]+)',1) as int)>=4 then "
    "1.05 else 1.0 end dw, "
    f"case when p.ms is null then null else least({_KMH}, p.ms) end sp from e join p on p.k={_KIND.format(c='highway')}), "
    "one as (select *, row_number() over (partition by f, t order by d nulls first, e) r_ from z), "
    "k as (select *, coalesce(lower(trim(oneway)) in ('yes','y','true','t','1','-1'), false) or coalesce(junction in ('roundabout','circular'), "
    "false) ow from one where r_=1) "
    "select e edge_id, f from_id, t to_id, round(dw, 3) d_weighted, round(d/nullif(sp*1000/3600, 0), 3) as time from k union all select e||'_r', t, "
    "f, round(dw, 3), round(d/nullif(sp*1000/3600, 0), 3) from k where not ow"
)


@query(_SC)
def sc_network(spark: SparkSession, d: str) -> DataFrame:
    """A network of normalised tables: vertices, edges of the street table, their ways, and the ways' tags as they are spelt in lower case."""
    v = read(spark, d, "vertex").where("id is not null and x between -180 and 180 and y between -90 and 90").select(
        F.col("id").alias("vertex_"), F.col("x").alias("x_"), F.col("y").alias("y_")
    )
    s = fx.streets(spark, d).edges
    tables = {
        "vertex": v, "edge": s.select(F.col("edge_id").cast("string").alias("edge_"), F.col("from_id").alias(".vx0"), F.col("to_id").alias(".vx1")),
        "object_link_edge": s.select(
            F.col("edge_id").cast("string").alias("edge_"), F.col("way_id").alias("object_")
        ), "object": read(spark, d, "sc_object").select("object_", "key", "value"),
    }
    g = network.weight_tables(tables, profiles.profile(read(spark, d, "weighting_profiles"), "pedal"), "bicycle")
    return g.edges.select("edge_id", "from_id", "to_id", F.round("d_weighted", 3).alias("d_weighted"), F.round("time", 3).alias("time"))


@query(
    f"with s as ({fx.SQL_STREETS}) select edge_id, round({
        _HAV.format(x0='from_lon', y0='from_lat', x1='to_lon', y1='to_lat')
    },3) metres from s where from_lon is not null and from_lat is not null and to_lon is not null and to_lat is not null"
)
def edge_lengths(spark: SparkSession, d: str) -> DataFrame:
    e = fx.streets(spark, d).edges.where("from_lon is not null and from_lat is not null and to_lon is not null and to_lat is not null")
    return e.select("edge_id", F.round(geo.haversine(F.col("from_lon"), F.col("from_lat"), F.col("to_lon"), F.col("to_lat")), 3).alias("metres"))
