"""Graphs made of the driver's tables, as frames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.schema import Graph
from wayloom.session import read


def _weight(f, t, d, a=7919, b=104729):
    """The weight that makes shortest routes unique; on columns or, as text, in SQL."""
    first, second = (f, t) if a == 7919 else (t, f)
    return (1 + (f * a + t * b + d) % 9973) * 1000000 + (first * first * 7307 + second * second * 9109 + first * second * 1013 + first * 31) % 999983


_W = "(1+(f*7919+t*104729+d)%9973)*1000000+(f*f*7307+t*t*9109+f*t*1013+f*31)%999983"
_TW = "(1+(f*104729+t*7919+d)%9973)*1000000+(t*t*7307+f*f*9109+f*t*1013+t*31)%999983"
_X, _Y = "(({v})*7919%1000)/1000.0", "(({v})*104729%1000)/1000.0"

SQL_DRESS = (
    f"select f,t,cast(d as double) d, cast({_W} as double) w, cast(2*d+1 as double) tm, cast({_TW} as double) tw, 'k'||cast((f+t)%3 as varchar) k, "
    "f*1000000+t e, "
    f"cast({_X.format(v='f')} as double) fx, cast({_Y.format(v='f')} as double) fy, cast({_X.format(v='t')} as double) tx, cast({_Y.format(v='t')} "
    "as double) ty from "
)
SQL_NATIONS = SQL_DRESS + (
    "(select cast(c_nationkey as bigint) f, cast(s_nationkey as bigint) t, cast(sum(l_quantity) as bigint) d from lineitem join orders on "
    "l_orderkey=o_orderkey join customer on o_custkey=c_custkey "
    "join supplier on l_suppkey=s_suppkey where c_nationkey<>s_nationkey group by 1,2) b0"
)
_LEADS = (
    "select cast(l_suppkey as bigint) f, cast(lead(l_suppkey) over (partition by l_orderkey order by "
    "l_linenumber,l_suppkey,l_quantity,l_partkey,l_extendedprice) as bigint) t, l_quantity q, "
    "row_number() over (order by l_orderkey,l_linenumber,l_suppkey,l_quantity,l_partkey,l_extendedprice) ord from lineitem"
)
SQL_SUPPLIERS = SQL_DRESS + f"(select f,t,cast(sum(q) as bigint) d from ({_LEADS}) x where t is not null and f<>t group by 1,2) b0"
SQL_RAW = f"select f,t,ord,cast(q as double) d, cast(q*((f*31+t*17+ord)%7+1) as double) w, cast(q*((f*13+t*29+ord)%5+1) as double) tw from ({_LEADS}) x where t is not null and f<>t"


def _dress(e: DataFrame) -> Graph:
    f, t, d = F.col("f"), F.col("t"), F.col("d")
    at = lambda v, k: F.try_mod(v * k, F.lit(1000)) / 1000.0
    return Graph.of(
        e.select(
            (f * 1000000 + t).alias("edge_id"), f.alias("from_id"), t.alias("to_id"), d.cast("double").alias("d"), _weight(f, t, d).cast("double").alias("d_weighted"), (2 * d + 1).cast("double").alias("time"),
            _weight(f, t, d, 104729, 7919).cast("double").alias("time_weighted"), F.concat(
                F.lit("k"), ((f + t) % 3).cast("string")
            ).alias("edge_type"), at(f, 7919).alias("from_lon"), at(f, 104729).alias("from_lat"), at(t, 7919).alias("to_lon"), at(t, 104729).alias("to_lat"),
        )
    )


def nations(spark: SparkSession, d: str) -> Graph:
    line = read(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders, customer, supplier = read(spark, d, "orders").select("o_orderkey", "o_custkey"), read(spark, d, "customer").select(
        "c_custkey", "c_nationkey"
    ), read(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    joined = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey")
    )
    pairs = joined.where("c_nationkey <> s_nationkey").groupBy(
        F.col("c_nationkey").cast("bigint").alias("f"), F.col("s_nationkey").cast("bigint").alias("t")
    )
    return _dress(pairs.agg(F.sum("l_quantity").cast("bigint").alias("d")))


_LINES = ["l_linenumber", "l_suppkey", "l_quantity", "l_partkey", "l_extendedprice"]


def _leads(spark: SparkSession, d: str, order: list[str] = _LINES) -> DataFrame:
    line = read(spark, d, "lineitem").select("l_orderkey", *order)
    return line.withColumns(
        {"f": F.col("l_suppkey").cast("bigint"), "t": F.lead("l_suppkey").over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("bigint")}
    )


def _supplier_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Lines that are equal in the first three columns have the same supplier and quantity, so their order doesn't change the pairs."""
    return _leads(spark, d, _LINES[:3]).where("t is not null and f <> t").groupBy("f", "t").agg(F.sum("l_quantity").cast("bigint").alias("d"))


def suppliers(spark: SparkSession, d: str) -> Graph:
    return _dress(_supplier_pairs(spark, d))


def raw_edges(spark: SparkSession, d: str) -> Graph:
    order = ["l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_partkey", "l_extendedprice"]
    e = _leads(spark, d)
    # a row's place in the whole order: that of its order key, by sums over order keys, and then within the order
    e = e.withColumn("k_", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order[1:])))
    sizes = e.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_"))
    from wayloom.session import materialize

    sizes = materialize(sizes.repartitionByRange("l_orderkey").sortWithinPartitions("l_orderkey").withColumn("p_", F.spark_partition_id()))
    start, base = {}, 0
    for r in sizes.groupBy("p_").agg(F.sum("n_").alias("n")).orderBy("p_").collect():
        start[r.p_], base = base, base + r.n
    offset = F.create_map(*[F.lit(x) for kv in start.items() for x in kv])[F.col("p_")] if start else F.lit(0)
    before = sizes.select("l_orderkey", (F.sum("n_").over(Window.partitionBy("p_").orderBy("l_orderkey")) - F.col("n_") + offset).alias("b_"))
    e = e.join(before, "l_orderkey").withColumn("ord", (F.col("b_") + F.col("k_")).cast("bigint")).where("t is not null and f <> t")
    q = F.col("l_quantity")
    mark = lambda a, b, m: (F.col("f") * a + F.col("t") * b + F.col("ord")) % m + 1
    return Graph.of(
        e.select(
            "ord", F.col("f").alias("from_id"), F.col("t").alias("to_id"), q.cast("double").alias("d"),
            (q * mark(31, 17, 7)).cast("double").alias("d_weighted"), (q * mark(13, 29, 5)).cast("double").alias("time_weighted")
        )
    )


def event_chains(spark: SparkSession, d: str) -> Graph:
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = read(spark, d, "events").select("event_id", "user_id", "ts", "event_type", "value").withColumn("to_id", F.lead("event_id").over(by_user))
    d_ = F.round(F.coalesce(F.col("value"), F.lit(0.0)) * 100)
    return Graph.of(
        e.where("to_id is not null").select(
            F.col("event_id").cast("bigint").alias("edge_id"), F.col("event_id").cast("bigint").alias("from_id"),
            F.col("to_id").cast("bigint").alias("to_id"), d_.alias("d"), d_.alias("d_weighted")
        )
    )


def streets(spark: SparkSession, d: str) -> Graph:
    """The street table: of several deliveries of an edge the last."""
    g = read(spark, d, "graph")
    cols = [c for c in g.columns if c not in ("edge_id", "loaded_at")]
    last = g.groupBy("edge_id").agg(F.max(F.struct("loaded_at", *cols)).alias("m"))
    return Graph.of(last.select("edge_id", *[F.col(f"m.{c}").alias(c) for c in cols], F.col("m.loaded_at").alias("loaded_at")), order="edge_id")


SQL_STREETS = "select * from (select *, row_number() over (partition by edge_id order by loaded_at desc) rn_ from graph) s_ where rn_=1"
