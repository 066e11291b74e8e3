"""The queries of the data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayloom.functions.text import is_placeholder, usable_word
from wayloom.operators import eav, impute, multivalue, spatial, units
from wayloom.session import read


def p1_wide(spark: SparkSession, d: str) -> DataFrame:
    return eav.widen(read(spark, d, "sc_object"), read(spark, d, "tag_key"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return eav.cells(p1_wide(spark, d))


def _street_fields(spark: SparkSession, d: str):
    """The street table with its speeds in one unit, and the fields to fill."""
    graph = read(spark, d, "graph").select("edge_id", "way_id", "highway", "surface", "maxspeed", "feed")
    parsed = units.common_speeds(graph, read(spark, d, "feed"), ["edge_id", "way_id", "highway", "surface"])
    speed = F.coalesce(F.col("speed_mh").cast("string"), F.col("word"))
    fields = [impute.Field(c, usable_word(F.col(c)), is_placeholder(F.col(c))) for c in ("highway", "surface")]
    return parsed, [*fields, impute.Field("maxspeed", speed, F.col("vacant"), F.col("speed_mh"))]


def p2_impute(spark: SparkSession, d: str) -> DataFrame:
    parsed, fields = _street_fields(spark, d)
    return impute.chained_imputation(parsed, "edge_id", "way_id", fields)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    full = p2_impute(spark, d)
    cell = [
        F.when(
            F.col(f"{c}_filled") & F.col(f"{c}_alike"), F.struct(F.lit(c).alias("field"), F.col(c).alias("item"))
        ) for c in ("highway", "surface", "maxspeed")
    ]
    return full.select("edge_id", F.inline(F.array_compact(F.array(*cell)))).distinct()


def p2_held_out(spark: SparkSession, d: str) -> DataFrame:
    parsed, fields = _street_fields(spark, d)
    return impute.held_out(parsed, "edge_id", "way_id", fields)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return multivalue.split_values(read(spark, d, "graph"), "edge_id", ["lanes", "maxspeed"]).distinct()


def p4_speeds(spark: SparkSession, d: str) -> DataFrame:
    return units.common_speeds(read(spark, d, "graph"), read(spark, d, "feed"), ["edge_id"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_speeds(spark, d).where(F.col("speed_mh").isNotNull() & ~F.col("is_kmh")).select("edge_id", "speed_mh").distinct()


def p5_near(spark: SparkSession, d: str) -> DataFrame:
    return spatial.near_pairs(read(spark, d, "vertex"), "id", "x", "y", 10.0).select("key_a", "key_b")


def p5_inside(spark: SparkSession, d: str) -> DataFrame:
    starts = read(spark, d, "graph").select("edge_id", "from_lon", "from_lat")
    return spatial.inside_regions(starts, "edge_id", "from_lon", "from_lat", read(spark, d, "area"), "area_id", "wkt").distinct()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    near = p5_near(spark, d).select(F.lit("near").alias("kind"), F.col("key_a"), F.col("key_b"))
    inside = p5_inside(spark, d).select(
        F.lit("inside").alias("kind"), F.col("edge_id").cast("string").alias("key_a"), F.col("area_id").cast("string").alias("key_b")
    )
    return near.unionByName(inside)


QUERIES = {f.__name__: f for f in (p1_found, p1_wide, p2_found, p2_impute, p2_held_out, p3_found, p4_found, p4_speeds, p5_found, p5_near, p5_inside)}


_UNKNOWN = "('', '-', '--', '---', '.', '..', '...', '?', '??', '???', 'fixme', 'missing', 'n.a.', 'n/a', 'na', 'nan', 'nil', 'no data', 'not known', 'null', 'tba', 'tbc', 'tbd', 'todo', 'undefined', 'unknown', 'unspecified', 'xxx')"
_TYPED = (
    "case dtype when 'word' then lower(t) when 'text' then t "
    "when 'int' then case when regexp_full_match(t,'[+-]?[0-9]{1,18}([.]0*)?') then cast(cast(regexp_extract(t,'^[+]?(-?[0-9]+)',1) as bigint) as varchar) end "
    "when 'num' then "
    "cast(try_cast(replace(nullif(regexp_extract(t,'^[+]?(-?[0-9]+([.,][0-9]*)?|-?[.,][0-9]+)\\s*(%|[A-Za-z]{1,8}[.]?)?$',1),''),',','.') as "
    "decimal(20,2)) as varchar) "
    "when 'bool' then case when lower(t) in ('yes','y','true','t','1','on') then 'true' when lower(t) in ('no','n','false','f','0','off') then 'false' end "
    "when 'date' then cast(cast(try_strptime(t,['%Y-%m-%d','%Y/%m/%d','%Y%m%d','%d.%m.%Y','%d %b %Y','%b %d, %Y','%Y-%m-%dT%H:%M:%S']) as date) as varchar) end"
)
_TAGS = (
    "with k as (select distinct lower(regexp_replace(spelling,'[^\\p{L}\\p{N}]+','','g')) k, attribute, dtype from tag_key where attribute is not null), "
    "r as (select object_, attribute, dtype, rev, edited_at, trim(regexp_replace(value,'^\\s+|\\s+$','','g')) t from sc_object s join k on "
    "k.k=lower(regexp_replace(s.key,'[^\\p{L}\\p{N}]+','','g'))), "
    f"v as (select object_, attribute, rev, edited_at, {_TYPED} item from r where lower(t) not in {_UNKNOWN}), "
    "b as (select object_, attribute, item from (select *, row_number() over (partition by object_,attribute order by rev desc, edited_at desc, "
    "item desc) n from v where item is not null) x where n=1)"
)
_SPEEDS = (
    "with u(u,mh) as (values "
    "('km/h',1000.0),('kmh',1000),('kmph',1000),('kph',1000),('mph',1609.344),('mi/h',1609.344),('m.p.h.',1609.344),('milesperhour',1609.344),('m/s',3600),('mps',3600),('m/sec',3600),"
    "('metrespersecond',3600),('kn',1852),('kt',1852),('kts',1852),('knots',1852),('fps',1097.28),('ft/s',1097.28),('feetpersecond',1097.28),('m/min',60),('metres/min',60),('mpermin',60)), "
    ""
    "g as (select edge_id, feed, regexp_replace(trim(replace(lower(maxspeed),' ',''),';\"'),'^max','') t from graph where not regexp_matches(maxspeed,',\\s')), "
    "x as (select edge_id, feed, regexp_extract(t,'^([a-z./]*)([0-9]+([.,][0-9]+)?)([a-z./]*)$',2) n, "
    "regexp_extract(t,'^([a-z./]*)([0-9]+([.,][0-9]+)?)([a-z./]*)$',1)||regexp_extract(t,'^([a-z./]*)([0-9]+([.,][0-9]+)?)([a-z./]*)$',4) unit from "
    "g), "
    "y as (select x.edge_id, x.unit, cast(replace(x.n,',','.') as decimal(18,4)) n, coalesce(u.mh, case when x.unit='' then w.mh*cast(f.scale as "
    "decimal(9,3)) end) mh from x left join u on u.u=x.unit left join feed f on f.feed=x.feed left join u w on w.u=f.unit where x.n<>'')"
)
_NEAR = (
    "with v as (select distinct id, x, y from vertex where id is not null and x between -180 and 180 and y between -90 and 90) select distinct a.id "
    "key_a, b.id key_b from v a join v b on b.y between a.y-0.00009 and a.y+0.00009 and a.id<b.id "
    "where 2*6371000.0*asin(least(1.0,sqrt(pow(sin(radians(b.y-a.y)/2),2)+cos(radians(a.y))*cos(radians(b.y))*pow(sin(radians(b.x-a.x)/2),2))))<=10"
)
_INSIDE = (
    "with ring as (select area_id, row_number() over () r, string_split(rg,',') p from (select area_id, "
    "unnest(regexp_extract_all(wkt,'\\(([^()]+)\\)',1)) rg from area where wkt is not null) q), "
    "pt as (select area_id, r, i, cast(regexp_extract(trim(p[i]),'^(\\S+)\\s+(\\S+)$',1) as double) x, "
    "cast(regexp_extract(trim(p[i]),'^(\\S+)\\s+(\\S+)$',2) as double) y from (select area_id, r, p, unnest(range(1,len(p)+1)) i from ring) q), "
    "seg as (select area_id, x x1, y y1, coalesce(lead(x) over w, first_value(x) over w) x2, coalesce(lead(y) over w, first_value(y) over w) y2 "
    "from pt window w as (partition by area_id, r order by i rows between unbounded preceding and unbounded following)), "
    "box as (select area_id, min(x) lx, max(x) hx, min(y) ly, max(y) hy from pt group by 1), s as (select distinct edge_id, from_lon px, from_lat "
    "py from graph where from_lon is not null and from_lat is not null), "
    "c as (select s.*, b.area_id from s join box b on px between lx and hx and py between ly and hy) "
    "select edge_id, c.area_id from c join seg on seg.area_id=c.area_id where (y1>py)<>(y2>py) and px<(x2-x1)*(py-y1)/(y2-y1)+x1 group by 1,2 "
    "having count(*)%2=1"
)

# The attributes of tag_key and how SQL types them.
_ATTRIBUTES = {
    "varchar": ["bicycle", "foot", "highway", "name", "operator", "ref", "smoothness", "surface"],
    "boolean": ["bridge", "covered", "lit", "oneway", "toll", "tunnel"],
    "bigint": ["capacity", "lanes", "layer", "step_count"],
    "decimal(20,2)": ["incline", "width"],
    "date": ["check_date", "start_date"],
}
_WIDE = " select o.object_, " + ", ".join(
    f"cast(max(case when b.attribute='{a}' then b.item end) as {t}) \"{a}\"" for t, names in _ATTRIBUTES.items() for a in names
) + " from (select distinct object_ from sc_object where object_ is not null) o left join b on b.object_=o.object_ group by 1"

_CELLS = (
    "with usable_ as (select edge_id, way_id, {word} item from graph) select g.edge_id, '{field}' field, a.item from (select distinct edge_id, "
    "way_id from usable_ where item is null) g "
    "join (select way_id, min(item) item from usable_ where item is not null group by 1 having count(distinct item)=1) a on a.way_id=g.way_id"
)


def _word(field: str) -> str:
    low = f"lower(trim(regexp_replace({field},'^\\s+|\\s+$','','g')))"
    return f"case when {low} not in {_UNKNOWN} then {low} end"


# what holds together, then single characters; of these tokens the delimiters cut the text
_TOKEN = (
    r'(?i)"(?:[^"]|"")*"|\([^()]*\)|\s+and\s+|\b(?:km|m|mi|ft|nm|nmi|metres?|meters?|miles?|foot|feet|kilomet(?:re|er)s?)\s*/\s*(?:hours?|hrs?|h|secs?|seconds?|s|mins?|minutes?)\b'
    r"|[0-9]+(?:,[0-9]+)*(?:(?:km|m|mi|ft|nm|nmi|metres?|meters?|miles?|feet)\s*/\s*(?:hours?|hrs?|h|secs?|s|mins?)\b)?|\bn\s*/\s*a\b|[\s\S]"
)
_PACKED = (
    "with f as (select distinct edge_id, 'lanes' field, lanes t from graph union select distinct edge_id, 'maxspeed', maxspeed from graph), "
    f"k as (select edge_id, field, t, regexp_extract_all(t, '{_TOKEN}') l from f where t is not null), "
    "u as (select edge_id, field, t, unnest(l) x, unnest(range(1, len(l)+1)) i from k), d as (select *, x in (';', '|', '&', ',', '/', chr(9), chr(10)) or regexp_full_match(x, '(?i)\\s+and\\s+') cut from u), "
    "p as (select *, 1+coalesce(sum(cut::int) over (partition by edge_id, field, t order by i rows between unbounded preceding and 1 preceding), 0) pos from d), "
    "g as (select edge_id, field, t, cast(pos as int) pos, regexp_replace(string_agg(x, '' order by i) filter (where not cut), '^\\s+|\\s+$', '', 'g') w from p group by 1, 2, 3, 4), "
    "z as (select edge_id, field, t, pos, case when w like '\"%\"' and len(w)>=2 then replace(w[2:len(w)-1], '\"\"', '\"') else w end item from g), "
    "n as (select *, count(*) filter (where trim(item)<>'') over (partition by edge_id, field, t) c from z) select distinct edge_id, field, pos, item from n where c>=2 and trim(item)<>''"
)

ORACLES: dict[str, str] = {
    "p3_found": _PACKED,
    "p1_found": _TAGS + " select object_, attribute, item from b",
    "p5_near": f"select key_a, key_b from ({_NEAR}) a",
    "p5_inside": _INSIDE,
    "p1_wide": _TAGS + _WIDE,
    "p2_found": (
        "select * from (" + _CELLS.format(
            word=_word("highway"), field="highway"
        ) + ") h_ union all select * from (" + _CELLS.format(word=_word("surface"), field="surface") + ") s_ union all select * from (" + _SPEEDS
        + ", m as (select g.edge_id, g.way_id, coalesce(cast(cast(round(y.n*y.mh) as bigint) as varchar), case when not regexp_matches(w.t,'[0-9;|&,/]') and w.t not in " + _UNKNOWN + " then w.t end) item, "
        "y.edge_id is not null and (y.n<=0 or y.mh is null and y.unit='') or regexp_full_match(w.t,'[-+]0*[0-9.]+') or trim(coalesce(lower(g.maxspeed),''),' ;|&,/\"') in " + _UNKNOWN + " vacant "
        "from graph g left join (select distinct edge_id, unit, n, mh from y) y on y.edge_id=g.edge_id left join (select distinct edge_id, trim(lower(maxspeed),' ;\"') t from graph) w on w.edge_id=g.edge_id) "
        "select c.edge_id, 'maxspeed' field, a.item from (select distinct edge_id, way_id from m where vacant) c join (select way_id, min(item) "
        "item from m where item is not null and not vacant group by 1 having count(distinct item)=1) a on a.way_id=c.way_id) z"
    ),
    "p4_speeds": (
        "select * from (" + _SPEEDS + ", w as (select edge_id, feed, maxspeed, trim(lower(maxspeed),' ;\"') t, trim(coalesce(lower(maxspeed),''),' ;|&,/\"') p from graph), "
        "z as (select distinct edge_id, unit, n, mh from y) select w.edge_id, case when z.n>0 then cast(round(z.n*z.mh) as bigint) end speed_mh, "
        "case when not regexp_matches(w.t,'[0-9;|&,/]') and w.t not in " + _UNKNOWN + " then w.t end word, coalesce(z.n>0 and z.mh=1000, false) is_kmh, "
        "coalesce(z.n<=0 or z.mh is null and z.unit='', false) or coalesce(regexp_full_match(w.t,'[-+]0*[0-9.]+'), false) or w.p in " + _UNKNOWN + " vacant from w left join z on z.edge_id=w.edge_id) q"
    ),
    "p4_found": _SPEEDS + " select distinct edge_id, cast(round(n*mh) as bigint) speed_mh from y where mh is not null and mh<>1000 and n>0",
    "p5_found": f"select 'near' kind, key_a, key_b from ({_NEAR}) a union all select 'inside', cast(edge_id as varchar), area_id from ({_INSIDE}) b",
}
