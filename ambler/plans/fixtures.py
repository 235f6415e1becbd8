"""Graphs derived from the driver's tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ambler.operators.graph import Graph

#: part - supplier: bipartite, symmetric, weighted, no sinks.
G1 = """
select l_partkey as src, n + l_suppkey as dst, cast(sum(l_quantity) as double) as w
from lineitem cross join (select max(l_partkey) + 1 as n from lineitem) np group by l_partkey, n + l_suppkey
union all
select n + l_suppkey as src, l_partkey as dst, cast(sum(l_quantity) as double) as w
from lineitem cross join (select max(l_partkey) + 1 as n from lineitem) np group by n + l_suppkey, l_partkey
"""
#: parts bought together: symmetric, with triangles.
G2 = """
select a.l_partkey as src, b.l_partkey as dst, cast(count(*) as double) as w
from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey <> b.l_partkey
group by a.l_partkey, b.l_partkey
"""
#: customer - nation - region: directed, five sinks, depth two.
G3 = """
select c_custkey as src, n + c_nationkey as dst, cast(1 as double) as w
from customer cross join (select max(c_custkey) + 1 as n from customer) nc
union all
select n + n_nationkey as src, n + 25 + n_regionkey as dst, cast(1 as double) as w
from nation cross join (select max(c_custkey) + 1 as n from customer) nc
"""
#: event types following one another, per user.
G4 = """
select src, dst, cast(count(*) as double) as w from (
    select a.id as src, b.id as dst from (
        select lag(event_type) over (partition by user_id order by ts, event_id) as one, event_type as two from events) x
    join (select event_type, dense_rank() over (order by event_type) - 1 as id from (select distinct event_type from events) t) a on a.event_type = x.one
    join (select event_type, dense_rank() over (order by event_type) - 1 as id from (select distinct event_type from events) t) b on b.event_type = x.two
) y group by src, dst
"""
#: as the first graph, with weights in sevenths.
SEVENTHS = f"select src, dst, w / 7.0 as w from ({G1})"
TABLES = {SEVENTHS: ("lineitem",), G1: ("lineitem",), G2: ("lineitem",), G3: ("customer", "nation"), G4: ("events",)}


def build(spark: SparkSession, sf_dir: str, raw: str) -> Graph:
    named = {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in TABLES[raw]}
    text = raw
    for name in named:
        text = text.replace(f" {name} ", f" {{{name}}} ").replace(f" {name})", f" {{{name}}})")
    return Graph.from_edges(spark.sql(text, **named))


def edges_sql(raw: str) -> str:
    """The CTEs raw, p, d, edges and vertices for an oracle."""
    return f"""
raw as ({raw}),
p as (select src, dst, w, row_number() over (partition by src order by dst, w) - 1 as pos from raw),
d as (select src as v, count(*) as deg, sum(w) as total_w from raw group by src),
edges as (
    select cast(p.src as bigint) as src, cast(p.pos as bigint) as pos, cast(p.dst as bigint) as dst, p.w,
           cast(a.deg as bigint) as src_deg, cast(coalesce(b.deg, 0) as bigint) as dst_deg
    from p join d a on a.v = p.src left join d b on b.v = p.dst),
vertices as (
    select cast(x.id as bigint) as id, cast(coalesce(d.deg, 0) as bigint) as deg, coalesce(d.total_w, 0.0) as total_w
    from (select src as id from raw union select dst from raw) x left join d on d.v = x.id)
"""
