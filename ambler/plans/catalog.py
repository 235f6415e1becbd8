"""Registered queries of the graph engine, each with the SQL that gives the same rows.

Walks and samples start from every vertex of the fixture graph.
"""

from __future__ import annotations

import os
import uuid
from math import prod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ambler.functions.rng import Channel, M, draw_sql
from ambler.operators import alias, graph, metrics, sample, walk
from ambler.operators.walk import WalkSpec, all_vertices, random_walk
from ambler.plans.fixtures import G1, G2, G3, G4, build, edges_sql
from ambler.plans.fixtures import SEVENTHS as _SEVENTHS
from ambler.plans.tables import shared_dir
from ambler.sources import gr, text

QUERIES = {}
ORACLES = {}
FLAGSHIP = "walk_uniform"

DEPTH = 10
HOPS = (3, 2)


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL of walks and samples -------------------------------------------------


def _walk_sql(raw: str, depth: int, kind: str = "uniform", tp: float = 0.0, seed: int = 0, last: str = "select walker, step, node from w", hub: int | None = None) -> str:
    slot = draw_sql("walker", "step", Channel.SLOT, seed)
    stop = f" and {draw_sql('walker', 'step', Channel.STOP, seed)} >= {tp * M!r}" if tp else ""
    if kind == "uniform":
        place, match = f"{slot} % nullif(deg, 0)", "e.pos = s.place"
    else:
        place = slot
        match = f"e.cum * {M} > s.place * e.total and (e.cum - e.b) * {M} <= s.place * e.total"
    b = {"uniform": "w", "weight": "w", "degree": "cast(dst_deg as double)"}[kind]
    # Vertices of ``hub`` edges or more have none.
    held = "{0}" if hub is None else f"case when {{0}} < {hub} then {{0}} else 0 end"
    kept = "" if hub is None else f" where src_deg < {hub}"
    return f"""
with recursive {edges_sql(raw)},
e as (select *, {b} as b, sum({b}) over (partition by src order by pos rows unbounded preceding) as cum,
             sum({b}) over (partition by src) as total from edges{kept}),
w(walker, step, node, deg) as (
    select id, cast(0 as bigint), id, {held.format('deg')} from vertices
    union all
    select s.walker, s.step + 1, e.dst, {held.format('e.dst_deg')}
    from (select walker, step, node, deg, {place} as place from w where step < {depth} and deg > 0{stop}) s
    join e on e.src = s.node and {match}
)
{last}
""".replace("select walker, step, node from w", "select walker, cast(step as int) as step, node from w")


_LENGTHS = "select walker, cast(max(step) as int) as length from w group by walker"


def _node2vec_sql(raw: str, depth: int, bias: str) -> str:
    parts = ["s0 as (select id as walker, id as node, cast(null as bigint) as prev, deg from vertices)"]
    for t in range(depth):
        parts.append(f"""
c{t} as (select s.walker, s.node, e.pos, e.dst, e.dst_deg, {bias} as b
         from s{t} s join edges e on e.src = s.node left join (select distinct src, dst from edges) x on x.src = s.prev and x.dst = e.dst),
r{t} as (select *, sum(b) over (partition by walker order by pos rows unbounded preceding) as cum, sum(b) over (partition by walker) as total from c{t}),
s{t + 1} as (select walker, dst as node, node as prev, dst_deg as deg from r{t}
             where cum * {M} > {draw_sql('walker', str(t), Channel.SLOT)} * total and (cum - b) * {M} <= {draw_sql('walker', str(t), Channel.SLOT)} * total)""")
    steps = " union all ".join(f"select walker, {t} as step, node from s{t}" for t in range(depth + 1))
    return f"with {edges_sql(raw)}, {', '.join(parts)} {steps}"


_BIASED = "case when s.prev is null then e.w when e.dst = s.prev then e.w / 2.0 when x.src is not null then e.w else e.w / 0.5 end"
_FLOORED = "case when e.dst = s.prev then 2.0 else 1.0 end"


def _sample_sql(raw: str, fanouts, method: str, last: str | None = None) -> str:
    stride = prod(fanouts)
    parts = ["s0 as (select id as instance, cast(-1 as bigint) as parent_slot, cast(0 as bigint) as slot, id as node, deg from vertices)"]
    for hop, f in enumerate(fanouts, 1):
        before, parent = f"s{hop - 1}", f"(instance * {stride} + slot)"
        if method == "weighted_distinct":
            key = draw_sql(parent, "e.pos", Channel.KEY + 16 * hop)
            parts.append(f"""
s{hop} as (select instance, parent_slot, parent_slot * {f} + rank - 1 as slot, node, deg from (
    select s.instance, s.slot as parent_slot, e.dst as node, e.dst_deg as deg, row_number() over (partition by s.instance, s.slot
        order by case when s.deg <= {f} then 0.0 else -ln(({key} + 1) / {float(M + 1)!r}) / e.w end, e.pos) as rank
    from {before} s join edges e on e.src = s.node where e.w > 0 or s.deg <= {f}) where rank <= {f})""")
            continue
        if method == "uniform_distinct":
            columns, chosen = [f"select *, least({f}, deg) as n from {before} where deg > 0"], []
            for i in range(f):
                h = draw_sql(f"{parent} * {f} + {i}", str(hop), Channel.SLOT)
                j = f"(deg - n + {i})"
                t = f"{h} % nullif(greatest({j} + 1, 1), 0)"
                taken = " or ".join(f"({t}) = c{k}" for k in chosen)
                value = f"case when {taken} then {j} else {t} end" if taken else t
                columns.append(f"select *, case when {i} < n then {value} end as c{i} from ({columns[-1]})")
                chosen.append(i)
            drawn = " union all ".join(f"select instance, slot, node, {i} as i, c{i} as pos from ({columns[-1]}) where c{i} is not null" for i in range(f))
        else:
            h = draw_sql(f"{parent} * {f} + i", str(hop), Channel.SLOT)
            whole = method in ("take_all", "alias")
            pos = f"case when deg <= {f} then i else {h} % nullif(deg, 0) end" if whole else f"{h} % nullif(deg, 0)"
            drawn = f"select instance, slot, node, deg, i, {pos} as pos from {before}, (select unnest(range({f})) as i) where deg > 0"
            drawn += " and i < deg" if method == "uniform_least" else ""
        if method.startswith("alias"):
            keep = f"({'x.deg <= ' + str(f) if method == 'alias' else 'false'}) or {draw_sql(f'(x.instance * {stride} + x.slot) * {f} + x.i', str(hop), Channel.COIN)} < a.prob * {M}"
            parts.append(f"""
s{hop} as (select x.instance, x.slot as parent_slot, x.slot * {f} + x.i as slot, case when {keep} then a.dst else a.alias_dst end as node,
                  case when {keep} then a.dst_deg else a.alias_dst_deg end as deg
           from ({drawn}) x join alias_table a on a.src = x.node and a.pos = x.pos)""")
            continue
        parts.append(f"""
s{hop} as (select x.instance, x.slot as parent_slot, x.slot * {f} + x.i as slot, e.dst as node, e.dst_deg as deg
           from ({drawn}) x join edges e on e.src = x.node and e.pos = x.pos)""")
    rows = " union all ".join(f"select instance, {hop} as hop, parent_slot, slot, node from s{hop}" for hop in range(len(fanouts) + 1))
    table = f"{_ALIAS}, " if method.startswith("alias") else ""
    return f"with recursive {edges_sql(raw)}, {table}{', '.join(parts)}, samples as ({rows}) {last or 'select * from samples'}"


_SAMPLE_LENGTHS = "select instance, hop, parent_slot, count(*) as len from samples where hop > 0 group by instance, hop, parent_slot"


#: Alias tables in SQL: each round pairs the last small slot of every row with its last large one.
_ALIAS = """
rows_ as (select src, list(w order by pos) as ws, sum(w) as total, count(*) as n from edges group by src),
start_ as (select src, n, total, list_transform(ws, lambda x: x * (n / nullif(total, 0))) as level from rows_ where total > 0),
pairing as (
    select src, n, level, list_transform(range(n), lambda i: i) as alias,
           list_filter(range(n), lambda i: level[i + 1] < 1) as small, list_filter(range(n), lambda i: level[i + 1] > 1) as large
    from start_
    union all
    select src, n, level[:big] || [rest] || level[big + 2:], alias[:s] || [big] || alias[s + 2:],
           case when rest < 1 then small[:-2] || [big] else small[:-2] end, case when rest <= 1 then large[:-2] else large end
    from (select *, small[-1] as s, large[-1] as big, level[large[-1] + 1] - (1 - level[small[-1] + 1]) as rest
          from pairing where len(small) > 0 and len(large) > 0)
),
paired as materialized (select src, n, level, alias, small || large as left_ from pairing where len(small) = 0 or len(large) = 0),
slots as (
    select src, i as pos, case when list_contains(left_, i) then 1.0 else least(level[i + 1], 1.0) end as prob, alias[i + 1] as alias_pos
    from (select *, unnest(range(n)) as i from paired)
),
alias_table as materialized (
    select e.src, e.pos, e.src_deg, e.dst, e.dst_deg, t.prob, t.alias_pos, x.dst as alias_dst, x.dst_deg as alias_dst_deg
    from edges e join slots t on t.src = e.src and t.pos = e.pos join edges x on x.src = e.src and x.pos = t.alias_pos
)"""


def _alias_walk_sql(raw: str, depth: int) -> str:
    coin = f"{draw_sql('walker', 'step', Channel.COIN)} < a.prob * {M}"
    return f"""
with recursive {edges_sql(raw)}, {_ALIAS},
w(walker, step, node, deg) as (
    select id, cast(0 as bigint), id, deg from vertices
    union all
    select s.walker, s.step + 1, case when {coin} then a.dst else a.alias_dst end, case when {coin} then a.dst_deg else a.alias_dst_deg end
    from (select walker, step, node, deg, {draw_sql('walker', 'step', Channel.SLOT)} % nullif(deg, 0) as place from w where step < {depth} and deg > 0) s
    join alias_table a on a.src = s.node and a.pos = s.place
)
select walker, cast(step as int) as step, node from w
"""


def _state_sql(raw: str, depth: int) -> str:
    parts = ["s0 as (select id as walker, id as node, cast(0 as bigint) as downs, deg from vertices)"]
    for t in range(depth):
        h = draw_sql("walker", str(t), Channel.SLOT)
        parts.append(f"""
c{t} as (select s.walker, s.node, e.pos, e.dst, e.dst_deg, s.downs + case when e.dst < s.node then 1 else 0 end as downs,
                case when s.downs + case when e.dst < s.node then 1 else 0 end > 1 then 0.0 else e.w end as b from s{t} s join edges e on e.src = s.node),
r{t} as (select *, sum(b) over (partition by walker order by pos rows unbounded preceding) as cum, sum(b) over (partition by walker) as total from c{t}),
s{t + 1} as (select walker, dst as node, downs, dst_deg as deg from r{t}
             where cum * {M} > {h} * total and (cum - b) * {M} <= {h} * total)""")
    steps = " union all ".join(f"select walker, {t} as step, node from s{t}" for t in range(depth + 1))
    return f"with {edges_sql(raw)}, {', '.join(parts)} {steps}"


def _rejected_sql(raw: str, depth: int, p: float, q: float) -> str:
    """Second-order walks by proposals; walkers that refuse all of them draw from running biases."""
    most = max(1 / p, 1.0, 1 / q)
    share = f"case when e.dst = s.prev then {1 / p!r} when x.src is not null then 1.0 else {1 / q!r} end"
    linked = "left join (select distinct src, dst from edges) x on x.src = s.prev and x.dst = e.dst"
    slot = " ".join(f"when {k} then {draw_sql('s.walker', '{t}', Channel.SLOT + walk.APART * k)}" for k in range(walk.ATTEMPTS))
    y = " ".join(f"when {k} then {draw_sql('s.walker', '{t}', Channel.ACCEPT + walk.APART * k)}" for k in range(walk.ATTEMPTS))
    parts = ["s0 as (select id as walker, id as node, cast(null as bigint) as prev, deg from vertices)"]
    for t in range(depth):
        h = draw_sql("walker", str(t), Channel.SLOT + walk.APART * walk.ATTEMPTS)
        parts.append(f"""
t{t} as (select s.*, k, case k {slot.replace('{t}', str(t))} end % s.deg as pos, case k {y.replace('{t}', str(t))} end as y
         from s{t} s, (select unnest(range({walk.ATTEMPTS})) as k) where s.deg > 0),
a{t} as (select s.walker, s.node, e.dst, e.dst_deg, row_number() over (partition by s.walker order by s.k) as first
         from t{t} s join edges e on e.src = s.node and e.pos = s.pos {linked} where s.prev is null or s.y * {most!r} < ({share}) * {M}),
c{t} as (select s.walker, s.node, e.pos, e.dst, e.dst_deg, case when s.prev is null then 1.0 else {share} end as b
         from s{t} s join edges e on e.src = s.node {linked} where s.walker not in (select walker from a{t})),
r{t} as (select *, sum(b) over (partition by walker order by pos rows unbounded preceding) as cum, sum(b) over (partition by walker) as total from c{t}),
s{t + 1} as (select walker, dst as node, node as prev, dst_deg as deg from a{t} where first = 1
             union all select walker, dst, node, dst_deg from r{t} where cum * {M} > {h} * total and (cum - b) * {M} <= {h} * total)""")
    steps = " union all ".join(f"select walker, {t} as step, node from s{t}" for t in range(depth + 1))
    return f"with {edges_sql(raw)}, {', '.join(parts)} {steps}"


def _seeds(g: graph.Graph) -> DataFrame:
    return g.ids.select(F.col("id").alias("instance"), F.col("id").alias("node"))


# --- graphs -------------------------------------------------------------------


@_query(f"with {edges_sql(G1)} select * from edges")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark, sf_dir, G1).edges


@_query(f"with {edges_sql(G2)} select * from edges")
def graph_copurchase(spark, sf_dir):
    return build(spark, sf_dir, G2).edges


@_query(f"with {edges_sql(G4)} select * from edges")
def graph_event_transitions(spark, sf_dir):
    return build(spark, sf_dir, G4).edges


@_query(f"with {edges_sql(G3)} select id, deg, total_w, total_w > 0 as valid from vertices")
def graph_vertices(spark, sf_dir):
    return build(spark, sf_dir, G3).vertices


@_query(f"""with {edges_sql(G3)} select count(*) as vertices, cast(sum(deg) as bigint) as edges, max(deg) as max_deg,
    min(id) filter (deg = (select max(deg) from vertices)) as max_id, cast(floor(sum(deg) / count(*)) as bigint) as avg_deg,
    count(*) filter (deg = 0) as sinks from vertices""")
def degree_stats(spark, sf_dir):
    return build(spark, sf_dir, G3).stats()


@_query(f"with {edges_sql(G1)} select deg, count(*) as n from vertices group by deg")
def degree_histogram(spark, sf_dir):
    return build(spark, sf_dir, G1).degree_histogram()


@_query(f"with {edges_sql(G1)} select id, deg from vertices where deg = (select max(deg) from vertices)")
def max_degree(spark, sf_dir):
    vertices = build(spark, sf_dir, G1).vertices.select("id", "deg")
    return vertices.join(F.broadcast(vertices.agg(F.max("deg").alias("deg"))), "deg").select("id", "deg")


@_query(f"with {edges_sql(G2)} select src, dst, exists (select 1 from edges e where e.src = p.dst and e.dst = p.src + 1) as connected from (select distinct src, dst from edges) p")
def edge_exists(spark, sf_dir):
    g = build(spark, sf_dir, G2)
    pairs = g.edges.select("src", "dst", F.col("dst").alias("a"), (F.col("src") + 1).alias("b")).distinct()
    return g.has_edges(pairs, "a", "b").select("src", "dst", "connected")


@_query(f"with {edges_sql(G1)} select cast(sum(deg * case when deg < 256 then 1 when deg < 65536 then 2 else 4 end) as bigint) as bytes from vertices")
def compressed_offsets(spark, sf_dir):
    return build(spark, sf_dir, G1).compressed_offset_bytes()


@_query(f"with {edges_sql(G1)} select src, pos, dst, {draw_sql('src', 'pos', Channel.WEIGHT)} / {float(M)!r} * 10.0 as w from edges")
def random_weights(spark, sf_dir):
    return build(spark, sf_dir, G1).with_weights("random", 10.0).edges.select("src", "pos", "dst", "w")


@_query(f"with {edges_sql(G1)} select src, pos, dst, cast(src_deg as double) as w from edges")
def degree_weights(spark, sf_dir):
    return build(spark, sf_dir, G1).with_weights("src_degree").edges.select("src", "pos", "dst", "w")


@_query(f"""with {edges_sql(G1)}, numbered as (select *, row_number() over (order by src, pos) - 1 as number from edges)
    select e.src, e.pos, e.dst, coalesce(n.w, 0.0) as w from edges e left join numbered n on n.number = e.dst""")
def dst_vertex_weights(spark, sf_dir):
    return build(spark, sf_dir, G1).with_weights("dst_vertex").edges.select("src", "pos", "dst", "w")


@_query(f"""with {edges_sql(G1)}, placed as (select id, deg, coalesce(sum(deg) over (order by id rows between unbounded preceding and 1 preceding), 0) as first,
        sum(deg) over () as total from vertices)
    select cast(least(floor(first * 4 / total), 3) as int) as part, min(id) as first_id, max(id) as last_id, count(*) as vertices, cast(sum(deg) as bigint) as edges
    from placed group by 1""")
def edge_cut_ranges(spark, sf_dir):
    return graph.edge_cut(build(spark, sf_dir, G1), 4)


@_query(f"""with {edges_sql(G1)}, size as (select max(id) + 1 as v from vertices)
    select cast(id // (v // 4 + 1) as int) as part, min(id) as first_id, max(id) as last_id, count(*) as vertices, cast(sum(deg) as bigint) as edges
    from vertices, size group by 1""")
def vertex_cut_ranges(spark, sf_dir):
    return graph.vertex_cut(build(spark, sf_dir, G1), 4)


@_query(f"""with {edges_sql(G1)}, size as (select max(id) + 1 as v from vertices)
    select id as src, deg, cast(id // (v // 10 + 1) as int) as bucket from vertices, size""")
def locality_buckets(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return graph.locality_buckets(g.vertices.select(F.col("id").alias("src"), "deg"), g)


def _gr_file(spark: SparkSession, sf_dir: str) -> str:
    """The graph as a binary adjacency file; the format's readers want a mounted folder, by a local path."""
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:")
    if "://" in folder:
        raise ValueError(f"binary adjacency files need a mounted folder, not {folder}")
    os.makedirs(folder, exist_ok=True)
    path = f"{folder}/{uuid.uuid4().hex}.gr"
    gr.write_gr(build(spark, sf_dir, G1), path)
    return path


@_query(f"with {edges_sql(G1)} select src, pos, dst, w from edges")
def gr_round_trip(spark, sf_dir):
    """The graph written as a binary adjacency file and read back by ranges."""
    return gr.read_gr(spark, _gr_file(spark, sf_dir))


@_query(f"with {edges_sql(G1)} select 1::bigint as version, 4::bigint as edge_bytes, (select max(id) + 1 from vertices) as vertices, count(*) as edges from edges")
def gr_header(spark, sf_dir):
    """Only the header of the file."""
    return gr.read_gr_header(spark, _gr_file(spark, sf_dir))


@_query(f"with {edges_sql(G1)} select src, pos, dst, w, src_deg, dst_deg from edges")
def edge_list_round_trip(spark, sf_dir):
    """The graph as a text edge list and back."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.txt"
    text.write_edge_list(build(spark, sf_dir, G1), path)
    return text.read_edge_list(spark, path, weighted=True).edges


@_query(f"with {edges_sql(G1)} select src, pos, dst, w from edges")
def parquet_round_trip(spark, sf_dir):
    """Canonical edges written once and read without ranking them again."""
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}.parquet"
    text.write_parquet(build(spark, sf_dir, G1), path)
    return text.read_parquet(spark, path).edges.select("src", "pos", "dst", "w")


@_query(f"with {edges_sql(G1)} select r.id, coalesce(v.deg, 0) as deg from (select unnest(range(0, 5000, 7)) as id) r left join vertices v on v.id = r.id")
def degree_lookup(spark, sf_dir):
    """Degrees of stated ids, some of which the graph lacks."""
    return build(spark, sf_dir, G1).degree_of(spark.range(0, 5000, 7))


# --- walks --------------------------------------------------------------------


@_query(_walk_sql(G1, DEPTH))
def walk_uniform(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return random_walk(g, all_vertices(g), WalkSpec(DEPTH))


@_query(_walk_sql(G1, DEPTH))
def walk_uniform_join(spark, sf_dir):
    """The same walks by step joins."""
    g = build(spark, sf_dir, G1).cached()
    return random_walk(g, all_vertices(g), WalkSpec(DEPTH), strategy="join")


@_query(_walk_sql(G3, 5, last=_LENGTHS))
def walk_lengths(spark, sf_dir):
    g = build(spark, sf_dir, G3)
    return walk.lengths(random_walk(g, all_vertices(g), WalkSpec(5), strategy="join"))


@_query(_walk_sql(G3, 5))
def walk_dangling(spark, sf_dir):
    g = build(spark, sf_dir, G3)
    return random_walk(g, all_vertices(g), WalkSpec(5))


@_query(_walk_sql(G1, 20, tp=0.15))
def ppr_walk(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return random_walk(g, all_vertices(g), walk.ppr(20))


@_query(_walk_sql(G1, 20, "weight", tp=0.15, last=_LENGTHS))
def ppr_weighted_lengths(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return walk.lengths(random_walk(g, all_vertices(g), walk.ppr(20, bias="weight")))


@_query(_walk_sql(G1, 5, "weight"))
def walk_weighted_its(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return random_walk(g, all_vertices(g), WalkSpec(5, bias="weight"))


@_query(_walk_sql(G1, 3, "weight"))
def walk_weighted_its_join(spark, sf_dir):
    g = build(spark, sf_dir, G1).cached()
    return random_walk(g, all_vertices(g), WalkSpec(3, bias="weight"), strategy="join")


@_query(_walk_sql(G1, 5, "degree"))
def walk_degree_bias(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return random_walk(g, all_vertices(g), WalkSpec(5, bias="degree"))


@_query(_node2vec_sql(G2, 3, _BIASED))
def node2vec_biased(spark, sf_dir):
    g = build(spark, sf_dir, G2).written()
    return random_walk(g, all_vertices(g), walk.node2vec(3))


@_query(_node2vec_sql(G2, 2, _BIASED))
def node2vec_biased_join(spark, sf_dir):
    g = build(spark, sf_dir, G2).written()
    return random_walk(g, all_vertices(g), walk.node2vec(2), strategy="join")


@_query(_node2vec_sql(G2, 3, _FLOORED))
def node2vec_floor(spark, sf_dir):
    g = build(spark, sf_dir, G2).written()
    return random_walk(g, all_vertices(g), WalkSpec(3, bias="node2vec_floor"))


@_query(_alias_walk_sql(G1, DEPTH))
def walk_alias(spark, sf_dir):
    """Weighted walks by alias tables."""
    g = build(spark, sf_dir, G1)
    return random_walk(g, all_vertices(g), WalkSpec(DEPTH, bias="weight", table=True))


@_query(_alias_walk_sql(G1, DEPTH))
def walk_alias_join(spark, sf_dir):
    g = build(spark, sf_dir, G1).cached()
    return random_walk(g, all_vertices(g), WalkSpec(DEPTH, bias="weight", table=True), strategy="join")


@_query(_walk_sql(G1, DEPTH, last="select count(*) as sampled_edges from w where step > 0"))
def walk_sampled_edges(spark, sf_dir):
    return metrics.walked_edges(walk_uniform(spark, sf_dir))


@_query(_walk_sql(G1, DEPTH, last=f"""select walker, string_agg(cast(node as varchar), ' ' order by step) as nodes
    from w where step < {DEPTH} and walker in (select id from vertices order by id limit 3) group by walker"""))
def walk_print(spark, sf_dir):
    return metrics.first_walks(walk_uniform(spark, sf_dir))


@_query(_walk_sql(_SEVENTHS, 5, "weight"))
def walk_fractional(spark, sf_dir):
    """Weights that no double holds exactly."""
    g = build(spark, sf_dir, _SEVENTHS)
    return random_walk(g, all_vertices(g), WalkSpec(5, bias="weight"))


@_query(_walk_sql(_SEVENTHS, 3, "weight"))
def walk_fractional_join(spark, sf_dir):
    g = build(spark, sf_dir, _SEVENTHS).cached()
    return random_walk(g, all_vertices(g), WalkSpec(3, bias="weight"), strategy="join")


@_query(_rejected_sql(G2, 3, 2.0, 0.5))
def node2vec_rejected(spark, sf_dir):
    """Second-order walks by rejection, which reads no whole rows."""
    g = build(spark, sf_dir, G2).written()
    return random_walk(g, all_vertices(g), walk.node2vec(3, reject=True))


@_query(_rejected_sql(G2, 2, 4.0, 0.25))
def node2vec_rejected_join(spark, sf_dir):
    g = build(spark, sf_dir, G2).written()
    return random_walk(g, all_vertices(g), walk.node2vec(2, p=4.0, q=0.25, reject=True), strategy="join")


@_query(_node2vec_sql(G2, 2, "case when e.dst = s.prev then 0.0 when x.src is not null then 3 * e.w else e.w end"))
def walk_own_bias(spark, sf_dir):
    """A second-order bias of one's own: never straight back, thrice as likely to common neighbours."""
    g = build(spark, sf_dir, G2).written()
    bias = lambda c: F.when(c.dst.eqNullSafe(c.prev), 0.0).when(c.connected, 3 * c.w).otherwise(c.w)
    return random_walk(g, all_vertices(g), WalkSpec(2, bias=bias))


@_query(_state_sql(G1, 4))
def walk_state(spark, sf_dir):
    """A bias that reads the walker's state: how often it went to a smaller number, once at most."""
    g = build(spark, sf_dir, G1).written()
    downs = lambda c: F.coalesce(c.state, F.lit(0)) + F.when(c.dst < c.node, 1).otherwise(0)
    bias = lambda c: F.when(downs(c) > 1, 0.0).otherwise(c.w)
    return random_walk(g, all_vertices(g), WalkSpec(4, bias=bias, update=downs))


@_query(f"""{_walk_sql(G1, 4, last="select walker, step, node from w")} where walker < 50""")
def walk_first_seeds(spark, sf_dir):
    """Seeds 0 to 49."""
    g = build(spark, sf_dir, G1)
    return random_walk(g, walk.first_vertices(g, 50), WalkSpec(4))


@_query(_walk_sql(G1, 5, hub=300))
def walk_without_hubs(spark, sf_dir):
    """Vertices of 300 edges or more end walks."""
    g = build(spark, sf_dir, G1)
    return random_walk(g.without_high_degree(300), all_vertices(g), WalkSpec(5))


@_query(_walk_sql(G1, DEPTH, last="""select max(ms) as ms, cast(sum(n) as bigint) as sampled_edges, sum(n) / (max(ms) / 1000) / 1e6 as mseps
    from (select walker % 4 as part, cast(1000 + walker % 4 as double) as ms, count(*) as n from w where step > 0 group by all)"""))
def metrics_combined(spark, sf_dir):
    """The metrics row of four runs, with stated times."""
    part = F.col("walker") % 4
    walked = walk_uniform(spark, sf_dir).where("step > 0").groupBy(part.alias("part")).agg(F.count("*").alias("sampled_edges"))
    return metrics.combined(walked.withColumn("ms", F.lit(1000.0) + F.col("part")))


# --- samples ------------------------------------------------------------------


@_query(_sample_sql(G1, HOPS, "uniform"))
def khop_uniform(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return sample.neighbor_sample(g, _seeds(g), HOPS)


@_query(_sample_sql(G3, (4, 3), "take_all", _SAMPLE_LENGTHS))
def khop_lengths(spark, sf_dir):
    g = build(spark, sf_dir, G3)
    return sample.sample_lengths(sample.neighbor_sample(g, _seeds(g), (4, 3), "take_all"))


@_query(_sample_sql(G1, sample.SAGE_FANOUTS, "uniform"))
def sage_25_10(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return sample.neighbor_sample(g, _seeds(g))


@_query(_sample_sql(G3, (4, 3), "uniform_least"))
def khop_least(spark, sf_dir):
    """min(fan-out, degree) draws with replacement."""
    g = build(spark, sf_dir, G3)
    return sample.neighbor_sample(g, _seeds(g), (4, 3), "uniform_least")


@_query(_sample_sql(G1, (6, 4), "alias_draws"))
def khop_alias_draws(spark, sf_dir):
    """Weighted draws with replacement, whatever the degree."""
    g = build(spark, sf_dir, G1)
    return sample.neighbor_sample(g, _seeds(g), (6, 4), "alias_draws")


@_query(_sample_sql(G1, HOPS, "uniform_distinct"))
def khop_distinct(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return sample.neighbor_sample(g, _seeds(g), HOPS, "uniform_distinct")


@_query(_sample_sql(G1, (40, 3), "take_all"))
def khop_takeall(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return sample.neighbor_sample(g, _seeds(g), (40, 3), "take_all")


@_query(_sample_sql(G1, HOPS, "weighted_distinct"))
def khop_weighted_topf(spark, sf_dir):
    g = build(spark, sf_dir, G1).written()
    return sample.neighbor_sample(g, _seeds(g), HOPS, "weighted_distinct")


@_query(_sample_sql(G2, (1,) * 5, "uniform"))
def khop_chain(spark, sf_dir):
    """Layers of one neighbour each."""
    g = build(spark, sf_dir, G2).written()
    return sample.neighbor_sample(g, _seeds(g), (1,) * 5)


@_query(_sample_sql(G1, (20, 5), "alias"))
def khop_alias(spark, sf_dir):
    g = build(spark, sf_dir, G1)
    return sample.neighbor_sample(g, _seeds(g), (20, 5), "alias")


@_query(_sample_sql(G1, HOPS, "uniform", "select count(*) as sampled_edges from samples where hop > 0"))
def sampled_edges(spark, sf_dir):
    return metrics.sampled_edges(khop_uniform(spark, sf_dir))


@_query(_sample_sql(G1, HOPS, "uniform", "select count(*) as sampled_edges from samples"))
def sampled_edges_with_seeds(spark, sf_dir):
    return metrics.sampled_edges(khop_uniform(spark, sf_dir), with_seeds=True)


@_query(_sample_sql(G1, HOPS, "weighted_distinct", "select hop, node from samples"))
def khop_bag(spark, sf_dir):
    return sample.frontier(khop_weighted_topf(spark, sf_dir))


@_query(_sample_sql(G1, HOPS, "uniform", "select hop, count(*) as n from samples group by hop"))
def frontier_sizes(spark, sf_dir):
    return sample.frontier_sizes(khop_uniform(spark, sf_dir))


@_query(_sample_sql(G1, HOPS, "uniform", "select * from samples where instance < 4 and slot < 30"))
def khop_print(spark, sf_dir):
    return metrics.first_samples(khop_uniform(spark, sf_dir))


# --- alias tables -------------------------------------------------------------


@_query(f"with {edges_sql(G1)} select src, pos, cast(floor(w / sum(w) over (partition by src) * 1e6 + 0.3) as bigint) as ppm from edges")
def alias_reconstruct(spark, sf_dir):
    """Probabilities that the tables give, in millionths; 0.3 keeps dyadic shares off the steps of floor."""
    table = alias.build_alias_table(build(spark, sf_dir, G1))
    return alias.reconstruct(table).select("src", "pos", F.floor(F.col("p") * 1e6 + 0.3).alias("ppm"))


@_query(f"with {edges_sql(G3)} select src, pos, dst_deg > 0 as valid, src_deg from edges")
def alias_valid(spark, sf_dir):
    """Tables by destination degree: rows that lead only to sinks have none."""
    table = alias.build_alias_table(build(spark, sf_dir, G3), F.col("dst_deg"))
    return table.select("src", "pos", "valid", "src_deg")


@_query(f"with recursive {edges_sql(G1)}, {_ALIAS} select src, pos, prob, alias_pos from alias_table order by src, pos limit 100")
def alias_print(spark, sf_dir):
    """The first hundred slots of the alias tables."""
    return metrics.first_slots(alias.build_alias_table(build(spark, sf_dir, G1)).where("valid"))
