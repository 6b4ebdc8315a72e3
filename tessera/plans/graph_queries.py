"""Registered queries over chains and families, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bitmaps, graph, structure
from ..operators.storage import fresh_path, materialize
from ..sources.fixtures import CHAIN_SQL, EDGE_SQL, NODE_SQL, Tables, chains, nodes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

CLOSURE_SQL = (
    EDGE_SQL.replace("node as", "node as", 1)
    + """, pair as (select distinct family, src, dst from edge),
 closed as (select family, src, dst from pair union select c.family, c.src, p.dst from closed c join pair p on c.family = p.family and c.dst = p.src)"""
)
DEGREE_SQL = """, member as (select distinct family, variant, node from chain),
 degree as (select m.family, m.node, coalesce(t.n, 0) as teachers, coalesce(s.n, 0) as students
 from (select distinct family, node from chain) m
 left join (select family, src as node, count(*) as n from pair group by all) t using (family, node)
 left join (select family, dst as node, count(*) as n from pair group by all) s using (family, node))"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _base(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame, DataFrame]:
    t = Tables(spark, sf_dir)
    c = chains(t)
    return t, c, graph.chain_edges(c)


def _stored(spark: SparkSession, sf_dir: str) -> tuple[Tables, DataFrame, DataFrame]:
    """As _base, with chains and the next node of each place stored for plans that use them again and again: edges are read from these."""
    t, c, _ = _base(spark, sf_dir)
    steps = materialize(graph.chain_steps(c))
    return t, steps.drop("dst", "dst_gen"), graph.step_edges(steps)


@query(f"with {EDGE_SQL} select family, variant, src, dst, src_gen, dst_gen, pos from edge")
def chain_edges(spark, sf_dir):
    return _base(spark, sf_dir)[2]


@query(
    f"""with {CHAIN_SQL}, j as (select *, case when gen >= lag(gen) over (partition by variant order by pos) + 2 then 1 else 0 end as jump from chain)
 select family, variant, node, gen, pos, cast(sum(jump) over (partition by variant order by pos) as int) as part from j"""
)
def tahwil_split(spark, sf_dir):
    return graph.split_by_gap(_base(spark, sf_dir)[1])


@query(
    f"""with {CHAIN_SQL}, l as (select *, max(pos) over (partition by variant, node) = pos as own_last from chain),
 n as (select *, lead(node) over w as dst, lead(own_last) over w as next_last from l window w as (partition by variant order by pos))
 select family, variant, node as src, dst, pos from n where own_last and next_last and node <> dst"""
)
def last_position_edges(spark, sf_dir):
    return graph.last_position_edges(_base(spark, sf_dir)[1])


@query(
    f"""with {CHAIN_SQL}, r as (select variant, pos, node, case when gen <> 3 then node end as named from chain)
 select variant, pos, node, last_value(named ignore nulls) over (partition by variant order by pos rows between unbounded preceding and current row) as referent from r"""
)
def carry_forward_names(spark, sf_dir):
    """Nodes of the third generation play the relative references that the last real name resolves."""
    c = _base(spark, sf_dir)[1]
    return graph.carry_forward(c, F.col("node"), F.col("gen") != 3, "referent").select("variant", "pos", "node", "referent")


@query(
    f"""with {EDGE_SQL}, p as (select distinct src, dst from edge)
 select node.id as node, name,
 list_sort(coalesce((select list(dst) from p where src = node.id), [])) as teachers,
 list_sort(coalesce((select list(src) from p where dst = node.id), [])) as students from node"""
)
def teachers_students(spark, sf_dir):
    """Distinct one-hop neighbours of every node over all families."""
    t, _, edges = _base(spark, sf_dir)
    one = edges.select("src", "dst").distinct()
    up = one.groupBy(F.col("src").alias("node")).agg(F.sort_array(F.collect_set("dst")).alias("teachers"))
    down = one.groupBy(F.col("dst").alias("node")).agg(F.sort_array(F.collect_set("src")).alias("students"))
    rows = nodes(t).select(F.col("id").alias("node"), "name").join(up, "node", "left").join(down, "node", "left")
    empty = F.array().cast("array<bigint>")
    return rows.select("node", "name", F.coalesce("teachers", empty).alias("teachers"), F.coalesce("students", empty).alias("students"))


@query(
    f"""with {EDGE_SQL}, p as (select distinct src, dst from edge),
 r as (select src, dst, row_number() over (partition by src order by dst) as rn, count(*) over (partition by src) as total from p)
 select src as node, list(dst order by dst) as teachers, any_value(total) as total from r where rn <= 25 group by src"""
)
def ego_graph_capped(spark, sf_dir):
    """Each node's teachers: the first 25 and how many there are in all."""
    one = _base(spark, sf_dir)[2].select("src", "dst").distinct()
    return graph.first_neighbours(one, "src", "dst").select("node", F.col("shown").alias("teachers"), "total")


@query(
    f"with {CLOSURE_SQL.replace('with ', '')}{DEGREE_SQL} select family, node, teachers = 0 as is_root, students = 0 as is_leaf from degree".replace(
        "with node", "with recursive node"
    )
)
def roots_leaves(spark, sf_dir):
    _, c, edges = _base(spark, sf_dir)
    return graph.degrees(c, edges).select("family", "node", (F.col("teachers") == 0).alias("is_root"), (F.col("students") == 0).alias("is_leaf"))


@query(
    f"""with {EDGE_SQL}, ends as (select family, src as node, src_gen < dst_gen as conflict from edge union all select family, dst, src_gen < dst_gen from edge)
 select family, node, count(*) as edges, round(avg(case when conflict then 1.0 else 0.0 end), 6) as ratio from ends group by family, node"""
)
def chronology_ratio(spark, sf_dir):
    return graph.chronology_ratio(_base(spark, sf_dir)[2]).withColumn("ratio", F.round("ratio", 6))


@query(f"with recursive {CLOSURE_SQL} select family, src, dst from closed where src <> dst")
def reachable_set(spark, sf_dir):
    return graph.reachable(graph.closure(_base(spark, sf_dir)[2]))


@query(
    f"""with recursive {CLOSURE_SQL}{DEGREE_SQL}
 select c.family, c.dst as node, count(distinct c.src) as terminals from closed c join degree d on d.family = c.family and d.node = c.src and d.students = 0
 where c.src <> c.dst group by c.family, c.dst"""
)
def reachable_terminals(spark, sf_dir):
    _, c, edges = _stored(spark, sf_dir)
    return bitmaps.terminals(bitmaps.reach(edges, c), graph.degrees(c, edges))


@query(
    f"""with recursive {CLOSURE_SQL}{DEGREE_SQL}
 select c.family, c.src as node, round(avg(case when d.students = 1 then 1.0 else 0.0 end), 6) as ratio
 from closed c join degree d on d.family = c.family and d.node = c.dst group by c.family, c.src"""
)
def pre_single_strand(spark, sf_dir):
    _, c, edges = _stored(spark, sf_dir)
    return bitmaps.single_strand_ratio(bitmaps.reach(edges, c), graph.degrees(c, edges)).withColumn("ratio", F.round("ratio", 6))


BYPASS_SQL = """, above as (select distinct c.family, c.src as n, m.variant from closed c join member m on m.family = c.family and m.node = c.dst where c.src <> c.dst),
 below as (select distinct c.family, c.dst as n, m.variant from closed c join member m on m.family = c.family and m.node = c.src where c.src <> c.dst),
 passed as (select a.family, a.n as node, count(*) as bypasses from above a join below b using (family, n, variant)
 where not exists (select 1 from member m where m.family = a.family and m.node = a.n and m.variant = a.variant) group by a.family, a.n)"""


@query(f"with recursive {CLOSURE_SQL}{DEGREE_SQL}{BYPASS_SQL}, v as (select family, count(distinct variant) as variants from chain group by family) select family, node, bypasses, round(bypasses / variants, 6) as ratio from passed join v using (family)")
def bypass_count(spark, sf_dir):
    _, c, edges = _stored(spark, sf_dir)
    return bitmaps.bypasses(c, bitmaps.reach(edges, c)).withColumn("ratio", F.round("ratio", 6))


@query(
    f"""with recursive {CLOSURE_SQL}, around as (select distinct family, node, node as other from chain
 union select family, src, dst from closed where src <> dst union select family, dst, src from closed where src <> dst)
 select family, node, round(avg(case when s_acctbal > 0 then 1.0 else 0.0 end), 6) as completeness from around join supplier on other = s_suppkey group by family, node"""
)
def provenance(spark, sf_dir):
    """Suppliers with a positive balance are the nodes with a known biography."""
    t, c, edges = _stored(spark, sf_dir)
    known = t.supplier.where("s_acctbal > 0").select(F.col("s_suppkey").alias("node"))
    return bitmaps.provenance_completeness(bitmaps.reach(edges, c), known).withColumn("completeness", F.round("completeness", 6))


def _levels_sql(n: int = 6) -> str:
    """Breadth-first levels as one expression for each level."""
    parts = [
        f"with {EDGE_SQL}, b as (select distinct src as a, dst as b, 0 as inward from edge union select distinct dst, src, 1 from edge)",
        "l0 as (select cast(1 as bigint) as node, 0 as level, cast(null as bigint) as parent, [cast(1 as bigint)] as path)",
        "s0 as (select * from l0)",
    ]
    for k in range(1, n + 1):
        parts.append(
            f"l{k} as (select node, {k} as level, parent, list_append(path, node) as path from (select b.b as node, b.a as parent, f.path,"
            f" row_number() over (partition by b.b order by inward, b.a) as rn from l{k - 1} f join b on f.node = b.a where b.b not in (select node from s{k - 1})) where rn = 1)"
        )
        parts.append(f"s{k} as (select * from s{k - 1} union all select * from l{k})")
    return ", ".join(parts) + f" select node, level, parent, path from s{n}"


@query(_levels_sql())
def bfs_path(spark, sf_dir):
    """Shortest paths of at most six steps from node 1 over the edges of all families."""
    edges = _base(spark, sf_dir)[2]
    return graph.shortest_paths(edges.select("src", "dst").distinct(), 1)


@query(
    f"""with {CHAIN_SQL}, g as (select family, gen, count(distinct node) as n, min(node) as node from chain where gen is not null group by family, gen),
 r as (select *, row_number() over (partition by family order by n, gen) as rn from g)
 select family, n as nodes, gen, case when n = 1 then node end as bottleneck,
 case when n >= 10 then 'mutawatir' when n >= 3 then 'mashhur' when n >= 2 then 'aziz' else 'gharib' end as breadth from r where rn = 1"""
)
def breadth_class(spark, sf_dir):
    return structure.breadth(_base(spark, sf_dir)[1])


@query(
    f"""with {CHAIN_SQL}, g as (select family, gen, count(distinct node) as n from chain group by family, gen), m as (select family, min(n) as n from g group by family)
 select case when n >= 10 then 'mutawatir' when n >= 3 then 'mashhur' when n >= 2 then 'aziz' else 'gharib' end as breadth, count(*) as families from m group by 1"""
)
def class_counts(spark, sf_dir):
    return structure.breadth(_base(spark, sf_dir)[1]).groupBy("breadth").agg(F.count("*").alias("families"))


PIVOT_SQL = f"""with recursive {CLOSURE_SQL}{DEGREE_SQL}{BYPASS_SQL}, v as (select family, count(distinct variant) as variants from chain group by family),
 term as (select c.family, c.dst as node, count(distinct c.src) as terminals from closed c join degree d on d.family = c.family and d.node = c.src and d.students = 0
 where c.src <> c.dst group by c.family, c.dst),
 cov as (select m.family, m.node, count(*) / any_value(v.variants) as coverage from member m join v using (family) group by m.family, m.node),
 r as (select cov.family, cov.node, coverage, students as fan_out, row_number() over (partition by cov.family order by coverage desc, students desc, cov.node) as rank
 from cov join degree d on d.family = cov.family and d.node = cov.node where coverage >= 0.2 or students >= 2)
 select r.family, r.node, cast(rank as int) as rank, round(coverage, 6) as coverage, fan_out, coalesce(terminals, 0) as terminals, coalesce(bypasses, 0) as bypasses, coverage >= 0.95 as is_bottleneck
 from r left join term using (family, node) left join passed using (family, node) where rank <= 10"""


@query(PIVOT_SQL)
def pivots(spark, sf_dir):
    _, c, edges = _stored(spark, sf_dir)
    return structure.pivots(c, edges, bitmaps.reach(edges, c)).withColumn("coverage", F.round("coverage", 6))


@query(
    f"select node, count(*) as families, count(*) filter (where is_bottleneck) as bottlenecks, list(family order by family) as in_families from ({PIVOT_SQL}) group by node"
)
def role_rollup(spark, sf_dir):
    """Each pivot's families, and in how many it is a bottleneck."""
    rows = pivots(spark, sf_dir)
    return rows.groupBy("node").agg(
        F.count("*").alias("families"), F.count_if("is_bottleneck").alias("bottlenecks"), F.sort_array(F.collect_list("family")).alias("in_families")
    )


@query(
    f"""with {CHAIN_SQL}, r as (select family, variant, arg_max(node, pos) as root from chain group by family, variant), p as (select family, root, count(*) as n from r group by family, root)
 select family, count(*) as roots, cast(sum(greatest(n - 1, 0)) as bigint) as parallels, greatest(count(*) - 1, 0) as witnesses from p group by family"""
)
def corroboration(spark, sf_dir):
    return structure.corroboration(_base(spark, sf_dir)[1])


@query(
    f"""with {EDGE_SQL} select family, bool_or(src_gen < dst_gen) as conflict,
 case when bool_or(src_gen < dst_gen) then ['chronology conflict'] else cast([] as varchar[]) end as messages from edge group by family"""
)
def defect_flags(spark, sf_dir):
    return structure.conflicts(_base(spark, sf_dir)[2])


#: The family's edges between two members of a variant, and the walk along them.
WALK_SQL = f"""{EDGE_SQL}, own as (select distinct family, variant, node from chain), pair as (select distinct family, src, dst from edge),
 inside as (select a.family, a.variant, p.src, p.dst from own a join pair p on p.family = a.family and p.src = a.node join own b on b.family = a.family and b.variant = a.variant and b.node = p.dst),
 t as (select family, variant, src as node, list(dst order by dst) as teachers from inside group by all),
 leaf as (select family, variant, min(node) filter (where not exists (select 1 from inside i where i.family = own.family and i.variant = own.variant and i.dst = own.node)) as node from own group by all),
 walk as (select family, variant, 0 as step, node, [node] as path from leaf where node is not null union all
 select family, variant, step + 1, nxt, list_append(path, nxt) from (select w.*, list_filter(t.teachers, lambda x: not list_contains(w.path, x))[1] as nxt from walk w join t on t.family = w.family and t.variant = w.variant and t.node = w.node) where nxt is not null),
 walked as (select family, variant, step, node from walk union all
 select family, variant, cast(row_number() over (partition by family, variant order by own.node) - 1 as int), own.node from own join leaf using (family, variant) where leaf.node is null)"""

_ASSESSED = f"""{WALK_SQL}, g as (select family, node, max(gen) as gen from chain group by all),
 steps as (select family, variant, step, node, gen, lead(node) over w as next, lead(gen) over w as next_gen from walked join g using (family, node) window w as (partition by family, variant order by step)),
 link as (select family, src, dst, coalesce(bool_or(src_gen < dst_gen), false) as conflict from edge group by all),
 p as (select s.*, coalesce(conflict, false) as conflict, case when next is not null and link.src is null then greatest(coalesce(abs(next_gen - gen) - 1, 0), 0) else 0 end as missing
 from steps s left join link on link.family = s.family and link.src = s.node and link.dst = s.next),
 q as (select *, sum(case when missing = 0 then 1 else 0 end) over (partition by family, variant order by step) as row_id from p),
 runs as (select family, variant, row_id, sum(missing) as run from q group by all),
 tot as (select family, variant, cast(sum(run) as bigint) as missing, cast(max(run) as bigint) as longest from runs group by all),
 e as (select family, variant, arg_max(gen, step) as last_gen, arg_max(node, step) as last_node, arg_min(coalesce(gen, -1), step) as first_gen, list(node order by step) as nodes, bool_or(conflict) as conflict from p group by all),
 told as (select family, variant, missing, longest, case when missing = 0 and last_gen = 2 and not exists (select 1 from pair where pair.family = tot.family and pair.src = e.last_node) then 'mursal'
 when missing = 0 then 'muttasil' when longest >= 2 then 'mudal' when first_gen = -1 then 'muallaq' else 'munqati' end as continuity, nodes, conflict from tot join e using (family, variant))"""


@query(f"with recursive {_ASSESSED} select family, variant, missing, longest, continuity from told")
def continuity(spark, sf_dir):
    _, c, edges = _stored(spark, sf_dir)
    return structure.continuity(c, edges)


@query(f"with recursive {WALK_SQL} select family, variant, step, node from walked")
def chain_walk(spark, sf_dir):
    _, c, edges = _stored(spark, sf_dir)
    return graph.greedy_walks(c, edges)


@query(
    f"""with {EDGE_SQL}, p as (select distinct src, dst from edge), up as (select src as node, dst as other, row_number() over (partition by src order by dst) as rn from p),
 down as (select dst as node, src as other, row_number() over (partition by dst order by src) as rn from p),
 n as (select id as node, coalesce((select list(other order by other) from up where up.node = id and rn <= 25), []) as teachers, coalesce((select list(other order by other) from down where down.node = id and rn <= 25), []) as students,
 (select count(*) from p where src = id) as total_teachers, (select count(*) from p where dst = id) as total_students from node),
 m as (select node, unnest(list_distinct(list_concat([node], list_concat(teachers, students)))) as other from n),
 l as (select a.node, list({{src: p.src, dst: p.dst}} order by p.src, p.dst) as links from m a join p on p.src = a.other join m b on b.node = a.node and b.other = p.dst group by a.node)
 select node, teachers, students, total_teachers, total_students, coalesce(len(links), 0)::bigint as links,
 md5(coalesce(array_to_string(list_transform(links, lambda x: x.src || '>' || x.dst), ','), '')) as links_md5 from n left join l using (node)"""
)
def ego_graph(spark, sf_dir):
    """Each node with its first 25 teachers and students, all edges among them by number and checksum, and the totals of both sides."""
    t, _, edges = _base(spark, sf_dir)
    rows = graph.ego_graphs(nodes(t).select(F.col("id").alias("node")), edges.select("src", "dst").distinct())
    names = F.array_join(F.transform("links", lambda x: F.concat_ws(">", x["src"], x["dst"])), ",")
    return rows.select(
        "node", "teachers", "students", "total_teachers", "total_students", F.size("links").cast("long").alias("links"), F.md5(names.cast("binary")).alias("links_md5")
    )


@query(
    f"""with {EDGE_SQL}, m as (select variant, list(distinct node order by node) as nodes from chain group by variant), e as (select variant, list({{source: src, target: dst, chain_position: pos}} order by pos) as edges from edge group by variant)
 select m.variant, nodes, coalesce(array_to_string(list_transform(edges, lambda x: x.source || '>' || x.target || '@' || x.chain_position), ','), '') as edges from m left join e using (variant)"""
)
def chain_graphs(spark, sf_dir):
    """Each variant's graph: its distinct nodes and its edges in the order of their places."""
    _, c, edges = _base(spark, sf_dir)
    ordered = F.array_sort(F.collect_list(F.struct("pos", "src", "dst")))
    links = edges.groupBy("variant").agg(F.array_join(F.transform(ordered, lambda x: F.concat(F.concat_ws(">", x["src"], x["dst"]), F.lit("@"), x["pos"].cast("string"))), ",").alias("edges"))
    members = c.groupBy("variant").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    return members.join(links, "variant", "left").select("variant", "nodes", F.coalesce("edges", F.lit("")).alias("edges"))


@query(
    f"""with {CHAIN_SQL} select n.id as node, name, count(c.variant) as variants, coalesce(avg(c.pos), -1) as mean_place
 from node n left join chain c on c.node = n.id group by n.id, name""".replace("coalesce(avg(c.pos), -1)", "round(coalesce(avg(c.pos), -1), 6)")
)
def degree_backfill(spark, sf_dir):
    """Edges (not distinct variants) of every node, 0 where it has none."""
    t, c, _ = _base(spark, sf_dir)
    per = c.groupBy(F.col("node").alias("id")).agg(F.count("*").alias("variants"), F.avg("pos").alias("mean_place"))
    return nodes(t).join(per, "id", "left").select(
        F.col("id").alias("node"), "name", F.coalesce("variants", F.lit(0)).alias("variants"), F.round(F.coalesce("mean_place", F.lit(-1.0)), 6).alias("mean_place")
    )


@query(
    f"""with {CHAIN_SQL} select c.node, substr(o_orderpriority, 1, 1) as collection, count(*) as edges from chain c join orders on variant = o_orderkey
 where o_orderpriority like '1%' group by all"""
)
def filtered_edge_count(spark, sf_dir):
    """Edges of each node into one collection."""
    t, c, _ = _base(spark, sf_dir)
    one = t.orders.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_orderkey").alias("variant"), F.substring("o_orderpriority", 1, 1).alias("collection"))
    return c.join(one, "variant").groupBy("node", "collection").agg(F.count("*").alias("edges"))


@query(
    f"""with {CHAIN_SQL}, h as (select node, count(distinct variant) as variants, avg(pos) as place, list(distinct variant order by variant) as v from chain group by node)
 select node, variants, round(place, 6) as mean_place, v[1:20] as sample from h where variants >= 10"""
)
def hubs(spark, sf_dir):
    """Nodes in at least ten chains, with a capped sample of them."""
    c = _base(spark, sf_dir)[1]
    first = graph.first_neighbours(c.select("node", "variant").distinct(), "node", "variant", 20).where("total >= 10")
    places = c.groupBy("node").agg(F.avg("pos").alias("mean_place"))
    return first.join(places, "node").select("node", F.col("total").alias("variants"), F.round("mean_place", 6).alias("mean_place"), F.col("shown").alias("sample"))


@query(
    f"""with {CHAIN_SQL}, t as (select family, variant, string_agg(name, ' < ' order by pos) as text, count(*) as places from chain join node on chain.node = node.id group by family, variant)
 select variant, text, places from t"""
)
def ordered_concat(spark, sf_dir):
    """Each chain as text, its nodes' names in order."""
    t, c, _ = _base(spark, sf_dir)
    named = c.join(nodes(t).select(F.col("id").alias("node"), "name"), "node")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name")))
    return named.groupBy("variant").agg(F.array_join(F.transform(ordered, lambda x: x["name"]), " < ").alias("text"), F.count("*").alias("places"))


@query(
    f"""with {EDGE_SQL}, m as (select family, count(distinct variant) as variants, count(distinct node) as nodes from chain group by family),
 e as (select family, count(*) as edges from edge group by family)
 select family, '# Family ' || family || chr(10) || '- variants: ' || variants || chr(10) || '- nodes: ' || nodes || chr(10) || '- edges: ' || coalesce(edges, 0) as markdown from m left join e using (family)"""
)
def family_export_md(spark, sf_dir):
    _, c, edges = _base(spark, sf_dir)
    rows = c.groupBy("family").agg(F.count_distinct("variant").alias("variants"), F.count_distinct("node").alias("nodes"))
    rows = rows.join(edges.groupBy("family").agg(F.count("*").alias("edges")), "family", "left")
    text = F.format_string("# Family %d\n- variants: %d\n- nodes: %d\n- edges: %d", "family", "variants", "nodes", F.coalesce("edges", F.lit(0).cast("long")))
    return rows.select("family", text.alias("markdown"))


_TWO_SQL = EDGE_SQL.replace(", step as", ", many as (select family from chain group by family having count(distinct variant) > 1), step as")


@query(
    f"""with {_TWO_SQL}, n as (select family, count(distinct variant) as variants, count(distinct node) as nodes from chain where family in (select family from many) group by family),
 p as (select distinct family, src, dst from edge), e as (select family, count(*) as edges from p group by family),
 r as (select family, count(*) as roots from (select distinct family, node from chain) c where not exists (select 1 from p where p.family = c.family and p.src = c.node) group by family)
 select family, variants, nodes, coalesce(edges, 0) as edges, coalesce(roots, 0) as roots from n left join e using (family) left join r using (family)"""
)
def family_graphs(spark, sf_dir):
    """Sizes of the family graphs; a lone variant has none."""
    _, c, edges = _base(spark, sf_dir)
    c = graph.of_two_or_more(c)
    size = c.groupBy("family").agg(F.count_distinct("variant").alias("variants"), F.count_distinct("node").alias("nodes"))
    links = graph.distinct_edges(edges).groupBy("family").agg(F.count("*").alias("edges"))
    roots = graph.degrees(c, edges).where("teachers = 0").groupBy("family").agg(F.count("*").alias("roots"))
    zero = lambda x: F.coalesce(x, F.lit(0).cast("bigint")).alias(x)
    return size.join(links, "family", "left").join(roots, "family", "left").select("family", "variants", "nodes", zero("edges"), zero("roots"))


@query(
    f"""with {_TWO_SQL}, g as (select family, gen, count(distinct node) as n from chain where gen is not null group by family, gen), b as (select *, row_number() over (partition by family order by n, gen) as rn from g),
 r as (select family, variant, arg_max(node, pos) as root from chain group by family, variant), p as (select family, root, count(*) as n from r group by family, root),
 c as (select family, count(*) as roots, cast(sum(greatest(n - 1, 0)) as bigint) as parallels, greatest(count(*) - 1, 0) as witnesses, cast(sum(n) as bigint) as chains from p group by family),
 d as (select family, bool_or(src_gen < dst_gen) as conflict from edge group by family)
 select family, chains, case when n >= 10 then 'mutawatir' when n >= 3 then 'mashhur' when n >= 2 then 'aziz' else 'gharib' end as breadth, n as least_nodes, gen as narrowest, roots, parallels, witnesses,
 case when conflict then ['chronology conflict'] else cast([] as varchar[]) end as messages from c join b using (family) left join d using (family) where rn = 1 and family in (select family from many)"""
)
def family_analysis(spark, sf_dir):
    """The table of families that the analysis stores."""
    _, c, edges = _stored(spark, sf_dir)
    return structure.analyse_families(c, edges, fresh_path(spark, "analysis"))["families"]


@query(
    f"""with recursive {_ASSESSED}, many as (select family from chain group by family having count(distinct variant) > 1)
 select family, variant, continuity, len(nodes) as node_count, conflict, nodes from told where family in (select family from many)"""
)
def chain_assessments(spark, sf_dir):
    """The table of chains that the analysis stores."""
    _, c, edges = _stored(spark, sf_dir)
    c = materialize(graph.of_two_or_more(c))
    return structure.chain_facts(c, materialize(edges.join(c.select("family").distinct(), "family", "left_semi")))


_NEAR = "list_dot_product(e.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))"


@query(
    f"""with recursive {CHAIN_SQL}, own as (select distinct variant, node from chain),
 topical as (select vec_id, list_concat(embedding::double[], list_transform(range(64), lambda i: case when i = label % 64 then 2.0::double else 0.0::double end)) as embedding from embeddings),
 s as (select q.vec_id as id, e.vec_id as other, {_NEAR} as score from topical e, topical q),
 s_r as (select *, row_number() over (partition by id order by round(score, 12) desc, other) as rank from s),
 e as (select distinct s_r.id, other from s_r join own a on a.variant = s_r.id + 1 join own b on b.variant = other + 1 and a.node = b.node where rank <= 10 and s_r.id <> other and score >= 0.85),
 edges as (select id as a, other as b from e union select other, id from e), reach as (select a as node, b as other from edges union select r.node, x.b from reach r join edges x on r.other = x.a),
 f as (select node, least(node, min(other)) as family, count(distinct other) as members from reach group by node)
 select f.node as vec_id, family, members, 'Family of ' || s_name || ', label ' || label as label from f join embeddings on vec_id = family join (select variant, min(node) as first from own group by variant) on variant = family + 1 join supplier on s_suppkey = first"""
)
def compute_families(spark, sf_dir):
    """Families of near texts that share a node: ten nearest, cosine 0.85, at least one common node; with label and size, for each member.

    The stored vectors are hardly alike, so each is lengthened by an axis of its label.
    """
    t, c, _ = _base(spark, sf_dir)
    axis = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.when(i == F.col("label") % 64, 2.0).otherwise(0.0))
    vectors = t.embeddings.select("vec_id", F.concat(F.col("embedding").cast("array<double>"), axis).alias("embedding"))
    own = graph.memberships(c).select("variant", "node").distinct()
    families = structure.compute_families(vectors, own.select((F.col("variant") - 1).alias("id"), "node"), "vec_id", "embedding")
    first = own.groupBy((F.col("variant") - 1).alias("family")).agg(F.min("node").alias("first"))
    named = first.join(nodes(t).select(F.col("id").alias("first"), "name"), "first").join(t.embeddings.select(F.col("vec_id").alias("family"), F.col("label").alias("kind")), "family")
    label = F.format_string("Family of %s, label %d", "name", "kind")
    return families.join(named, "family").select(F.col("id").alias("vec_id"), "family", "members", label.alias("label"))


@query(
    f"""with {CHAIN_SQL}, n as (select distinct node, variant from chain) select node, count(*) as variants, min(variant) as first_variant, max(variant) as last_variant, md5(string_agg(variant, ',' order by variant)) as variants_md5 from n group by node"""
)
def node_variants(spark, sf_dir):
    """The reverse map: each node's variants, by number and checksum of the ordered list."""
    own = _base(spark, sf_dir)[1].select("node", "variant").distinct()
    listed = F.md5(F.array_join(F.sort_array(F.collect_list("variant")), ",").cast("binary"))
    return own.groupBy("node").agg(F.count("*").alias("variants"), F.min("variant").alias("first_variant"), F.max("variant").alias("last_variant"), listed.alias("variants_md5"))


@query(
    f"""with {CHAIN_SQL}, a as (select family, node, gen, row_number() over (partition by family order by gen desc, node) as rank, count(*) over (partition by family) as n from (select distinct family, node, gen from chain))
 select family, node, round(radius * cos(angle), 4) + 0.0 as x, round(radius * sin(angle), 4) + 0.0 as y from (select family, node, 120.0::double * (6 - gen) as radius, 2 * pi() * (rank - 1) / n as angle from a)"""
)
def radial_layout(spark, sf_dir):
    """Places of a family's nodes on rings by generation, dealt evenly around."""
    return structure.radial_layout(_base(spark, sf_dir)[1], 120.0, 6)


assert NODE_SQL in CHAIN_SQL
