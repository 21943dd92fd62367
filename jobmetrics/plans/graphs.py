"""Queries: graph operators (G) and DOT text (S6)."""

from pyspark.sql import functions as F

from jobmetrics.operators import graph
from jobmetrics.plans.registry import query
from jobmetrics.runtime import cut, scratch_path
from jobmetrics.sources.text import dot_edges, dot_vertices, read_dot

WALKS = """select flow_id, src_stage as stage, 0 as level from edges union
    select flow_id, dest_stage, 1 from edges where not exists (select 1 from edges e
        where e.flow_id = edges.flow_id and e.dest_stage = edges.src_stage)
    union select e.flow_id, e.dest_stage, w.level + 1 from walks w join edges e on e.flow_id = w.flow_id and e.src_stage = w.stage"""
LEVELS = "select flow_id, stage, max(level) as level from walks group by all"


@query("g3_dag_levels", "select * from levels", {"walks": WALKS, "levels": LEVELS})
def _(t):
    return graph.dag_levels(t.edges)


@query(
    "g4_topo_order",
    "select *, row_number() over (partition by flow_id order by level, stage) as position from levels",
    {"walks": WALKS, "levels": LEVELS},
)
def _(t):
    return graph.topo_order(t.edges)


# Failed steps are run again by the steps they feed, and submitted ones wait for themselves.
LOOPED = """select * from edges union select e.flow_id, e.dest_stage, e.src_stage from edges e join steps s
        on s.flow_id = e.flow_id and s.step_number = e.src_stage where s.step_status = 'FAILED'
    union select flow_id, step_number, step_number from steps where step_status = 'SUBMITTED'"""
REACHED = """select flow_id, src_stage as a, dest_stage as b from looped where src_stage <> dest_stage
    union select r.flow_id, r.a, l.dest_stage from reached r join looped l on l.flow_id = r.flow_id and l.src_stage = r.b"""


def looped_edges(t):
    edges = cut(t.edges)
    failed = t.steps.filter("step_status = 'FAILED'").selectExpr("flow_id", "step_number as src_stage")
    back = edges.join(failed, ["flow_id", "src_stage"], "left_semi")
    back = back.selectExpr("flow_id", "dest_stage as src_stage", "src_stage as dest_stage")
    own = t.steps.filter("step_status = 'SUBMITTED'").selectExpr("flow_id", "step_number as src_stage", "step_number as dest_stage")
    return edges.unionByName(back).unionByName(own).distinct()


@query(
    "g5_cycle_steps",
    """select x.flow_id, x.a as stage, max(x.b) as cycle_id from reached x join reached y
        on x.flow_id = y.flow_id and x.a = y.b and x.b = y.a group by x.flow_id, x.a having count(distinct x.b) > 1""",
    {"looped": LOOPED, "reached": REACHED},
)
def _(t):
    return graph.cycle_steps(looped_edges(t))


@query(
    "g5_acyclic_flows",
    """select flow_id, bool_and(src_stage <> dest_stage) and not flow_id in (select flow_id from reached where a = b)
        as is_acyclic from looped group by flow_id""",
    {"looped": LOOPED, "reached": REACHED},
)
def _(t):
    return graph.acyclic_flows(looped_edges(t))


@query(
    "g6_components",
    "select flow_id, a as stage, min(b) as component from joined_up group by all",
    {
        "joined_up": """select flow_id, src_stage as a, src_stage as b from edges union
            select flow_id, dest_stage, dest_stage from edges union
            select j.flow_id, j.a, case when e.src_stage = j.b then e.dest_stage else e.src_stage end from joined_up j
            join edges e on e.flow_id = j.flow_id and (e.src_stage = j.b or e.dest_stage = j.b)"""
    },
)
def _(t):
    return graph.components(t.edges)


WEIGHTED = """select e.*, s.step_running_time as weight from edges e join steps s
    on s.flow_id = e.flow_id and s.step_number = e.src_stage"""
PATHS = """select flow_id, source, source as stage, cast(0 as bigint) as distance, 0 as n, cast(null as int) as predecessor
    from starts union all select p.flow_id, p.source, w.dest_stage, p.distance + w.weight, p.n + 1, w.src_stage
    from paths p join weighted w on w.flow_id = p.flow_id and w.src_stage = p.stage"""
DISTANCES = """select flow_id, source, stage, distance, predecessor from paths qualify row_number() over
    (partition by flow_id, source, stage order by distance, n, predecessor) = 1"""


def weighted_edges(t):
    times = t.steps.select("flow_id", F.col("step_number").alias("src_stage"), F.col("step_running_time").alias("weight"))
    return t.edges.join(times, ["flow_id", "src_stage"])


@query(
    "g7_shortest_paths",
    DISTANCES,
    {
        "weighted": WEIGHTED,
        "starts": "select flow_id, min(src_stage) as source from edges group by flow_id",
        "paths": PATHS,
    },
)
def _(t):
    edges = cut(weighted_edges(t))
    sources = edges.groupBy("flow_id").agg(F.min("src_stage").alias("source"))
    return graph.shortest_paths(edges, sources, "weight")


@query(
    "g8_root_distances",
    DISTANCES,
    {
        "weighted": "select *, cast(1 as bigint) as weight from edges",
        "starts": "select distinct flow_id, src_stage as source from edges e where not exists "
        "(select 1 from edges d where d.flow_id = e.flow_id and d.dest_stage = e.src_stage)",
        "paths": PATHS,
    },
)
def _(t):
    """Hop distances from every step that nothing feeds."""
    edges = cut(t.edges)
    fed = edges.select("flow_id", F.col("dest_stage").alias("src_stage")).distinct()
    roots = edges.join(fed, ["flow_id", "src_stage"], "left_anti").select("flow_id", F.col("src_stage").alias("source"))
    return graph.shortest_paths(edges, roots.distinct())


@query(
    "g8_all_distances",
    DISTANCES,
    {
        "weighted": "select *, cast(1 as bigint) as weight from edges",
        "starts": "select flow_id, src_stage as source from edges union select flow_id, dest_stage from edges",
        "paths": PATHS,
    },
)
def _(t):
    """Hop distances of all pairs of steps of which one reaches the other."""
    return graph.all_distances(cut(t.edges))


# DOT text: node names differ from stages, and ids are hexadecimal.
def dot_lines(t):
    node = F.col("step_number") + 100
    vertex = F.format_string('  %d [label = "%d_%s"];', node, "step_number", F.md5(F.concat_ws("-", "flow_id", "step_number")))
    vertices = t.step_keys.select("flow_id", F.col("step_number").alias("line_no"), vertex.alias("line"))
    text = F.format_string("  %d -> %d;", F.col("src_stage") + 100, F.col("dest_stage") + 100)
    edges = t.edges.select("flow_id", (F.col("dest_stage") * 1000 - F.col("src_stage")).alias("line_no"), text.alias("line"))
    return vertices.unionByName(edges)


@query(
    "g1_dot_vertices",
    "select flow_id, cast(step_number + 100 as varchar) as node, step_number as stage, md5(step_id) as step_id from step_keys",
)
def _(t):
    return dot_vertices(dot_lines(t))


@query("g2_j2_dot_edges", "select * from edges")
def _(t):
    return dot_edges(dot_lines(t))


@query("g2_last_line_wins", "select flow_id, src_stage, max(dest_stage) as dest_stage from edges group by all")
def _(t):
    return dot_edges(dot_lines(t), last_line_wins=True)


@query(
    "s6_read_dot",
    """select distinct cast(cast(flow_id as bigint) % 50 as varchar) as flow_id, cast(cast(flow_id as bigint) * 10 + src_stage as int) as src_stage,
        cast(cast(flow_id as bigint) * 10 + dest_stage as int) as dest_stage from edges""",
)
def _(t):
    """Graphs of many vertices and lines, in files whose path names them; a line lists all targets of its node."""
    path = scratch_path(t.spark, "dot")
    number = F.col("flow_id").cast("bigint") * 10
    group = (F.col("flow_id").cast("bigint") % 50).alias("graph")
    vertex = F.format_string('  %d [label = "%d_%s"];', number + F.col("step_number"), number + F.col("step_number"), F.md5("flow_id"))
    targets = F.array_join(F.sort_array(F.collect_list((number + F.col("dest_stage")).cast("string"))), " ")
    edges = t.edges.groupBy("flow_id", "src_stage").agg(targets.alias("targets"))
    edge = F.format_string("  %d -> %s;", number + F.col("src_stage"), "targets")
    lines = t.step_keys.select(group, vertex.alias("value")).unionByName(edges.select(group, edge.alias("value")))
    for head in (F.lit("digraph G {"), F.lit("}")):
        lines = lines.unionByName(t.step_keys.select(group).distinct().select("graph", head.alias("value")))
    lines.write.partitionBy("graph").option("lineSep", "\r\n").text(path)
    return dot_edges(read_dot(t.spark, path, r"graph=([^/]+)/[^/]*$"))
