"""Graph operators against brute force on random graphs, and DOT text."""

import itertools
import random

import pytest
from pyspark.errors import PySparkException

from jobmetrics.operators import graph
from jobmetrics.sources.text import dot_edges, dot_vertices, read_dot, read_numbered_dot

SCHEMA = "flow_id string, src_stage int, dest_stage int"


def random_edges(seed, n_flows=12, n=9, acyclic=False):
    rng = random.Random(seed)
    out = set()
    for flow in range(n_flows):
        for _ in range(rng.randrange(3, 14)):
            a, b = rng.randrange(n), rng.randrange(n)
            if acyclic and a == b:
                continue
            out.add((f"f{flow}", min(a, b), max(a, b)) if acyclic else (f"f{flow}", a, b))
    return sorted(out)


def flows_of(edges):
    for flow, group in itertools.groupby(edges, key=lambda e: e[0]):
        pairs = [(a, b) for _, a, b in group]
        yield flow, pairs, sorted({v for p in pairs for v in p})


def distances(pairs, nodes, weights=None):
    inf = float("inf")
    d = {(a, b): 0 if a == b else inf for a in nodes for b in nodes}
    for a, b in pairs:
        d[a, b] = min(d[a, b], (weights or {}).get((a, b), 1))
    for k, i, j in itertools.product(nodes, nodes, nodes):
        d[i, j] = min(d[i, j], d[i, k] + d[k, j])
    return d


def test_levels_and_order(spark):
    edges = random_edges(1, acyclic=True)
    df = spark.createDataFrame(edges, SCHEMA)
    levels = {(r.flow_id, r.stage): r.level for r in graph.dag_levels(df).collect()}
    order = {(r.flow_id, r.stage): r.position for r in graph.topo_order(df).collect()}
    for flow, pairs, nodes in flows_of(edges):
        want = dict.fromkeys(nodes, 0)
        for _ in nodes:
            for a, b in pairs:
                want[b] = max(want[b], want[a] + 1)
        assert {v: levels[flow, v] for v in nodes} == want
        assert sorted(order[flow, v] for v in nodes) == list(range(1, len(nodes) + 1))
        assert all(order[flow, a] < order[flow, b] for a, b in pairs)


def test_rounds_do_not_grow_with_the_length_of_a_chain(spark, monkeypatch):
    """Chains of 10 and 1,000 steps, alone and between branchings."""
    names = []
    watched = graph._watched
    monkeypatch.setattr(graph, "_watched", lambda stage, name, *rest, **more: names.append(name) or watched(stage, name, *rest, **more))
    rounds = {}
    for n in (10, 1000):
        names.clear()
        chain = [("c", i, i + 1) for i in range(n)]
        loop = [("d", 0, 1), ("d", 0, 5000), ("d", 5000, n + 1), *(("d", i, i + 1) for i in range(1, n + 1)), ("d", n + 1, n + 2)]
        levels = {(r.flow_id, r.stage): r.level for r in graph.dag_levels(spark.createDataFrame(chain + loop, SCHEMA)).collect()}
        assert levels == {("c", i): i for i in range(n + 1)} | {("d", i): i for i in range(n + 3)} | {("d", 5000): 1}
        rounds[n] = len(names)
    assert rounds[1000] - rounds[10] <= 7


def test_rings_are_errors(spark):
    for edges in ([("f", 1, 1)], [("f", 1, 2), ("f", 2, 1)], [("f", 1, 2), ("f", 2, 3), ("f", 3, 1), ("g", 4, 5)], [("f", i, (i + 1) % 17) for i in range(17)]):
        with pytest.raises(graph.CycleError):
            graph.dag_levels(spark.createDataFrame(edges, SCHEMA))


def test_cycle_is_an_error(spark):
    with pytest.raises(graph.CycleError):
        graph.dag_levels(spark.createDataFrame([("f", 1, 2), ("f", 2, 3), ("f", 3, 2), ("g", 1, 2)], SCHEMA))
    with pytest.raises(graph.CycleError):
        graph.topo_order(spark.createDataFrame([("f", 1, 1), ("f", 1, 2)], SCHEMA))


@pytest.mark.parametrize("seed", [2, 3])
def test_cycles(spark, seed):
    edges = random_edges(seed)
    df = spark.createDataFrame(edges, SCHEMA)
    got = {(r.flow_id, r.stage): r.cycle_id for r in graph.cycle_steps(df).collect()}
    acyclic = {r.flow_id: r.is_acyclic for r in graph.acyclic_flows(df).collect()}
    want = {}
    for flow, pairs, nodes in flows_of(edges):
        d = distances(pairs, nodes)
        for v in nodes:
            mates = [u for u in nodes if d[u, v] < float("inf") and d[v, u] < float("inf")]
            if len(mates) > 1:
                want[flow, v] = max(mates)
        cyclic = any((flow, v) in want for v in nodes) or any(a == b for a, b in pairs)
        assert acyclic[flow] is not cyclic
    assert got == want


def test_components(spark):
    edges = random_edges(5, n=14) + [("chain", i, i + 1) for i in range(40)] + [("self", 1, 1)]
    edges.sort()
    got = {(r.flow_id, r.stage): r.component for r in graph.components(spark.createDataFrame(edges, SCHEMA)).collect()}
    want = {}
    for flow, pairs, nodes in flows_of(edges):
        d = distances(pairs + [(b, a) for a, b in pairs], nodes)
        for v in nodes:
            want[flow, v] = min(u for u in nodes if d[v, u] < float("inf"))
    assert got == want


def test_paths_from_every_vertex(spark):
    edges = random_edges(7, n_flows=5)
    rng = random.Random(8)
    weighted = [(*e, rng.randrange(0, 6)) for e in edges]
    df = spark.createDataFrame(weighted, SCHEMA + ", w long")
    sources = graph.vertices(df).withColumnRenamed("stage", "source")
    got = {(r.flow_id, r.source, r.stage): (r.distance, r.predecessor) for r in graph.shortest_paths(df, sources, "w").collect()}
    for flow, pairs, nodes in flows_of(edges):
        weights = {(a, b): w for f, a, b, w in weighted if f == flow}
        d = distances(pairs, nodes, weights)
        for s, v in itertools.product(nodes, nodes):
            distance, before = got.get((flow, s, v), (None, None))
            assert distance == (None if d[s, v] == float("inf") else d[s, v])
            if distance is not None and s != v:
                assert d[s, before] + weights[before, v] == distance
                path = [v]
                while path[-1] != s:
                    path.append(got[flow, s, path[-1]][1])
                    assert len(path) <= len(nodes)


def test_negative_weight_is_an_error(spark):
    df = spark.createDataFrame([("f", 1, 2, -1)], SCHEMA + ", w long")
    sources = spark.createDataFrame([("f", 1)], "flow_id string, source int")
    with pytest.raises(PySparkException, match="negative edge weight"):
        graph.shortest_paths(df, sources, "w").collect()


DOT = """digraph %s {
  1 [label = "11_AA01"];
  2 [label = "22_AA02"];
  3 [label = "33_AA03"];
  4 [label = "44_AA04"];
  not a graph line
  1 -> 2;
  1 -> 3;
  2 -> 4;
  3 -> 4;
}
"""


def test_dot(spark, tmp_path):
    """Two graphs of the same name, told apart by their files, with line ends of either system."""
    (tmp_path / "G.txt").write_text(DOT % "G")
    (tmp_path / "H.txt").write_bytes((DOT % "G").replace("\n", "\r\n").encode())
    lines = read_numbered_dot(spark, str(tmp_path))
    assert sorted(map(tuple, read_dot(spark, str(tmp_path)).collect())) == sorted((r.flow_id, r.line) for r in lines.filter("line <> ''").collect())
    vertices = {(r.flow_id, r.node, r.stage, r.step_id) for r in dot_vertices(lines).collect()}
    assert vertices == {(g, str(n), 11 * n, f"AA0{n}") for g in "GH" for n in (1, 2, 3, 4)}
    full = {(g, a, b) for g in "GH" for a, b in ((11, 22), (11, 33), (22, 44), (33, 44))}
    assert {tuple(r) for r in dot_edges(lines).collect()} == full
    assert {tuple(r) for r in dot_edges(lines, last_line_wins=True).collect()} == full - {(g, 11, 22) for g in "GH"}


def test_order_of_lines_in_files_of_many_splits(spark, tmp_path):
    """The last line of each node counts, in a file that many tasks read."""
    rng = random.Random(6)
    lines = ["digraph G {", *(f'  {n} [label = "{n}_{n:04X}"];' for n in range(200))]
    last = {}
    for _ in range(5000):
        node, targets = rng.randrange(200), sorted({rng.randrange(200) for _ in range(3)})
        last[node] = targets
        lines.append(f"  {node} -> {' '.join(map(str, targets))};")
    (tmp_path / "G.txt").write_text("\n".join([*lines, "}"]) + "\n")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        read = read_numbered_dot(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 8
        got = {tuple(r) for r in dot_edges(read, last_line_wins=True).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got == {("G", node, target) for node, targets in last.items() for target in targets}


def test_dot_with_many_targets(spark):
    lines = [("G", 0, ' 1 [label = "5_A"];'), ("G", 1, ' 2 [label = "6_B"];'), ("G", 2, ' 3 [label = "7_C"];'), ("G", 3, " 1 -> 2 \t3 ;")]
    df = spark.createDataFrame(lines, "flow_id string, line_no int, line string")
    assert {tuple(r) for r in dot_edges(df).collect()} == {("G", 5, 6), ("G", 5, 7)}
