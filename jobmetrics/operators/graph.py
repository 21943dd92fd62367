"""Graph questions over the edges of all flows at once.

Edges are rows (flow_id, src_stage, dest_stage). Each algorithm is a loop of joins and aggregations. A round writes what
is still open to the shared folder and removes what the round before wrote; the rows of flows in which nothing
changes any more go to a result folder and take no part in later rounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from jobmetrics.operators.skew import lookup, rank_in_slices
from jobmetrics.runtime import Stage

EDGE = ["flow_id", "src_stage", "dest_stage"]
RANK_SLICE = 100_000


class Settled:
    """Rows that are final, written round by round into one folder and read once at the end, with the round as a column."""

    def __init__(self, stage: Stage, name: str, round_column: str = "_round"):
        self.stage, self.root, self.column, self.schema = stage, f"{stage.root}/{name}", round_column, None

    def add(self, round_: int, rows: DataFrame) -> None:
        self.schema = self.schema or rows.schema
        rows.write.parquet(f"{self.root}/{self.column}={round_}")

    def read(self) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField(self.column, IntegerType())])
        return self.stage.spark.read.schema(schema).parquet(self.root)


class CycleError(ValueError):
    pass


def vertices(edges: DataFrame) -> DataFrame:
    """Distinct (flow_id, stage) of both ends."""
    ends = F.explode(F.array("src_stage", "dest_stage"))
    return edges.select("flow_id", ends.alias("stage")).distinct()


def _targets(edges: DataFrame) -> DataFrame:
    return edges.select("flow_id", F.col("dest_stage").alias("src_stage")).distinct()


def _watched(stage: Stage, name: str, df: DataFrame, *kept: str, **counts: Column) -> tuple[DataFrame, dict]:
    """Write a table (in a folder for each value of the ``kept`` columns), and count some of its rows on the way."""
    seen = Observation()
    path = stage.paths[name] = f"{stage.root}/{name}"
    watched = df.observe(seen, *[F.count_if(condition).alias(key) for key, condition in counts.items()])
    watched.write.partitionBy(*kept).parquet(path)
    return stage.spark.read.schema(df.schema).parquet(path), seen.get


def _chains(hops: DataFrame, stage: Stage) -> DataFrame:
    """Vertices with one way in and one way out: (flow_id, stage, head, distance), the head being the nearest vertex before it
    that is not one of them. Pointer doubling: a run of n vertices takes log2(n) rounds. A ring of them is an error."""
    ways_in = hops.groupBy("flow_id", F.col("dest_stage").alias("stage")).agg(F.count(F.lit(1)).alias("n"), F.min("src_stage").alias("head"))
    ways_out = hops.groupBy("flow_id", F.col("src_stage").alias("stage")).agg(F.count(F.lit(1)).alias("m"))
    inner = ways_in.where("n = 1").join(ways_out.where("m = 1"), ["flow_id", "stage"]).select("flow_id", "stage", "head")
    inner = stage.put("inner", inner)
    known = inner.select("flow_id", F.col("stage").alias("head"), F.lit(True).alias("open"))
    first = inner.join(known, ["flow_id", "head"], "left").select("flow_id", "stage", "head", F.lit(1).cast("bigint").alias("distance"), F.coalesce("open", F.lit(False)).alias("open"))
    chains, seen = _watched(stage, "chain-0", first, open=F.col("open"), rows=F.lit(True))
    r = 0
    while seen["open"]:
        if 1 << r > seen["rows"]:
            raise CycleError("the edges contain a cycle")
        before = chains.select("flow_id", F.col("stage").alias("head"), F.col("head").alias("_head"), F.col("distance").alias("_distance"), F.col("open").alias("_open"))
        # Those that have their head meet nothing.
        joined = chains.withColumn("_at", F.when(F.col("open"), F.col("head"))).join(before.withColumnRenamed("head", "_at"), ["flow_id", "_at"], "left")
        moved = joined.select(
            "flow_id",
            "stage",
            F.coalesce("_head", "head").alias("head"),
            (F.col("distance") + F.coalesce("_distance", F.lit(0))).alias("distance"),
            (F.col("open") & F.coalesce("_open", F.lit(False))).alias("open"),
        )
        r += 1
        chains, seen = _watched(stage, f"chain-{r}", moved, open=F.col("open"), rows=F.lit(True))
        stage.drop(f"chain-{r - 1}")
    stage.drop("inner")
    return chains.drop("open")


def dag_levels(edges: DataFrame) -> DataFrame:
    """Longest-path level of each vertex (flow_id, stage, level); vertices without incoming edges have level 0. A cycle is an error.

    Runs of vertices with one way in and one way out become one edge as long as the run (``_chains``). On what is left, a round
    settles the vertices that no edge leads to any more and takes their edges away, in one write; so the rounds are as many as
    the branchings on a path, not its steps. Then the runs get their levels from their heads.
    """
    stage = Stage(edges.sparkSession, "levels")
    hops = stage.put("hops", edges.select(*EDGE).distinct())
    chains = _chains(hops, stage)
    inner = chains.select("flow_id", F.col("stage").alias("dest_stage"))
    runs = chains.select("flow_id", F.col("stage").alias("src_stage"), "head", "distance")
    ends = hops.join(inner, ["flow_id", "dest_stage"], "left_anti").join(runs, ["flow_id", "src_stage"], "left")
    kind = hops.schema["src_stage"].dataType
    columns = ["flow_id", "src_stage", "dest_stage", "value", "kind"]
    left = ends.groupBy("flow_id", F.coalesce("head", "src_stage").cast(kind).alias("src_stage"), "dest_stage").agg(
        F.max(F.coalesce("distance", F.lit(0)) + 1).alias("value")
    )
    left = stage.put("left", left)
    ready = left.select("flow_id", "src_stage").distinct().join(_targets(left), ["flow_id", "src_stage"], "left_anti")
    ready = ready.select("flow_id", "src_stage", F.lit(None).cast(kind).alias("dest_stage"), F.lit(0).cast("bigint").alias("value"), F.lit("ready").alias("kind"))
    written, seen = _watched(stage, "rounds/at=0", left.withColumn("kind", F.lit("edge")).select(*columns).unionByName(ready), "kind", edges=F.col("kind") == "edge", ready=F.col("kind") == "ready")
    r = 0
    while seen["edges"]:
        if not seen["ready"]:
            raise CycleError("the edges contain a cycle")
        left, ready = written.where("kind = 'edge'"), written.where("kind = 'ready'").select("flow_id", "src_stage", F.col("value").alias("level"))
        followed = left.join(ready, ["flow_id", "src_stage"], "left")
        rest = followed.where("level is null").select(*columns)
        offers = followed.where("level is not null").select("flow_id", F.col("dest_stage").alias("src_stage"), (F.col("level") + F.col("value")).alias("value"))
        offers = offers.unionByName(written.where("kind = 'open'").select("flow_id", "src_stage", "value"))
        offers = offers.groupBy("flow_id", "src_stage").agg(F.max("value").alias("value"))
        still = _targets(rest).withColumn("_still", F.lit(True))
        vertices_ = offers.join(still, ["flow_id", "src_stage"], "left")
        state = F.when(F.col("_still").isNull(), "ready").otherwise("open").alias("kind")
        step = rest.unionByName(vertices_.select("flow_id", "src_stage", F.lit(None).cast(kind).alias("dest_stage"), "value", state))
        r += 1
        written, seen = _watched(stage, f"rounds/at={r}", step, "kind", edges=F.col("kind") == "edge", ready=F.col("kind") == "ready")
        for part in ("edge", "open"):
            stage.paths["gone"] = f"{stage.root}/rounds/at={r - 1}/kind={part}"
            stage.drop("gone")
    stage.drop("left", "hops")
    levels = stage.spark.read.schema(written.schema).parquet(f"{stage.root}/rounds")
    levels = levels.where("kind = 'ready'").select("flow_id", F.col("src_stage").alias("stage"), F.col("value").alias("level"))
    spread = lookup(chains.withColumnRenamed("stage", "_stage").withColumnRenamed("head", "stage"), levels, ["flow_id", "stage"])
    spread = spread.select("flow_id", F.col("_stage").alias("stage"), (F.col("level") + F.col("distance")).alias("level"))
    return levels.unionByName(spread).select("flow_id", "stage", F.col("level").cast("int").alias("level"))


def topo_order(edges: DataFrame) -> DataFrame:
    """Position of each vertex in a topological order of its flow: by level, then stage. A cycle is an error."""
    leveled = dag_levels(edges).withColumn("_slice", F.floor(F.col("stage") / RANK_SLICE))
    return rank_in_slices(leveled, ["flow_id"], ["level", "_slice"], ["stage"], "position").drop("_slice")


def _core(edges: DataFrame, stage: Stage, name: str) -> tuple[DataFrame, int]:
    """Written edges without those that lead from or to a dead end, pruned over and over."""
    left, size, r = edges, edges.count(), 0
    while size:
        sources = left.select("flow_id", F.col("src_stage").alias("dest_stage")).distinct()
        kept = lookup(left, _targets(left), ["flow_id", "src_stage"], "left_semi")
        kept = stage.put(f"{name}-{r}", lookup(kept, sources, ["flow_id", "dest_stage"], "left_semi").select(*EDGE))
        kept_size = kept.count()
        if r:
            stage.drop(f"{name}-{r - 1}")
        r += 1
        left, before, size = kept, size, kept_size
        if before == size:
            break
    return left, size


def acyclic_flows(edges: DataFrame) -> DataFrame:
    """Rows (flow_id, is_acyclic); an edge from a vertex to itself is a cycle too."""
    stage = Stage(edges.sparkSession, "acyclic")
    edges = stage.put("edges", edges.select(*EDGE).distinct())
    core, size = _core(edges, stage, "core")
    every = edges.select("flow_id").distinct()
    if not size:
        return every.withColumn("is_acyclic", F.lit(True))
    cyclic = core.select("flow_id").distinct().withColumn("is_acyclic", F.lit(False))
    return every.join(cyclic, "flow_id", "left").withColumn("is_acyclic", F.coalesce("is_acyclic", F.lit(True)))


def _settle(state: DataFrame, settled: Settled, stage: Stage, name: str, r: int) -> tuple[DataFrame, bool]:
    """Rows of flows without a new row go to the result; the others are the state of the next round, if there are any."""
    written = stage.put(f"{name}-{r}", state)
    busy = written.filter("_new").select("flow_id").distinct()
    settled.add(r, lookup(written, busy.withColumn("_busy", F.lit(True)), ["flow_id"], "left").filter("_busy is null").drop("_busy", "_new"))
    if busy.isEmpty():
        return written, False
    open_ = stage.put(f"{name}-{r}-open", lookup(written, busy, ["flow_id"], "left_semi"))
    stage.drop(f"{name}-{r}")
    return open_, True


def _spread(state: DataFrame, edges: DataFrame, better: Column, value: str, stage: Stage, name: str) -> DataFrame:
    """Push ``value`` along the edges until no vertex improves. Only improved vertices push in the next round."""
    settled = Settled(stage, name)
    state, r = state.withColumn("_new", F.lit(True)), 0
    while True:
        frontier = state.filter("_new").drop("_new")
        offers = (
            lookup(edges, frontier.withColumnRenamed("stage", "src_stage"), ["flow_id", "src_stage"])
            .groupBy("flow_id", F.col("dest_stage").alias("stage"))
            .agg(F.max(value).alias("_offer"))
        )
        joined = state.drop("_new").join(offers, ["flow_id", "stage"], "left")
        improved = F.coalesce(better, F.lit(False))
        moved = joined.select(
            "flow_id", "stage", F.when(improved, F.col("_offer")).otherwise(F.col(value)).alias(value), improved.alias("_new")
        )
        state, more = _settle(moved, settled, stage, f"{name}-state", r)
        if r:
            stage.drop(f"{name}-state-{r - 1}-open")
        if not more:
            stage.drop(f"{name}-state-{r}")
            return settled.read().drop("_round")
        r += 1


def cycle_steps(edges: DataFrame) -> DataFrame:
    """Vertices that lie on a cycle of at least two, as (flow_id, stage, cycle_id).

    cycle_id is the largest vertex of the strongly connected component. The pruned edges are coloured with the
    largest vertex that reaches each vertex; a vertex with its own colour is a root, and what reaches the root
    inside its colour is the root's component. Components are taken out and the rest goes into the next round.
    """
    stage = Stage(edges.sparkSession, "cycles")
    proper = stage.put("edges", edges.select(*EDGE).filter("src_stage <> dest_stage").distinct())
    found = Settled(stage, "found")
    core, size = _core(proper, stage, "core0")
    r = 0
    while size:
        start = vertices(core).withColumn("color", F.col("stage"))
        colored = _spread(start, core, F.col("_offer") > F.col("color"), "color", stage, f"color{r}")
        src = colored.select("flow_id", F.col("stage").alias("src_stage"), F.col("color").alias("_src_color"))
        dest = colored.select("flow_id", F.col("stage").alias("dest_stage"), F.col("color").alias("_dest_color"))
        same = core.join(src, ["flow_id", "src_stage"]).join(dest, ["flow_id", "dest_stage"])
        backward = stage.put(
            f"backward{r}",
            same.filter("_src_color = _dest_color").select(
                "flow_id", F.col("dest_stage").alias("src_stage"), F.col("src_stage").alias("dest_stage")
            ),
        )
        marks = colored.withColumn("mark", F.when(F.col("stage") == F.col("color"), 1).otherwise(0))
        unmarked = (F.col("_offer") == 1) & (F.col("mark") == 0)
        reached = _spread(marks.select("flow_id", "stage", "mark"), backward, unmarked, "mark", stage, f"mark{r}").filter("mark = 1")
        members = reached.join(colored, ["flow_id", "stage"]).select("flow_id", "stage", F.col("color").alias("cycle_id"))
        members = stage.put(f"members{r}", members)
        found.add(r, members)
        gone = members.select("flow_id", "stage")
        rest = core.join(gone.withColumnRenamed("stage", "src_stage"), ["flow_id", "src_stage"], "left_anti")
        rest = rest.join(gone.withColumnRenamed("stage", "dest_stage"), ["flow_id", "dest_stage"], "left_anti")
        r += 1
        core, size = _core(stage.put(f"rest{r}", rest.select(*EDGE)), stage, f"core{r}")
        stage.drop(f"backward{r - 1}", f"members{r - 1}")
    if not r:
        return vertices(proper).withColumn("cycle_id", F.col("stage")).limit(0)
    components = found.read().drop("_round")
    several = components.groupBy("flow_id", "cycle_id").count().filter("count > 1").drop("count")
    return components.join(several, ["flow_id", "cycle_id"], "left_semi").select("flow_id", "stage", "cycle_id")


def components(edges: DataFrame) -> DataFrame:
    """Connected components without regard to direction: (flow_id, stage, component), named by the smallest vertex.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each links neighbours to the smallest
    vertex around, and the number of rounds grows with the logarithm of the size, not with the diameter.
    """
    stage = Stage(edges.sparkSession, "components")
    edges = stage.put("edges", edges.select(*EDGE).distinct())
    high, low = F.greatest("src_stage", "dest_stage"), F.least("src_stage", "dest_stage")
    pairs = edges.select("flow_id", high.alias("u"), low.alias("v")).filter("u <> v").distinct()

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        """Neighbours above (large) or not above (small) each vertex are linked to the smallest vertex around it."""
        ends = F.struct(F.col("u").alias("at"), F.col("v").alias("other"))
        if large:
            back = F.struct(F.col("v").alias("at"), F.col("u").alias("other"))
            around = pairs.select("flow_id", F.explode(F.array(ends, back)).alias("e")).select("flow_id", "e.*")
        else:
            around = pairs.select("flow_id", ends.alias("e")).select("flow_id", "e.*")
        least = around.groupBy("flow_id", "at").agg(F.least(F.min("other"), F.col("at")).alias("low"))
        joined = lookup(around, least, ["flow_id", "at"])
        if large:
            linked = joined.filter("other > at").select("flow_id", F.col("other").alias("u"), F.col("low").alias("v"))
        else:
            own = F.array("other", "at")
            linked = joined.select("flow_id", F.explode(own).alias("u"), F.col("low").alias("v"))
        return linked.filter("u <> v").distinct()

    settled = Settled(stage, "settled")
    r = 0
    while True:
        # Each pair with whether it is there before the round, after it, or both: a flow in which none is there once is done.
        after = star(star(pairs, large=True), large=False).withColumn("_after", F.lit(True))
        both = pairs.withColumn("_before", F.lit(True)).join(after, ["flow_id", "u", "v"], "full_outer")
        marked = both.select("flow_id", "u", "v", F.col("_after").isNotNull().alias("_kept"), (F.col("_before").isNull() | F.col("_after").isNull()).alias("_new"))
        open_, more = _settle(marked, settled, stage, "pairs", r)
        if r:
            stage.drop(f"pairs-{r - 1}-open")
        if not more:
            stage.drop(f"pairs-{r}")
            break
        pairs = open_.filter("_kept").select("flow_id", "u", "v")
        r += 1
    lows = settled.read().select("flow_id", F.col("u").alias("stage"), F.col("v").alias("low"))
    return (
        vertices(edges)
        .join(lows, ["flow_id", "stage"], "left")
        .select("flow_id", "stage", F.coalesce("low", "stage").alias("component"))
    )


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str | None = None) -> DataFrame:
    """Distance and predecessor of every vertex that can be reached from a source of its flow; the source itself is at 0.

    ``sources`` has flow_id and source; one that no edge has is left out. Without ``weight`` each edge counts 1; a
    negative weight is an error. Of several shortest paths the one with the fewest edges counts, then the smallest
    predecessor. Rounds only follow vertices whose distance improved.
    """
    stage = Stage(edges.sparkSession, "paths")
    length = F.lit(1).cast("bigint") if weight is None else F.col(weight)
    checked = F.when(length < 0, F.raise_error(F.lit("negative edge weight"))).otherwise(length)
    hops = stage.put("hops", edges.select(*EDGE, checked.alias("_length")).groupBy(*EDGE).agg(F.min("_length").alias("_length")))
    keys = ["flow_id", "source", "stage"]
    zero = F.lit(0).cast(hops.schema["_length"].dataType)
    start = sources.select("flow_id", "source", F.col("source").alias("stage")).distinct()
    start = start.join(vertices(hops), ["flow_id", "stage"], "left_semi").select(*keys)
    best = F.struct(zero.alias("distance"), F.lit(0).alias("edges"), F.lit(None).cast("int").alias("predecessor"))
    state = stage.put("start", start.select(*keys, best.alias("best"), F.lit(True).alias("_new")))
    settled = Settled(stage, "settled")
    r = 0
    while True:
        frontier = state.filter("_new").drop("_new")
        offers = (
            frontier.withColumnRenamed("stage", "src_stage")
            .join(hops, ["flow_id", "src_stage"])
            .select(
                "flow_id",
                "source",
                F.col("dest_stage").alias("stage"),
                F.struct(
                    (F.col("best.distance") + F.col("_length")).alias("distance"),
                    (F.col("best.edges") + 1).alias("edges"),
                    F.col("src_stage").alias("predecessor"),
                ).alias("offer"),
            )
            .groupBy(*keys)
            .agg(F.min("offer").alias("offer"))
        )
        joined = state.drop("_new").join(offers, keys, "full_outer")
        improved = F.col("best").isNull() | F.coalesce(F.col("offer") < F.col("best"), F.lit(False))
        moved = joined.select(*keys, F.when(improved, F.col("offer")).otherwise(F.col("best")).alias("best"), improved.alias("_new"))
        state, more = _settle(moved, settled, stage, "state", r)
        if r:
            stage.drop(f"state-{r - 1}-open")
        if not more:
            stage.drop(f"state-{r}", "hops", "start")
            return settled.read().select(*keys, "best.distance", "best.predecessor")
        r += 1


def all_distances(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """``shortest_paths`` from every vertex: (flow_id, source, stage, distance, predecessor) of all pairs of which one reaches the other.

    A flow of n vertices gives up to n^2 rows, spread over as many tasks as there are partitions; pass the flows that are wanted.
    """
    return shortest_paths(edges, vertices(edges).withColumnRenamed("stage", "source"), weight)
