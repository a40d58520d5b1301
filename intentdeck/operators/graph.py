"""The narrative graph: traversal, narratives, degrees, topological levels and replay plans over an edge table (from_id, to_id, relation, weight)."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from intentdeck.functions.text import substitute_vars
from intentdeck.schemas import OUTCOME, CycleDetected, NodeNotFound
from intentdeck.shared import discard, materialize


def _bfs(edges: DataFrame, start: int, depth: int, src: str, dst: str) -> DataFrame:
    # only nodes are carried; a level is one join of the frontier with the edges and one anti-join
    steps = edges.select(F.col(src).alias("node"), F.col(dst).alias("next"))
    return _levels(edges.sparkSession, lambda frontier: steps.join(frontier, "node", "left_semi").select("next"), start, depth)


def _levels(spark: SparkSession, step: Callable[[DataFrame], DataFrame], start: int, depth: int) -> DataFrame:
    """(node, depth) of what depth steps reach; step gives the nodes (next) that follow those of a frontier (node)."""
    seen = materialize(spark.createDataFrame([(start, 0)], "node long, depth int"), "bfs")
    for level in range(1, depth + 1):
        frontier = seen.where(F.col("depth") == level - 1)
        new = step(frontier.select("node")).select(F.col("next").alias("node")).distinct().join(seen, "node", "left_anti")
        grown = materialize(seen.unionByName(new.withColumn("depth", F.lit(level))), "bfs")
        discard(seen)
        seen = grown
        if seen.where(F.col("depth") == level).isEmpty():
            break
    return seen


def bfs_forward(edges: DataFrame, start: int, depth: int) -> DataFrame:
    """(node, depth): nodes within depth steps, start included even if unknown; depth is the fewest steps."""
    return _bfs(edges, start, depth, "from_id", "to_id")


def bfs_backward(edges: DataFrame, start: int, depth: int) -> DataFrame:
    return _bfs(edges, start, depth, "to_id", "from_id")


#: Makes the edges that begin, or that end, in the nodes (node) of a table.
Edges = Callable[[DataFrame], DataFrame]


def bfs_forward_by(edges_from: Edges, spark: SparkSession, start: int, depth: int) -> DataFrame:
    """bfs_forward() where edges are made as they are asked for: edges_from gives those that begin in the nodes (node) of a frontier."""
    return _levels(spark, lambda frontier: edges_from(frontier).select(F.col("to_id").alias("next")), start, depth)


def bfs_backward_by(edges_to: Callable[[DataFrame], DataFrame], spark: SparkSession, start: int, depth: int) -> DataFrame:
    """bfs_backward() where edges are made as they are asked for: edges_to gives those that end in the nodes (node) of a frontier."""
    return _levels(spark, lambda frontier: edges_to(frontier).select(F.col("from_id").alias("next")), start, depth)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("from_id", "to_id").unionByName(edges.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id")))


def narrative_nodes(edges: DataFrame, root: int, depth: int) -> DataFrame:
    """(node, depth) of the undirected neighbourhood."""
    return _bfs(_both_ways(edges), root, depth, "from_id", "to_id")


def narrative_nodes_by(edges_from: Edges, edges_to: Edges, spark: SparkSession, root: int, depth: int) -> DataFrame:
    """narrative_nodes() where edges are made as they are asked for."""
    return _levels(spark, lambda frontier: edges_from(frontier).select(F.col("to_id").alias("next")).unionByName(edges_to(frontier).select(F.col("from_id").alias("next"))), root, depth)


def narrative_edges(edges: DataFrame, root: int, depth: int, distinct: bool = False) -> DataFrame:
    """All out-edges and all in-edges of every node within depth - 1 steps: an edge between two of them appears twice."""
    inner = narrative_nodes(edges, root, depth).where(F.col("depth") < depth).select("node")
    out = edges.join(inner, edges["from_id"] == inner["node"], "left_semi").unionByName(edges.join(inner, edges["to_id"] == inner["node"], "left_semi"))
    return out.distinct() if distinct else out


def narrative_edges_by(edges_from: Edges, edges_to: Edges, spark: SparkSession, root: int, depth: int, distinct: bool = False) -> DataFrame:
    """narrative_edges() where edges are made as they are asked for."""
    inner = narrative_nodes_by(edges_from, edges_to, spark, root, max(0, depth - 1)).where(F.col("depth") < depth).select("node")
    out = edges_from(inner).unionByName(edges_to(inner))
    return out.distinct() if distinct else out


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in nodes (node)."""
    n = nodes.select("node").distinct()
    return edges.join(n.withColumnRenamed("node", "from_id"), "from_id", "left_semi").join(n.withColumnRenamed("node", "to_id"), "to_id", "left_semi").select(*edges.columns)


def successors(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("from_id") == node).select(F.col("to_id").alias("node"), "relation", "weight")


def predecessors(edges: DataFrame, node: int) -> DataFrame:
    return edges.where(F.col("to_id") == node).select(F.col("from_id").alias("node"), "relation", "weight")


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return counts_with(nodes, edges.agg(F.count("*").alias("edges")))


def counts_with(nodes: DataFrame, edge_count: DataFrame) -> DataFrame:
    """counts() with a row (edges) that already says how many edges there are."""
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(edge_count)


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("from_id").alias("node")).agg(F.count("*").alias("degree"))


def in_degree(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, degree) of every node, 0 included; multi-edges count each time."""
    d = edges.groupBy(F.col("to_id").alias("node")).agg(F.count("*").alias("degree"))
    return nodes.select("node").join(d, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def upsert_nodes(nodes: DataFrame, new: DataFrame, order: str = "seq") -> DataFrame:
    """nodes with those of new in their place; of rows of one node in new the one with the largest ``order`` counts. Columns of nodes."""
    rest = [c for c in nodes.columns if c != "node"]
    last = new.groupBy("node").agg(F.max_by(F.struct(*rest), order).alias("row")).select("node", *[F.col("row")[c].alias(c) for c in rest])
    return nodes.join(last, "node", "left_anti").unionByName(last)


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges are appended as they are: several between two nodes, unknown nodes and cycles included."""
    return edges.unionByName(new.select(*edges.columns))


def csr_offsets(nodes: DataFrame, edges: DataFrame, width: int | None = None) -> DataFrame:
    """(node, row_start, row_end): exclusive running sums of out-degrees in node order.

    Sums run within ranges of ids; only the ranges' totals go through one ordered window. Without ``width`` a range is as wide as there are ranges
    (4096 ids at least), so that neither a range nor the window grows with more than the root of the ids.
    """
    if width is None:
        low, high = nodes.agg(F.min("node"), F.max("node")).first()
        width = max(4096, math.isqrt(0 if low is None else high - low) + 1)
    d = nodes.select("node").join(out_degree(edges), "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"), F.floor(F.col("node") / width).alias("range"))
    totals = d.groupBy("range").agg(F.sum("degree").alias("total"))
    before = totals.select("range", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.sum("degree").over(Window.partitionBy("range").orderBy("node"))
    end = (F.col("before") + F.col("inside")).alias("row_end")
    return d.withColumn("inside", inside).join(before, "range").select("node", (F.col("before") + F.col("inside") - F.col("degree")).alias("row_start"), end)


def topological_levels(nodes: DataFrame, edges: DataFrame, fail: bool = True) -> DataFrame:
    """(node, level): the longest path to each node of the graph induced by nodes. A cycle raises, or with fail=False its nodes get level null."""
    e = materialize(induced(edges, nodes).select("from_id", "to_id"), "topo")
    left = materialize(nodes.select("node").distinct(), "topo")
    done = None
    level = 0
    while True:
        ready = left.join(e, left["node"] == e["to_id"], "left_anti")
        ready = materialize(ready.withColumn("level", F.lit(level)), "level")
        if ready.isEmpty():
            break
        done = ready if done is None else done.unionByName(ready)
        rest = materialize(left.join(ready, "node", "left_anti"), "topo")
        kept = materialize(e.join(ready.select(F.col("node").alias("from_id")), "from_id", "left_anti").select("from_id", "to_id"), "topo")
        discard(left)
        discard(e)
        left, e, level = rest, kept, level + 1
        if left.isEmpty():
            return done
    if left.isEmpty():
        return done if done is not None else left.withColumn("level", F.lit(0))
    if fail:
        raise CycleDetected(f"{left.count()} nodes are on or behind a cycle")
    rest = left.withColumn("level", F.lit(None).cast("int"))
    return rest if done is None else done.unionByName(rest)


def build_plan(nodes: DataFrame, edges: DataFrame, commands: DataFrame) -> DataFrame:
    """(level, intent_id, command, deps): steps of nodes in dependency order; a missing command is empty, deps repeat multi-edges."""
    levels = topological_levels(nodes, edges)
    deps = induced(edges, nodes).groupBy(F.col("to_id").alias("node")).agg(F.sort_array(F.collect_list("from_id")).alias("deps"))
    df = levels.join(deps, "node", "left").join(commands.select(F.col("id").alias("node"), "command"), "node", "left")
    return df.select("level", F.col("node").alias("intent_id"), F.coalesce("command", F.lit("")).alias("command"), F.coalesce("deps", F.array().cast("array<bigint>")).alias("deps"))


def replay(nodes: DataFrame, edges: DataFrame, commands: DataFrame, root: int, depth: int) -> DataFrame:
    """The plan of what root leads to within depth steps."""
    if nodes.where(F.col("node") == root).isEmpty():
        raise NodeNotFound(str(root))
    return build_plan(bfs_forward(edges, root, depth).select("node"), edges, commands)


def replay_by(nodes: DataFrame, edges_from: Edges, edges_to: Edges, commands: DataFrame, root: int, depth: int) -> DataFrame:
    """replay() where edges are made as they are asked for: those that steps follow, then those that end in what was reached."""
    if nodes.where(F.col("node") == root).isEmpty():
        raise NodeNotFound(str(root))
    reached = bfs_forward_by(edges_from, nodes.sparkSession, root, depth).select("node")
    return build_plan(reached, materialize(induced(edges_to(reached), reached), "edges"), commands)


def filter_completed(plan: DataFrame, completed: DataFrame) -> DataFrame:
    return plan.join(completed.select(F.col("id").alias("intent_id")), "intent_id", "left_anti").select(*plan.columns)


def dry_run(plan: DataFrame, completed: DataFrame, values: dict[str, str]) -> DataFrame:
    """The plan without completed steps, with variables filled in."""
    return filter_completed(plan, completed).withColumn("command", substitute_vars(F.col("command"), values))


def execute(plan: DataFrame, completed: DataFrame, values: dict[str, str] | None = None, executor=None) -> DataFrame:
    """The plan with skipped and outcome (status, latency_ns, exit_code) columns; no command is ever run in a shell.

    Completed steps are skipped with a successful outcome of latency 0. Others are Pending without an executor, else executor(command) gives
    (status, latency_ns, exit_code); it must be a pure function, as it runs in Python workers.
    """
    done = completed.select(F.col("id").alias("intent_id"), F.lit(True).alias("_done")).distinct()
    df = plan.withColumn("command", substitute_vars(F.col("command"), values or {})).join(done, "intent_id", "left")
    skipped = F.col("_done").isNotNull()

    def outcome(status: Column, latency: Column, code: Column) -> Column:
        return F.struct(status.cast("int").alias("status"), latency.cast("long").alias("latency_ns"), code.cast("int").alias("exit_code"))

    if executor is None:
        ran = outcome(F.lit(0), F.lit(0), F.lit(0))
    else:
        @F.pandas_udf(OUTCOME)
        def run(commands: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([executor(c) for c in commands], columns=["status", "latency_ns", "exit_code"])

        ran = run("command")
    return df.select(*plan.columns, skipped.alias("skipped"), F.when(skipped, outcome(F.lit(1), F.lit(0), F.lit(0))).otherwise(ran).alias("outcome"))


def narrative_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Extension: edges of narrative a that b does not have."""
    return a.exceptAll(b)
