"""Helpers shared by the training-data operators: tables in the shared folder, components, ids."""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from intentdeck.shared import discard, materialize, shared_dir

__all__ = ["connected_components", "discard", "forest", "groups_of", "materialize", "read_table", "release", "shared_dir"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that ended: it does so when the driver's JVM collects what referred to them."""
    gc.collect()
    spark._jvm.System.gc()


#: A key that one in HOT_SHARE rows has is hot (so at most so many are): its rows are dealt to SALTS tasks.
HOT_SHARE, SALTS = 200, 64


def hot_keys(counts: DataFrame, on: list[str], rows: int) -> DataFrame:
    """(on..., salts) of the hot keys, at most HOT_SHARE rows, from a table of one row a key with its number of ``records`` of all ``rows``."""
    return counts.where(F.col("records") >= max(SALTS, rows / HOT_SHARE)).select(*on, F.lit(SALTS).cast("long").alias("salts"))


def join_spread(records: DataFrame, single: DataFrame, hot: DataFrame, by: list[str], how: str) -> DataFrame:
    """records joined with single, a table of one row a key, on the keys of hot; what is hot meets copies of that row in SALTS tasks, dealt by the columns ``by``."""
    on = [c for c in hot.columns if c != "salts"]
    hot = F.broadcast(hot)
    salt = F.coalesce(F.pmod(F.xxhash64(*by), F.col("salts")), F.lit(0).cast("long"))
    dealt = records.join(hot, on, "left").withColumn("salt", salt).drop("salts")
    every = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1).cast("long")) - 1)
    copies = single.join(hot, on, "left").withColumn("salt", F.explode(every)).drop("salts")
    return dealt.join(copies, [*on, "salt"], how).drop("salt")


def forest(n: int, pairs: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """The edges (node, root) of a spanning forest of pairs over range(n)."""
    up = list(range(n))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in range(n) if top(x) != x]


def groups_of(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 4096) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Whole groups of a stream that is sorted by its first ``keys`` columns, at least ``rows`` rows at a time: the rows and each group's (first, end).

    Holds one group and one batch, whatever the length of the stream.
    """
    import numpy as np

    held: list[pa.RecordBatch] = []

    def bounds(t: pa.Table) -> list[int]:
        new = np.zeros(max(0, t.num_rows - 1), bool)
        for k in range(keys):
            c = t.column(k).to_numpy()
            new |= c[1:] != c[:-1]
        return [0, *(np.nonzero(new)[0] + 1).tolist()]

    for b in batches:
        if b.num_rows:
            held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            t = pa.Table.from_batches(held).combine_chunks()
            first = bounds(t)
            if len(first) > 1:
                yield t.slice(0, first[-1]), list(zip(first[:-1], first[1:], strict=True))
            rest = t.slice(first[-1])
            held = rest.to_batches()
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        first = bounds(t)
        yield t, list(zip(first, [*first[1:], t.num_rows], strict=True))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for an undirected edge table (a, b) of longs; component is the smallest node reachable.

    In a round every node hooks on to the least of itself and its neighbours, in an order that a hash deals anew each round, and then
    on to what that one hooked on to; edges within a tree vanish and the rest join the trees. At least each node that is not the least of its
    neighbourhood goes, so rounds end by themselves, for chains and stars alike after about log(n) of them. Tables are written to the shared
    folder; joins read written tables on both sides, so that Spark can split the rows of a hub. Nodes without an edge to another node do not appear;
    null ends are ignored.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc")
    hooks: list[DataFrame] = []
    while not e.isEmpty():
        turn = F.lit(len(hooks))
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", turn).alias("h"), "b")).alias("m"))
        up = materialize(least.select("a", F.least(F.struct(F.xxhash64("a", turn).alias("h"), F.col("a").alias("b")), "m")["b"].alias("up")), "cc")
        root = materialize(up.join(up.select(F.col("a").alias("up"), F.col("up").alias("root")), "up").select("a", "root"), "cc")
        discard(up)
        left = e.join(root.withColumnRenamed("root", "x"), "a").join(root.select(F.col("a").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        rest = materialize(left.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "cc")
        discard(e)
        e = rest
        hooks.append(root)
    discard(e)
    if not hooks:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    nodes = hooks[0].withColumnRenamed("a", "node")
    for h in hooks[1:]:
        nodes = nodes.join(h.select(F.col("a").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    nodes = materialize(nodes, "cc")
    low = materialize(nodes.groupBy("root").agg(F.min("node").alias("component")), "cc")
    out = materialize(nodes.join(low, "root").select("node", "component"), "components")
    for t in (nodes, low, *hooks):
        discard(t)
    return out
