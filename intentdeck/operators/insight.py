"""Mining: n-grams, next-command prediction, summaries, k-means and insights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from intentdeck.functions import vector as V
from intentdeck.schemas import DimensionMismatch

HOUR_NS = 3_600_000_000_000


def following(rows: DataFrame, steps: int, bucket: Column | None = None, command: str = "raw_command") -> DataFrame:
    """rows with next1..nextN: the commands after each in (ts_ns, id) order over all rows.

    Rows are ordered within buckets of time, and only the first rows of each bucket go through a global
    window to serve the bucket before, so no task sorts the whole table. bucket must rise with ts_ns.
    """
    bucket = F.floor(F.col("ts_ns") / HOUR_NS) if bucket is None else bucket
    w = Window.partitionBy("_b").orderBy("ts_ns", "id")
    df = rows.withColumn("_b", bucket).withColumn("_r", F.row_number().over(w))
    for k in range(1, steps + 1):
        df = df.withColumn(f"next{k}", F.lead(command, k).over(w))
    heads = df.where(F.col("_r") <= steps).select("_b", "_r", F.col(command).alias("_c"))
    everywhere = Window.orderBy("_b", "_r")
    last = F.row_number().over(Window.partitionBy("_b").orderBy(F.desc("_r"))) == 1
    after = heads.select("_b", *[F.lead("_c", k).over(everywhere).alias(f"_a{k}") for k in range(1, steps + 1)], last.alias("_l")).where("_l").drop("_l")
    size = F.count("*").over(Window.partitionBy("_b"))
    df = df.withColumn("_left", size - F.col("_r")).join(after, "_b", "left")
    for k in range(1, steps + 1):
        # the (k - left)-th command after the bucket
        beyond = F.element_at(F.array(*[F.col(f"_a{j}") for j in range(1, steps + 1)]), F.greatest(F.lit(1), F.lit(k) - F.col("_left")).cast("int"))
        df = df.withColumn(f"next{k}", F.when(F.col("_left") >= k, F.col(f"next{k}")).otherwise(beyond))
    return df.drop("_b", "_r", "_left", *[f"_a{k}" for k in range(1, steps + 1)])


def ngrams(rows: DataFrame, size: int, by_session: bool = False) -> DataFrame:
    """(commands, count) of runs of size commands: over all rows in time order, or (another question) within sessions."""
    if by_session:
        w = Window.partitionBy("session_id").orderBy("ts_ns", "id")
        df = rows
        for k in range(1, size):
            df = df.withColumn(f"next{k}", F.lead("raw_command", k).over(w))
    else:
        df = following(rows, size - 1)
    parts = ["raw_command", *[f"next{k}" for k in range(1, size)]]
    return df.where(F.col(parts[-1]).isNotNull()).groupBy(F.array(*parts).alias("commands")).agg(F.count("*").alias("count"))


def patterns(rows: DataFrame, min_count: int = 2, by_session: bool = False) -> DataFrame:
    """Pairs and triples seen at least min_count times; order by (count desc, length desc, commands) to present them."""
    both = ngrams(rows, 2, by_session).unionByName(ngrams(rows, 3, by_session))
    return both.where(F.col("count") >= min_count)


def predict_next(rows: DataFrame, history: list[str]) -> DataFrame:
    """(command, support, context): the commonest successor of the longest of the last 3, 2, 1 commands that has one; no row if none has.

    rows in (ts_ns, id) order are the corpus. Ties go to the smaller command.
    """
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "command string, support long, context int")
    if not history:
        return empty
    most = min(3, len(history))
    df = following(rows, most)
    found = None
    for c in range(most, 0, -1):
        cols = ["raw_command", *[f"next{k}" for k in range(1, c)]]
        same = F.lit(True)
        for name, want in zip(cols, history[-c:], strict=True):
            same &= F.col(name) == want
        got = df.where(same & F.col(f"next{c}").isNotNull()).groupBy(F.col(f"next{c}").alias("command")).agg(F.count("*").alias("support")).withColumn("context", F.lit(c))
        found = got if found is None else found.unionByName(got)
    return found.orderBy(F.desc("context"), F.desc("support"), "command").limit(1)


def summary_counts(rows: DataFrame) -> DataFrame:
    """total, succeeded (partial included), failed, pending (no outcome included), first and last ts_ns."""
    s = F.coalesce(F.col("status"), F.lit(0))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(F.count("*").alias("total"), n(s.isin(1, 3)).alias("succeeded"), n(s == 2).alias("failed"), n(s == 0).alias("pending"), F.min("ts_ns").alias("start_ns"), F.max("ts_ns").alias("end_ns"))


def top_commands(rows: DataFrame, k: int = 10) -> DataFrame:
    return rows.groupBy(F.col("raw_command").alias("command")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "command").limit(k)


def summary(rows: DataFrame) -> DataFrame:
    """One row: the counts, success rate in percent, seconds covered, the ten commonest commands and a text."""
    top = top_commands(rows).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), F.col("command").alias("c")))).alias("t")).select(F.transform("t", lambda x: F.struct(x["c"].alias("command"), (-x["n"]).alias("count"))).alias("top_commands"))
    df = summary_counts(rows).crossJoin(top)
    df = df.withColumn("success_rate", F.when(F.col("total") > 0, F.col("succeeded") * 100.0 / F.col("total")).otherwise(0.0)).withColumn("duration_s", F.coalesce((F.col("end_ns") - F.col("start_ns")) / 1e9, F.lit(0.0)))
    lines = F.array_join(F.transform(F.slice("top_commands", 1, 5), lambda t: F.format_string("\n  %s (%dx)", t["command"], t["count"])), "")
    text = F.concat(F.format_string("%d intents over %.1fs. Success rate: %.1f%% (%d ok, %d failed, %d pending).", "total", "duration_s", "success_rate", "succeeded", "failed", "pending"), F.when(F.size("top_commands") > 0, F.concat(F.lit("\nTop commands:"), lines)).otherwise(F.lit("")))
    return df.withColumn("text", F.when(F.col("total") == 0, F.lit("No intents to summarize.")).otherwise(text))


def kmeans(rows: DataFrame, start: list[list[float]], max_iter: int = 100) -> tuple[DataFrame, DataFrame, int, bool]:
    """Lloyd's algorithm from given centres over rows (id, v): (assignments (id, cluster), centres (cluster, v), update steps, converged).

    Stops when a pass changes no assignment; all rows start in cluster 0. Distance ties go to the lower cluster and an empty cluster
    keeps its centre. A pass is one scan that assigns each row under the centres of this pass and of the one before, and one aggregation of k x dimension sums; nothing is
    written between passes.
    """
    if not start or not start[0] or len({len(c) for c in start}) > 1:
        raise DimensionMismatch("centres must be at least one and of one dimension above 0")
    dim = len(start[0])
    shape = rows.agg(F.count("*"), F.coalesce(F.sum((F.size("v") != dim).cast("int")), F.lit(0))).first()
    if shape[0] < len(start) or shape[1]:
        raise DimensionMismatch(f"{len(start)} clusters of dimension {dim} over {shape[0]} rows, {shape[1]} of another dimension")
    centres = [list(map(float, c)) for c in start]

    def cluster(at: list[list[float]]) -> Column:
        d = F.array(*[V.l2_sq(F.col("v"), F.array(*[F.lit(x) for x in c])) for c in at])
        return (F.array_position(d, F.array_min(d)) - 1).cast("int")

    used, steps, converged = None, 0, False
    for _ in range(max_iter):
        was = F.lit(0) if used is None else cluster(used)
        used = [c[:] for c in centres]
        df = rows.select(cluster(used).alias("cluster"), was.alias("was"), "v").select("cluster", (F.col("cluster") != F.col("was")).alias("moved"), F.posexplode("v").alias("p", "x"))
        sums = df.groupBy("cluster", "p").agg(F.avg("x").alias("m"), F.max("moved").alias("moved")).collect()  # k x dimension rows
        if not any(r.moved for r in sums):
            converged = True
            break
        for r in sums:
            centres[r.cluster][r.p] = r.m
        steps += 1
    spark = rows.sparkSession
    return rows.select("id", (F.lit(0) if used is None else cluster(used)).alias("cluster")), spark.createDataFrame(list(enumerate(centres)), "cluster int, v array<double>"), steps, converged


def ordered_patterns(rows: DataFrame, min_count: int = 2) -> DataFrame:
    """patterns() by falling count, then the longer first, then by their commands."""
    return patterns(rows, min_count).orderBy(F.desc("count"), F.desc(F.size("commands")), F.concat_ws(" ", "commands"))


def pattern_insights(rows: DataFrame, min_count: int = 2) -> DataFrame:
    n = rows.agg(F.count("*").alias("n"))
    df = patterns(rows, min_count).crossJoin(n)
    return df.select(F.lit("pattern").alias("kind"), F.format_string("%s (%d times)", F.concat_ws(" -> ", "commands"), F.col("count")).alias("description"), F.least(F.col("count") / F.col("n"), F.lit(1.0)).alias("confidence"))


def cluster_insights(assignments: DataFrame, converged: bool) -> DataFrame:
    """An insight for each non-empty cluster, with its members in order."""
    g = assignments.groupBy("cluster").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("id")).alias("intent_ids"))
    return g.select(F.lit("failure_cluster").alias("kind"), F.format_string("Cluster %d: %d intents", "cluster", "size").alias("description"), F.lit(0.8 if converged else 0.5).alias("confidence"), "intent_ids")


def insights(rows: DataFrame, vectors: DataFrame, k: int = 5, min_count: int = 2, seed_ids: list[int] | None = None) -> DataFrame:
    """(kind, description, confidence) of patterns, the summary and clusters; empty without rows. k is cut to the number of vectors."""
    first = summary(rows).where("total > 0").select(F.lit("summary").alias("kind"), F.col("text").alias("description"), F.lit(1.0).alias("confidence"))
    out = pattern_insights(rows, min_count).unionByName(first)
    order = F.xxhash64("id") if seed_ids is None else F.array_position(F.array(*[F.lit(i) for i in seed_ids]), F.col("id"))
    pick = vectors if seed_ids is None else vectors.where(F.col("id").isin(seed_ids))
    start = [r[0] for r in pick.select("v", order.alias("o"), "id").orderBy("o", "id").limit(k).collect()]
    if start:
        a, _, _, converged = kmeans(vectors, start)
        out = out.unionByName(cluster_insights(a, converged).drop("intent_ids"))
    return out


def relation_inference(rows: DataFrame) -> DataFrame:
    """Extension: (from_id, to_id, relation) of temporal edges (1) between neighbours in a session, and retry edges (3) where the earlier failed and the command is the same."""
    w = Window.partitionBy("session_id").orderBy("ts_ns", "id")
    df = rows.select(F.lag("id").over(w).alias("from_id"), F.col("id").alias("to_id"), F.lag("status").over(w).alias("s"), (F.lag("raw_command").over(w) == F.col("raw_command")).alias("same")).where("from_id is not null")
    return df.select("from_id", "to_id", F.when((F.col("s") == 2) & F.col("same"), 3).otherwise(1).alias("relation"))
