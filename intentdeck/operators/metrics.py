"""Operational metrics: histograms, quantiles, rates, lock statistics, gauges and their text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the latency histogram in microseconds.
BOUNDS = (10, 50, 100, 250, 500, 1000, 2500, 5000, 10000, 50000)
#: Fixed value: nanoseconds of waiting from which a lock was contended.
CONTENDED_NS = 1000


def histogram(rows: DataFrame, value: str, bounds=BOUNDS, by: list[str] | None = None) -> DataFrame:
    """(by..., le, count): cumulative buckets; le null is +Inf. One aggregation whatever the number of bounds."""
    by = by or []
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)] + [F.count(value).alias("binf")]
    g = rows.groupBy(*by).agg(*counts)
    rows_ = [F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("count")) for i, b in enumerate(bounds)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("binf").alias("count"))]
    return g.select(*by, F.explode(F.array(*rows_)).alias("h")).select(*by, "h.le", "h.count")


def histogram_quantile(buckets: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """(by..., value): linear within the bucket that holds rank q; the last finite bound where that is +Inf, null without observations."""
    by = by or []
    w = Window.partitionBy(*by).orderBy(F.col("le").asc_nulls_last())
    df = buckets.withColumn("total", F.max("count").over(Window.partitionBy(*by))).withColumn("low", F.coalesce(F.lag("le").over(w), F.lit(0.0))).withColumn("under", F.coalesce(F.lag("count").over(w), F.lit(0)))
    rank = F.lit(q) * F.col("total")
    hit = df.where((F.col("total") > 0) & (F.col("count") >= rank)).withColumn("r", F.row_number().over(w)).where("r = 1")
    inside = F.col("count") - F.col("under")
    value = F.when(F.col("le").isNull(), F.col("low")).otherwise(F.col("low") + (F.col("le") - F.col("low")) * F.when(inside > 0, (rank - F.col("under")) / inside).otherwise(0.0))
    return hit.select(*by, value.alias("value"))


def lock_stats(rows: DataFrame, lock: str, wait_ns: Column, hold_ns: Column) -> DataFrame:
    return rows.groupBy(F.col(lock).alias("lock")).agg(
        F.count("*").alias("acquisitions"),
        F.count_if(wait_ns > CONTENDED_NS).alias("contended"),
        F.sum(wait_ns).cast("long").alias("wait_sum_ns"),
        F.max(wait_ns).cast("long").alias("wait_max_ns"),
        F.sum(hold_ns).cast("long").alias("hold_sum_ns"),
        F.max(hold_ns).cast("long").alias("hold_max_ns"),
    )


def gauges_of(sums: DataFrame, capacity: int) -> DataFrame:
    """gauges() of rows that partial sums (n, total) stand for."""
    g = sums.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"), F.sum("total").cast("long").alias("total"))
    return g.select("n", "total", F.when(F.col("n") > 0, F.expr("total div n")).otherwise(F.lit(0)).cast("long").alias("mean"), F.expr(f"(n % {capacity}) * 1000 div {capacity}").cast("long").alias("fill"))


def gauges(rows: DataFrame, value: str, capacity: int) -> DataFrame:
    """Means from totals by whole division, and the fill of a buffer of that capacity in thousandths."""
    return gauges_of(rows.agg(F.count("*").alias("n"), F.sum(value).cast("long").alias("total")), capacity)


def exposition(series: DataFrame) -> DataFrame:
    """(line) of the text format from (name, labels map<string,string>, value double); labels in key order, whole values without decimals."""
    escaped = lambda v: F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    pairs = F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), escaped(e["value"]), F.lit('"')))
    label = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise(F.lit(""))
    number = F.when(F.col("value") == F.floor("value"), F.col("value").cast("decimal(38,0)").cast("string")).otherwise(F.col("value").cast("string"))
    return series.select(F.concat("name", label, F.lit(" "), number).alias("line"))


#: The exported scalar series with their kinds; the histograms; the kinds of lock series with the columns of lock_stats() behind them.
SCALARS = (
    [(n, "counter") for n in ("intents_ingested_total", "intents_success_total", "intents_failure_total", "intents_partial_total", "queries_total", "replays_total", "insights_total")]
    + [(n, "counter") for n in ("chaos_events_total", "chaos_failures_injected", "chaos_latency_spikes", "chaos_retries_injected")]
    + [(n, "gauge") for n in ("graph_node_count", "graph_edge_count", "hnsw_index_size", "active_patterns", "active_clusters", "uptime_seconds", "hot_buffer_fill_ratio")]
    + [(n, "gauge") for n in ("wal_entries_total", "segments_flushed_total", "bytes_flushed_total", "hnsw_avg_search_visited")]
)
HISTOGRAMS = tuple(f"{n}_latency_us" for n in ("ingest", "query", "extract", "wal_append", "hnsw_insert", "edge_search", "hot_push", "segment_flush"))
LOCKS = (("lock_acquisitions_total", "counter", "acquisitions"), ("lock_contentions_total", "counter", "contended"), ("lock_wait_ns_total", "counter", "wait_sum_ns"), ("lock_hold_ns_total", "counter", "hold_sum_ns"), ("lock_max_wait_ns", "gauge", "wait_max_ns"), ("lock_max_hold_ns", "gauge", "hold_max_ns"))
PHASES = tuple((f"{place}_{op}_{what}", "counter") for place, ops in (("store", ("wal_append", "hnsw_insert", "hot_push", "segment_flush", "edge_search")), ("daemon", ("extract", "store_insert", "edge_formation", "query", "replay", "insight"))) for op in ops for what in ("ns_total", "count"))


def family_heads(name: str, kind: str) -> list[str]:
    """The two lines that open a family of series."""
    return [f"# HELP {name} {name.replace('_', ' ').capitalize()}.", f"# TYPE {name} {kind}"]


def exporter(scalars: DataFrame, histograms: DataFrame, locks: DataFrame, vertical: str, prefix: str = "intentdeck_") -> DataFrame:
    """(line) of the whole exposition, in order: scalars, histograms, locks, phases; a series without a value is 0.

    scalars is (name, value), histograms (name, le, count, total) with le null for +Inf and total the sum of the values, locks the result of
    lock_stats(). Names are those of SCALARS, HISTOGRAMS and PHASES, without prefix. All tables hold a few rows for each series.
    """
    spark = scalars.sparkSession
    label = f'vertical="{vertical}"'
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").cast("string")
    families = [(n, k, "scalar") for n, k in SCALARS] + [(n, "histogram", "histogram") for n in HISTOGRAMS] + [(n, k, "lock") for n, k, _ in LOCKS] + [(n, k, "scalar") for n, k in PHASES]
    # the lock families open together and their series follow by lock
    place = {n: (len(SCALARS) + len(HISTOGRAMS) if group == "lock" else i) for i, (n, _, group) in enumerate(families)}
    heads = [(place[n], 2 * i + j, 0.0, line) for i, (n, k, _) in enumerate(families) for j, line in enumerate(family_heads(prefix + n, k))]
    out = spark.createDataFrame(heads, "family int, part int, at double, line string")
    last = 2 * len(families)

    names = spark.createDataFrame([(place[n], n) for n, _, group in families if group == "scalar"], "family int, name string")
    got = names.join(scalars.select("name", "value"), "name", "left")
    out = out.unionByName(got.select("family", F.lit(last).alias("part"), F.lit(0.0).alias("at"), F.concat(F.lit(prefix), "name", F.lit(f"{{{label}}} "), number("value")).alias("line")))

    bounds = [(place[n], n, b, float(b or 0), f"{b}" if b else "+Inf") for n in HISTOGRAMS for b in (*BOUNDS, None)]
    names = spark.createDataFrame([(f, n, None if b is None else float(b), text) for f, n, b, _, text in bounds], "family int, name string, le double, text string")
    h = histograms.select(F.col("name").alias("of"), F.col("le").alias("bound"), "count", "total")
    got = names.join(h, (F.col("name") == F.col("of")) & F.col("le").eqNullSafe(F.col("bound")), "left")
    bucket = F.concat(F.lit(prefix), "name", F.lit(f'_bucket{{{label},le="'), "text", F.lit('"} '), number("count"))
    tail = [F.concat(F.lit(prefix), "name", F.lit(f"_{what}{{{label}}} "), number(c)) for what, c in (("sum", "total"), ("count", "count"))]
    lines = F.when(F.col("le").isNull(), F.array(bucket, *tail)).otherwise(F.array(bucket))
    out = out.unionByName(got.select("family", F.coalesce("le", F.lit(float("inf"))).alias("at"), F.posexplode(lines).alias("k", "line")).select("family", (F.lit(last) + F.col("k")).alias("part"), "at", "line"))

    series = F.array(*[F.concat(F.lit(f'{prefix}{n}{{{label},lock="'), "lock", F.lit('"} '), number(c)) for n, _, c in LOCKS])
    ranked = locks.withColumn("at", F.row_number().over(Window.orderBy("lock")).cast("double"))
    got = ranked.select("at", F.posexplode(series).alias("k", "line"))
    out = out.unionByName(got.select(F.lit(place[LOCKS[0][0]]).alias("family"), F.lit(last).alias("part"), (F.col("at") * len(LOCKS) + F.col("k")).alias("at"), "line"))
    # within a histogram: buckets by bound, then sum and count
    return out.orderBy("family", F.when(F.col("part") < last, F.col("part")).otherwise(last), "at", "part").select("line")


def chaos_mode(failures: Column, spikes: Column, retries: Column, events_per_s: Column, stampede: float = 100.0) -> Column:
    """The mode that rises of the fault counters tell: one alone names it, several are mixed, and from ``stampede`` events a second on all is a stampede; else null.

    A null rise counts as none.
    """
    up = [F.coalesce(c, F.lit(0)) > 0 for c in (failures, spikes, retries)]
    several = sum((u.cast("int") for u in up[1:]), up[0].cast("int")) > 1
    return F.when(events_per_s >= stampede, "Stampede").when(several, "Mixed Chaos").when(up[0], "Failure Injection").when(up[1], "Latency Storm").when(up[2], "Retry Cascade")


def window_rate(rows: DataFrame, seconds: int, by: list[str] | None = None) -> DataFrame:
    """(window_start_s, by..., events, rate) in tumbling windows of the ts_ns column."""
    by = by or []
    start = (F.floor(F.col("ts_ns") / (seconds * 1_000_000_000)) * seconds).cast("long").alias("window_start_s")
    return rows.groupBy(start, *by).agg(F.count("*").alias("events")).withColumn("rate", F.col("events") / float(seconds))


def success_rate(rows: DataFrame, seconds: int, by: list[str] | None = None) -> DataFrame:
    by = by or []
    start = (F.floor(F.col("ts_ns") / (seconds * 1_000_000_000)) * seconds).cast("long").alias("window_start_s")
    ok = F.sum(F.when(F.col("status") == 1, 1).otherwise(0))
    return rows.groupBy(start, *by).agg((100.0 * ok / F.count("*")).alias("success_rate"))


def failure_ratio(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg((F.sum(F.when(F.col("status") == 2, 1.0).otherwise(0.0)) / F.count("*")).alias("failure_ratio"))


def sliding_average(rows: DataFrame, value: str, by: str, seconds: int) -> DataFrame:
    """(id, avg_value): the mean over the last ``seconds`` up to each row, by series."""
    w = Window.partitionBy(by).orderBy("ts_ns").rangeBetween(-seconds * 1_000_000_000, 0)
    return rows.select("id", F.avg(value).over(w).alias("avg_value"))


def last_values(rows: DataFrame, value: str, by: str) -> DataFrame:
    """The latest value of each series."""
    return rows.groupBy(by).agg(F.max_by(value, F.struct("ts_ns", "id")).alias("value"))


#: The six kinds of injected faults and their shares in percent.
CHAOS = (("ForcedFailure", 30), ("LatencySpike", 25), ("RetryStorm", 20), ("IngestFailure", 10), ("DegenerateQuery", 10), ("InsightStress", 5))


def chaos_kind(percent: Column, kinds=CHAOS) -> Column:
    """The kind in whose share of [0, 100) percent lies."""
    out, low = None, 0
    for name, share in kinds:
        low += share
        out = F.when(percent < low, name) if out is None else out.when(percent < low, name)
    return out
