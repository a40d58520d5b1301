"""Word splitting, rejection, nulls in vectors, incremental edges, dry runs and the order of patterns."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from intentdeck.engine import Engine
from intentdeck.functions import sql, text
from intentdeck.functions.vector import EPSILON
from intentdeck.functions.text import shell_words
from intentdeck.operators import graph, insight, knn, metrics, store
from intentdeck.plans import catalog
from intentdeck.schemas import ExtractionFailed, NodeNotFound, SegmentCorrupted
from intentdeck.sources import messages, workload
from intentdeck.streaming import ingest
from tests.conftest import SF_SMALL


@pytest.mark.parametrize(
    "raw, words",
    [
        (r'echo "a\nb"', ["echo", r"a\nb"]),
        (r'echo "a\"b\\c\$d\`e"', ["echo", 'a"b\\c$d`e']),
        (r"echo '\n' a\ b", ["echo", r"\n", "a b"]),
        ('"open\\', ["open\\"]),
        ("open\\", ["open"]),
        ("a\rb\u00a0c\td\ne", ["a\rb\u00a0c", "d", "e"]),
        ("a|b>>c>d<e", ["a", "|", "b", ">>", "c", ">", "d", "<", "e"]),
        ("'' \"\"", []),
    ],
)
def test_shell_words(raw, words):
    assert shell_words(raw) == words


def test_empty_commands_are_rejected(spark, tmp_path):
    empty = ["", " ", "\t\n", "\r", "\u00a0\u3000", "''", '"" \'\'', "'", "\\", ' "" \\']
    full = ["ls", "'a'", '"\\', "\\ ", "|", " \ta"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate([*empty, *full, None])], "id int, raw_command string")
    assert sorted(r.id for r in store.rejected(df).collect()) == [*range(len(empty)), len(empty) + len(full)]
    for c in full:
        assert shell_words(c)
    engine = Engine(spark, str(tmp_path / "s"))
    for c in empty[:6]:
        with pytest.raises(ExtractionFailed):
            engine.ingest(c)


def test_edges_with_null_and_ragged_vectors(spark):
    rows = [(i, [float((i * 7 + j * 3) % 11) + 0.5 for j in range(4)]) for i in range(60)] + [(60, None), (61, [1.0, None, 2.0, 3.0]), (62, [1.0, 2.0]), (63, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    want = sorted(map(tuple, knn.form_edges(df, 3, strategy="native").collect()))
    assert sorted(map(tuple, knn.form_edges(df, 3, block=9).collect())) == want
    assert (62, 63) in {(a, b) for a, b, _, _ in want} and not {60, 61} & {x for e in want for x in e[:2]}
    got = knn.form_edges_incremental(df.where("id < 40"), df.where("id >= 40"), 3, block=7)
    assert sorted(map(tuple, got.collect())) == [e for e in want if e[1] >= 40]


def by_hand(ids, v, asks, k):
    out = set()
    with np.errstate(all="ignore"):
        for q in asks:
            s = np.round(v @ v[q] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]) + EPSILON), 6)
            c = np.flatnonzero((ids < ids[q]) & ~np.isnan(s))
            out |= {(int(ids[q]), int(ids[j]), float(s[j])) for j in c[np.lexsort((ids[c], -s[c]))][:k]}
    return out


@pytest.mark.parametrize("kind", ["random", "copies", "odd", "opposed", "tiny", "coarse", "rising"])
def test_nearest_earlier(kind):
    """The tiled search against all pairs, with large groups of copies, zeros, values that are not finite, and neighbours that get ever better."""
    rng = np.random.default_rng(7)
    ids, v = np.sort(rng.choice(10**6, 2500, replace=False)), rng.normal(size=(2500, 8))
    if kind == "copies":
        v[rng.random(2500) < 0.6] = v[0]
    elif kind == "odd":
        v[5], v[6, 0], v[7, 1] = 0, np.nan, np.inf
        v[:100] *= 1e-5
    elif kind == "opposed":
        v = np.abs(v) * np.where(np.arange(2500) % 2, 1, -1)[:, None]
    elif kind == "tiny":
        v *= 1e-4
    elif kind == "coarse":
        v = np.round(v[:, :2])
    elif kind == "rising":
        v = np.stack([np.cos(np.linspace(3, 0, 2500)), np.sin(np.linspace(3, 0, 2500))], axis=1)
    asks = rng.permutation(2500)[:1500]
    got = knn.nearest_earlier(ids[asks], v[asks], ids, v, 5)
    assert set(zip(*[z.tolist() for z in got], strict=True)) == by_hand(ids, v, asks, 5)


def test_rows_are_dealt_out_a_fixed_number_of_times(spark, monkeypatch):
    """Blocks grow with the table, so that the rows shuffled grow as it does; up to a block's bytes, from which on there are more."""
    monkeypatch.setattr(knn, "BLOCK", 100)
    rows = lambda n: spark.range(n).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    assert [len(knn._cuts(rows(n), None)) + 1 for n in (0, 100, 101, 1000, 24_000, 240_000)] == [1, 1, 2, 10, 24, 24]
    monkeypatch.setattr(knn, "MOST_BYTES", 16 * 1000)
    assert len(knn._cuts(rows(240_000), None)) + 1 == 240


def test_edges_to_some_nodes(spark, monkeypatch):
    """Edges of the nodes asked for, without those of others, are those of the whole table; so are the steps backward over them."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)] + [(300, None), (301, [0.0] * 4), (302, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>").cache()
    every = knn.form_edges(df, 5, strategy="native").cache()
    nodes = lambda ids: spark.createDataFrame([(i,) for i in ids], "node long")
    asks = [0, 1, 3, 77, 77, 299, 300, 301, 302, 999]
    for block in (None, 40):
        assert sorted(knn.form_edges_to(df, nodes(asks), 5, block).collect()) == sorted(every.where(F.col("to_id").isin(asks)).collect())
    assert knn.form_edges_to(df, nodes([])).count() == 0
    asked = []
    to = lambda frontier: asked.append({r.node for r in frontier.collect()}) or knn.form_edges_to(df, frontier)
    assert sorted(graph.bfs_backward_by(to, spark, 250, 2).collect()) == sorted(graph.bfs_backward(every, 250, 2).collect())
    assert asked == [{250}, {r.from_id for r in every.where("to_id = 250").collect()}]


def test_queries_of_few_edges_do_not_make_all(spark, monkeypatch):
    """predecessors, bfs_backward, status and graph_counts on a table of which nothing asks for all edges."""
    want = {name: sorted(catalog.QUERIES[name](spark, SF_SMALL).collect()) for name in ("predecessors", "bfs_backward", "status", "graph_counts")}
    every = catalog.edges_of(spark, SF_SMALL)
    assert want["predecessors"] == sorted(graph.predecessors(every, 300).collect()) and want["bfs_backward"] == sorted(graph.bfs_backward(every, 480, 2).collect())
    assert want["status"][0].edges == want["graph_counts"][0].edges == every.count()
    monkeypatch.setattr(catalog, "edges_of", None)
    monkeypatch.setattr(knn, "form_edges", None)
    for name, rows in want.items():
        assert sorted(catalog.QUERIES[name](spark, SF_SMALL).collect()) == rows


@pytest.mark.parametrize("rows", [0, 1, 3, 5, 6, 40])
def test_edges_are_counted_without_being_made(spark, rows):
    made = [(i, [float(i % 7), 1.0, -0.5]) for i in range(rows)] + [(50, None), (51, [1.0, None, 2.0]), (52, [0.0] * 3), (53, [1.0, 2.0]), (54, [2.0, 1.0])]
    made += [(55, [float("nan"), 1.0, 1.0]), (56, [float("inf"), 1.0, 0.0]), (52, [0.0] * 3), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(made, "id long, v array<double>")
    assert knn.count_edges(df).first().edges == knn.form_edges(df).count()
    assert knn.count_edges(df.where("id = 50")).first().edges == 0


def test_batches_deal_out_few_rows(spark, monkeypatch):
    """What meets in groups when a batch asks and history is searched: each row as often as the other side has blocks, and no more blocks than BLOCKS."""
    monkeypatch.setattr(knn, "BLOCK", 10)
    monkeypatch.setattr(knn, "BLOCKS", 4)
    monkeypatch.setattr(knn, "_best_stored", lambda k: lambda b: pa.table({"from_id": [b.num_rows], "to_id": [0], "weight": [0.0]}))
    rows = spark.range(1200).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    met = knn._earlier(rows.where("id >= 800"), rows, 5, None).agg(F.sum("from_id")).first()[0]
    assert met <= 5 * (400 + 1200)


def test_whole_table_deals_out_few_rows(spark, monkeypatch):
    """The edges that replay_commands and the narratives walk: each row meets the blocks before and after its own once, however long the table."""
    monkeypatch.setattr(knn, "BLOCK", 10)
    monkeypatch.setattr(knn, "BLOCKS", 4)
    monkeypatch.setattr(knn, "_best_stored", lambda k: lambda b: pa.table({"from_id": [b.num_rows], "to_id": [0], "weight": [0.0]}))
    rows = spark.range(1200).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("v"))
    groups = [r.from_id for r in knn._earlier(rows, rows, 5, None).collect()]
    assert len(groups) == 10 and sum(groups) <= 5 * 1200 * 1.1 and max(groups) <= 2 * 300 * 1.2


def test_rows_dealt_out_grow_as_the_table(spark, monkeypatch):
    """a table and a last batch of ten times the rows deal out ten times as many, from a tenth of 1 GB on; blocks stay within their bytes."""
    monkeypatch.setattr(knn, "_best_stored", lambda k: lambda b: pa.table({"from_id": [b.num_rows], "to_id": [b.num_rows], "weight": [0.0]}))
    dealt = {}
    for n in (10_000, 100_000):
        rows = spark.range(n).select("id", F.array(F.lit(1.0)).alias("v"))
        last = rows.where(F.col("id") >= n // 3 * 2)
        dealt[n] = [[r.from_id for r in knn._earlier(a, rows, 5, None).collect()] for a in (rows, last)]
    for small, large in zip(*dealt.values(), strict=True):
        assert sum(large) < 11.5 * sum(small) and 20 < len(large) < 60
    assert sum(dealt[100_000][0]) < 11 * 100_000 and sum(dealt[100_000][1]) < 9 * 100_000
    monkeypatch.setattr(knn, "MOST_BYTES", 8 * 2000)
    assert all(r.to_id < 2 * 2300 for a in (rows, last) for r in knn._earlier(a, rows, 5, None).collect())


def test_replay_over_copies(spark, monkeypatch):
    """The plan and the narrative over edges of several blocks, with a large group of copies, are those over edges made pair by pair."""
    monkeypatch.setattr(knn, "BLOCK", 30)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(120, 3))
    v[rng.random(120) < 0.5] = v[2]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").cache()
    commands = df.select("id", F.col("id").cast("string").alias("command"))
    nodes = df.select(F.col("id").alias("node"))
    native, blocked = (knn.form_edges(df, 5, strategy=s).cache() for s in ("native", "blocked"))
    for walk in (lambda e: graph.replay(nodes, e, commands, 100, 2), lambda e: graph.narrative_edges(e, 7, 2)):
        assert sorted(map(str, walk(blocked).collect())) == sorted(map(str, walk(native).collect()))


@pytest.mark.parametrize("kind", ["random", "copies", "many nodes"])
def test_edges_from_some_nodes(spark, monkeypatch, kind):
    """Edges that begin in the nodes asked for are those of the whole table, in few and many samples, with nodes in parts; few rows search all."""
    monkeypatch.setattr(knn, "SAMPLE", 30)
    monkeypatch.setattr(knn, "SAMPLE_EACH", 10)
    monkeypatch.setattr(knn, "GROWTH", 3)
    monkeypatch.setattr(knn, "FEW", 5)
    monkeypatch.setattr(knn, "BLOCK", 60)
    rng = np.random.default_rng(11)
    v = rng.normal(size=(500, 6))
    if kind == "copies":
        v[rng.random(500) < 0.4] = v[9]
    if kind == "many nodes":
        monkeypatch.setattr(knn, "MOST_SAMPLE", 40)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [0.0] * 6), (502, [1.0, 2.0]), (503, [float("nan")] * 6), (504, [2.0, 1.0]), (505, [None] * 6), (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "id long, v array<double>").cache()
    every = knn.form_edges(df, 3).cache()
    searched, into = [], knn._edges_into
    monkeypatch.setattr(knn, "_edges_into", lambda rows, some, *a: searched.append(some.count()) or into(rows, some, *a))
    for asks in ([9], [0, 200, 200, 502, 501, 503, 999], list(range(0, 500, 4)) if kind == "many nodes" else [499], [500, 999], []):
        got = knn.form_edges_from(df, spark.createDataFrame([(i,) for i in asks], "node long"), 3)
        assert sorted(got.collect()) == sorted(every.where(F.col("from_id").isin(asks)).collect())
    if kind == "random":
        assert searched[0] < 100 and not any(searched[3:])


@pytest.mark.parametrize("name", ["replay_commands", "replay_plan", "bfs_forward", "successors"])
def test_queries_forward_do_not_make_all(spark, monkeypatch, name):
    """what follows edges forward asks for those that begin in its nodes; plans are those over all edges."""
    every = catalog.edges_of(spark, SF_SMALL)
    want = {
        "replay_commands": lambda: graph.replay(catalog.nodes_of(spark, SF_SMALL), every, catalog._commands(spark, SF_SMALL), 450, 2).select("intent_id", "command"),
        "bfs_forward": lambda: graph.bfs_forward(every, 250, 2),
        "successors": lambda: graph.successors(every, 3),
    }
    want = sorted(want[name]().collect()) if name in want else None
    monkeypatch.setattr(catalog, "edges_of", None)
    monkeypatch.setattr(knn, "form_edges", None)
    got = catalog.QUERIES[name](spark, SF_SMALL).collect()
    assert got and (want is None or sorted(got) == want)
    with pytest.raises(NodeNotFound):
        graph.replay_by(catalog.nodes_of(spark, SF_SMALL), *catalog._ways(spark, SF_SMALL), catalog._commands(spark, SF_SMALL), 10**9, 2)


def test_narratives_do_not_make_all(spark, monkeypatch):
    """narratives ask for the edges that begin or end in their nodes; they are those over all edges, doubled ones included."""
    every = catalog.edges_of(spark, SF_SMALL)
    want = sorted(graph.narrative_edges(every, 7, 2).select("from_id", "to_id", "weight").collect()), sorted(graph.narrative_nodes(every, 7, 2).collect())
    monkeypatch.setattr(catalog, "edges_of", None)
    monkeypatch.setattr(knn, "form_edges", None)
    monkeypatch.setattr(knn, "SAMPLE", 60)
    monkeypatch.setattr(knn, "SAMPLE_EACH", 2)
    assert (sorted(catalog.QUERIES["narrative_edges"](spark, SF_SMALL).collect()), sorted(catalog.QUERIES["narrative_nodes"](spark, SF_SMALL).collect())) == want
    assert graph.narrative_edges_by(*catalog._ways(spark, SF_SMALL), spark, 7, 0).count() == graph.narrative_edges(every, 7, 0).count() == 0
    once = graph.narrative_edges_by(*catalog._ways(spark, SF_SMALL), spark, 7, 2, distinct=True)
    assert sorted(once.select("from_id", "to_id", "weight").collect()) == sorted(set(want[0]))


def test_cells_in_parts(spark, monkeypatch):
    """The asking rows of a cell are dealt out over parts, so that no group holds all of them; the edges are the same."""
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(400)], "id long, v array<double>").cache()
    want = sorted(knn.knn_earlier(df, 5, "ivf", cells=4, probes=2).collect())
    met, best = spark.sparkContext.accumulator(0), knn._best_stored
    monkeypatch.setattr(knn, "PART_ROWS", 50)
    assert sorted(knn.knn_earlier(df, 5, "ivf", cells=4, probes=2).collect()) == want

    def few(k):
        f = best(k)

        def checked(b):
            met.add(1)
            assert sum(b["asks"].to_pylist()) <= 50
            return f(b)

        return checked

    monkeypatch.setattr(knn, "_best_stored", few)
    assert sorted(knn.knn_earlier(df, 5, "ivf", cells=4, probes=2).collect()) == want and met.value > 16


def test_parts_of_cells_grow_no_faster(spark, monkeypatch):
    """a row of a cell is dealt to as many parts at ten and at sixty times the rows; from some rows on parts stay as large and grow in number."""
    monkeypatch.setattr(knn, "assign_cells", lambda rows, at, probes: rows.select("id", "v", F.array(*[((F.col("id") + i) % 16).cast("int") for i in range(probes)]).alias("near")))
    monkeypatch.setattr(knn, "_best_stored", lambda k: lambda b: pa.table({"from_id": [b.num_rows], "to_id": [sum(b["asks"].to_pylist())], "weight": [0.0]}))
    got = {}
    for n in (10_000, 100_000, 600_000):
        rows = spark.range(n).select("id", F.array(F.lit(1.0)).alias("v"))
        got[n] = [(r.from_id, r.to_id) for r in knn._ivf(rows, 5, 16, 8).collect()]
        assert len(got[n]) == 64 and sum(x for x, _ in got[n]) == 12 * n
    assert max(asks for _, asks in got[600_000]) < 600_000 * 8 / 16 / 4 * 1.1
    monkeypatch.setattr(knn, "PART_ROWS", 1000)
    assert max(r.to_id for r in knn._ivf(spark.range(10_000).select("id", F.array(F.lit(1.0)).alias("v")), 5, 16, 8).collect()) < 1000


def test_dry_run_and_execute(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "s"))
    a, b = engine.ingest_many([("deploy ${HOST}", None), ("deploy ${HOST} again", None)])
    assert [(c, i) for c, i, _ in engine.replay(a)] == [("deploy ${HOST}", a), ("deploy ${HOST} again", b)]
    assert [(c, i) for c, i, _ in engine.dry_run(a, completed=[a], values={"HOST": "x1"})] == [("deploy x1 again", b)]
    ran = engine.execute(a, completed=[a], values={"HOST": "x1"}, executor=lambda c: (1 if c == "deploy x1 again" else 2, 5, 0))
    assert ran == [("deploy x1", a, True, 1), ("deploy x1 again", b, False, 1)]


def test_pattern_order(spark):
    rows = [(k, k, c) for k, c in enumerate("a b c a b c a b".split())]
    got = insight.ordered_patterns(spark.createDataFrame(rows, "id long, ts_ns long, raw_command string").withColumn("status", F.lit(1))).collect()
    keys = [(-r["count"], -len(r.commands)) for r in got]
    assert keys == sorted(keys) and len(got) > 3


def test_exporter_lines_in_order(spark):
    scalars = spark.createDataFrame([("queries_total", 7)], "name string, value long")
    rows = spark.createDataFrame([("a", 30, 2000), ("b", 70_000, 10)], "lock string, us long, ns long")
    buckets = metrics.histogram(rows, "us").crossJoin(rows.agg(F.sum("us").alias("total"))).withColumn("name", F.lit("query_latency_us"))
    lines = [r.line for r in metrics.exporter(scalars, buckets, metrics.lock_stats(rows, "lock", F.col("ns"), F.col("us")), "v").collect()]
    at = lines.index("# TYPE intentdeck_query_latency_us histogram")
    label = 'intentdeck_query_latency_us_bucket{vertical="v",le='
    want = [f'{label}"{b}"}} {int(b >= 30)}' for b in metrics.BOUNDS] + [f'{label}"+Inf"}} 2', 'intentdeck_query_latency_us_sum{vertical="v"} 70030', 'intentdeck_query_latency_us_count{vertical="v"} 2']
    assert lines[at + 1 : at + 14] == want
    at = lines.index("# TYPE intentdeck_lock_max_hold_ns gauge")
    assert lines[at + 1] == 'intentdeck_lock_acquisitions_total{vertical="v",lock="a"} 1' and lines[at + 12] == 'intentdeck_lock_max_hold_ns{vertical="v",lock="b"} 70000'
    assert lines[lines.index("# TYPE intentdeck_queries_total counter") + 1] == 'intentdeck_queries_total{vertical="v"} 7'
    assert lines[-1] == 'intentdeck_daemon_insight_count{vertical="v"} 0'
    empty = metrics.exporter(scalars.limit(0), buckets.limit(0), metrics.lock_stats(rows.limit(0), "lock", F.col("ns"), F.col("us")), "v").collect()
    assert len(empty) == len(lines) - 12


@pytest.mark.parametrize("rows, kept", [(0, 0), (1000, 1000), (1001, 501), (1500, 1000), (1501, 501), (2600, 600)])
def test_recent_ids(spark, rows, kept):
    n: list[int] = []
    for k in range(rows):
        n.append(k)
        if len(n) > 1000:
            del n[:500]
    assert len(n) == kept
    assert [r.id for r in store.recent_ids(spark.range(rows).withColumn("ts_ns", F.col("id"))).collect()] == n[::-1]


def test_nodes_and_edges_are_added(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b")], "node long, name string")
    new = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "node long, name string, seq long")
    assert sorted(map(tuple, graph.upsert_nodes(nodes, new).collect())) == [(1, "a"), (2, "d"), (3, "e")]
    e = spark.createDataFrame([(1, 2)], "from_id long, to_id long")
    assert graph.add_edges(e, e).count() == 2


def test_messages():
    every = {
        "ping": {"from": 1, "seq": 2**64 - 1},
        "pong": {"from": 2, "seq": 0},
        "intent_forward": {"partition": 7, "payload": b"\x00\xffabc"},
        "segment_sync": {"partition": 2**32 - 1, "segment_data": b""},
        "membership_update": {"version": 3, "members": [5, 6]},
        "partition_table_update": {"version": 4, "assignments": [{"partition_id": 1, "owner": 9, "replicas": [8, 7]}, {"partition_id": 2, "owner": 9, "replicas": []}]},
    }
    for name, fields in every.items():
        data = messages.encode(name, fields)
        assert messages.decode(data) == (name, fields) == messages.decode(data + b"more")
        with pytest.raises(SegmentCorrupted):
            messages.decode(data[:-1])
    assert messages.encode("membership_update", every["membership_update"]).hex() == "051c0000000300000000000000" + "02000000" + "0500000000000000" + "0600000000000000"
    for bad in (b"", b"\x01\x00\x00\x00", b"\x09\x00\x00\x00\x00", b"\x01\x08\x00\x00\x00" + bytes(8), b"\x05\x0c\x00\x00\x00" + bytes(8) + b"\x01\x00\x00\x00"):
        with pytest.raises(SegmentCorrupted):
            messages.decode(bad)


def test_embeddings_of_many_texts(spark):
    texts = ["", "ls", "ünï", "x" * 300_000, *(f"cmd {k} -{'v' * (k % 40)}" for k in range(3000))]
    assert np.array_equal(text.embed_many(texts), np.stack([text.embed_numpy(t) for t in texts])) and text.embed_many([]).shape == (0, text.DIM)
    rows = ["ls", None, "ls", "", "git push", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "id int, t string").coalesce(1).select("t", text.embed_udf("t").alias("e"), text.classify_udf("t").alias("c")).collect()
    assert [r.t for r in got] == rows
    assert [r.e for r in got] == [None if t is None else text.embed_numpy(t).astype("f4").tolist() for t in rows]
    assert [r.c for r in got] == [None if t is None else text.classify_text(t) for t in rows]


def test_words_of_a_batch_are_held_a_few_rows_at_a_time():
    """Python's peak memory over a batch of 10 000 commands is a small part of what their tokens take as objects; the tokens are the same."""
    raw = pa.array([None, "", *(f"cmd{k} -x{k} 'a b' | grep {k} >> out" for k in range(10_000))])
    tracemalloc.start()
    got = text.in_slices(raw, text.tokens, text.TOKEN_TYPE)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000
    assert got.to_pylist() == [None if r is None else text.tokens(r) for r in raw.to_pylist()]
    assert text.in_slices(raw[:0], text.shell_words, text.WORDS_TYPE).to_pylist() == []
    assert text.in_slices(raw[:9], text.shell_words, text.WORDS_TYPE).to_pylist() == [None if r is None else text.shell_words(r) for r in raw[:9].to_pylist()]


def test_stream_batches_are_many_tasks(spark, monkeypatch):
    """Files of the stream hold so many rows each, so that a batch is read by more tasks as the table grows; there are three batches."""
    made = []
    stream = ingest.command_stream
    monkeypatch.setattr(ingest, "command_stream", lambda spark, path, schema, files: made.append((path, files)) or stream(spark, path, schema, files))
    monkeypatch.setattr(catalog, "STREAM_ROWS", 500)
    got = {r.raw_command: r.n for r in catalog.QUERIES["stream_ingest"](spark, SF_SMALL).collect()}
    events = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    assert got == {r.event_type: r["count"] for r in events.where("event_id % 9 <> 0").groupBy("event_type").count().collect()}
    (path, files), n = made[0], events.count()
    rows = [r["count"] for r in spark.read.parquet(path).groupBy(F.spark_partition_id(), F.input_file_name()).count().collect()]
    assert files == -(-n // 1500) and len(rows) == 3 * files and max(rows) <= 510


def test_functions_in_sql(spark):
    names = sql.register(spark)
    got = spark.sql("SELECT shell_words('ls -l \"a b\"') AS w, vec_dot(array(1D, 2D), array(3D, 4D)) AS d, vec_cosine(array(0D), array(1D)) AS z, vec_dot(NULL, array(1D)) AS n, size(hash_embedding('ls')) AS e, classify_command('git push') AS c").first()
    assert (list(got.w), got.d, got.z, got.n) == (["ls", "-l", "a b"], 11.0, 0.0, None) and got.e > 0 and got.c and len(names) == 7


def test_workload_source(spark):
    spark.dataSource.register(workload.WorkloadSource)
    read = lambda **o: spark.read.format("intentdeck_workload").options(**o).load()
    for name in workload.VERTICALS:
        want = sorted(map(tuple, workload.generate(spark, name, 50, seed=-(2**40), start_ns=5).collect()))
        assert sorted(map(tuple, read(vertical=name, rows=50, seed=-(2**40), start_ns=5, rows_per_partition=7).collect())) == want
    assert read(rows=0).count() == 0
