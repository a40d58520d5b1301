"""Expected values for single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from intentdeck import cli
from intentdeck.functions import hashing as H
from intentdeck.functions import text as X
from intentdeck.functions import vector as V
from intentdeck.operators import cluster, graph, insight, knn, metrics, store
from intentdeck.schemas import CycleDetected, DimensionMismatch, ExtractionFailed, NodeNotFound, SegmentCorrupted
from intentdeck.sources import segment, wal, workload

C, A, FL, P, RI = "Command", "Arg", "Flag", "Pipe", "RedirectIn"


@pytest.mark.parametrize(
    "raw, want",
    [
        ("ls -la /tmp", [(C, "ls"), (FL, "-la"), (A, "/tmp")]),
        ("cat file.txt | grep error", [(C, "cat"), (A, "file.txt"), (P, None), (C, "grep"), (A, "error")]),
        ("sort < input.txt >> output.txt", [(C, "sort"), (RI, None), (A, "input.txt"), ("RedirectOut", True), (A, "output.txt")]),
        ('echo "hello world"', [(C, "echo"), (A, "hello world")]),
        ("grep 'foo bar' file.txt", [(C, "grep"), (A, "foo bar"), (A, "file.txt")]),
        ("ps aux | grep rust | wc -l", [(C, "ps"), (A, "aux"), (P, None), (C, "grep"), (A, "rust"), (P, None), (C, "wc"), (FL, "-l")]),
        ("echo hello>out.txt", [(C, "echo"), (A, "hello"), ("RedirectOut", False), (A, "out.txt")]),
        ("", []),
        ("a 2>&1", [(C, "a"), (A, "2"), ("RedirectOut", False), (A, "&1")]),
        ("x '' end\\", [(C, "x"), (A, "end")]),
        ("-x y", [(C, "-x"), (A, "y")]),
    ],
)
def test_tokens(raw, want):
    assert [(t["kind"], t["value"] if t["append"] is None else t["append"]) for t in X.tokens(raw)] == want


def test_embedding():
    v = X.embed_numpy("ls")
    assert {int(i): round(float(v[i]), 6) for i in np.nonzero(v)[0]} == {58: -0.471155, 60: 0.237933, 134: -0.235577, 180: 0.662915, 300: 0.475866}
    a, b, c = (X.embed_numpy(t) for t in ("cargo build", "cargo build --release", "kubectl apply -f deploy.yaml"))
    assert round(float(a @ b), 6) == 0.773820 and round(float(a @ c), 6) == -0.064714
    assert not X.embed_numpy("").any()


@pytest.mark.parametrize("raw, want", [("cargo build --release", "Build"), ("cd /home/user/project", "Navigate"), ("grep -r TODO src/", "Query"), ("kubectl apply -f service.yaml", "Deploy"), ("strace -p 5678", "Debug"), ("chmod 755 deploy.sh", "Configure"), ("click", "Other")])
def test_classify(raw, want):
    assert X.classify_text(raw) == want


def test_native_embedding_and_udfs(spark):
    df = spark.createDataFrame([(1, "cargo build"), (2, "é|x"), (3, None)], "id long, t string")
    got = {(r.id, r.idx): r.weight for r in X.embed_native(df, "id", "t").collect()}
    for i, t in ((1, "cargo build"), (2, "é|x")):
        v = X.embed_numpy(t)
        assert all(abs(v[k] - got.get((i, k), 0.0)) < 1e-12 for k in range(X.DIM))
    r = df.select(X.shell_words_udf("t").alias("w"), X.classify_udf("t").alias("c"), X.embed_udf("t").alias("e")).collect()
    assert r[0].w == ["cargo", "build"] and r[0].c == "Build" and r[2].w is None and r[2].c is None and len(r[0].e) == 384


@pytest.mark.parametrize("text, values, want", [("cd ${HOME} && deploy --env=${ENV}", {"HOME": "/home/user", "ENV": "prod"}, "cd /home/user && deploy --env=prod"), ("${X} ${open", {}, "${X} ${open"), ("${A}${B}", {"A": "foo", "B": "bar"}, "foobar"), ("a${}b", {"": "-"}, "a-b"), ("${A}", {"A": "${B}", "B": "no"}, "${B}"), ("plain", {"A": "x"}, "plain")])
def test_substitute(spark, text, values, want):
    assert X.substitute(text, values) == want
    assert spark.createDataFrame([(text,)], "t string").select(X.substitute_vars(F.col("t"), values)).first()[0] == want


def test_hashes(spark):
    one = spark.range(1)
    b = lambda data: F.array(*[F.lit(x).cast("long") for x in data]) if data else F.array().cast("array<bigint>")
    want = {bytes(): 14695981039346656037, b"a": 12638187200555641996, bytes(range(1, 17)): 16712008635831575701, bytes(range(16, 0, -1)): 17238417441651937861, bytes(16): 9808874869469701221}
    for data, h in want.items():
        assert int(one.select(H.fnv1a(b(data))).first()[0]) == h == H.Bloom.fnv(data)
    assert [one.select(H.partition_of(b(d), 64)).first()[0] for d in list(want)[2:]] == [21, 5, 37]
    assert one.select(H.partition_of(b(b"a"), 0)).first()[0] == 0
    for ctx, h in ((("/home/user/project", 12345, 99, "zsh", "ops"), 4063486511700207614), (("/home/user", 0, 1, "bash", "testuser"), 11623893448884078365), (("/specific/path", 42, 7, "zsh", "ops"), 3189785188113215066), (("", 0, 0, "", ""), 9808874869469701221)):
        assert int(one.select(H.context_hash(*[F.lit(x) for x in ctx])).first()[0]) == h


def test_bloom():
    assert [(x.bits, x.hashes) for x in map(H.Bloom, (1, 5, 100, 10000))] == [(64, 45), (64, 9), (959, 7), (95851, 7)]
    f = H.Bloom(500)
    keys = [k.to_bytes(16, "little") for k in range(500)]
    for k in keys:
        f.insert(k)
    assert all(map(f.contains, keys))
    assert sum(f.contains(k.to_bytes(16, "little")) for k in range(10_000, 12_000)) < 60


def test_half_precision():
    x = np.array([0.0, -0.0, 1.0, -2.5, 65504.0, 1e6, -1e6, 1e-8, 0.1, float("inf"), float("nan")], "f4")
    back = V.from_half_bits(V.half_bits(x))
    assert back[:4].tolist() == [0.0, -0.0, 1.0, -2.5] and math.copysign(1, back[1]) == -1
    assert back[5] == np.inf and back[6] == -np.inf and back[7] == 0 and np.isnan(back[10])
    assert 0 < 0.1 - back[8] < 0.1 / 1024  # cut off, not rounded


def test_quantize(spark):
    df = spark.createDataFrame([([1.0, -0.5, 0.25],), ([0.0, 0.0, 0.0],)], "v array<double>")
    r = df.select(V.quantize_int8(F.col("v")).alias("q"), V.int8_scale(F.col("v")).alias("s")).collect()
    assert [list(x.q) for x in r] == [[127, -64, 32], [0, 0, 0]] and r[1].s == 1.0


# -- store, graph, mining


def intents(spark, rows):
    return spark.createDataFrame([(k, ts, c, s) for k, (c, ts, s) in enumerate(rows)], "id long, ts_ns long, raw_command string, status int")


def test_temporal(spark):
    df = spark.createDataFrame([(i, i * 100) for i in range(20)], "id long, ts_ns long")
    assert [r.ts_ns for r in store.temporal_range(df, 500, 1500).collect()] == list(range(500, 1500, 100))


def test_patterns_predict_summary(spark):
    cmds = ["git status", "git add .", "git commit"] * 3
    rows = intents(spark, [(c, k, 1) for k, c in enumerate(cmds, 1)])
    got = {tuple(r.commands): r["count"] for r in insight.patterns(rows, 2).collect()}
    assert got[("git status", "git add .", "git commit")] == 3 and got[("git status", "git add .")] == 3
    wide = intents(spark, [(c, k * insight.HOUR_NS, 1) for k, c in enumerate(cmds, 1)])  # one row in each bucket of time
    assert {tuple(r.commands): r["count"] for r in insight.patterns(wide, 2).collect()} == got
    for few in ([], [("x", 1, 1)]):
        assert insight.patterns(intents(spark, few), 1).count() == 0
    corpus = intents(spark, [(c, k, 1) for k, c in enumerate(["cd src", "cargo build", "cargo test"] * 2 + ["cd src", "cargo build"])])
    assert insight.predict_next(corpus, ["cd src", "cargo build"]).first().command == "cargo test"
    assert insight.predict_next(intents(spark, [("ls", 1, 1), ("pwd", 2, 1)]), ["git push"]).first() is None
    assert insight.predict_next(corpus, []).first() is None
    s = insight.summary(intents(spark, [("cargo build", 10**9, 1), ("cargo test", 2 * 10**9, 1), ("cargo build", 3 * 10**9, 2), ("cargo build", 4 * 10**9, 3)])).first()
    assert (s.total, s.succeeded, s.failed, s.pending, s.start_ns, s.end_ns) == (4, 3, 1, 0, 10**9, 4 * 10**9)
    assert tuple(s.top_commands[0]) == ("cargo build", 3) and "4 intents" in s.text and "75.0%" in s.text
    assert insight.summary(intents(spark, [])).first().text == "No intents to summarize."
    assert insight.summary(intents(spark, [("x", 1, None)])).first().pending == 1


def test_kmeans(spark):
    pts = [[0.1 * k, 0.0] for k in range(5)] + [[10.0 + 0.1 * k, 10.0] for k in range(5)]
    df = spark.createDataFrame(list(enumerate(pts)), "id long, v array<double>")
    a, c, steps, ok = insight.kmeans(df, [pts[0], pts[9]])
    assert ok and {r.cluster for r in a.where("id < 5").collect()} == {0} and {r.cluster for r in a.where("id >= 5").collect()} == {1}
    _, c, steps, ok = insight.kmeans(df, [pts[3]])
    assert ok and steps == 0 and list(c.first().v) == pts[3]
    for bad in ([], [[1.0]], [[1.0, 2.0]] * 11):
        with pytest.raises(DimensionMismatch):
            insight.kmeans(df, bad)


def edges(spark, pairs):
    return spark.createDataFrame([(a, b, 0, 1.0) for a, b in pairs], "from_id long, to_id long, relation int, weight double")


def nodes(spark, n):
    return spark.range(n).select(F.col("id").alias("node"))


def test_graph(spark):
    diamond = edges(spark, [(0, 1), (0, 2), (1, 3), (2, 3)])
    commands = spark.createDataFrame([(0, "a ${X}"), (1, "b")], "id long, command string")
    plan = graph.build_plan(nodes(spark, 4), diamond, commands)
    assert {r.intent_id: (r.level, r.command, list(r.deps)) for r in plan.collect()} == {0: (0, "a ${X}", []), 1: (1, "b", [0]), 2: (1, "", [0]), 3: (2, "", [1, 2])}
    with pytest.raises(CycleDetected):
        graph.topological_levels(nodes(spark, 2), edges(spark, [(0, 1), (1, 0)]))
    assert graph.build_plan(nodes(spark, 1), edges(spark, []), commands).count() == 1
    with pytest.raises(NodeNotFound):
        graph.replay(nodes(spark, 4), diamond, commands, 99, 1)
    assert [r.node for r in graph.bfs_forward(diamond, 99, 3).collect()] == [99]
    assert {r.node: r.depth for r in graph.bfs_backward(diamond, 3, 5).collect()} == {3: 0, 1: 1, 2: 1, 0: 2}
    assert graph.narrative_edges(diamond, 0, 1).count() == 2 and graph.narrative_edges(diamond, 0, 2).count() == 6
    done = spark.createDataFrame([(0,), (1,)], "id long")
    assert {r.intent_id for r in graph.filter_completed(plan, done).collect()} == {2, 3}
    ran = {r.intent_id: r for r in graph.execute(plan, done, {"X": "1"}, executor=lambda c: (1, len(c), 0)).collect()}
    assert ran[0].skipped and ran[0].outcome.latency_ns == 0 and ran[0].command == "a 1" and not ran[2].skipped and ran[3].outcome.status == 1
    assert {r.outcome.status for r in graph.execute(plan, done).collect() if not r.skipped} == {0}
    csr = graph.csr_offsets(nodes(spark, 4), edges(spark, [(0, 1), (0, 2), (2, 3)]), width=2)
    assert {r.node: (r.row_start, r.row_end) for r in csr.collect()} == {0: (0, 2), 1: (2, 2), 2: (2, 3), 3: (3, 3)}
    twice = edges(spark, [(0, 1), (0, 1)])
    assert {r.node: r.degree for r in graph.in_degree(nodes(spark, 2), twice).collect()} == {0: 0, 1: 2}


def test_knn_strategies(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(120)]
    rows += [(120, rows[3][1]), (121, rows[3][1])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    native = {tuple(r) for r in knn.knn_earlier(df, 5, "native").collect()}
    assert native == {tuple(r) for r in knn.knn_earlier(df, 5, "blocked").collect()} == {tuple(r) for r in knn.knn_earlier(df, 5, "blocked", block=25).collect()}
    assert len(native) == 10 + 5 * 117
    ivf = {tuple(r)[:2] for r in knn.knn_earlier(df, 5, "ivf", cells=8, probes=8).collect()}
    assert ivf == {e[:2] for e in native}
    part = {tuple(r) for r in knn.form_edges_incremental(df.where("id < 60"), df.where("id >= 60")).collect()}
    assert {(a, b) for a, b, *_ in part} == {(a, b) for a, b, _ in native if b >= 60}
    assert knn.search(df, [0.0] * 8, 3).count() == 3  # a zero query: ties in id order are settled by distance
    assert knn.search(df.limit(0), rows[0][1], 3).count() == 0


def test_store(spark, tmp_path):
    ctx = "struct<cwd:string,env_hash:decimal(20,0),session_id:decimal(20,0),shell:string,user:string>"
    from decimal import Decimal

    df = spark.createDataFrame([("a", 1, "cargo build", ("/", Decimal(0), Decimal(1), "sh", "u")), ("b", 2, "ls", ("/", Decimal(0), Decimal(1), "sh", "u"))], f"id string, ts_ns long, raw_command string, context {ctx}")
    s = store.IntentStore(spark, 384, str(tmp_path / "store"))
    assert s.get("a") is None and s.query_semantic([0.0] * 384, 3).count() == 0
    s.ingest(df)
    assert s.get("a").category == "Build" and s.get("zz") is None
    assert s.query_semantic(X.embed_numpy("cargo build").tolist(), 1).first().id == "a"
    with pytest.raises(DimensionMismatch):
        s.query_semantic([1.0], 1)
    with pytest.raises(DimensionMismatch):
        s.insert(store.extract(df).withColumn("embedding", F.array(F.lit(1.0).cast("float"))))
    with pytest.raises(ExtractionFailed):
        s.ingest(df.withColumn("raw_command", F.lit("  ")))
    out = spark.createDataFrame([("a", 1, 42_000, 0, 1), ("a", 2, 1, 1, 2)], "id string, status int, latency_ns long, exit_code int, seq long")
    assert s.attach_outcome(out).where("id = 'a'").first().outcome.status == 2
    with pytest.raises(NodeNotFound):
        s.attach_outcome(out.withColumn("id", F.lit("q")))


# -- sources


def test_wal(spark, tmp_path):
    entries = [(bytes([k] * 16), 1000 + k, [0.5, k], f"cmd é {k}") for k in range(5)] + [(bytes(16), 2**64 - 1, [], "")]
    data = b"".join(wal.encode_entry(*e) for e in entries)
    assert [(bytes.fromhex(i), t, v, c) for i, t, v, c in wal.decode_log(data + b"\1\0")] == entries  # a cut-off length ends the log
    with pytest.raises(SegmentCorrupted):
        list(wal.decode_log(data[:-3]))
    (tmp_path / "x.wal").write_bytes(data)
    got = wal.read_wal(spark, str(tmp_path / "x.wal")).collect()
    assert [r.raw_command for r in got] == [e[3] for e in entries] and int(got[5].ts_ns) == 2**64 - 1


def test_segment(spark, tmp_path):
    ns = [(bytes([i]) + bytes(14) + bytes([i * 7 % 256]), 1000 + 100 * i, 0xDEAD0000 + i, 0.5 + 0.125 * i, i % 3, [i / 2] * 8) for i in range(5)]
    es = [(0, 1, 0, 0.5), (0, 2, 1, 0.75), (3, 4, 2, 0.5)]
    data = segment.write_segment(ns, [*es, (9, 0, 0, 1.0)], 8)
    nodes_, edges_, bloom = segment.read_segment(data)
    assert nodes_ == ns and edges_ == es and all(bloom.contains(x[0]) for x in ns)
    assert segment.read_segment(segment.write_segment([], [], 4))[0] == []
    for bad in (b"XXXX" + data[4:], data[:64]):
        with pytest.raises(SegmentCorrupted):
            segment.read_segment(bad)
    (tmp_path / "s.seg").write_bytes(data)
    assert segment.read_segments(spark, str(tmp_path / "s.seg")).count() == 5


def test_workload(spark):
    for v in workload.VERTICALS:
        df = workload.generate(spark, v, 2000, seed=1)
        assert df.collect()[:3] == workload.generate(spark, v, 2000, seed=1).collect()[:3]
        ok = df.where("status = 1").count() / 2000
        assert abs(ok - workload.VERTICALS[v].success) < 0.04
        assert df.where("(status = 2) <> (exit_code > 0)").count() == 0
    assert workload.inject(df, "RetryStorm").count() == 10_000 and workload.inject(df, "ForcedFailure").where("exit_code <> 137").count() == 0


# -- cluster, metrics, cli


def test_cluster(spark):
    p = spark.createDataFrame([(0, 10, [11]), (1, 11, [10]), (2, 12, [])], "partition_id int, owner long, replicas array<long>")
    assert [sorted(r.partition_id for r in cluster.partitions_for(p, n).collect()) for n in (10, 12, 99)] == [[0, 1], [2], []]
    assert [r.owner for r in cluster.owner_of(p, 1).collect()] == [11] and cluster.owner_of(p, 99).count() == 0
    m = spark.createDataFrame([(1, "Alive", 1), (2, "Alive", 2), (2, "Dead", 5)], "node long, state string, version long")
    assert [r.node for r in cluster.alive(m).collect()] == [1]


def test_histogram(spark):
    df = spark.createDataFrame([(v,) for v in (5, 10, 11, 60_000)], "us long")
    h = metrics.histogram(df, "us")
    assert {r.le: r["count"] for r in h.collect()} == {10.0: 2, **{float(b): 3 for b in metrics.BOUNDS[1:]}, None: 4}
    assert metrics.histogram_quantile(h, 0.5).first().value == 10.0 and metrics.histogram_quantile(h, 0.99).first().value == 50000.0
    assert metrics.histogram_quantile(metrics.histogram(df.limit(0), "us"), 0.5).count() == 0
    line = metrics.exposition(spark.createDataFrame([("m", {"b": 'q"', "a": "1"}, 2.0), ("n", {}, 0.5)], "name string, labels map<string,string>, value double"))
    assert [r.line for r in line.collect()] == ['m{a="1",b="q\\""} 2', "n 0.5"]


def test_cli_parse():
    assert cli.parse(["ingest", "ls"]).text == "ls"
    assert cli.parse(["find", "q"]).number == 10 and cli.parse(["find", "q", "--k", "20"]).number == 20
    assert cli.parse(["replay", "u"]).number == 3 and cli.parse(["replay", "u", "--depth", "5", "--dry-run"]).dry_run
    assert cli.parse(["insights"]).number == 5 and cli.parse(["insights", "--clusters", "8"]).number == 8
    for bad in ([], ["what"], ["ingest"], ["find"], ["find", "q", "--k"], ["find", "q", "--k", "x"], ["find", "q", "--z"], ["replay"], ["insights", "--depth", "1"], ["status", "--x"]):
        with pytest.raises(cli.UsageError):
            cli.parse(bad)


def test_engine(spark, tmp_path):
    from intentdeck.engine import Engine

    e = Engine(spark, str(tmp_path / "engine"))
    assert "No results" in cli.run(e, cli.parse(["find", "x"])) and "No insights" in cli.run(e, cli.parse(["insights"]))
    ids = e.ingest_many([(f"cargo build --profile={i}", None) for i in range(7)], [1] * 7)
    ids.append(e.ingest("cargo build --profile=7"))
    assert e.status() == (8, 0 + 1 + 2 + 3 + 4 + 5 + 5 + 5, 8, 384)
    assert "  Nodes:    8\n" in cli.run(e, cli.parse(["status"]))
    assert len(e.find("cargo build", 3)) == 3
    assert len(e.replay(ids[0], 0)) == 1 and e.replay(ids[0], 2)[0][1] == ids[0]
    with pytest.raises(NodeNotFound):
        e.replay("00000000-0000-0000-0000-000000000000", 1)
    with pytest.raises(ExtractionFailed):
        e.ingest("  ")
    assert any(k == "summary" for k, _, _ in e.insights(2))
