"""WARC, url rules, vectors, components and the pipeline."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from pyspark.sql import functions as F

from intentdeck.llm import near_vectors, registry, url_filter, warc
from intentdeck.llm._common import hot_keys, join_spread
from intentdeck.llm._common import connected_components

SF = "/root/testdata/sf0.001"


# -- WARC


def test_warc_round_trip(spark):
    big, other = "x" * 1200 + "é", "y" * 1500
    rows = [(1, "http://a", big), (2, "http://b", big), (5, None, big), (3, "http://c\r\nWARC-Type: revisit", "small"), (4, "u", "small"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", other)]
    df = spark.createDataFrame([(i, u, h, "z", "s") for i, u, h in rows], "page_id long, url string, html string, payload string, sha256 string")
    archive = warc.write_archive(df)
    assert spark.read.parquet(archive.payloads).count() == 4  # each payload once
    records = warc.read_archive(spark, archive)
    got = collections.Counter(tuple(r) for r in warc.parse_records(records).collect())

    def row(i, h, kind, to):
        b = (h or "").encode()
        return (i, len(b), hashlib.sha1(b).hexdigest(), kind, to)

    want = [row(1, big, "revisit", "5"), row(2, big, "revisit", "5"), row(5, big, "response", None), row(3, "small", "response", None), row(4, "small", "response", None), row(6, None, "response", None), row(7, "", "response", None), row(8, other, "response", None), row(8, other, "response", None), row(None, other, "revisit", "8")]
    assert got == collections.Counter(want)
    exact = {r.id: bytes(r.record) for r in records.where("id = 3 or id = 5").collect()}
    assert exact[5].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and exact[5].endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n")
    assert b"%0D%0AWARC-Type: revisit" in exact[3]


def test_warc_damage_is_found(spark):
    df = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    archive = warc.write_archive(df)
    bad = spark.read.parquet(archive.payloads).selectExpr("sha256", "cast('changed' as binary) as payload")
    bad.write.parquet(archive.payloads + "-bad")
    with pytest.raises(Exception, match="digest"):
        warc.parse_records(warc.read_archive(spark, warc.Archive(archive.headers, archive.payloads + "-bad"))).collect()


def test_warc_hot_payload(spark):
    long, other = "x" * 2000, "y" * 1500
    rows = [(i, f"http://h/{i}", long if i % 3 == 0 else "" if i % 3 == 1 else f"{i}") for i in range(900)] + [(900, None, other), (901, "u", other), (None, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    archive = warc.write_archive(df)
    headers = spark.read.parquet(archive.headers)
    hot = hot_keys(headers.groupBy("sha256").agg(F.count("*").alias("records")), ["sha256"], headers.count())
    assert hot.count() == 2  # the long and the empty payload
    met = join_spread(headers, spark.read.parquet(archive.payloads), hot, ["id", "header"], "inner")
    assert met.count() == len(rows) and spark.read.parquet(archive.payloads).count() == 303
    got = {(r.id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.parse_records(warc.read_archive(spark, archive)).collect()}
    top = {long: 897, other: 901}
    want = {(i, len(b), "revisit" if b in top and i != top[b] else "response", str(top[b]) if b in top and i != top[b] else None) for i, _, b in rows}
    assert got == want


def test_warc_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.parse_records(warc.read_archive(spark, warc.write_archive(df))).count() == 0


# -- urls


def judged(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url) if url is not None else None
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
    path = m[2] if m else ""
    best = None
    for rule, verdict in url_filter.LISTED:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    if best:
        return host, path, *best
    words = re.split("[^a-z0-9]", host)
    return host, path, None, "block" if set(words) & set(url_filter.HOST_WORDS) else "allow"


URLS = [None, "", "no scheme", "://", "http://", "http://com/en/", "http://x.com/en/1", "HTTP://WWW.Example.COM/en/7", "http://example.com/en/70?x", "http://notexample.com/en/7", "http://a.example.net/de/8", "http://a.example.net/de/9#f", "http://org/es", "http://org/es/", "http://xcom/en/", "http://cheap-pills.example.com/fr/1", "https://spamfarm.com/x", "a://b://com/en/", "http://u@Casino.win:80/en/", "http://ÀB.com/en/\nx", "http://com?/en/", "http://com#/en/"]


@pytest.mark.parametrize("inline", [512, 0])
def test_url_rules(spark, inline):
    urls = URLS + URLS[:3] + [r["url"] for r in pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()]
    df = spark.createDataFrame([(i, u, "h", "v", "t") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string, tokens string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, inline_rules=inline).collect()}
    assert got == {i: judged(u) for i, u in enumerate(urls)}


def test_url_rules_of_the_contract(spark):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    df = spark.createDataFrame([(i, f"http://{rule}") for i, rule in enumerate(want)], "page_id long, url string")
    assert {r.rule: r.verdict for r in url_filter.filter_urls(df).collect()} == want == dict(url_filter.LISTED)


def test_url_no_rules_or_rows(spark):
    df = spark.createDataFrame([(1, "http://com/en/")], "page_id long, url string")
    assert url_filter.filter_urls(df, []).first().verdict == "allow"
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# -- vectors


def brute_vectors(rows):
    x = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x.setdefault(i, (np.array(v, float), label))
    ids = list(x)
    links, up = collections.Counter(), {i: i for i, _, _ in rows if i is not None}

    def top(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in ids:
        for b in ids:
            (p, lp), (q, lq) = x[a], x[b]
            if a < b and lp == lq and len(p) == len(q) and p @ q / (np.linalg.norm(p) * np.linalg.norm(q)) >= 0.93:
                links[a] += 1
                links[b] += 1
                m, n = sorted((top(a), top(b)))
                up[n] = m
    return {i: (links[i], top(i), top(i) == i) for i in up}


@pytest.mark.parametrize("block", [1024, 20])
def test_near_vectors_brute_force(spark, block):
    rng = np.random.default_rng(1)
    rows = []
    base = rng.normal(size=(40, 16))
    for i in range(300):
        v = base[i % 40] + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 0.35])
        rows.append((i, [float(c) for c in v.astype("f4")], int(i % 40) % 3))
    rows += [(400, None, 1), (401, [0.0] * 16, 1), (402, [float("nan")] + [1.0] * 15, 1), (403, [None] + [1.0] * 15, 1), (404, [float("inf")] + [1.0] * 15, 1), (405, rows[0][1], None), (406, [1.0, 2.0], 1), (407, [2.0, 4.0], 1), (408, [], 1), (409, [-0.0] + [1.0] * 15, 2), (410, [0.0] + [1.0] * 15, 2)]
    df = spark.createDataFrame([(i, v, lab, "c", 7) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, class string, copies int")
    got = {r[0]: tuple(r[1:]) for r in near_vectors.near_vectors(df, block=block).collect()}
    want = brute_vectors(rows)
    assert set(got) == set(want)
    total = sum(w[0] for w in want.values())
    assert sum(g[0] for g in got.values()) >= 0.98 * total  # recall; found links are exact
    assert all(got[i][0] <= want[i][0] for i in want)


def test_near_vectors_hot_copies(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    v = [base if i % 3 == 0 else base * 3 + rng.normal(size=16) * 0.01 if i % 3 == 1 else rng.normal(size=16) for i in range(900)]
    got = {r[0]: r[1:] for r in near_vectors.near_vectors(spark.createDataFrame([(i, x.tolist(), 1) for i, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    x = np.array(v)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.93).sum(axis=1) - 1
    assert links[0] >= 599 and all(got[i][0] == links[i] for i in range(900))
    assert all(got[i][1] == 0 for i in range(900) if i % 3 < 2)


def test_near_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert near_vectors.near_vectors(df).count() == 0
    one = spark.createDataFrame([(None, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(str, map(tuple, near_vectors.near_vectors(one).collect()))) == sorted(map(str, [(None, 0, None, None), (1, 0, 1, True)]))


def test_near_vectors_recall_on_clusters(spark, monkeypatch):
    """64 dimensions, 30 clusters, a partner for each vector just above the threshold, and more pivots than the rows alone would give."""
    monkeypatch.setattr(near_vectors, "LEAST_PIVOTS", 1500)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 64))[rng.integers(0, 30, 1500)] + 0.45 * rng.normal(size=(1500, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    off = rng.normal(size=x.shape)
    off -= (off * x).sum(axis=1, keepdims=True) * x
    y = 0.932 * x + np.sqrt(1 - 0.932**2) * off / np.linalg.norm(off, axis=1)[:, None]
    v = np.concatenate([x, y])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    want = (unit @ unit.T >= 0.93).sum() - len(v)
    got = near_vectors.near_vectors(spark.createDataFrame([(i, r.tolist(), 1) for i, r in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()
    assert want >= 3000 and 0.97 * want <= sum(r.n_links for r in got) <= want


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(100, 160)] + [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(5, 5), (None, 3)]
    up = {n: n for e in edges for n in e if n is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None:
            p, q = sorted((top(a), top(b)))
            up[q] = p
    linked = {n for a, b in edges if a is not None and a != b for n in (a, b)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in linked}


# -- the registry and the pipeline


def test_registry():
    assert sorted(registry.queries(), key=lambda n: int(n[2:].split("_")[0])) and len(registry.queries()) == 10
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_pipeline_loses_no_text(spark):
    """Repeated and null ids: a row goes only if its own text is a copy."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(60))
    rows = [(1, long), (2, long), (2, "other words entirely here"), (2, "other words entirely here"), (3, None), (None, long), (None, "lone words of no one else"), (4, ""), (5, long + " end")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _id string, copies int")
    got = corpus_pipeline.jaccard_stage(spark, df, SF)
    assert got.columns == df.columns
    assert {(r._id, r.copies) for r in got.collect()} == {("c", 1)}
    assert sorted((str(r.doc_id), r.text or "") for r in got.collect()) == sorted([("1", long), ("2", rows[2][1]), ("3", ""), ("None", rows[6][1]), ("4", "")])
    assert corpus_pipeline.jaccard_stage(spark, df.limit(0), SF).count() == 0


def test_pipeline_stages_odd_rows(spark):
    """Nulls, empty, repeated and clashing columns in every stage; an empty table stays one."""
    import corpus_pipeline

    key = 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    item = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()[0]["text"]
    rows = [(None, None), (1, None), (2, ""), (3, "plain words"), (3, "plain words"), (3, f"with {key} in it"), (None, f"it holds {item} whole"), (4, " \n"), (5, "x" * 30_000)]
    df = spark.createDataFrame([(i, t, None, None, None, "c", 0.5) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _cands string, score double")
    stage = dict(corpus_pipeline.STAGES)
    texts = lambda d: collections.Counter(str(r.text) for r in d.collect())
    all_ = texts(df)
    assert texts(stage["toxicity"](spark, df, SF)) == all_
    assert texts(stage["decontamination"](spark, df, SF)) == all_ - collections.Counter([rows[6][1]])
    got = stage["secrets"](spark, df, SF)
    assert texts(got) == all_ - collections.Counter([rows[5][1]]) + collections.Counter(['with token = "[SECRET]" in it'])
    assert {r.n_chars for r in got.where("text like 'with%'").collect()} == {len('with token = "[SECRET]" in it')}
    packed = stage["packing"](spark, df, SF).collect()
    assert sum(r.piece == 0 for r in packed) == len(rows)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, df.limit(0), SF)
        assert out.count() == 0 and (name == "packing" or out.columns == df.columns)


def test_pipeline_equals_its_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "jaccard", "decontamination", "secrets", "packing"]
    from tests.llm.test_text_operators import best_window, brute_jaccard
    from intentdeck.llm.decontamination import words_of

    stage = dict(corpus_pipeline.STAGES)
    rows = docs.collect()
    kept = stage["jaccard"](spark, docs, SF)
    assert kept.columns == docs.columns
    want = {r[0] for r in brute_jaccard([(r.doc_id, r.text) for r in rows]) if r[4]}
    assert {r.doc_id for r in kept.collect()} == want
    items = pq.read_table(f"{SF}/benchmark.parquet").to_pylist()
    clean = stage["decontamination"](spark, docs, SF)
    assert clean.columns == docs.columns
    left = {r.doc_id for r in clean.collect()}
    exact = {r.doc_id for r in rows for i in items if " ".join(words_of(i["text"])) in " ".join(words_of(r.text))}
    assert exact and not left & exact
    short, bad = [r for r in rows if len(r.text) < 2000], set()
    for r in short:
        have = set(words_of(r.text))
        for i in items:
            w = words_of(i["text"])
            if sum(x in have for x in w) >= 0.8 * len(w) and best_window(i["text"], r.text) <= int(0.2 * len(w)):
                bad.add(r.doc_id)
    gone = {r.doc_id for r in short} - left
    assert gone <= bad and len(gone) >= 0.97 * len(bad)
    assert stage["secrets"](spark, docs, SF).count() == len(rows)
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in out}
    assert ids and ids <= {r.doc_id for r in rows} and {"sequence_id", "offset"} <= set(out[0].asDict())
