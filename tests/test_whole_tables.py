"""Queries over all rows of a table, where a subset of the ids would give the same answer on the given ones."""

from pyspark.sql import functions as F

from intentdeck.functions import hashing as H
from intentdeck.operators import store
from intentdeck.plans import catalog


def test_context_hash_of_every_event(spark, tmp_path):
    ids = [0, 7, 1999, 2000, 2001, 70_000, 2**40 + 3]
    rows = [(i, 3 * i + 1, t) for i, t in zip(ids, ["click", "view", "", "error", "ünï", "view", "purchase"], strict=True)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    want = {i: str(H.Bloom.fnv(t.encode() + i.to_bytes(8, "little") + u.to_bytes(8, "little") + b"bashops")) for i, u, t in rows}
    assert {r.id: r.hash for r in catalog.QUERIES["context_hash"](spark, str(tmp_path)).collect()} == want


def test_bloom_members_above_any_id(spark, tmp_path):
    ids = [*range(90_000, 110_000), 2**40, 2**40, 2**40 + 1, -4, None]
    spark.createDataFrame([(i, [0.0], "x") for i in ids], "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["bloom_member"](spark, str(tmp_path)).first()
    assert (got.probes, got.members, got.lost) == (20_005, 10_003, 0)


def test_bloom_filters_of_segments_reject_others(spark):
    got = store.segment_members(spark.range(40_000), F.col("id") % 2 == 0, per_segment=10_000)
    counts = {(r.member, r.may): r["count"] for r in got.groupBy("member", "may").count().collect()}
    assert counts[True, True] == 20_000 and 0 < counts[False, True] < 0.02 * 20_000
