"""Quality by importance resampling over hashed n-grams.

Two generative models over hashed word uni- and bigrams: of the target (documents labelled as good) and of the raw
text (all documents). A document's log weight is the log ratio of its likelihood under both; adding a Gumbel
variate to it and taking the k largest draws k documents without replacement in proportion to the weights. The k-th largest key is found
exactly by counting keys in ever narrower ranges, so nothing is sorted or gathered.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from intentdeck.llm._common import materialize, read_table

BUCKETS = 16_384
SMOOTH = 0.5
#: About the most ids of good documents that are broadcast at once; more take more passes over the documents.
TARGET_BLOCK = 500_000
#: Counting ranges of one round of the k-th key search, and the rows from which the rest is fetched and sorted.
RANGES, FETCH = 4096, 5000
TOKEN = re.compile(r"\w+|[^\w\s]+")


class NGramHasher:
    """Bucket numbers of a text's word unigrams and bigrams (punctuation runs are words too)."""

    def __init__(self, buckets: int = BUCKETS, remember: int = 150_000):
        self.buckets, self.remember, self.known = buckets, remember, {}

    def __call__(self, text: str | None):
        import numpy as np
        import xxhash

        known, found = self.known, TOKEN.findall((text or "").lower())
        if len(known) > self.remember:
            known.clear()
        try:
            h = np.fromiter(map(known.__getitem__, found), "u8", len(found))
        except KeyError:
            for w in found:
                if w not in known:
                    known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace"))
            h = np.fromiter(map(known.__getitem__, found), "u8", len(found))
        two = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        two ^= two >> np.uint64(33)
        n = np.uint64(self.buckets)
        return np.concatenate([h % n, (two * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(20)) % n]).astype("i8")


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, raw, target): n-gram counts over all rows of docs (text, is_target); at most a row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        hasher, raw, target = NGramHasher(buckets), np.zeros(buckets, "i8"), np.zeros(buckets, "i8")
        for b in batches:
            for t, good in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                c = np.bincount(hasher(t), minlength=buckets)
                raw += c
                if good:
                    target += c
        at = np.nonzero(raw)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    counted = docs.select("text", "is_target").mapInArrow(run, "bucket long, raw long, target long")
    return counted.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def block_counts(docs: DataFrame, good: DataFrame, blocks: int, buckets: int = BUCKETS) -> Iterator[DataFrame]:
    """bucket_counts() whose sum counts all rows of docs once, and as target all rows whose doc_id is in good (distinct), by a pass for each block of ids.

    A block is bounded and broadcast, so no text is shuffled to find its label. Only the first pass reads the texts of other documents.
    """
    docs = docs.select("doc_id", "text")
    for k in range(blocks):
        block = F.broadcast(good.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == k).select("doc_id", F.lit(True).alias("is_target")))
        counts = bucket_counts(docs.join(block, "doc_id", "inner" if k else "left"), buckets)
        yield counts.withColumn("raw", F.lit(0).cast("long")) if k else counts


def log_ratio(counts: Iterator[DataFrame], buckets: int = BUCKETS):
    """The log of target probability over raw probability of each bucket, smoothed, from the sum of the counts."""
    import numpy as np

    raw, target = np.full(buckets, SMOOTH), np.full(buckets, SMOOTH)
    for part in counts:
        for b, r, t in part.collect():  # at most a row per bucket
            raw[b] += r
            target[b] += t
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def gumbel(*cols, seed: int = 17):
    """A Gumbel variate fixed by the columns."""
    u = (F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def weigh(docs: DataFrame, ratio, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, log_weight) for every row over its whole text; a text without words weighs 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = NGramHasher(buckets)
        for b in batches:
            w = [float(ratio[hasher(t)].sum()) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, log_weight double")


def kth_largest(keys: DataFrame, k: int) -> float:
    """The k-th largest value of keys.key (1 <= k <= rows), exact, by counting."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while True:
        inside = keys.where(F.col("key").between(low, high))
        n = inside.count()
        if n <= FETCH or low == high:
            got = sorted((r[0] for r in inside.select("key").limit(FETCH + 1).collect()), reverse=True) if n <= FETCH else [low]
            return got[min(k - above, len(got)) - 1]
        width = (high - low) / RANGES
        if low + width == low or high - width == high:
            distinct = inside.groupBy("key").count().orderBy(F.desc("key")).limit(RANGES).collect()
            for v, c in distinct:
                if above + c >= k:
                    return v
                above += c
            high = distinct[-1][0]
            continue
        at = F.least(F.floor((F.col("key") - low) / width), F.lit(RANGES - 1)).cast("int").alias("at")
        counts = dict(inside.groupBy(at).agg(F.struct(F.count("*"), F.min("key"), F.max("key"))).collect())
        for b in sorted(counts, reverse=True):
            c, lo, hi = counts[b]
            if above + c >= k:
                low, high = lo, hi
                break
            above += c


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, seed: int = 17, target_block: int = TARGET_BLOCK) -> DataFrame:
    """(doc_id, log_weight, key) of the documents drawn: the k rows with the largest keys, and rows whose key equals the k-th.

    k is ``share`` of all rows, by default the share of labelled doc_ids that are good. The raw model counts all documents, the target
    model all good ones, by a pass over the documents for about each target_block of them. Labels that are null teach nothing; a doc_id with several labels is good if any is.
    Without good documents, or rows, nothing is drawn. Repeated rows have equal keys and are drawn or left together. Null doc_ids are drawn like any other.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("q"))
    known = materialize(known, "quality")
    labelled, targets = known.agg(F.count("*"), F.coalesce(F.sum("q"), F.lit(0))).first()
    share = share if share is not None else (targets / labelled if labelled else 0.0)
    n = docs.select("doc_id").count()
    counts = block_counts(docs, known.where("q = 1"), max(1, -(-targets // target_block)))
    scored = weigh(docs, log_ratio(counts)).withColumn("key", F.col("log_weight") + gumbel("doc_id", seed=seed))
    k = round(share * n)
    if not targets or k < 1:
        return scored.where(F.lit(False))
    scored = materialize(scored, "weights")
    return scored.where(F.col("key") >= kth_largest(scored, k))


def op10_quality_resampling(spark, sf_dir) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")).select("doc_id", "log_weight", "key")
